"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.encode import encode_corpus
from voxloom.llm.leaks import RUN, leaked_items
from voxloom.llm.lookalike import consistent_forms
from voxloom.llm.overlap import cross_split_links, cross_split_pairs
from voxloom.llm.packing import pack
from voxloom.llm.personal import find_personal
from voxloom.llm.pieces import cut_pieces
from voxloom.llm.splits import speaker_places, speaker_splits
from voxloom.llm.terms import frequent_ngrams, marked_terms
from voxloom.operators.versions import current_version
from voxloom.session import read_table


def current_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_version(read_table(spark, d, "utt_text"), ["uttid"], keep=["text", *columns])


#: Proportions of the splits.
SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


def corpus_labels(spark: SparkSession, d: str) -> DataFrame:
    return current_texts(spark, d, "source", "lang").select("uttid", F.concat_ws("|", "source", "lang").alias("label"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every utterance: 80/10/10, stratified by corpus and language."""
    return speaker_splits(read_table(spark, d, "utt2spk"), corpus_labels(spark, d), SHARES).select("uttid", "split")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the speakers that were placed together, as one component in one split."""
    placed = speaker_places(read_table(spark, d, "utt2spk"), corpus_labels(spark, d), SHARES)
    a, b = placed.withColumnRenamed("speaker", "spk_a").alias("a"), placed.withColumnRenamed("speaker", "spk_b").alias("b")
    same = (F.col("a.component") == F.col("b.component")) & F.col("a.split").eqNullSafe(F.col("b.split"))
    return a.join(b, same & (F.col("spk_a") < F.col("spk_b"))).select("spk_a", "spk_b")


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """One row per component of speakers, with its split and number of speakers; pairs need not be listed for it."""
    placed = speaker_places(read_table(spark, d, "utt2spk"), corpus_labels(spark, d), SHARES)
    return placed.groupBy("component").agg(F.min("split").alias("split"), F.count("*").alias("n_speakers"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of each label, and the share of them that each split got."""
    labels = corpus_labels(spark, d)
    rows = p1_splits(spark, d).join(labels, "uttid", "left").withColumn("label", F.coalesce("label", F.lit("none")))
    share = [F.avg((F.col("split") == s).cast("int")).alias(s) for s in SHARES]
    return rows.groupBy("label").agg(F.count("*").alias("n"), *share)


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Numbered pieces of every utterance that has a current segment or text."""
    seg = current_version(read_table(spark, d, "segments"), ["uttid"], keep=["starttime", "endtime"])
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    seg = seg.select("uttid", ms("starttime").alias("start_ms"), ms("endtime").alias("end_ms"))
    return cut_pieces(seg.join(current_texts(spark, d), "uttid", "full"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("piece = 1").select("uttid")


def packed_options(spark: SparkSession, d: str) -> DataFrame:
    options = read_table(spark, d, "iterator_options").filter("batch_bins is not null").select(
        "opt_id", F.lower(F.trim("batch_type")).alias("batch_type"), F.col("batch_bins").alias("capacity"), F.array_distinct("shape_files").alias("files")
    )
    shapes = current_version(read_table(spark, d, "shape_file"), ["uttid", "filename"], keep=["shape"])
    usable = shapes.filter("size(shape) > 0 and shape[0] > 0")
    wanted = options.select("opt_id", "batch_type", "capacity", F.size("files").alias("n_files"), F.explode("files").alias("filename"))
    product = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    load = F.when(F.col("batch_type") == "numel", product).otherwise(F.element_at("shape", 1))
    # The options are a fixed table of a dozen rows; Spark broadcasts it by its size.
    loads = usable.join(wanted, "filename").groupBy("opt_id", "capacity", "batch_type", "n_files", "uttid").agg(F.sum(load).alias("load"), F.count("*").alias("n"))
    return loads.filter("n = n_files").select(F.col("opt_id").alias("bin_set"), "capacity", F.col("uttid").alias("item"), "load", "batch_type")


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """Mini-batches of every option that has a capacity."""
    packed = pack(packed_options(spark, d))
    return packed.select(F.col("bin_set").alias("opt_id"), F.col("container").alias("batch_id"), F.col("item").alias("uttid"), "part", "n_parts", F.col("part_load").alias("load"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = read_table(spark, d, "iterator_options").filter(F.lower(F.trim("batch_type")).isin("length", "numel")).select("opt_id")
    split = p5_batches(spark, d).filter("n_parts > 1 and part = 0")
    return split.join(kinds, "opt_id", "left_semi").select("opt_id", "uttid")


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """Batches, load and share of the capacity used, by option."""
    used = p5_batches(spark, d).groupBy("opt_id").agg(F.sum("load").alias("load"), F.countDistinct("batch_id").alias("n_batches"), F.count("*").alias("n_items"))
    options = read_table(spark, d, "iterator_options").select("opt_id", "batch_bins")
    return used.join(options, "opt_id").select("opt_id", "n_batches", "n_items", (F.col("load") / (F.col("batch_bins") * F.col("n_batches"))).alias("fill"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(current_texts(spark, d), "text").select("term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).filter("mark is not null").select("term", "mark")


def p4_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Word pairs by the same suffix arrays."""
    return marked_terms(current_texts(spark, d), "text", max_n=2).filter("n = 2").select("term", "occurrences", "records")


#: Longest n-grams of p4_ngrams, and their least number of occurrences.
MOST_WORDS, LEAST_OCCURRENCES = 6, 20


def p4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Recurring passages: all n-grams of one to six terms that occur at least so often."""
    return frequent_ngrams(current_texts(spark, d), "text", MOST_WORDS, LEAST_OCCURRENCES)


#: The dsets of evaluation and of training utterances.
EVALUATION, TRAINING = ("valid", "test", "test_other"), ("train", "train_sp")


def sided_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = current_texts(spark, d, "dset", "source", "lang")
    side = F.when(F.col("dset").isin(*EVALUATION), True).when(F.col("dset").isin(*TRAINING), False)
    return texts.withColumn("is_eval", side)


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation and training utterances with the same or nearly the same text."""
    return cross_split_pairs(sided_texts(spark, d), "uttid", "text", "lang", "is_eval", keep=["dset", "source"])


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per utterance: its class of equal texts, and how many utterances of the other side are near it."""
    return cross_split_links(sided_texts(spark, d), "uttid", "text", "lang", "is_eval", keep=["dset", "source"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select(F.least("eval_key", "train_key").alias("uttid_a"), F.greatest("eval_key", "train_key").alias("uttid_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs, and evaluation utterances with any, by dset and source; counted without listing pairs."""
    linked = p6_links(spark, d).filter("is_eval and n_links > 0")
    return linked.groupBy("dset", "source").agg(F.sum("n_links").alias("n_pairs"), F.count("*").alias("n_utts"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_forms(current_texts(spark, d, "lang"), "uttid", "text", "lang").select("uttid", "form")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    forms = consistent_forms(current_texts(spark, d, "lang"), "uttid", "text", "lang")
    return forms.filter("form <> text").select("uttid")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read_table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and held-out items that share an n-gram of words, with their alignment."""
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "heldout_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders in the place of personal information."""
    return find_personal(read_table(spark, d, "documents"), read_table(spark, d, "name_lexicon"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_redacted(spark, d).select("doc_id", F.explode("kinds").alias("kind"))


_CURRENT_TEXT = """
WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn
                 FROM utt_text WHERE uttid IS NOT NULL) WHERE rn = 1)"""
_TERMS = _CURRENT_TEXT + r""",
pieces AS (SELECT uttid, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM cur WHERE text IS NOT NULL),
occ AS (SELECT uttid, unnest(w) AS term FROM pieces),
total AS (SELECT count(*) AS n FROM pieces WHERE len(w) > 0),
counts AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT uttid) AS records,
         CASE WHEN count(DISTINCT uttid) < 3 THEN 'rare' WHEN count(DISTINCT uttid) * 8 > (SELECT n FROM total) THEN 'common' END AS mark
  FROM occ GROUP BY term)
"""

QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_components": p1_components, "p1_shares": p1_shares, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p5_batches": p5_batches, "p5_fill": p5_fill, "p4_found": p4_found, "p4_terms": p4_terms, "p4_bigrams": p4_bigrams, "p4_ngrams": p4_ngrams, "p6_found": p6_found, "p6_pairs": p6_pairs, "p6_links": p6_links, "p6_report": p6_report, "p7_found": p7_found, "p7_forms": p7_forms, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLE: dict[str, str] = {
    "p1_found": r"""
WITH RECURSIVE named AS (
  SELECT DISTINCT uttid, lower(trim(spkid, E' \t\r\n')) AS s FROM utt2spk WHERE lower(trim(spkid, E' \t\r\n')) NOT IN ('', '<na>', 'unk')),
edges AS (
  SELECT a.s AS x, b.s AS y FROM named a JOIN named b ON a.uttid = b.uttid AND a.s <> b.s
  UNION SELECT s, 'base:' || regexp_replace(s, '^(sp[0-9]+(\.[0-9]+)?-)+', '') FROM named
  UNION SELECT 'base:' || regexp_replace(s, '^(sp[0-9]+(\.[0-9]+)?-)+', ''), s FROM named),
reach AS (SELECT DISTINCT s AS f, s AS t FROM named UNION SELECT reach.f, edges.y FROM reach JOIN edges ON reach.t = edges.x)
SELECT f AS spk_a, t AS spk_b FROM reach WHERE f < t AND t NOT LIKE 'base:%'""",
    "p2_found": _CURRENT_TEXT + """,
seg AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, starttime DESC NULLS LAST, endtime DESC NULLS LAST) AS rn
                 FROM segments WHERE uttid IS NOT NULL) WHERE rn = 1)
SELECT uttid FROM cur WHERE length(text) > 400
UNION SELECT uttid FROM seg WHERE CAST(round(endtime * 1000) AS BIGINT) - CAST(round(starttime * 1000) AS BIGINT) > 30000""",
    "p5_found": """
WITH shp AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uttid, filename ORDER BY loaded_at DESC NULLS LAST, shape DESC NULLS LAST) AS rn
                 FROM shape_file WHERE uttid IS NOT NULL AND filename IS NOT NULL) WHERE rn = 1),
opt AS (
  SELECT opt_id, lower(trim(batch_type)) AS kind, batch_bins, len(list_distinct(shape_files)) AS n, unnest(list_distinct(shape_files)) AS filename
  FROM iterator_options WHERE batch_bins IS NOT NULL AND lower(trim(batch_type)) IN ('length', 'numel'))
SELECT opt_id, uttid FROM opt JOIN shp USING (filename) WHERE len(shape) > 0 AND shape[1] > 0
GROUP BY opt_id, uttid, batch_bins, n
HAVING count(*) = n AND sum(CASE WHEN kind = 'numel' THEN list_aggregate(shape, 'product') ELSE shape[1] END) > batch_bins""",
    "p4_found": _TERMS + "SELECT term, mark FROM counts WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + "SELECT term, occurrences, records, mark FROM counts",
    "p4_ngrams": _TERMS
    + """, sizes AS (SELECT unnest(range(1, 7)) AS n),
grams AS (SELECT uttid, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS term FROM pieces, sizes WHERE len(w) >= n)
SELECT CAST(n AS INTEGER) AS n, term, count(*) AS occurrences, count(DISTINCT uttid) AS records FROM grams GROUP BY n, term HAVING count(*) >= 20""",
    "p4_bigrams": _TERMS + """, pairs AS (SELECT uttid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM pieces WHERE len(w) > 1)
SELECT term, count(*) AS occurrences, count(DISTINCT uttid) AS records FROM pairs GROUP BY term""",
}
