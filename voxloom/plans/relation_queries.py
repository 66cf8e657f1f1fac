"""Queries on joins, set operations, filters, limits and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import relations as R
from voxloom.operators import splitting as S
from voxloom.operators.ordering import global_index, seeded_order
from voxloom.operators.versions import current_version
from voxloom.session import read_table

TRAIN_SHAPES = "exp/asr_stats_raw/train/speech_shape"
CHAR_SHAPES = "exp/asr_stats_raw/train/text_shape.char"


def texts(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return current_version(read_table(s, d, "utt_text"), ["uttid"], keep=["text", *cols])


def speakers(s: SparkSession, d: str) -> DataFrame:
    """One speaker per utterance: the least named one."""
    name = F.lower(F.trim("spkid"))
    return read_table(s, d, "utt2spk").filter("uttid is not null").select("uttid", name.alias("spk")).filter("spk not in ('', '<na>', 'unk')").groupBy("uttid").agg(F.min("spk").alias("spk"))


def segments(s: SparkSession, d: str) -> DataFrame:
    return current_version(read_table(s, d, "segments"), ["uttid"], keep=["recid", "starttime", "endtime"])


def shapes(s: SparkSession, d: str, file: str) -> DataFrame:
    rows = read_table(s, d, "shape_file").filter(F.col("filename") == file)
    return current_version(rows, ["uttid"], keep=["shape"]).select("uttid", "shape")


TEXTS = "txt AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM utt_text WHERE uttid IS NOT NULL) WHERE rn = 1)"
SPEAKERS = "spk AS (SELECT uttid, min(lower(trim(spkid))) AS spk FROM utt2spk WHERE uttid IS NOT NULL AND lower(trim(spkid)) NOT IN ('', '<na>', 'unk') GROUP BY uttid)"
SEGMENTS = "seg AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, recid DESC NULLS LAST, starttime DESC NULLS LAST, endtime DESC NULLS LAST) AS rn FROM segments WHERE uttid IS NOT NULL) WHERE rn = 1)"


def shape_sql(name: str, file: str) -> str:
    return f"{name} AS (SELECT uttid, shape FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, shape DESC NULLS LAST) AS rn FROM shape_file WHERE uttid IS NOT NULL AND filename = '{file}') WHERE rn = 1)"


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# Joins


@query(f"WITH {TEXTS}, {SPEAKERS}, {SEGMENTS} SELECT uttid, text, spk, recid, starttime, endtime FROM txt JOIN spk USING (uttid) JOIN seg USING (uttid)")
def strict_key_join(s, d):
    """Aligned relations by key, restricted to the keys that all hold."""
    seg = segments(s, d).drop("loaded_at")
    return R.strict_join([texts(s, d).drop("loaded_at"), speakers(s, d), seg], "uttid", check=False)


@query(f"WITH {TEXTS}, {SPEAKERS}, {SEGMENTS}, k AS (SELECT uttid, 1 AS a, 0 AS b, 0 AS c FROM txt UNION ALL SELECT uttid, 0, 1, 0 FROM spk UNION ALL SELECT uttid, 0, 0, 1 FROM seg) SELECT uttid, CAST(sum(a) AS BIGINT) AS n_1, CAST(sum(b) AS BIGINT) AS n_2, CAST(sum(c) AS BIGINT) AS n_3 FROM k GROUP BY uttid HAVING sum(a) <> sum(b) OR sum(a) <> sum(c)")
def uneven_keys(s, d):
    """J1, S16 in strict mode: the keys at which the check of an aligned join fails."""
    return R.uneven_keys([texts(s, d), speakers(s, d), segments(s, d)], "uttid")


@query(f"WITH {TEXTS}, {SPEAKERS} SELECT uttid, text, spk FROM txt JOIN spk USING (uttid)")
def keyed_subset_join(s, d):
    """J1 with a key list: the keys that both hold, checked to be complete."""
    t, p = texts(s, d).drop("loaded_at"), speakers(s, d)
    return R.strict_join([t, p], "uttid", keys=t.select("uttid").intersect(p.select("uttid")))


@query(f"WITH {TEXTS}, {SPEAKERS} SELECT uttid, text, coalesce(spk, '?') AS spk FROM txt LEFT JOIN spk USING (uttid)")
def total_lookup_join(s, d):
    """Left-driven lookup that must be total."""
    t = texts(s, d).drop("loaded_at")
    filled = t.select("uttid").join(speakers(s, d), "uttid", "left").select("uttid", F.coalesce("spk", F.lit("?")).alias("spk"))
    return R.lookup_join(t, [filled], "uttid")


@query(
    f"WITH {shape_sql('a', TRAIN_SHAPES)}, {shape_sql('b', CHAR_SHAPES)}, {TEXTS} SELECT uttid, a.shape AS ilen_shape, b.shape AS olen_shape, coalesce(text, 'none') AS text, lang FROM a JOIN b USING (uttid) JOIN txt USING (uttid)"
)
def merge_scp_fields(s, d):
    """Fields of several relations on the common keys, the later winning where it has a value."""
    a = shapes(s, d, TRAIN_SHAPES).select("uttid", F.col("shape").alias("ilen_shape"), F.lit("none").alias("text"))
    b = shapes(s, d, CHAR_SHAPES).select("uttid", F.col("shape").alias("olen_shape"))
    return R.merge_fields([a, b, texts(s, d, "lang").drop("loaded_at")], "uttid").select("uttid", "ilen_shape", "olen_shape", "text", "lang")


@query(f"WITH {shape_sql('a', TRAIN_SHAPES)}, {shape_sql('b', CHAR_SHAPES)} SELECT uttid, 'input1' AS name, a.shape FROM a JOIN b USING (uttid) UNION ALL SELECT uttid, 'input2' AS name, b.shape FROM a JOIN b USING (uttid)")
def add_second_input(s, d):
    """Further input of an utterance on the intersection."""
    a = shapes(s, d, TRAIN_SHAPES).select("uttid", F.array(F.struct(F.lit("input1").alias("name"), "shape")).alias("input"))
    b = shapes(s, d, CHAR_SHAPES).select("uttid", F.array(F.struct(F.lit("input2").alias("name"), "shape")).alias("more"))
    return a.join(b, "uttid").select("uttid", F.inline(F.concat("input", "more")))


@query("SELECT uttid FROM utt_text WHERE uttid IS NOT NULL INTERSECT SELECT uttid FROM segments")
def key_intersection(s, d):
    """J6, U4."""
    return read_table(s, d, "utt_text").select("uttid").filter("uttid is not null").intersect(read_table(s, d, "segments").select("uttid"))


@query(f"WITH {SEGMENTS} SELECT uttid, recid, starttime, endtime FROM seg WHERE uttid IN (SELECT uttid FROM utt_text WHERE lang = 'de')")
def restrict_by_keys(s, d):
    """Semi join by a key list."""
    return R.restrict(segments(s, d).drop("loaded_at"), read_table(s, d, "utt_text").filter("lang = 'de'"), "uttid")


@query(f"WITH {SEGMENTS} SELECT recid, path, fs, n_samples FROM wav_scp WHERE recid IN (SELECT recid FROM seg WHERE uttid IN (SELECT uttid FROM utt_text WHERE dset = 'test'))")
def recordings_of_utterances(s, d):
    """Two hops, utterances to segments to recordings."""
    return R.restrict_two_hops(read_table(s, d, "utt_text").filter("dset = 'test'"), segments(s, d), read_table(s, d, "wav_scp"), "uttid", "recid")


@query(f"WITH {SPEAKERS}, {TEXTS} SELECT uttid, spk FROM spk WHERE spk NOT IN (SELECT spk FROM spk JOIN txt USING (uttid) WHERE dset = 'test')")
def exclude_speakers(s, d):
    """Anti join on speakers."""
    spk = speakers(s, d)
    test = spk.join(texts(s, d, "dset").filter("dset = 'test'"), "uttid").select("spk").distinct()
    return R.exclude(spk, test, "spk").select("uttid", "spk")


@query(f"WITH {SPEAKERS}, ids AS (SELECT spk, row_number() OVER (ORDER BY spk) AS sid FROM (SELECT DISTINCT spk FROM spk)), {TEXTS} SELECT uttid, coalesce(sid, 0) AS sid FROM txt LEFT JOIN spk USING (uttid) LEFT JOIN ids USING (spk)")
def speaker_ids(s, d):
    """Dimension lookup with a default."""
    spk = speakers(s, d)
    ids = global_index(spk.select("spk").distinct(), ["spk"]).select("spk", (F.col("ordinal") + 1).alias("sid"))
    t = texts(s, d).select("uttid").join(spk, "uttid", "left")
    return R.default_join(t, ids, "spk", "sid", 0).select("uttid", "sid")


@query(
    f"WITH {TEXTS} SELECT a.uttid AS source, b.uttid AS target, a.text AS source_text, b.text AS target_text FROM txt a JOIN txt b ON regexp_replace(a.uttid, '^sp[0-9.]+-', '') = b.uttid WHERE a.uttid <> b.uttid"
)
def perturbed_pairs(s, d):
    """Pairs by a key derived from the other's key."""
    t = texts(s, d)
    a = t.select(F.col("uttid").alias("source"), F.col("text").alias("source_text"), F.regexp_replace("uttid", r"^sp[0-9.]+-", "").alias("target"))
    b = t.select(F.col("uttid").alias("target"), F.col("text").alias("target_text"))
    return a.join(b, "target").filter("source <> target").select("source", "target", "source_text", "target_text")


@query(f"WITH {SEGMENTS} SELECT uttid, recid, path, starttime, endtime FROM seg JOIN wav_scp USING (recid)")
def segments_with_audio(s, d):
    """Equi-join on a key that is not the first column."""
    return segments(s, d).join(read_table(s, d, "wav_scp"), "recid").select("uttid", "recid", "path", "starttime", "endtime")


@query("SELECT a.recid, b.path FROM wav_scp a JOIN wav_scp b ON contains(b.path, a.recid)")
def generated_truth_pairs(s, d):
    """Substring theta join, by shared n-grams instead of all pairs."""
    w = read_table(s, d, "wav_scp")
    return R.contains_join(w.select("recid"), w.select("path"), "recid", "path").select("recid", "path")


@query(
    f"WITH {SEGMENTS}, ok AS (SELECT * FROM seg WHERE recid IS NOT NULL AND endtime > starttime), mid AS (SELECT uttid AS point_utt, recid, (starttime + endtime) / 2 AS mid_s FROM ok) SELECT point_utt, ok.uttid AS within_utt FROM mid JOIN ok ON mid.recid = ok.recid AND mid_s >= starttime AND mid_s < endtime WHERE point_utt <> ok.uttid"
)
def interval_slice_join(s, d):
    """Points within intervals of the same recording, by bins of time."""
    ok = segments(s, d).filter("recid is not null and endtime > starttime")
    points = ok.select(F.col("uttid").alias("point_utt"), "recid", ((F.col("starttime") + F.col("endtime")) / 2).alias("at"))
    ivs = ok.select(F.col("uttid").alias("within_utt"), "recid", "starttime", "endtime")
    return R.interval_join(points, ivs, "recid", "at", "starttime", "endtime", 10.0).filter("point_utt <> within_utt").select("point_utt", "within_utt")


@query(
    f"WITH {SPEAKERS}, o AS (SELECT uttid, spk, row_number() OVER (ORDER BY md5(uttid || '|7'), uttid) - 1 AS i, count(*) OVER () AS n FROM spk), p AS (SELECT a.uttid, a.spk, k, b.uttid AS other FROM o a, unnest(range(1, 11)) t(k) JOIN o b ON b.i = (a.i + k) % a.n WHERE a.spk <> b.spk) SELECT uttid, arg_min(other, k) AS other FROM p GROUP BY uttid"
)
def mixing_partner(s, d):
    """A pseudo-random utterance of another speaker, of ten tries; none if all are the same speaker's."""
    o = global_index(speakers(s, d), seeded_order("uttid", 7))
    n = o.agg(F.count("*").alias("n"))
    tries = o.crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("uttid", "spk", "k", ((F.col("ordinal") + F.col("k")) % F.col("n")).alias("ordinal"))
    b = o.select("ordinal", F.col("uttid").alias("other"), F.col("spk").alias("other_spk"))
    return tries.join(b, "ordinal").filter("spk <> other_spk").groupBy("uttid").agg(F.min_by("other", "k").alias("other"))


@query(
    f"WITH {SPEAKERS}, o AS (SELECT uttid, spk, row_number() OVER (PARTITION BY spk ORDER BY md5(uttid || '|3'), uttid) - 1 AS i, count(*) OVER (PARTITION BY spk) AS n FROM spk) SELECT a.uttid, b.uttid AS enrolment FROM o a JOIN o b ON a.spk = b.spk AND b.i = (a.i + 1) % a.n WHERE a.n > 1"
)
def enrolment_utterance(s, d):
    """Another utterance of the same speaker; speakers with one utterance have none.

    The next in a global order by (speaker, hash), so a hot speaker is not one task.
    """
    o = global_index(speakers(s, d), [F.col("spk"), *seeded_order("uttid", 3)])
    spans = o.groupBy("spk").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).filter("n > 1")
    nxt = o.join(spans, "spk").select("uttid", (F.col("first") + (F.col("ordinal") - F.col("first") + 1) % F.col("n")).alias("ordinal"))
    return nxt.join(o.select("ordinal", F.col("uttid").alias("enrolment")), "ordinal").select("uttid", "enrolment")


@query("SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def two_column_join(s, d):
    """Plain joins on value columns."""
    o, c, n = (read_table(s, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_custkey", "n_name")


# Set operations


@query(f"WITH {TEXTS} SELECT uttid, text, src FROM (SELECT uttid, text, 'new' AS src FROM txt UNION ALL SELECT uttid, any_value(NULL) AS text, 'old' AS src FROM utt_text WHERE uttid IS NOT NULL AND uttid NOT IN (SELECT uttid FROM txt) GROUP BY uttid)")
def concat_last_wins(s, d):
    """Keyed union, the last writer wins."""
    old = read_table(s, d, "utt_text").filter("uttid is not null").select("uttid", F.lit(None).cast("string").alias("text"), F.lit("old").alias("src")).distinct()
    new = texts(s, d).select("uttid", "text", F.lit("new").alias("src"))
    return R.last_writer_union([old, new], "uttid")


@query("SELECT recid AS key, path FROM wav_scp UNION ALL SELECT recid || '.1' AS key, path FROM wav_scp WHERE fs = 8000")
def concat_multi_reference(s, d):
    """Union that keeps all rows under suffixed keys."""
    w = read_table(s, d, "wav_scp").select(F.col("recid").alias("key"), "path", "fs")
    return R.suffixed_union([w, w.filter("fs = 8000")], "key").select("key", "path")


@query("SELECT uttid, text, NULL AS spkid FROM utt_text UNION ALL SELECT uttid, NULL AS text, spkid FROM utt2spk")
def combine_relations(s, d):
    """Union of relations with missing columns."""
    return R.combine([read_table(s, d, "utt_text").select("uttid", "text"), read_table(s, d, "utt2spk").select("uttid", "spkid")])


@query("(SELECT uttid FROM utt_text EXCEPT ALL SELECT uttid FROM segments) UNION ALL (SELECT uttid FROM segments EXCEPT ALL SELECT uttid FROM utt_text)")
def key_symmetric_difference(s, d):
    """Rows of either relation but not both."""
    return R.symmetric_difference(read_table(s, d, "utt_text").select("uttid"), read_table(s, d, "segments").select("uttid"))


@query("SELECT uttid, spkid, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at, spkid) AS rn FROM utt2spk WHERE uttid IS NOT NULL) WHERE rn = 1")
def dedup_keep_first(s, d):
    """The first row of each key."""
    return R.first_per_key(read_table(s, d, "utt2spk").filter("uttid is not null"), "uttid", ["loaded_at", F.col("spkid").asc_nulls_last()])


@query("SELECT DISTINCT source, lang FROM utt_text")
def sorted_distinct(s, d):
    """U7."""
    return read_table(s, d, "utt_text").select("source", "lang").distinct().orderBy("source", "lang")


@query(f"WITH {TEXTS} SELECT uttid, text FROM (SELECT uttid, text, row_number() OVER (PARTITION BY text ORDER BY uttid) AS rn FROM txt WHERE text IS NOT NULL) WHERE rn <= 3")
def cap_repeated_texts(s, d):
    """U8: at most three utterances of a transcript."""
    return R.cap_repeats(texts(s, d).filter("text is not null").select("uttid", "text"), "text", 3, ["uttid"])


# Projections and filters


@query(f"WITH {TEXTS} SELECT uttid, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')[2:4], ' ') AS fields FROM txt WHERE text IS NOT NULL")
def field_slice(s, d):
    """Fields 2 to 4 of a line, 1-based."""
    from voxloom.functions.text import field_slice as cut

    return texts(s, d).filter("text is not null").select("uttid", cut(F.col("text"), 2, 4).alias("fields"))


@query("SELECT 'sp0.9-' || uttid AS uttid, 'sp0.9-' || recid AS recid, printf('%.2f', starttime / 0.9) AS starttime, printf('%.2f', endtime / 0.9) AS endtime FROM segments WHERE endtime / 0.9 > starttime / 0.9 + 0.01")
def speed_perturbed_segments(s, d):
    """Prefixed keys, rescaled intervals that stay valid."""
    from voxloom.operators.intervals import rescale

    return rescale(read_table(s, d, "segments"), 0.9, keys=["uttid", "recid"]).select("uttid", "recid", "starttime", "endtime")


@query(f"WITH {shape_sql('a', TRAIN_SHAPES)}, {TEXTS} SELECT uttid, shape[1] AS n FROM a JOIN txt USING (uttid) WHERE shape[1] > 100 AND shape[1] < 1000 AND trim(text) <> ''")
def length_and_text_filter(s, d):
    """Strict length bounds, no empty texts."""
    n = F.element_at(F.when(F.size("shape") > 0, F.col("shape")), 1)
    a = shapes(s, d, TRAIN_SHAPES).select("uttid", n.alias("n")).filter("n > 100 and n < 1000")
    return a.join(texts(s, d).filter("trim(text) <> ''"), "uttid").select("uttid", "n")


@query(f"WITH {TEXTS} SELECT uttid || '-lm' || CASE WHEN dset = 'train' THEN '1' ELSE '2' END AS uttid, text FROM txt WHERE text <> ''")
def language_model_text(s, d):
    """Suffixed keys, then union."""
    t = texts(s, d, "dset").filter("text <> ''")
    parts = [t.filter(c).select(F.concat("uttid", F.lit(f"-lm{i}")).alias("uttid"), "text") for i, c in ((1, "dset = 'train'"), (2, "not dset <=> 'train'"))]
    return R.combine(parts)


@query(f"WITH {shape_sql('a', CHAR_SHAPES)} SELECT uttid, list_append(shape, 48) AS shape FROM a WHERE len(shape) > 0")
def shape_with_vocabulary(s, d):
    """The vocabulary size appended to shapes."""
    return shapes(s, d, CHAR_SHAPES).filter("size(shape) > 0").select("uttid", F.array_append("shape", F.lit(48).cast("bigint")).alias("shape"))


@query("SELECT vec_id, embedding[4] AS channel FROM embeddings")
def select_channel(s, d):
    """One fixed channel."""
    return read_table(s, d, "embeddings").select("vec_id", F.element_at("embedding", 4).alias("channel"))


@query("SELECT uttid, split_part(uttid, '-', -1) AS last_part FROM utt_text WHERE uttid IS NOT NULL")
def key_suffix(s, d):
    """P10: the last part of a key."""
    return read_table(s, d, "utt_text").filter("uttid is not null").select("uttid", F.element_at(F.split("uttid", "-"), -1).alias("last_part"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, CAST(l_discount AS FLOAT) AS discount FROM lineitem")
def coerced_columns(s, d):
    """Required columns and coercion by kind."""
    rows = R.check_columns(read_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_discount").cast("float").alias("discount"))


@query(f"WITH {TEXTS} SELECT coalesce(lang, '') AS lang, count(*) AS n, count(text) AS n_texts FROM txt GROUP BY 1")
def divide_by_language(s, d):
    """The sets that a division by language gives."""
    return texts(s, d, "lang").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.count("text").alias("n_texts"))


# Orders, limits, samples, splits


@query(f"WITH {shape_sql('a', TRAIN_SHAPES)} SELECT uttid, shape[1] AS n, row_number() OVER (ORDER BY shape[1] DESC, uttid) - 1 AS ordinal FROM a WHERE len(shape) > 0")
def sort_by_length(s, d):
    """L1: stable order by length, as positions."""
    a = shapes(s, d, TRAIN_SHAPES).filter("size(shape) > 0").select("uttid", F.element_at("shape", 1).alias("n"))
    return global_index(a, [F.desc("n"), F.col("uttid")])


@query("(SELECT 'first' AS part, recid FROM wav_scp ORDER BY recid LIMIT 20) UNION ALL (SELECT 'last' AS part, recid FROM wav_scp ORDER BY recid DESC LIMIT 20)")
def first_and_last(s, d):
    """L2: subsets from both ends."""
    w = read_table(s, d, "wav_scp").select("recid")
    return S.first_rows(w, 20, ["recid"]).select(F.lit("first").alias("part"), "recid").union(S.last_rows(w, 20, ["recid"]).select(F.lit("last").alias("part"), "recid"))


@query("SELECT recid, (row_number() OVER (ORDER BY recid) - 1) % 7 AS split FROM wav_scp")
def round_robin_split(s, d):
    """L6, L8."""
    return S.round_robin(read_table(s, d, "wav_scp").select("recid"), 7, ["recid"]).select("recid", "split")


@query("SELECT doc_id, ntile(9) OVER (ORDER BY doc_id) - 1 AS split FROM documents")
def ntile_split(s, d):
    """Contiguous splits, the larger ones first."""
    return S.contiguous(read_table(s, d, "documents").select("doc_id"), 9, ["doc_id"]).select("doc_id", "split")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|' || 15), doc_id) - 1 AS ordinal FROM documents")
def epoch_shuffle(s, d):
    """The order of epoch 5 with seed 10."""
    return S.shuffled(read_table(s, d, "documents").select("doc_id"), "doc_id", 10, 5)


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT doc_id, n, (i - (300 * 4) % n + n) % n AS first FROM o) SELECT doc_id, unnest(range(first, 300, n)) AS place FROM p WHERE first < 300")
def epoch_window(s, d):
    """The fifth short epoch of 300 items, running on over passes."""
    o = global_index(read_table(s, d, "documents").select("doc_id"), ["doc_id"])
    return S.epoch_slice(o, o.count(), 300, 4).select("doc_id", "place")


@query("WITH s AS (SELECT doc_id, ntile(4) OVER (ORDER BY doc_id) - 1 AS split FROM documents), o AS (SELECT split, row_number() OVER (ORDER BY md5(split::VARCHAR || '|2'), split) - 1 AS r FROM (SELECT DISTINCT split FROM s)) SELECT doc_id, row_number() OVER (ORDER BY r, doc_id) - 1 AS ordinal FROM s JOIN o USING (split)")
def shuffled_splits(s, d):
    """Splits in pseudo-random order, one after another."""
    parts = S.contiguous(read_table(s, d, "documents").select("doc_id"), 4, ["doc_id"]).select("doc_id", "split")
    return global_index(parts, [*seeded_order("split", 2), F.col("doc_id")]).select("doc_id", "ordinal")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 50")
def seeded_sample(s, d):
    """An exact sample of 50."""
    return S.sample_rows(read_table(s, d, "documents").select("doc_id"), 50, "doc_id", 42)


@query(
    "WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|1'), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS place FROM documents) SELECT doc_id, lang, CASE WHEN place < 0.8 - 1e-12 THEN 'train' WHEN place < 0.9 - 1e-12 THEN 'valid' ELSE 'test' END AS split FROM r"
)
def stratified_split(s, d):
    """80/10/10 within every language."""
    return S.stratified(read_table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 1, [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).select("doc_id", "lang", "split")


@query("SELECT part.* FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10) OR p_partkey IN (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 10)")
def keep_n_best(s, d):
    """Rows among the ten best by either of two criteria."""
    return S.keep_best(read_table(s, d, "part"), [("p_retailprice", True), ("p_size", False)], 10, "p_partkey")


@query("SELECT recid AS key, path AS value FROM wav_scp UNION ALL SELECT uttid AS key, recid AS value FROM segments WHERE uttid IS NOT NULL")
def sorted_concatenation(s, d):
    """Outputs of jobs in one sorted relation."""
    a = read_table(s, d, "wav_scp").select(F.col("recid").alias("key"), F.col("path").alias("value"))
    return a.union(read_table(s, d, "segments").filter("uttid is not null").select("uttid", "recid")).orderBy("key")
