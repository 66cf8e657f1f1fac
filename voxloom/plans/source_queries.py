"""Queries on parsing and writing formats, over lines made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.plans.relation_queries import SEGMENTS, SPEAKERS, TEXTS, TRAIN_SHAPES, segments, shape_sql, shapes, speakers, texts
from voxloom.plans.sequence_queries import _X, signals
from voxloom.plans.text_queries import UPPER
from voxloom.session import checkpoint_dir, read_table
from voxloom.sources import binary, formats, scores, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"WITH {TEXTS} SELECT uttid, regexp_replace(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\x0b\\f]+', ''), '[ \\t\\n\\r\\x0b\\f]+$', '') AS value FROM txt WHERE regexp_full_match(uttid, '[!-~]+')")
def two_column_align(s, d):
    """Lines of a two-column relation parsed again."""
    lines = texts(s, d).filter(F.col("uttid").rlike("^[!-~]+$")).select(F.concat(F.lit("  "), "uttid", F.lit("\t"), F.coalesce("text", F.lit(""))).alias("value"))
    return formats.parse_two_column(lines)


@query("SELECT uttid, filename, list_sum(shape)::BIGINT AS total FROM shape_file WHERE len(shape) > 0")
def number_sequences(s, d):
    """Number sequences parsed by type."""
    rows = read_table(s, d, "shape_file").filter("size(shape) > 0").select("uttid", "filename", F.array_join("shape", ",").alias("line"))
    v = formats.parse_sequence(F.col("line"), "csv_int")
    return rows.select("uttid", "filename", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"WITH {SEGMENTS} SELECT uttid, starttime AS st, endtime AS et, recid AS label FROM seg WHERE recid IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL")
def label_triples(s, d):
    """S3: triples parsed, an incomplete last one dropped."""
    rows = segments(s, d).filter("recid is not null and starttime is not null and endtime is not null")
    line = F.concat_ws(" ", F.col("starttime").cast("string"), F.col("endtime").cast("string"), "recid", F.lit("7.5"))
    return rows.select("uttid", F.inline(formats.parse_label(line)))


@query(
    f"WITH {SEGMENTS}, {SPEAKERS}, t AS (SELECT recid, spk, CAST(round(starttime * 100) AS BIGINT) AS st, CAST(round(endtime * 100) AS BIGINT) + 1 AS et FROM seg JOIN spk USING (uttid) WHERE recid IS NOT NULL AND endtime > starttime AND starttime >= 0), n AS (SELECT recid, max(et) - 1 AS n FROM t GROUP BY recid), c AS (SELECT recid, spk, n, st, least(et, n) AS et FROM t JOIN n USING (recid)), o AS (SELECT *, max(et) OVER (PARTITION BY recid, spk ORDER BY st, et ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c WHERE et > st), i AS (SELECT *, sum((p IS NULL OR st > p)::INT) OVER (PARTITION BY recid, spk ORDER BY st, et ROWS UNBOUNDED PRECEDING) AS g FROM o), m AS (SELECT recid, spk, g, max(et) - min(st) AS len FROM i GROUP BY ALL), f AS (SELECT recid, spk, row_number() OVER (PARTITION BY recid ORDER BY min(st), spk) - 1 AS spk_index FROM c GROUP BY recid, spk) SELECT recid AS utt, spk, spk_index, count(*) AS n_ranges, sum(len)::BIGINT AS active FROM m JOIN f USING (recid, spk) GROUP BY ALL"
)
def rttm_activity(s, d):
    """RTTM lines parsed; each speaker's active samples as merged ranges."""
    t = segments(s, d).join(speakers(s, d), "uttid").filter("recid is not null and endtime > starttime and starttime >= 0")
    st, et = F.round(F.col("starttime") * 100).cast("bigint"), F.round(F.col("endtime") * 100).cast("bigint")
    na = F.lit("<NA>")
    talk = t.select(F.concat_ws(" ", F.lit("SPEAKER"), "recid", F.lit("1"), st.cast("string"), (et - st).cast("string"), na, na, "spk", na).alias("value"))
    ends = t.groupBy("recid").agg(F.max(et).alias("n")).select(F.concat_ws(" ", F.lit("END"), "recid", na, F.col("n").cast("string"), na, na, na, na, na).alias("value"))
    out = formats.rttm_labels(formats.parse_rttm(talk.union(ends)))
    total = F.aggregate("active", F.lit(0).cast("bigint"), lambda a, x: a + x["et"] - x["st"])
    return out.select("utt", "spk", F.col("spk_index").cast("bigint").alias("spk_index"), F.size("active").cast("bigint").alias("n_ranges"), total.alias("active"))


@query("SELECT doc_id, 90 + doc_id % 60 AS tempo, doc_type AS lyric, 60 + doc_id % 12 AS midi FROM documents")
def score_round_trip(s, d):
    """A score written as JSON and parsed again."""
    notes = F.array(F.struct(F.lit(0.0).alias("st"), F.lit(0.5).alias("et"), F.col("doc_type").alias("lyric"), (60 + F.col("doc_id") % 12).cast("int").alias("midi"), F.lit("a_b").alias("phns")))
    made = read_table(s, d, "documents").select("doc_id", scores.score_json((90 + F.col("doc_id") % 60).cast("int"), F.array(F.lit("st"), F.lit("et")), notes).alias("j"))
    back = made.select("doc_id", F.from_json("j", scores.SCORE).alias("s"))
    return back.select("doc_id", F.col("s.tempo").cast("bigint").alias("tempo"), F.get(F.get("s.note", 0), 2).alias("lyric"), F.get(F.get("s.note", 0), 3).cast("bigint").alias("midi"))


@query(
    "WITH n AS (SELECT doc_id, k, md5(doc_id::VARCHAR || '|5|' || (k // 8)) AS h FROM documents, unnest(range(0, 10)) t(k)) SELECT doc_id, list(2 + CAST(floor(('0x' || substr(h, CAST(4 * (k % 8) + 1 AS BIGINT), 4))::BIGINT / 65536 * 7) AS BIGINT) ORDER BY k) AS numbers FROM n GROUP BY doc_id"
)
def random_sequences(s, d):
    """Seeded random whole numbers of a given length."""
    return read_table(s, d, "documents").select("doc_id", binary.random_ints("doc_id", 10, 2, 9, 5).alias("numbers"))


_OWN = "regexp_replace(regexp_replace({c}, '^[ \\t\\n\\r\\x0b\\f]+', ''), ' +$', '')"


@query(f"WITH {TEXTS} SELECT uttid AS id, lang AS speaker, {_OWN.format(c=UPPER.format(c='text'))} AS ref, {_OWN.format(c='text')} AS hyp, length(text) AS c FROM txt WHERE text IS NOT NULL")
def report_records(s, d):
    """Records of a scoring report, from its lines."""
    t = texts(s, d, "lang").filter("text is not null")
    lines = F.array(F.concat(F.lit("Speaker sentences "), "lang"), F.concat(F.lit("id: "), "uttid"), F.concat(F.lit("Scores: (#C #S #D #I) "), F.length("text").cast("string"), F.lit(" 1 2 3")), F.concat(F.lit("REF: "), F.upper("text")), F.concat(F.lit("HYP: "), "text"))
    rows = t.select("uttid", F.posexplode(lines).alias("p", "value"))
    out = formats.parse_report(rows, ["uttid", "p"])
    return out.select("id", "speaker", "ref", "hyp", formats.parse_scores(F.col("scores"))["c"].alias("c"))


@query("SELECT round(sum(1 + event_id % 7), 3)::DOUBLE AS seconds, count(*) AS n FROM events")
def decoding_times(s, d):
    """Pairs of start and end lines of a log."""
    e = read_table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss,SSS")
    lines = F.array(F.concat(stamp(F.col("t")), F.lit(" (asr:1) INFO: decoding start")), F.concat(stamp(F.timestamp_add("SECOND", (1 + F.col("event_id") % 7).cast("int"), F.col("t"))), F.lit(" (asr:2) INFO: decoding end")))
    rows = e.select("event_id", F.posexplode(lines).alias("p", "value"))
    return formats.parse_timing(rows, ["event_id", "p"]).agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count("*").alias("n"))


@query(f"WITH {TEXTS}, {SPEAKERS}, e AS (SELECT uttid FROM txt UNION SELECT uttid FROM spk) SELECT 'spk' AS relation, uttid FROM e WHERE uttid NOT IN (SELECT uttid FROM spk) UNION ALL SELECT 'text', uttid FROM e WHERE uttid NOT IN (SELECT uttid FROM txt)")
def datadir_gaps(s, d):
    """K1: keys that sibling relations of a data directory lack."""
    return sinks.key_gaps({"text": texts(s, d), "spk": speakers(s, d)}, "uttid").select("relation", "uttid")


@query(f"WITH {shape_sql('a', TRAIN_SHAPES)} SELECT uttid, uttid || ' ' || array_to_string(shape, ',') AS line FROM a WHERE len(shape) > 0")
def shape_lines(s, d):
    """K4: lines of a shape file."""
    rows = shapes(s, d, TRAIN_SHAPES).filter("size(shape) > 0").select("uttid", F.array_join("shape", ",").alias("v"))
    return rows.select("uttid", formats.two_column_line("uttid", "v").alias("line"))


# Files written to the shared folder and read back


def fresh_folder(s, name: str) -> str:
    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def file_key(c: str):
    """The name of a file without its folder and ending, as a number."""
    return F.regexp_extract(c, r"([0-9]+)\.[a-z]+$", 1).cast("bigint")


@query(f"WITH {_X} SELECT vec_id, 16000 AS rate, list_transform(x, lambda v: round(v * 1000) / 32768) AS samples FROM x")
def wav_round_trip(s, d):
    """PCM files written and read, normalised by their width."""
    folder = fresh_folder(s, "wav")
    rows = signals(s, d).select(F.concat("vec_id", F.lit(".wav")).alias("name"), F.transform("x", lambda v: F.round(v * 1000).cast("int")).alias("v"))
    sinks.write_files(rows, folder, "name", "v", lambda v: binary.encode_wav(v, 16000))
    return binary.read_wav(s, folder).select(file_key("path").alias("vec_id"), "rate", F.get("samples", 0).alias("samples"))


@query(f"WITH {_X} SELECT vec_id, 64 AS length, 8000 AS rate, list_transform(x, lambda v: round(v * 1000) / 32768) AS samples FROM x")
def sound_container(s, d):
    """Sounds written to one container and read, lengths without the bytes."""
    folder = fresh_folder(s, "sounds")
    sinks.write_sounds(signals(s, d).select("vec_id", F.transform("x", lambda v: F.round(v * 1000).cast("int")).alias("v")), folder, "vec_id", "v", 8000)
    return binary.read_sounds(s, folder).select(F.col("key").alias("vec_id"), "length", "rate", F.get("samples", 0).alias("samples"))


@query(f"WITH {_X} SELECT vec_id, 64 AS length, list_transform(x, lambda v: round(v, 9)) AS values FROM x")
def npy_round_trip(s, d):
    """Array files written and read."""
    folder = fresh_folder(s, "npy")
    sinks.write_files(signals(s, d).select(F.concat("vec_id", F.lit(".npy")).alias("name"), "x"), folder, "name", "x", binary.encode_npy)
    return binary.read_npy(s, folder).select(file_key("path").alias("vec_id"), F.get("shape", 0).alias("length"), F.transform("values", lambda v: F.round(v, 9)).alias("values"))


@query(f"WITH {_X} SELECT vec_id::VARCHAR AS uttid, 64 AS length, round(list_sum(x), 6) AS total FROM x")
def ark_round_trip(s, d):
    """Archives written by partition and read."""
    folder = fresh_folder(s, "ark")
    sinks.write_ark(signals(s, d), folder, "vec_id", "x")
    return binary.read_ark(s, folder).select("uttid", F.get("shape", 0).alias("length"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"WITH {_X}, n AS (SELECT count(*) AS n FROM x) SELECT kind, n FROM n, (VALUES ('ark'), ('npy'), ('sound')) k(kind)")
def typed_readers(s, d):
    """Readers by the name of a type, shapes alone where values are not asked for."""
    x, out = signals(s, d), None
    for kind, ending, encode in (("sound", "wav", lambda v: binary.encode_wav(v * 100, 8000)), ("npy", "npy", binary.encode_npy)):
        folder = fresh_folder(s, kind)
        sinks.write_files(x.select(F.concat("vec_id", F.lit(f".{ending}")).alias("name"), "x"), folder, "name", "x", encode)
        one = binary.read_typed(s, folder, kind).select(F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    folder = fresh_folder(s, "ark")
    sinks.write_ark(x, folder, "vec_id", "x")
    out = out.union(binary.read_typed(s, folder, "ark", shape_only=True).filter("shape[0] = 64").select(F.lit("ark").alias("kind")))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT recid AS lyric, 60 + len(recid) % 12 AS midi, 90 + len(recid) % 7 AS tempo FROM wav_scp")
def musicxml_round_trip(s, d):
    """Scores written as MusicXML and read again."""
    folder = fresh_folder(s, "xml")
    n = F.length("recid")
    notes = F.array(F.struct(F.lit(0.0).alias("st"), F.lit(1.0).alias("et"), F.col("recid").alias("lyric"), (60 + n % 12).alias("midi")), F.struct(F.lit(1.0).alias("st"), F.lit(2.0).alias("et"), F.lit("").alias("lyric"), F.lit(0).alias("midi")))
    read_table(s, d, "wav_scp").select(scores.score_xml(90 + n % 7, notes).alias("value"), F.md5("recid").alias("part")).write.partitionBy("part").text(folder)
    back = scores.read_musicxml(s, f"{folder}/part=*")
    return back.select(F.get("notes", 0)["lyric"].alias("lyric"), F.get("notes", 0)["midi"].cast("bigint").alias("midi"), F.col("tempo").cast("bigint").alias("tempo"))


@query("SELECT uttid, lang FROM utt_text WHERE dset = 'test'")
def delimited_projection(s, d):
    """A delimited file read by a declared schema, projected and filtered; texts hold separators and line breaks."""
    folder = fresh_folder(s, "tsv")
    read_table(s, d, "utt_text").select("uttid", "dset", "lang", "text").write.csv(folder, sep="\t", header=True, quote='"', escape='"')
    return formats.read_delimited(s, folder, "uttid string, dset string, lang string, text string", ["uttid", "lang"], "dset = 'test'")


@query(f"WITH {SPEAKERS}, {SEGMENTS} SELECT uttid, spk, recid FROM spk JOIN seg USING (uttid) WHERE recid IS NOT NULL")
def datadir_round_trip(s, d):
    """K1, K2: a data directory of relations with the same keys, checked, written and read."""
    both = speakers(s, d).join(segments(s, d).filter("recid is not null"), "uttid").select("uttid", "spk", "recid")
    folder = fresh_folder(s, "datadir")
    sinks.write_datadir({n: both.select("uttid", F.col(c).alias("value")) for n, c in (("utt2spk", "spk"), ("utt2rec", "recid"))}, folder)
    spk, rec = (formats.read_two_column(s, f"{folder}/{n}").select("uttid", F.col("value").alias(c)) for n, c in (("utt2spk", "spk"), ("utt2rec", "recid")))
    return spk.join(rec, "uttid")


@query(f"WITH {_X} SELECT vec_id, 64 AS n, round(list_sum(x) * 2, 6) AS total FROM x")
def copied_feats(s, d):
    """K5: arrays transformed and written with their lengths, which are read without the arrays."""
    folder = fresh_folder(s, "feats")
    sinks.copy_feats(signals(s, d), folder, "x", [lambda df: df.withColumn("x", F.transform("x", lambda v: v * 2))])
    back = s.read.parquet(folder)
    return back.select("vec_id", F.col("x_length").cast("bigint").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM utt_text WHERE lang IS NOT NULL GROUP BY lang), r AS (SELECT row_number() OVER (ORDER BY lang) + 2 AS line, '|' || lang || '|' || n || '|' AS text FROM c) SELECT line, text FROM r UNION ALL SELECT * FROM (VALUES (1, '|lang|n|'), (2, '|---|---|'))")
def markdown_report(s, d):
    """K8: a table of results as Markdown, one row a line."""
    counts = read_table(s, d, "utt_text").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    lines = sinks.markdown_table(counts).splitlines()
    return s.createDataFrame(list(enumerate(lines, 1)), "line bigint, text string")
