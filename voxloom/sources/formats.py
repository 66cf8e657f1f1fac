"""Text formats of keyed relations: parsing lines, and assembling lines to write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Number sequences by type name: delimiter and element type.
SEQUENCES = {"text_int": (" ", "bigint"), "text_float": (" ", "double"), "csv_int": (",", "bigint"), "csv_float": (",", "double")}


def parse_two_column(lines: DataFrame, value: str = "value", need_value: bool = False) -> DataFrame:
    """(uttid, value) of lines: the first word is the key, the rest of the line the value.

    Outer white space is ignored and a lone key has the value "" (or, with ``need_value``,
    fails). A blank line fails when it is read.
    """
    line = F.regexp_extract(value, r"^\s*(.*?)\s*$", 1)
    key = F.regexp_extract(line, r"^(\S+)", 1)
    rest = F.regexp_replace(line, r"^\S+\s*", "")
    rows = lines.select(key.alias("uttid"), rest.alias("value"))
    rows = rows.filter(F.assert_true(F.col("uttid") != "", F.lit("a blank line where a key should be")).isNull())
    if need_value:
        rows = rows.filter(F.assert_true(F.col("value") != "", F.concat(F.lit("no value for key "), F.col("uttid"))).isNull())
    return rows


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """The same rows; fails if a key occurs twice (checked at once)."""
    if twice := df.groupBy(key).count().filter("count > 1").take(1):
        raise ValueError(f"key {twice[0][0]!r} occurs {twice[0][1]} times")
    return df


def read_two_column(spark: SparkSession, path: str, unique: bool = True, need_value: bool = False) -> DataFrame:
    rows = parse_two_column(spark.read.text(path), need_value=need_value)
    return check_unique(rows, "uttid") if unique else rows


def parse_sequence(c: Column, kind: str) -> Column:
    """Numbers between exactly one delimiter each; anything else fails (ANSI casts)."""
    if kind not in SEQUENCES:
        raise ValueError(f"{kind!r} is not a number sequence; known: {sorted(SEQUENCES)}")
    delimiter, element = SEQUENCES[kind]
    return F.transform(F.split(c, re.escape(delimiter)), lambda x: x.cast(element))


def read_sequences(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_two_column(spark, path).select("uttid", parse_sequence(F.col("value"), kind).alias("value"))


def parse_label(c: Column) -> Column:
    """(start, end, label) triples of a line; an incomplete last triple is dropped."""
    w = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    n = F.floor(F.size(w) / 3).cast("int")
    triple = lambda i: F.struct(F.get(w, i * 3).cast("double").alias("st"), F.get(w, i * 3 + 1).cast("double").alias("et"), F.get(w, i * 3 + 2).alias("label"))
    none = F.array().cast("array<struct<st:double,et:double,label:string>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), triple)).otherwise(none)


def parse_rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, utt, start, n, spk) of RTTM lines with nine fields; times are sample numbers. Others fail."""
    f = F.split(F.regexp_replace(F.trim(value), r"\s+", " "), " ")
    rows = lines.filter(F.trim(value) != "").select(f.alias("f"))
    rows = rows.filter(F.assert_true(F.size("f") == 9, F.lit("an RTTM line has nine fields")).isNull())
    is_end = F.col("f")[0] == "END"
    number = lambda c: F.floor(c.cast("double")).cast("bigint")
    return rows.select(F.col("f")[0].alias("kind"), F.col("f")[1].alias("utt"), number(F.when(~is_end, F.col("f")[3])).alias("start"), number(F.when(is_end, F.col("f")[3]).otherwise(F.col("f")[4])).alias("n"), F.when(~is_end, F.col("f")[7]).alias("spk"))


def rttm_labels(rows: DataFrame) -> DataFrame:
    """(utt, n_samples, spk, spk_index, active): active samples of each speaker as merged ranges.

    The last sample of an interval belongs to it. Speakers are numbered by first start (ties by
    name). Without an END row the length is 0 and nothing is active. Ranges are cut to the length.
    """
    total = rows.groupBy("utt").agg(F.coalesce(F.max(F.when(F.col("kind") == "END", F.col("n"))), F.lit(0)).alias("n_samples"))
    talk = rows.filter("kind = 'SPEAKER'").join(total, "utt")
    ends = talk.select("utt", "n_samples", "spk", "start", F.least(F.col("start") + F.col("n") + 1, F.col("n_samples")).alias("end"))
    first = talk.groupBy("utt", "spk").agg(F.min("start").alias("first"))
    index = first.withColumn("spk_index", F.row_number().over(Window.partitionBy("utt").orderBy("first", "spk")) - 1).drop("first")
    w = Window.partitionBy("utt", "spk").orderBy("start", "end")
    fresh = F.col("start") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = ends.filter("end > start").withColumn("i", F.sum(fresh.cast("int")).over(w))
    merged = islands.groupBy("utt", "n_samples", "spk", "i").agg(F.min("start").alias("st"), F.max("end").alias("et"))
    grouped = merged.groupBy("utt", "n_samples", "spk").agg(F.array_sort(F.collect_list(F.struct("st", "et"))).alias("active"))
    return grouped.join(index, ["utt", "spk"]).select("utt", "n_samples", "spk", "spk_index", "active")


def parse_report(lines: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """(record, id, speaker, scores, ref, hyp) of a scoring report: an ``id:`` line begins a record.

    ``order`` are columns that order the lines. Lines before the first ``id:`` are dropped, and
    the last record ends with the file. Records are numbered without gathering the lines.
    """
    from voxloom.operators.batching import Fold, fold_batches

    kind = F.regexp_extract(value, r"^\s*(id|Speaker sentences|Scores|REF|HYP)\s*:?", 1)
    kept = lines.select(*order, kind.alias("kind"), F.trim(F.regexp_replace(value, r"^\s*(id|Speaker sentences|Scores|REF|HYP)\s*:?\s*", "")).alias("v")).filter("kind <> ''")
    by = lambda k: Fold(lambda v: [int(v[0] == k)], lambda s, v: None if v[0] == k else s)
    spoken = fold_batches(kept, by("Speaker sentences"), ["kind"], order).withColumnRenamed("batch", "part")
    rows = fold_batches(spoken, by("id"), ["kind"], order).withColumnRenamed("batch", "record")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    records = rows.groupBy("record").agg(pick("id").alias("id"), F.max(F.when(F.col("kind") == "id", F.col("part"))).alias("part"), *[pick(k).alias(n) for k, n in (("Scores", "scores"), ("REF", "ref"), ("HYP", "hyp"))]).filter("id is not null")
    speakers = rows.groupBy("part").agg(pick("Speaker sentences").alias("speaker"))
    return records.join(speakers, "part", "left").select("record", "id", "speaker", "scores", "ref", "hyp")


def parse_scores(c: Column) -> Column:
    """struct(c, s, d, i) of the four numbers at the end of a Scores value."""
    n = lambda k: F.regexp_extract(c, r"(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$", k).cast("bigint")
    return F.struct(n(1).alias("c"), n(2).alias("s"), n(3).alias("d"), n(4).alias("i"))


def parse_timing(lines: DataFrame, order: list[str], value: str = "value", pattern: str = "yyyy-MM-dd HH:mm:ss,SSS") -> DataFrame:
    """(ordinal, seconds): the n-th start line and the n-th end line of a decoding log belong together."""
    from voxloom.operators.ordering import global_index

    stamp = F.to_timestamp(F.regexp_extract(value, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3})", 1), pattern)
    marks = lambda what, name: global_index(lines.filter(F.col(value).contains(what)).select(*order, stamp.alias(name)), order).select("ordinal", name)
    a, b = marks("decoding start", "a"), marks("decoding end", "b")
    return a.join(b, "ordinal").select("ordinal", (F.col("b").cast("double") - F.col("a").cast("double")).alias("seconds"))


# Lines to write


def two_column_line(key: str, value: str) -> Column:
    return F.concat_ws(" ", key, F.col(value).cast("string"))


def trn_line(text: str, key: str) -> Column:
    return F.concat(F.col(text), F.lit(" ("), F.col(key), F.lit(")"))


def seconds_text(c: Column) -> Column:
    """Seconds with two decimals, rounded half up from whole milliseconds."""
    h = F.floor((F.round(c * 1000).cast("bigint") + 5) / 10)
    return F.format_string("%d.%02d", F.floor(h / 100), h % 100)


def stm_line(rec: str, spk: str, start: str, end: str, text: str) -> Column:
    return F.concat_ws(" ", rec, F.lit("1"), spk, seconds_text(F.col(start)), seconds_text(F.col(end)), F.upper(text))


def ctm_line(rec: str, start: Column, duration: Column, word: Column) -> Column:
    return F.concat_ws(" ", rec, F.lit("1"), seconds_text(start), seconds_text(duration), word)


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, where: Column | str | None = None, separator: str = "\t", header: bool = True) -> DataFrame:
    """A table of delimited lines with a declared schema: the named columns of the rows that ``where`` keeps.

    Quoted fields may hold the separator, quotes (doubled) and line breaks. Only the columns
    that are asked for are converted; a line that does not fit the schema fails the query.
    """
    rows = spark.read.csv(path, schema=schema, sep=separator, header=header, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=True)
    if where is not None:
        rows = rows.filter(where)
    return rows.select(*columns) if columns else rows
