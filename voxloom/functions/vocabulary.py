"""Vocabularies from token counts, and conversion of tokens to ids and back.

Counts are aggregated map-side. A vocabulary of up to MOST_SENT entries, checked by count, is
sent to the tasks, which look tokens up inside their arrays in Arrow: no row is exploded and
nothing shuffled. A larger one is joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most entries of a vocabulary that is sent to every task.
MOST_SENT = 1_000_000
_OWN = ("<sos>", "<eos>", "<unk>")


def _occurrences(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def by_count(df: DataFrame, key: str, tokens: Column, cutoff: int, size: int, symbols: list[tuple[str, int]]) -> DataFrame:
    """(token, n, id): tokens with more than ``cutoff`` occurrences, most frequent first, ties in order of first sight.

    At most ``size`` entries with the symbols, which are inserted at their index one after
    another (a negative index counts from the end) and have a null count.
    """
    counts = _occurrences(df, tokens, key).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    kept = counts.filter(F.col("n") > cutoff).orderBy(F.desc("n"), "first").limit(max(size - len(symbols), 0))
    ids = kept.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)  # at most ``size`` rows
    out = ids.select("token", "n", "id")
    n = kept.count() if any(at < 0 for _, at in symbols) else 0  # once, before any symbol is in
    for i, (name, at) in enumerate(symbols):
        place = at if at >= 0 else n + i + 1 + at
        out = out.withColumn("id", F.when(F.col("id") >= place, F.col("id") + 1).otherwise(F.col("id")))
        out = out.union(df.sparkSession.createDataFrame([(name, None, place)], "token string, n bigint, id int"))
    return out.withColumn("id", F.col("id").cast("bigint"))


def sorted_tokens(df: DataFrame, tokens: Column, cutoff: int, size: int) -> DataFrame:
    """(token, id): the ``size`` most frequent tokens above the cutoff in code-point order from 2, ``<unk>`` as 1."""
    counts = df.select(F.explode(tokens).alias("token")).filter(~F.col("token").isin(*_OWN)).groupBy("token").agg(F.count("*").alias("n"))
    kept = counts.filter(F.col("n") > cutoff).orderBy(F.desc("n"), "token").limit(size)
    ids = kept.select("token", (F.row_number().over(Window.orderBy("token")) + 1).cast("bigint").alias("id"))  # at most ``size`` rows
    return ids.union(df.sparkSession.createDataFrame([("<unk>", 1)], "token string, id bigint"))


def top_by_group(df: DataFrame, group: str, tokens: Column, cutoff: int, k: int) -> DataFrame:
    """(group, token, n, rank): the k most frequent tokens of each group."""
    counts = df.select(group, F.explode(tokens).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n")).filter(F.col("n") > cutoff)
    w = Window.partitionBy(group).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def _sent(vocab: DataFrame) -> tuple[list, list] | None:
    """(tokens, ids) of a vocabulary small enough to send, else None."""
    rows = vocab.select("token", F.col("id").cast("bigint").alias("id")).filter("token is not null and id is not null").limit(MOST_SENT + 1).collect()
    return None if len(rows) > MOST_SENT else ([r["token"] for r in rows], [r["id"] for r in rows])


def token_ids(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, unknown: int) -> DataFrame:
    """(key, ids): ids in token order; rows without tokens are left out, a null token is unknown."""
    rows = df.select(key, tokens.alias("__t")).filter(F.size("__t") > 0)
    if (entries := _sent(vocab)) is None:
        occ = rows.select(key, F.posexplode("__t").alias("pos", "token")).join(vocab, "token", "left")
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id"))))
        return occ.groupBy(key).agg(ordered.alias("p")).select(key, F.col("p.id").alias("ids"))
    sent, kind = df.sparkSession.sparkContext.broadcast(entries), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = pa.array(sent.value[0], pa.string()), pa.array(sent.value[1], pa.int64())
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=names)
            found = pc.fill_null(ids.take(at), unknown)
            begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), found)], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} {kind}, ids array<bigint>")


def ids_to_text(df: DataFrame, key: str, ids: str, vocab: DataFrame, drop: tuple[str, ...] = ("<eos>",)) -> DataFrame:
    """(key, text): tokens joined by blanks, without the dropped ones and ids not known; rows without any are left out."""
    rows = df.select(key, F.col(ids).cast("array<bigint>").alias("__i")).filter(F.size("__i") > 0)
    if (entries := _sent(vocab.filter(~F.col("token").isin(*drop)))) is None:
        occ = rows.select(key, F.posexplode("__i").alias("pos", "id")).join(vocab, "id").filter(~F.col("token").isin(*drop))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
        return occ.groupBy(key).agg(ordered.alias("p")).select(key, F.array_join("p.token", " ").alias("text"))
    sent, kind = df.sparkSession.sparkContext.broadcast(entries), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = pa.array(sent.value[0], pa.string()), pa.array(sent.value[1], pa.int64())
        for b in batches:
            lists = b.column(1)
            tokens = names.take(pc.index_in(lists.flatten(), value_set=numbers))
            known = pc.is_valid(tokens)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known.to_numpy(zero_copy_only=False)]
            count = np.bincount(row, minlength=len(lists))
            begin = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(begin, tokens.filter(known)), " ")
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=[key, "text"]).filter(pa.array(count > 0))

    return rows.mapInArrow(run, f"{key} {kind}, text string")


def oov_counts(df: DataFrame, tokens: Column, vocab: DataFrame) -> DataFrame:
    """One row (n_tokens, n_oovs)."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = counts.join(vocab.select("token", F.lit(1).alias("known")), "token", "left")
    return known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_oovs"))


def label_distribution(df: DataFrame, labels: Column, end: str = "<eos>") -> DataFrame:
    """(label, share): labels counted once a row, the end label once for every row, shares of the sum."""
    once = df.select(F.explode(F.array_append(F.array_distinct(labels), F.lit(end))).alias("label"))
    counts = once.groupBy("label").agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("k") / F.col("t")).alias("share"))
