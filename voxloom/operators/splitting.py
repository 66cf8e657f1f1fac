"""Orders, limits, samples and splits. Every order ends in a key, so results are reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.ordering import global_index, seeded_order


def first_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows; each partition sends at most n."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed."""
    return df.orderBy(*seeded_order(key, seed)).limit(n)


def round_robin(df: DataFrame, n: int, order: list) -> DataFrame:
    """Adds ``split`` = position modulo n."""
    return global_index(df, order).withColumn("split", F.col("ordinal") % n)


def contiguous(df: DataFrame, n: int, order: list) -> DataFrame:
    """Adds ``split``: n stretches of consecutive rows, the larger ones first."""
    indexed = global_index(df, order)
    total = indexed.agg(F.count("*").alias("__total"))
    small, extra = F.floor(F.col("__total") / n), F.col("__total") % n
    wide = extra * (small + 1)
    at = F.when(F.col("ordinal") < wide, F.floor(F.col("ordinal") / (small + 1))).otherwise(extra + F.floor((F.col("ordinal") - wide) / F.greatest(small, F.lit(1))))
    return indexed.crossJoin(F.broadcast(total)).withColumn("split", at).drop("__total")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds ``ordinal``: the row's place in the pseudo-random order of an epoch."""
    return global_index(df, seeded_order(key, seed + epoch))


def epoch_slice(indexed: DataFrame, total: int, per_epoch: int, epoch: int) -> DataFrame:
    """Rows (``ordinal``) of a short epoch of ``per_epoch`` items that runs on over passes of ``total`` items.

    ``place`` is the position within the epoch. An epoch longer than a pass holds rows more than once.
    """
    if total <= 0:
        return indexed.limit(0).withColumn("place", F.lit(0).cast("bigint"))
    begin = per_epoch * epoch % total
    first = F.pmod(F.col("ordinal") - begin, F.lit(total))
    times = F.when(first < per_epoch, F.sequence(first, F.lit(per_epoch - 1).cast("bigint"), F.lit(total).cast("bigint")))
    return indexed.withColumn("place", F.explode(times))


def stratified(df: DataFrame, label: str, key: str, seed: int, shares: list[tuple[str, float]]) -> DataFrame:
    """Adds ``split``: every label is divided in the given shares, in pseudo-random order.

    The rank within a label comes from one global order by (label, hash), so a label with a
    third of the rows is not gathered in one task.
    """
    order = [F.col(label), *seeded_order(key, seed)]
    indexed = global_index(df, order)
    spans = indexed.groupBy(label).agg(F.min("ordinal").alias("__first"), F.count("*").alias("__n"))
    joined = indexed.join(spans, indexed[label].eqNullSafe(spans[label])).drop(spans[label])
    at = (F.col("ordinal") - F.col("__first")) / F.col("__n")
    split, upto = None, 0.0
    for name, share in shares:
        upto += share
        split = F.when(at < upto - 1e-12, name) if split is None else split.when(at < upto - 1e-12, name)
    return joined.withColumn("split", split.otherwise(shares[-1][0])).drop("__first", "__n", "ordinal")


def keep_best(df: DataFrame, criteria: list[tuple[str, bool]], n: int, key: str) -> DataFrame:
    """Rows among the best n by any criterion (column, smaller is better); nulls and NaN come last."""
    out = df
    for i, (c, least) in enumerate(criteria):
        v = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))
        best = df.orderBy(v.asc_nulls_last() if least else v.desc_nulls_last(), key).limit(n).select(F.col(key), F.lit(True).alias(f"__{i}"))
        out = out.join(best, key, "left")
    kept = F.greatest(*[F.coalesce(F.col(f"__{i}"), F.lit(False)) for i in range(len(criteria))]) if len(criteria) > 1 else F.coalesce(F.col("__0"), F.lit(False))
    return out.filter(kept).select(*df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; partitions are cut to n rows a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
