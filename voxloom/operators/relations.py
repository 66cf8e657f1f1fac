"""Joins, unions and set operations of keyed relations.

A relation is a DataFrame with a key column. Null keys name nothing and never match. Columns
that clash are resolved as each operator says; columns it does not name are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class KeyMismatch(ValueError):
    """Relations that should hold the same keys do not."""


def check_columns(df: DataFrame, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """Raises before anything runs if a required column is missing, or one beyond optional is present."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if optional is not None and (extra := [c for c in df.columns if c not in {*required, *optional}]):
        raise ValueError(f"columns not known: {extra}")
    return df


def renamed_apart(dfs: list[DataFrame], key: str) -> list[DataFrame]:
    """Clashing value columns of later relations get the suffix _2, _3, ..."""
    seen, out = {key}, []
    for i, df in enumerate(dfs, 1):
        names = {c: c if c not in seen else f"{c}_{i}" for c in df.columns if c != key}
        seen |= set(names.values())
        out.append(df.select(key, *[F.col(c).alias(n) for c, n in names.items()]))
    return out


def uneven_keys(dfs: list[DataFrame], key: str) -> DataFrame:
    """(key, n_1, n_2, ...): the keys that not every relation holds equally often, with how often each does.

    One aggregation over all keys, with map-side counts.
    """
    tagged = reduce(lambda a, b: a.union(b), [d.select(key, F.lit(i).alias("__src")) for i, d in enumerate(dfs)])
    counts = tagged.groupBy(key).agg(*[F.count_if(F.col("__src") == i).alias(f"n_{i + 1}") for i in range(len(dfs))])
    uneven = reduce(lambda a, b: a | b, [F.col("n_1") != F.col(f"n_{i + 1}") for i in range(1, len(dfs))], F.lit(False))
    return counts.filter(uneven)


def strict_join(dfs: list[DataFrame], key: str, keys: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Inner join of relations that must all hold the same keys; ``keys`` restricts it to some of them.

    With ``check`` a key missing anywhere raises KeyMismatch, without it such keys are left out.
    """
    parts = renamed_apart(dfs, key)
    if keys is not None:
        parts = [p.join(keys.select(key).distinct(), key, "left_semi") for p in parts]
    if check:
        odd = uneven_keys(parts + ([keys.select(key).distinct()] if keys is not None else []), key).take(1)
        if odd:
            raise KeyMismatch(f"key {odd[0][0]!r} is not in every relation")
    return reduce(lambda a, b: a.join(b, key), parts)


def lookup_join(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left-driven join that must be total: a key of ``first`` that another lacks fails the query when read."""
    parts = renamed_apart([first, *others], key)
    out = parts[0]
    for i, p in enumerate(parts[1:], 2):
        out = out.join(p.withColumn(f"__has_{i}", F.lit(True)), key, "left")
        told = F.concat(F.lit("key not found: "), F.col(key).cast("string"))
        out = out.filter(F.assert_true(F.col(f"__has_{i}"), told).isNull()).drop(f"__has_{i}")
    return out


def default_join(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join of one value with a default for keys the dimension lacks; the dimension's first value by order counts."""
    one = dim.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def merge_fields(dfs: list[DataFrame], key: str) -> DataFrame:
    """Inner join on the common keys; of clashing fields the last non-null value wins."""
    common = reduce(lambda a, b: a.join(b, key), [df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(f"__{i}")) for i, df in enumerate(dfs)])
    fields = dict.fromkeys(c for df in dfs for c in df.columns if c != key)
    having = {f: [i for i, df in enumerate(dfs) if f in df.columns] for f in fields}
    return common.select(key, *[F.coalesce(*[F.col(f"__{i}")[f] for i in reversed(ix)]).alias(f) for f, ix in having.items()])


def last_writer_union(dfs: list[DataFrame], key: str) -> DataFrame:
    """Union by key in which the last relation that holds a key wins."""
    tagged = [df.withColumn("__src", F.lit(i)) for i, df in enumerate(dfs)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy(F.desc("__src"), *[F.col(c) for c in dfs[-1].columns if c != key])
    return every.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__src")


def suffixed_union(dfs: list[DataFrame], key: str) -> DataFrame:
    """Union that keeps all rows: keys of the i-th relation get the suffix .i, but for the first."""
    parts = [df.withColumn(key, F.concat(F.col(key), F.lit(f".{i}"))) if i else df for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine(dfs: list[DataFrame]) -> DataFrame:
    """Union of relations; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per_key(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key form one group."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def cap_repeats(df: DataFrame, by: str, most: int, order: list[str]) -> DataFrame:
    """At most ``most`` rows per value of ``by``, the first by ``order``."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__rank")


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either but not both, as multisets."""
    return a.exceptAll(b).union(b.exceptAll(a))


def restrict_two_hops(keys: DataFrame, segments: DataFrame, recordings: DataFrame, key: str, via: str) -> DataFrame:
    """Recordings that segments of the listed keys refer to."""
    used = segments.join(keys.select(key), key, "left_semi").select(via).distinct()
    return recordings.join(used, via, "left_semi")


def interval_join(points: DataFrame, intervals: DataFrame, by: str, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the intervals [start, end) of the same ``by`` that hold them.

    Intervals are cut into bins of ``width``, so the join is an equality on (by, bin): a group
    with many intervals is spread over its bins, and only neighbours in time are compared.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1e-9) / width))
    cut = intervals.filter(F.col(end) > F.col(start)).withColumn("__bin", F.explode(bins))
    at = points.withColumn("__bin", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return at.join(cut, [by, "__bin"]).filter(inside).drop("__bin")


def contains_join(needles: DataFrame, haystack: DataFrame, needle: str, hay: str, gram: int = 8) -> DataFrame:
    """Pairs in which ``hay`` contains ``needle``, found over the rarest character n-gram of each needle.

    Instead of comparing all pairs, one n-gram of each needle must stand in the haystack text:
    of all its n-grams the one that the fewest haystack rows hold, so a beginning that many
    names share is no join key. Then comes the exact test. Needles shorter than ``gram`` are
    looked up by their own length; empty and null ones match nothing.
    """
    taken = {needle, hay, *needles.columns, *haystack.columns}
    g, n = (next(x for x in (f"__{c}{i}" for i in range(99)) if x not in taken) for c in "gn")

    def grams(c: str, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - (size - 1))
        return F.array_distinct(F.when(F.length(c) >= size, F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(size)))).otherwise(F.array().cast("array<string>")))

    wanted = needles.filter(F.col(needle) != "")
    sizes = [r["n"] for r in wanted.select(F.least(F.length(needle), F.lit(gram)).alias("n")).distinct().collect()]  # at most ``gram`` rows
    out = None
    for size in sorted(sizes):
        some = wanted.filter(F.length(needle) >= gram if size == gram else F.length(needle) == size)
        mine = some.select(needle).distinct().select(needle, F.explode(grams(needle, size)).alias(g))
        spread = haystack.withColumn(g, F.explode(grams(hay, size)))
        # How many haystack rows hold each n-gram that a needle has.
        held = spread.select(g).join(mine.select(g).distinct(), g, "left_semi").groupBy(g).agg(F.count("*").alias(n))
        # A needle of which an n-gram is held nowhere matches nothing; the inner join may lose it.
        lead = mine.join(held, g).groupBy(needle).agg(F.min_by(g, F.struct(n, g)).alias(g))
        found = some.join(lead, needle).join(spread, g).filter(F.col(hay).contains(F.col(needle))).drop(g)
        out = found if out is None else out.unionByName(found)
    return needles.crossJoin(haystack.limit(0)) if out is None else out
