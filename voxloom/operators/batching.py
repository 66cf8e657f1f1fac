"""Mini-batches of items in order, whose running totals restart with every batch.

Such folds are sequential, so rows are range-sorted over the cluster and every partition folds
its own stretch, first as if a batch began with it. Then each partition gets the state that
the one before ended with and folds again, until no end state changes. A fold forgets its
entry state at the first batch it opens, so partitions nearly always agree after the second
round; the result is exact in any case, and no group is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.ordering import global_index
from voxloom.session import cut

State = list


@dataclass(frozen=True)
class Fold:
    """``open`` gives the state of a batch that begins with an item; ``add`` the state with one more item, or None if that item begins a new batch."""

    open: Callable[[tuple], State]
    add: Callable[[State, tuple], State | None]


def fold_batches(df: DataFrame, fold: Fold, values: list[str], order: list, category: str | None = None) -> DataFrame:
    """Adds ``batch``, counted from 0 over all rows in order (categories in order of their name).

    A batch never spans categories; a null category is one of its own. ``order`` should be total.

    A partition's exit state no longer depends on its entry once the folds from both agree,
    nearly always within the first few batches, so two passes are the rule. In the worst case,
    where no batch closes within a partition (a limit beyond a partition's content), the true
    state moves on by one partition a pass: at most partitions + 1 passes.
    """
    cat = F.col(category).cast("string") if category else F.lit("").cast("string")
    ordered = df.withColumn("__cat", cat).repartitionByRange(F.col("__cat").asc_nulls_first(), *order).sortWithinPartitions(F.col("__cat").asc_nulls_first(), *order)
    ordered = cut(ordered.withColumn("__pid", F.spark_partition_id()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def walk(b: pd.DataFrame, state: tuple) -> tuple[list[bool], tuple]:
        cat, inner = state
        opens = []
        columns = [b[c].tolist() for c in values]
        for c, *item in zip(b["__cat"].tolist(), *columns):
            new = fold.add(inner, tuple(item)) if inner is not None and c == cat else None
            opens.append(new is None)
            cat, inner = c, fold.open(tuple(item)) if new is None else new
        return opens, (cat, inner)

    def ends(entry: dict[int, tuple]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pid, state, opened = None, (None, None), 0
            for b in batches:
                if b.empty:
                    continue
                if pid is None:
                    pid = int(b["__pid"].iat[0])
                    state = entry.get(pid, state)
                opens, state = walk(b, state)
                opened += sum(opens)
            if pid is not None:
                yield pd.DataFrame([(pid, opened, json.dumps(state))], columns=["pid", "opened", "state"])

        return run

    entry: dict[int, tuple] = {}
    while True:
        outs = sorted(ordered.mapInPandas(ends(entry), "pid int, opened bigint, state string").collect(), key=lambda r: r["pid"])  # one row per partition
        due = {b["pid"]: tuple(json.loads(a["state"])) for a, b in zip(outs[:-1], outs[1:])}
        if due == entry:
            break
        entry = due
    before, total = {}, 0
    for r in outs:
        before[r["pid"]] = total
        total += r["opened"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, 0
        for b in batches:
            if b.empty:
                continue
            if state is None:
                pid = int(b["__pid"].iat[0])
                state, at = entry.get(pid, (None, None)), before[pid] - 1
            opens, state = walk(b, state)
            ids = []
            for o in opens:
                at += o
                ids.append(at)
            yield b.drop(columns=["__cat", "__pid"]).assign(batch=ids)

    return ordered.mapInPandas(label, f"{schema}, batch bigint")


def greedy_groups(df: DataFrame, by: str, order: list, size: str, most: float) -> DataFrame:
    """Consecutive rows of an entity up to a total of ``most``; a row that would exceed it begins a new batch."""
    num = lambda v: 0.0 if v is None or v != v else v
    add = lambda s, v: [s[0] + num(v[0])] if s[0] + num(v[0]) <= most else None
    return fold_batches(df, Fold(lambda v: [num(v[0])], add), [size], order, by)


def length_batches(df: DataFrame, lengths: list[str], bins: int, order: list, least: int = 1, padding: bool = True, category: str | None = None) -> DataFrame:
    """A batch closes with the item that brings it over ``bins``, once it has ``least`` items.

    With padding, its bins are the number of items times the longest length, summed over inputs;
    without, the sum of all lengths.
    """

    def full(s: State) -> bool:
        n, rest = s[0], s[1:]
        return (n * sum(rest) if padding else sum(rest)) > bins and n >= least

    def add(s: State, v: tuple) -> State | None:
        if full(s):
            return None
        merged = [max(a, b) for a, b in zip(s[1:], v)] if padding else [a + b for a, b in zip(s[1:], v)]
        return [s[0] + 1, *merged]

    return fold_batches(df, Fold(lambda v: [1, *v], add), lengths, order, category)


def numel_batches(df: DataFrame, lengths: list[str], widths: list[int], bins: int, order: list, least: int = 1, category: str | None = None) -> DataFrame:
    """As length_batches with padding, each input's length times its fixed width."""

    def add(s: State, v: tuple) -> State | None:
        if s[0] * sum(x * w for x, w in zip(s[1:], widths)) > bins and s[0] >= least:
            return None
        return [s[0] + 1, *(max(a, b) for a, b in zip(s[1:], v))]

    return fold_batches(df, Fold(lambda v: [1, *v], add), lengths, order, category)


def folded_batches(df: DataFrame, lengths: list[str], folds: list[int], base: int, order: list, least: int = 1, category: str | None = None) -> DataFrame:
    """The batch size is decided by the first item: base / (1 + the greatest of length // fold), at least ``least`` and 1."""

    def size(v: tuple) -> int:
        return max(least, 1, int(base / (1 + max(int(x / f) for x, f in zip(v, folds)))))

    add = lambda s, v: [s[0] + 1, s[1]] if s[0] < s[1] else None
    return fold_batches(df, Fold(lambda v: [1, size(v)], add), lengths, order, category)


def bin_batches(df: DataFrame, length_in: str, length_out: str, width_in: int, width_out: int, bins: int, order: list, most: int = 0, category: str | None = None) -> DataFrame:
    """Padded elements of input and output stay within ``bins``: an item that would exceed them begins a new batch; at most ``most`` items if positive."""

    def add(s: State, v: tuple) -> State | None:
        n, a, b = s[0] + 1, max(s[1], v[0]), max(s[2], v[1])
        return None if n * (a * width_in + b * width_out) > bins or 0 < most < n else [n, a, b]

    return fold_batches(df, Fold(lambda v: [1, *v], add), [length_in, length_out], order, category)


def frame_batches(df: DataFrame, length_in: str, length_out: str, most_in: int, most_out: int, most_both: int, order: list, category: str | None = None) -> DataFrame:
    """Padded frames of input, output and both stay within their limits (0 is none)."""

    def add(s: State, v: tuple) -> State | None:
        n, a, b = s[0] + 1, max(s[1], v[0]), max(s[2], v[1])
        over = (most_in and n * a > most_in) or (most_out and n * b > most_out) or (most_both and n * (a + b) > most_both)
        return None if over else [n, a, b]

    return fold_batches(df, Fold(lambda v: [1, *v], add), [length_in, length_out], order, category)


def even_batches(df: DataFrame, size: int, order: list, drop_last: bool = False) -> DataFrame:
    """Adds ``batch`` in closed form: max(n // size, 1) batches with bounds i n / N, or fixed ones without the rest."""
    indexed = global_index(df, order)
    total = indexed.agg(F.count("*").alias("__n"))
    out = indexed.crossJoin(F.broadcast(total))
    if drop_last:
        return out.withColumn("batch", F.floor(F.col("ordinal") / size)).filter(F.col("batch") < F.floor(F.col("__n") / size)).drop("__n")
    n_batches = F.greatest(F.floor(F.col("__n") / size), F.lit(1))
    return out.withColumn("batch", F.floor(((F.col("ordinal") + 1) * n_batches - 1) / F.col("__n"))).drop("__n")


def fixed_batches(df: DataFrame, size: int, order: list) -> DataFrame:
    """Consecutive batches of ``size``; the last may be smaller."""
    return global_index(df, order).withColumn("batch", F.floor(F.col("ordinal") / size))


def spread_tail(df: DataFrame, least: int, order: list) -> DataFrame:
    """If the last batch has fewer than ``least`` items, they go one each to the batches before it, from the last on.

    Only the last ``least`` + 1 batches can change, so their sizes alone are looked at.
    """
    sizes = df.groupBy("batch").agg(F.count("*").alias("n")).orderBy(F.desc("batch")).limit(least + 1).collect()
    if len(sizes) < 2 or sizes[0]["n"] >= least:
        return df
    extra, rest = sizes[0]["n"], [s["n"] for s in sizes[1:]]
    for i in range(extra):
        rest[i % len(rest)] += 1
    first = sizes[-1]["batch"]
    head, tail = df.filter(F.col("batch") < first), df.filter(F.col("batch") >= first)
    indexed = global_index(tail, order)
    bounds = [0]
    for n in reversed(rest[1:]):
        bounds.append(bounds[-1] + n)
    # The place among the bounds of the few batches that can change.
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("ordinal"))) - 1 + F.lit(first).cast("bigint")
    return head.unionByName(indexed.withColumn("batch", at).drop("ordinal"))


def build_batches(kind: str, df: DataFrame, **options) -> DataFrame:
    """Batches of a named kind; an unknown name raises."""
    kinds = {"unsorted": even_batches, "sorted": even_batches, "folded": folded_batches, "length": length_batches, "numel": numel_batches, "bin": bin_batches, "frame": frame_batches, "seq": fixed_batches}
    if kind not in kinds:
        raise ValueError(f"no batch type {kind!r}; known: {sorted(kinds)}")
    return kinds[kind](df, **options)
