"""Filling containers of fixed capacity with items of varying length.

Method: length-histogram planning. Best fit in descending order runs over the counts of equal
lengths, not over the items; the plan says which ranks within a length go to which
containers. The items then take their places by joining on the rank within their length. The
histogram has at most one row per length up to the capacity, whatever the number of items.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut

#: Ranks of one length that meet the plan under one join key.
CHUNK = 100_000


def best_fit_plan(capacity: int, histogram: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first container, items per container) for (length, count) rows.

    An item of rank r in [first rank, last rank] goes to container first container +
    (r - first rank) // items per container. Items go to the fullest container they fit in;
    containers alike are kept as one range, so the plan has about as many rows as lengths.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rests: list[int] = []  # what is left in open containers, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # rest -> ranges (first container, number)
    opened = 0

    def leave(rest: int, first: int, number: int) -> None:
        if rest <= 0 or number <= 0:
            return
        if rest not in ranges:
            bisect.insort(rests, rest)
            ranges[rest] = []
        ranges[rest].append((first, number))

    def fill(length: int, rank: int, left: int, rest: int, first: int, number: int) -> int:
        """Puts up to ``left`` items into ``number`` containers with ``rest`` each; returns how many."""
        per = rest // length
        full = min(number, left // per)
        taken = full * per
        if full:
            plan.append((length, rank, rank + taken - 1, first, per))
            leave(rest - per * length, first, full)
        if full < number:
            some = min(left - taken, per)
            if some:
                plan.append((length, rank + taken, rank + taken + some - 1, first + full, per))
                leave(rest - some * length, first + full, 1)
                taken += some
                full += 1
            leave(rest, first + full, number - full)
        return taken

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect.bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                first, number = ranges[rest].pop()
                if not ranges[rest]:
                    del ranges[rest], rests[at]
            else:
                per = capacity // length
                rest, first = capacity, opened
                number = -((rank - count) // per)
                opened += number
            rank += fill(length, rank, count - rank, rest, first, number)
    return plan


def pack(items: DataFrame) -> DataFrame:
    """Containers for rows (bin_set, capacity, item, load): (bin_set, item, part, n_parts, part_load, container).

    ``bin_set`` names the containers that an item may go to, all of one capacity; loads and
    capacities are whole numbers. An item whose load exceeds the capacity alone is split into
    parts of the capacity and a rest; no other is. Rows with a null or non-positive load or
    capacity are left out. Equal rows are items of their own.
    """
    fine = items.filter("bin_set is not null and capacity > 0 and load > 0")
    n_parts = F.ceil(F.col("load") / F.col("capacity")).cast("bigint")
    parts = (
        fine.withColumn("n_parts", n_parts)
        .withColumn("part", F.explode(F.expr("sequence(0L, n_parts - 1L)")))
        .withColumn("part_load", F.when(F.col("part") < F.col("n_parts") - 1, F.col("capacity")).otherwise(F.col("load") - F.col("capacity") * (F.col("n_parts") - 1)))
        .select("bin_set", "capacity", "item", "part", "n_parts", "part_load")
    )
    ordered = parts.repartitionByRange("bin_set", "part_load", "item", "part").sortWithinPartitions("bin_set", "part_load", "item", "part")
    ordered = cut(ordered.withColumn("pid", F.spark_partition_id()))

    def plan(f: pd.DataFrame) -> pd.DataFrame:
        rows = best_fit_plan(int(f["capacity"].iat[0]), list(zip(f["part_load"].tolist(), f["n"].tolist())))
        p = pd.DataFrame(rows, columns=["part_load", "from_rank", "to_rank", "first", "per"])
        p.insert(0, "bin_set", f["bin_set"].iat[0])
        return p

    histogram = ordered.groupBy("bin_set", "capacity", "part_load").agg(F.count("*").alias("n"))
    planned = histogram.groupBy("bin_set").applyInPandas(plan, "bin_set bigint, part_load bigint, from_rank bigint, to_rank bigint, first bigint, per bigint")

    # Rank within a length: equal lengths lie in consecutive partitions, so only the last
    # length of a partition can run on; one summary row per partition is collected.
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, first, last, n = None, None, None, 0
        for b in batches:
            if b.empty:
                continue
            keys = list(zip(b["bin_set"].tolist(), b["part_load"].tolist()))
            if pid is None:
                pid, first = int(b["pid"].iat[0]), keys[0]
            own = int(((b["bin_set"] == keys[-1][0]) & (b["part_load"] == keys[-1][1])).sum())
            n = n + own if keys[-1] == last else own
            last = keys[-1]
        if pid is not None:
            yield pd.DataFrame([(pid, *first, *last, n)], columns=["pid", "fs", "fl", "ls", "ll", "n"])

    carried: dict[int, tuple] = {}
    state: tuple | None = None
    for r in sorted(ordered.mapInPandas(ends, "pid int, fs bigint, fl bigint, ls bigint, ll bigint, n bigint").collect(), key=lambda r: r["pid"]):
        if state is not None and state[0] == (r["fs"], r["fl"]):
            carried[r["pid"]] = state
        runs_on = state is not None and state[0] == (r["ls"], r["ll"])
        state = ((r["ls"], r["ll"]), r["n"] + (state[1] if runs_on else 0))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, begun = None, 0, False
        for b in batches:
            if b.empty:
                continue
            if not begun:
                key, seen = carried.get(int(b["pid"].iat[0]), (None, 0))
                begun = True
            r = b.groupby(["bin_set", "part_load"], sort=False).cumcount()
            head = (int(b["bin_set"].iat[0]), int(b["part_load"].iat[0]))
            if head == key:
                r = r.where((b["bin_set"] != head[0]) | (b["part_load"] != head[1]), r + seen)
            b = b.assign(rank=r.astype("int64"))
            key, seen = (int(b["bin_set"].iat[-1]), int(b["part_load"].iat[-1])), int(r.iat[-1]) + 1
            yield b[["bin_set", "item", "part", "n_parts", "part_load", "rank"]]

    ranked = ordered.mapInPandas(rank, "bin_set bigint, item string, part bigint, n_parts bigint, part_load bigint, rank bigint")
    # A length with many items meets its plan in chunks of ranks, so that none is one task.
    spread = planned.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("from_rank") / CHUNK), F.floor(F.col("to_rank") / CHUNK))))
    placed = ranked.withColumn("chunk", F.floor(F.col("rank") / CHUNK)).join(spread, ["bin_set", "part_load", "chunk"]).filter(F.col("rank").between(F.col("from_rank"), F.col("to_rank")))
    container = F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per"))
    return placed.select("bin_set", "item", "part", "n_parts", "part_load", container.cast("bigint").alias("container"))
