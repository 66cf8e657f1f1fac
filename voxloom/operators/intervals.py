"""Merging overlapping intervals of an entity into periods, and listing the gaps between them.

The rows are range-sorted by (entity, start) over the whole cluster, so one entity with a
third of all rows is spread over many partitions. Each partition gives one summary row; the
summaries, one per partition, are prefix-combined on the driver; a second scan starts every
partition with the state that its predecessors left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut

_SUMMARY = "pid int, first_entity string, last_entity string, max_end bigint, island_start bigint"
_PIECES = "kind string, entity string, lo bigint, hi bigint, n bigint"


def _scan(entity: np.ndarray, start: np.ndarray, end: np.ndarray, state: tuple | None):
    """Labels one sorted batch. Returns (new-island flags, island starts, running maxima before each row, after each row)."""
    n = len(start)
    first = np.ones(n, dtype=bool)
    first[1:] = entity[1:] != entity[:-1]
    group = np.cumsum(first)
    after = pd.Series(end).groupby(group).cummax().to_numpy(copy=True)
    carried = state is not None and entity[0] == state[0]
    if carried:
        lead = group == 1
        after[lead] = np.maximum(after[lead], state[1])
    before = np.empty(n, dtype=np.int64)
    before[1:] = after[:-1]
    if carried:
        first = first.copy()
        first[0] = False
        before[0] = state[1]
    opens = first | (start > before)
    at = np.where(opens, np.arange(n), -1)
    at = np.maximum.accumulate(at)
    island = np.where(at >= 0, start[at], state[2] if carried else 0)
    return opens, first, island, before, after


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, first_entity, pid = None, None, None
    for b in batches:
        if b.empty:
            continue
        e = b["entity"].to_numpy()
        if state is None:
            first_entity, pid = e[0], int(b["pid"].iat[0])
        _, _, island, _, after = _scan(e, b["start"].to_numpy(), b["end"].to_numpy(), state)
        state = (e[-1], int(after[-1]), int(island[-1]))
    if state is not None:
        yield pd.DataFrame([(pid, first_entity, *state)], columns=["pid", "first_entity", "last_entity", "max_end", "island_start"])


def _combine(rows: list) -> dict[int, tuple]:
    """State each partition starts with; one entry per partition that continues an entity."""
    carry: dict[int, tuple] = {}
    state: tuple | None = None
    for r in sorted(rows, key=lambda r: r["pid"]):
        if state is not None and state[0] == r["first_entity"]:
            carry[r["pid"]] = state
            if r["last_entity"] == state[0]:
                joined = state[1] >= r["island_start"]
                state = (state[0], max(state[1], r["max_end"]), state[2] if joined else r["island_start"])
                continue
        state = (r["last_entity"], r["max_end"], r["island_start"])
    return carry


def merge_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods and gaps of each entity: (kind, entity, lo, hi, n).

    ``kind`` is ``period`` (n = number of intervals in it) or ``gap`` (n = 0). ``start`` and
    ``end`` are whole numbers. Intervals that overlap, nest or touch form one period. Rows
    with a null entity, start or end, or with end <= start, do not count. Equal rows count
    as often as they occur; an empty input gives no rows. Other columns are not read, so
    their names cannot clash.
    """
    rows = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
        .filter("entity is not null and start is not null and end is not null and end > start")
    )
    ordered = rows.repartitionByRange("entity", "start", "end").sortWithinPartitions("entity", "start", "end")
    ordered = cut(ordered.withColumn("pid", F.spark_partition_id()))
    carry = _combine(ordered.mapInPandas(_summarise, _SUMMARY).collect())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for b in batches:
            if b.empty:
                continue
            if not begun:
                state, begun = carry.get(int(b["pid"].iat[0])), True
            e, s, t = b["entity"].to_numpy(), b["start"].to_numpy(), b["end"].to_numpy()
            opens, first, island, before, after = _scan(e, s, t, state)
            gap = opens & ~first
            yield pd.DataFrame({"kind": "gap", "entity": e[gap], "lo": before[gap], "hi": s[gap], "n": 0})
            part = pd.DataFrame({"entity": e, "lo": island, "hi": t}).groupby(["entity", "lo"], sort=False)["hi"].agg(["max", "size"]).reset_index()
            yield pd.DataFrame({"kind": "period", "entity": part["entity"], "lo": part["lo"], "hi": part["max"], "n": part["size"]})
            state = (e[-1], int(after[-1]), int(island[-1]))

    pieces = ordered.mapInPandas(label, _PIECES)
    # A period cut by a batch or partition edge comes in pieces with the same start.
    return pieces.groupBy("kind", "entity", "lo", F.when(F.col("kind") == "gap", F.col("hi")).alias("g")).agg(F.max("hi").alias("hi"), F.sum("n").alias("n")).select("kind", "entity", "lo", "hi", "n")


def rescale(df: DataFrame, factor: float, keys: list[str], start: str = "starttime", end: str = "endtime", least: float = 0.01) -> DataFrame:
    """Segments of a speed-perturbed copy: keys prefixed, times divided by the factor, two decimals as text.

    Segments that the factor leaves no longer than ``least`` are dropped, as are those with a null time.
    """
    prefix = F.lit(f"sp{factor}-")
    s, e = F.col(start) / factor, F.col(end) / factor
    out = df.filter(e > s + least)
    fixed = lambda c: F.format_string("%.2f", c)
    return out.select(*[F.concat(prefix, F.col(c)).alias(c) if c in keys else fixed(s).alias(c) if c == start else fixed(e).alias(c) if c == end else F.col(c) for c in df.columns])
