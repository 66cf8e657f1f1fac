"""Ordered computations: frames, windows, islands, chunks, alignments.

Row-local ones are Column expressions over arrays; those over rows take an entity and an
order. Arrays passed to them should be stored columns, not expressions, so that they are
not computed again for every element. Null arrays give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.arrays import let


def frames(x: Column, length: int, shift: int, centred: bool = False) -> Column:
    """Overlapping frames of ``length`` every ``shift``; a tail shorter than a frame is dropped.

    ``centred`` pads both ends by half a frame with the edge values.
    """
    if shift < 1 or length < 1:
        raise ValueError("frame length and shift must be at least 1")
    if centred:
        half = length // 2
        x = F.when(F.size(x) > 0, F.concat(F.array_repeat(F.get(x, 0), half), x, F.array_repeat(F.element_at(x, -1), half))).otherwise(x)
    n = F.floor((F.size(x) - length) / shift).cast("int") + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * shift + 1, F.lit(length)))).when(x.isNotNull(), F.slice(F.array(x), 1, 0))


def _dot(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def voiced_frames(x: Column, length: int, shift: int, threshold: float = 0.01) -> Column:
    """Whether each frame's power exceeds ``threshold`` times the mean power; one true if shorter than a frame."""
    power = F.transform(frames(x, length, shift), lambda v: _dot(v) / length)
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v) / F.size(p)
    above = lambda p: let(mean(p), lambda m: F.transform(p, lambda v: (v > m * threshold) | (m == 0)))
    return F.when(F.size(x) < length, F.array(F.lit(True))).otherwise(let(power, above))


def deltas(df: DataFrame, by: list[str], t: str, x: str, width: int = 2) -> DataFrame:
    """Adds ``delta``: sum of i (x[t+i] - x[t-i]) over 2 sum of i squared, edges repeated."""
    w = Window.partitionBy(*by).orderBy(t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    terms = [i * (F.coalesce(F.lead(x, i).over(w), last) - F.coalesce(F.lag(x, i).over(w), first)) for i in range(1, width + 1)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return df.withColumn("delta", total / (2 * sum(i * i for i in range(1, width + 1))))


def frame_labels(x: Column, win: int, hop: int) -> Column:
    """1 for each frame in which more than half of the samples are active (ties are not)."""
    return F.transform(frames(x, win, hop), lambda f: (F.aggregate(f, F.lit(0), lambda s, v: s + v.cast("int")) > win // 2).cast("int"))


def centre_labels(x: Column, win: int, hop: int) -> Column:
    """The value at the centre of each frame."""
    return F.transform(frames(x, win, hop), lambda f: F.get(f, F.lit(win // 2)))


def islands(df: DataFrame, by: list[str], order: str, active: Column) -> DataFrame:
    """(by..., island, first, last, n): maximal runs of consecutive active rows.

    A null condition is inactive. Runs are found by the difference of two row numbers.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__at", F.row_number().over(w)).filter(F.coalesce(active, F.lit(False)))
    rows = rows.withColumn("__g", F.col("__at") - F.row_number().over(w))
    runs = rows.groupBy(*by, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return runs.withColumn("island", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).drop("__g")


def median_filter(df: DataFrame, by: list[str], order: str, x: str, width: int) -> DataFrame:
    """Adds ``median`` over an odd ``width``; beyond the edges values count as zero."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    got = F.collect_list(x).over(w)
    padded = F.array_sort(F.concat(got, F.array_repeat(F.lit(0).cast(df.schema[x].dataType), F.greatest(F.lit(width) - F.size(got), F.lit(0)))))
    return df.withColumn("median", F.get(padded, half))


def chunks(x: Column, length: int, ratio: float) -> Column:
    """struct(start, values) of chunks of ``length`` with step int(length * ratio); the tail is dropped.

    Sequences shorter than a chunk give none; a step of 0 is refused.
    """
    step = int(length * ratio)
    if step < 1:
        raise ValueError("the chunk step must be at least 1")
    n = F.floor((F.size(x) - length) / step).cast("int") + 1
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("start"), F.slice(x, i * step + 1, F.lit(length)).alias("values")))
    return F.when((F.size(x) >= length) & (n > 0), made)


def text_windows(words: Column, most: int, overlap: int) -> Column:
    """Windows of ``most`` words, ``overlap`` shared: max(words // step, 1) of them, joined by blanks."""
    step = most - overlap
    if step < 1:
        raise ValueError("the overlap must be smaller than the window")
    n = F.greatest(F.floor(F.size(words) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(most)), " "))


def uniform_times(words: Column, duration: Column) -> Column:
    """struct(word, start, duration) in whole units: equal shares, the last word takes the rest."""
    n = F.size(words)
    step = F.floor(duration / n)
    return F.when(n > 0, F.transform(words, lambda w, i: F.struct(w.alias("word"), (i * step).alias("start"), F.when(i == n - 1, duration - step * (n - 1)).otherwise(step).alias("duration"))))


def occurrence_number(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Adds ``occurrence``, counted from 0 among equal ``by``."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def dtw_cost(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Total distance and length of the best warping path of two sequences of vectors, exact."""
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    n, m = d.shape
    # Anti-diagonals i + j = k of the table with its border, held by i; the cells of one need only the two before.
    cost, steps = [np.full(n + 1, np.inf) for _ in range(2)], [np.zeros(n + 1, dtype=int) for _ in range(2)]
    cost[0][0] = 0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        best, taken = cost[0][i - 1], steps[0][i - 1]
        for c, s in ((cost[1][i - 1], steps[1][i - 1]), (cost[1][i], steps[1][i])):
            less = (c < best) | ((c == best) & (s < taken))
            best, taken = np.where(less, c, best), np.where(less, s, taken)
        new, new_steps = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        new[i], new_steps[i] = best + d[i - 1, k - i - 1], taken + 1
        cost, steps = [cost[1], new], [steps[1], new_steps]
    return float(cost[1][n]), int(steps[1][n])


def dtw(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, cost, mean_cost) of two sequences of numbers in one row; null where either is null or empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for k, x, y in zip(f["k"], f["a"], f["b"]):
                if x is None or y is None or not len(x) or not len(y):
                    out.append((k, None, None))
                    continue
                c, n = dtw_cost(np.asarray(x, dtype=float).reshape(len(x), -1), np.asarray(y, dtype=float).reshape(len(y), -1))
                out.append((k, c, c / n))
            yield pd.DataFrame(out, columns=[key, "cost", "mean_cost"])

    return df.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, f"{key} {kind}, cost double, mean_cost double")


def trim_bounds(x: Column, drop_db: float, margin: int) -> Column:
    """struct(start, end) of samples louder than the loudest less ``drop_db``, widened by ``margin`` and clamped."""

    def bounds(loud: Column) -> Column:
        first = F.array_position(loud, True) - 1
        last = F.size(loud) - F.array_position(F.reverse(loud), True) + 1
        return F.when(F.array_contains(loud, True), F.struct(F.greatest(first - margin, F.lit(0)).alias("start"), F.least(last + margin, F.size(loud)).alias("end")))

    def loud(power: Column) -> Column:
        return let(F.array_max(power) * (10 ** (-drop_db / 10)), lambda least: F.transform(power, lambda p: p > least))

    return let(let(F.transform(x, lambda v: v * v), loud), bounds)


def overlap_add(df: DataFrame, by: list[str], start: str, values: str) -> DataFrame:
    """(by..., pos, value): segments stitched together, samples of several averaged."""
    x = df.select(*by, F.col(start).alias("__s"), F.posexplode(values).alias("__i", "__v"))
    return x.groupBy(*by, (F.col("__s") + F.col("__i")).alias("pos")).agg(F.avg("__v").alias("value"))


def frame_durations(df: DataFrame, by: list[str], start: str, end: str, label: str, fs: int, hop: int, silence: str = "sil") -> DataFrame:
    """(by..., label, start, frames): durations in frames from intervals; gaps become ``silence``.

    A boundary lies at frame int(t fs / hop + 0.5), and a duration is a difference of rounded
    boundaries, so durations add up to the whole.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    after = F.coalesce(F.lag(end).over(w), F.lit(0.0))
    rows = df.withColumn("__gap", after)
    own = rows.select(*by, F.col(label).alias("label"), F.col(start).alias("st"), F.col(end).alias("et"))
    gaps = rows.filter(F.col(start) > F.col("__gap")).select(*by, F.lit(silence).alias("label"), F.col("__gap").alias("st"), F.col(start).alias("et"))
    at = lambda c: F.floor(F.col(c) * fs / hop + 0.5).cast("bigint")
    return own.union(gaps).select(*by, "label", F.col("st").alias("start"), (at("et") - at("st")).alias("frames"))


def expand_durations(values: Column, counts: Column) -> Column:
    """Each value repeated as often as its count says."""
    return F.flatten(F.zip_with(values, counts, lambda v, n: F.array_repeat(v, n.cast("int"))))
