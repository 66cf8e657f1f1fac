"""Mixtures of several speakers: building them, scoring separated signals, and stitching segments of streams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.arrays import dot, si_snr
from voxloom.operators.scoring import assignment


def mix_signals(sources: list[np.ndarray], rirs: list[np.ndarray] | None, noise: np.ndarray | None, fs: int, snr_db: float, scale: float, early_ms: float = 50.0, limit: float = 1.0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(mixture, references, noise part) of one sample.

    Each source is convolved with its room response and cut to its length; its reference is the
    convolution with the response up to ``early_ms`` after the peak, which keeps direct sound
    and early reflections. The images are summed, noise is repeated to the length and added at
    ``snr_db``; then all signals are divided by one factor where the mixture's peak exceeds
    ``limit``, and all are scaled to the peak ``scale``.
    """
    n = max((len(s) for s in sources), default=0)
    images, refs = [], []
    for i, s in enumerate(sources):
        s = np.pad(s, (0, n - len(s)))
        h = rirs[i] if rirs is not None and i < len(rirs) and len(rirs[i]) else np.ones(1)
        early = h[: int(np.argmax(np.abs(h))) + int(fs * early_ms / 1000) + 1]
        images.append(np.convolve(s, h)[:n] if n else s)
        refs.append(np.convolve(s, early)[:n] if n else s)
    mix = np.sum(images, axis=0) if images else np.zeros(0)
    part = np.zeros(n)
    if noise is not None and len(noise) and n:
        fitted = np.resize(noise, n)
        power = float(fitted @ fitted)
        part = fitted * np.sqrt(float(mix @ mix) / (power + 1e-20) * 10 ** (-snr_db / 10)) if power else part
        mix = mix + part
    peak = float(np.max(np.abs(mix))) if n else 0.0
    down = limit / peak if peak > limit else 1.0
    peak *= down
    factor = down * (scale / peak if peak > 0 else 1.0)
    return mix * factor, [r * factor for r in refs], part * factor


def enhancement_mix(df: DataFrame, key: str, sources: str, rirs: str | None, noise: str | None, fs: int, snr_db: float = 10.0, scale: float = 0.9, early_ms: float = 50.0) -> DataFrame:
    """(key, mixture, references, noise) of rows with arrays of sources and of room responses.

    All related signals get one scale. Null arrays count as empty, null values as 0.
    """
    kind = df.schema[key].dataType.simpleString()
    clean = lambda a: np.nan_to_num(np.asarray([] if a is None else a, dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, h, z in zip(b["k"], b["s"], b["h"], b["z"]):
                mix, refs, part = mix_signals([clean(x) for x in (s if s is not None else [])], [clean(x) for x in h] if h is not None else None, clean(z), fs, snr_db, scale, early_ms)
                out.append((k, mix.tolist(), [r.tolist() for r in refs], part.tolist()))
            yield pd.DataFrame(out, columns=[key, "mixture", "references", "noise"])

    none = F.lit(None)
    rows = df.select(F.col(key).alias("k"), F.col(sources).alias("s"), (F.col(rirs) if rirs else none.cast("array<array<double>>")).alias("h"), (F.col(noise) if noise else none.cast("array<double>")).alias("z"))
    return rows.mapInPandas(run, f"{key} {kind}, mixture array<double>, references array<array<double>>, noise array<double>")


def snr(ref: Column, est: Column) -> Column:
    """Signal-to-noise ratio in dB of an estimate, up to the shorter length."""
    noise = F.zip_with(ref, est, lambda a, b: a - b)
    return 10 * F.log10((dot(ref, ref) + 1e-20) / (dot(noise, noise) + 1e-20))


def separation_scores(df: DataFrame, key: str, refs: str, ests: str, flexible: bool = False) -> DataFrame:
    """(key, ref, hyp, si_snr, snr): metrics of each reference with the estimate matched to it.

    Matched by the greatest sum of scale-invariant ratios. Numbers of references and
    estimates must agree and the query fails where they do not; with ``flexible`` the side with
    fewer is filled with signals of 1e-6.
    """
    n_r, n_e = F.size(refs), F.size(ests)
    r, e = F.col(refs), F.col(ests)
    if flexible:
        quiet = F.array_repeat(F.lit(1e-6), F.array_max(F.transform(F.concat(r, e), lambda x: F.size(x))))
        more = lambda c, n: F.concat(c, F.array_repeat(quiet, F.greatest(n, F.lit(0))))
        r, e = more(r, n_e - n_r), more(e, n_r - n_e)
    rows = df.select(F.col(key).alias("__key"), r.alias("__r"), e.alias("__e"))
    rows = rows.filter(F.assert_true(F.size("__r") == F.size("__e"), F.lit("numbers of references and estimates differ")).isNull())
    pairs = rows.select("__key", "__e", F.posexplode("__r").alias("ref", "__x")).select("__key", "ref", "__x", F.posexplode("__e").alias("hyp", "__y"))
    scored = pairs.select("__key", (F.col("ref") + 1).cast("bigint").alias("ref"), (F.col("hyp") + 1).cast("bigint").alias("hyp"), si_snr(F.col("__x"), F.col("__y")).alias("si_snr"), snr(F.col("__x"), F.col("__y")).alias("snr"))
    chosen = assignment(scored.withColumn("cost", -F.col("si_snr")), "__key", "cost")
    return scored.join(chosen, ["__key", "ref", "hyp"]).withColumnRenamed("__key", key)


def stitched_streams(df: DataFrame, sample: str, number: str, streams: str, n: int, hop: int, overlap: int, length: str) -> DataFrame:
    """(sample, stream, at, value): segments of ``n`` separated streams put together again.

    Segment k holds hop + overlap values a stream from position hop k on. Its streams come in any
    order: they are permuted to be most similar to those of the segment before over the overlap
    (the first permutation among equals); overlaps are averaged. Values beyond ``length``, which
    the last segment's padding gives, are dropped; a sample that does not reach its length fails.
    """
    perms = list(permutations(range(n)))
    w = Window.partitionBy("__s").orderBy("__k")
    rows = df.select(F.col(sample).alias("__s"), F.col(number).alias("__k"), F.col(streams).alias("cur"), F.col(length).alias("__length")).withColumn("prev", F.lag("cur").over(w))
    likeness = lambda j, i: dot(F.slice(F.get("prev", j), hop + 1, overlap), F.slice(F.get("cur", i), 1, overlap))
    table = rows.withColumn("like", F.array(*[likeness(j, i) for j in range(n) for i in range(n)]))
    # Greatest first, then the earlier permutation; a first segment has nothing to be like.
    options = F.array(*[F.struct((-sum((F.get("like", j * n + i) for j, i in enumerate(p)), F.lit(0.0))).alias("cost"), F.lit(q).alias("q"), F.array(*[F.lit(i) for i in p]).alias("p")) for q, p in enumerate(perms)])
    local = table.withColumn("own", F.when(F.col("prev").isNull(), F.array(*[F.lit(i) for i in range(n)])).otherwise(F.array_min(options)["p"]))
    # Which raw stream of each segment continues each stream of the first: permutations one after another.
    chain = local.groupBy("__s").agg(F.array_sort(F.collect_list(F.struct("__k", "own"))).alias("steps"))
    start = F.array(F.array(*[F.lit(i) for i in range(n)]))
    follow = F.aggregate("steps", start, lambda acc, x: F.concat(acc, F.array(F.transform(F.element_at(acc, -1), lambda j: F.get(x["own"], j)))))
    order = chain.select("__s", F.explode(F.arrays_zip(F.col("steps.__k").alias("k"), F.slice(follow, 2, F.size("steps")).alias("order"))).alias("z")).select("__s", F.col("z.k").alias("__k"), F.col("z.order").alias("order"))
    laid = local.select("__s", "__k", "cur", "__length").join(order, ["__s", "__k"])
    each = laid.select("__s", "__k", "cur", "__length", F.posexplode("order").alias("stream", "raw")).select("__s", "__k", "stream", "__length", F.posexplode(F.expr("get(cur, raw)")).alias("offset", "value"))
    values = each.select("__s", "stream", "__length", (F.col("__k") * hop + F.col("offset")).alias("at"), "value").filter(F.col("at") < F.col("__length"))
    joined = values.groupBy("__s", "stream", "at").agg(F.avg("value").alias("value"), F.max("__length").alias("__length"))
    reached = joined.groupBy("__s").agg(F.max("at").alias("last"), F.max("__length").alias("__length"))
    whole = reached.filter(F.assert_true(F.col("last") + 1 == F.col("__length"), F.lit("segments do not reach the length")).isNull()).select("__s")
    return joined.drop("__length").join(whole, "__s").withColumnRenamed("__s", sample)
