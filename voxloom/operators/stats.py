"""Feature statistics, normalisation and metric aggregation.

Sums are exact up to the order of addition; aggregation is partial on every partition, so a
group with a third of all rows shuffles one partial row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.arrays import let

EPS = 1e-20


def feature_stats(df: DataFrame, feats: str, by: list[str] | None = None) -> DataFrame:
    """(by..., pos, n, total, squares): count, sum and sum of squares of each dimension. Null elements do not count."""
    by = by or []
    x = F.col("x").cast("double")
    return df.select(*by, F.posexplode(feats).alias("pos", "x")).filter("x is not null").groupBy(*by, "pos").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def merge_stats(partials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Final statistics from persisted partial ones."""
    return partials.groupBy(*(by or []), "pos").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def moments(stats: DataFrame, by: list[str] | None = None, floor_on: str = "std") -> DataFrame:
    """(by..., mean, std): arrays over dimensions. The floor EPS is on the deviation (``std``) or the variance (``var``).

    A variance that rounding makes negative counts as zero.
    """
    mean = F.col("total") / F.col("n")
    var = F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))
    std = F.greatest(F.sqrt(var), F.lit(EPS)) if floor_on == "std" else F.sqrt(F.greatest(var, F.lit(EPS)))
    per = stats.select(*(by or []), "pos", mean.alias("m"), std.alias("s"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
    agg = per.groupBy(*by).agg(packed.alias("p")) if by else per.agg(packed.alias("p"))
    return agg.select(*(by or []), F.col("p.m").alias("mean"), F.col("p.s").alias("std"))


def normalise(df: DataFrame, feats: str, stats: DataFrame, by: list[str] | None = None, norm_mean: bool = True, norm_var: bool = True, reverse: bool = False) -> DataFrame:
    """Replaces ``feats`` by its normalised (or, reversed, its original) values.

    Without ``by`` the statistics are one row, which is broadcast; with it they join by key.
    """
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))
    x = F.col(feats)
    if reverse:
        if norm_var:
            x = F.zip_with(x, "std", lambda a, b: a * b)
        if norm_mean:
            x = F.zip_with(x, "mean", lambda a, b: a + b)
    else:
        if norm_mean:
            x = F.zip_with(x, "mean", lambda a, b: a - b)
        if norm_var:
            x = F.zip_with(x, "std", lambda a, b: a / b)
    return joined.withColumn(feats, x).drop("mean", "std")


def row_normalise(feats: Column, norm_var: bool = True, floor: float = EPS) -> Column:
    """One array by its own mean and deviation (floor on the variance)."""
    n = F.size(feats)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(feats, F.lit(0.0), lambda a, x: a + x * x)
    std = lambda m: F.sqrt(F.greatest(squares / n - m * m, F.lit(floor))) if norm_var else F.lit(1.0)
    made = let(total(feats) / n, lambda m: F.struct(m.alias("m"), std(m).alias("s")))
    return let(made, lambda p: F.transform(feats, lambda x: (x - p["m"]) / p["s"]))


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def metric_average(v: Column) -> Column:
    """Mean without NaN (infinities stay); NaN if nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(float("nan")))


def metric_weighted(v: Column, w: Column) -> Column:
    """Weighted mean over rows in which value and weight are finite; NaN if the weights sum to zero."""
    ok = finite(v).isNotNull() & finite(w).isNotNull()
    total = F.sum(F.when(ok, w))
    return F.when(total != 0, F.sum(F.when(ok, v * w)) / total).otherwise(F.lit(float("nan")))


def align_steps(df: DataFrame, step: str, metric: str, value: str) -> DataFrame:
    """(step, metric, value) for every step and metric; NaN where a metric was not reported. The first of repeated reports by value counts."""
    one = df.groupBy(step, metric).agg(F.min(value).alias(value))
    grid = one.select(step).distinct().join(F.broadcast(one.select(metric).distinct()), how="cross")  # metrics are few by nature
    return grid.join(one, [step, metric], "left").withColumn(value, F.coalesce(value, F.lit(float("nan"))))


def perplexity(df: DataFrame, nll: str, n: str, by: list[str] | None = None) -> DataFrame:
    """exp(sum of NLL / sum of tokens), overall or by group; null without tokens."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.when(F.sum(n) > 0, F.exp(F.sum(nll) / F.sum(n))).alias("ppl"))


def real_time_factor(df: DataFrame, decode: str, audio: str) -> DataFrame:
    """One row: seconds decoded and heard, their ratio, and milliseconds an item; 0 where nothing was heard."""
    d, a, n = F.coalesce(F.sum(decode), F.lit(0.0)), F.coalesce(F.sum(audio), F.lit(0.0)), F.count("*")
    return df.agg(a.alias("audio_s"), d.alias("decode_s"), F.when(a > 0, d / a).otherwise(0.0).alias("rtf"), F.when(n > 0, 1000 * d / n).otherwise(0.0).alias("latency_ms"))


def classification_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1); undefined ratios are 0."""
    t = df.filter(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"), F.sum((F.col(truth) == F.col(guess)).cast("bigint")).alias("tp"))
    g = df.filter(F.col(guess).isNotNull()).groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("n_guess"))
    j = t.join(g, "label", "full").na.fill(0)
    p = F.when(F.col("n_guess") > 0, F.col("tp") / F.col("n_guess")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    out = j.select("label", "tp", (F.col("n_guess") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def diarization_counts(frames: DataFrame) -> DataFrame:
    """One row of counters and the error rate over frames (n_ref, n_sys, n_map): speakers active in truth, system, both."""
    miss, fa = F.greatest(F.col("n_ref") - F.col("n_sys"), F.lit(0)), F.greatest(F.col("n_sys") - F.col("n_ref"), F.lit(0))
    conf = F.least("n_ref", "n_sys") - F.col("n_map")
    s = frames.agg(F.sum("n_ref").alias("scored"), F.sum(miss).alias("miss"), F.sum(fa).alias("false_alarm"), F.sum(conf).alias("confusion"))
    return s.withColumn("der", F.when(F.col("scored") > 0, (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("scored")))


def average_parameters(df: DataFrame, feats: str, by: list[str], whole: Column) -> DataFrame:
    """(by..., pos, value): mean over models; parameters of whole numbers (``whole``) are summed."""
    x = df.select(*by, whole.alias("w"), F.posexplode(feats).alias("pos", "x"))
    return x.groupBy(*by, "pos").agg(F.when(F.max("w"), F.sum("x")).otherwise(F.avg("x")).alias("value"))


def assign_centroids(df: DataFrame, key: str, feats: str, centroids: DataFrame, cid: str, centre: str) -> DataFrame:
    """(key, cid): the nearest centroid by x.x - 2 x.c + c.c, the least id among equals.

    The centroids are one row of k vectors (k is a parameter of the model), broadcast and
    searched row by row, so no pair of rows is ever shuffled.
    """
    book = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(cid).alias("c"), F.col(centre).alias("v")))).alias("__book"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = F.transform(feats, lambda v: v.cast("double"))
    scored = F.transform("__book", lambda b: F.struct((dot(b["v"], b["v"]) - 2 * dot(x, b["v"])).alias("d"), b["c"].alias("c")))
    return df.crossJoin(F.broadcast(book)).select(key, F.array_min(scored)["c"].alias(cid))


def fit_kmeans(df: DataFrame, feats: str, k: int, seed: int):
    """A k-means model (pyspark.ml) over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector(F.transform(feats, lambda v: v.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features").fit(vectors)


def running_best(df: DataFrame, epoch: str, value: str, patience: int, least: bool = True) -> DataFrame:
    """Adds the best epoch so far (the earliest among equals) and ``stop``: more than ``patience`` epochs ago.

    One row per epoch is expected, so the order is small.
    """
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(F.col(value) if least else -F.col(value), F.col(epoch))
    best = F.min_by(epoch, F.when(~F.isnan(value), key)).over(w)
    return df.withColumn("best_epoch", best).withColumn("stop", F.col(epoch) - F.col("best_epoch") > patience)
