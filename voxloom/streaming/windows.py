"""Event-time windows with watermarks. An extension: the engine's other operators need no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """(start, end, by..., n, total of value): events later than ``late`` behind the newest are dropped."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): activity with no pause of ``gap``."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first event of equal keys among those within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
