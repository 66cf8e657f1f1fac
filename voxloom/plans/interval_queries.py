"""Queries on the time intervals of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.intervals import merge_intervals
from voxloom.operators.versions import current_version
from voxloom.session import read_table

LONGEST_GAP_MS = 3_600_000


def current_intervals(spark: SparkSession, d: str) -> DataFrame:
    seg = current_version(read_table(spark, d, "segments"), ["uttid"], keep=["recid", "starttime", "endtime"])
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return seg.select("uttid", "recid", ms("starttime").alias("start_ms"), ms("endtime").alias("end_ms"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every period and every gap of each recording, single-utterance periods included."""
    return merge_intervals(current_intervals(spark, d), "recid", "start_ms", "end_ms").select(
        "kind", F.col("entity").alias("recid"), F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"), F.col("n").alias("n_utts")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keep = ((F.col("kind") == "period") & (F.col("n_utts") >= 2)) | ((F.col("kind") == "gap") & (F.col("end_ms") - F.col("start_ms") <= LONGEST_GAP_MS))
    return p3_periods(spark, d).filter(keep).select("kind", "recid", "start_ms", "end_ms")


_ISLANDS = """
WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at DESC NULLS LAST, recid DESC NULLS LAST, starttime DESC NULLS LAST, endtime DESC NULLS LAST) AS rn
                 FROM segments WHERE uttid IS NOT NULL) WHERE rn = 1),
ms AS (
  SELECT recid, CAST(round(starttime * 1000) AS BIGINT) AS s, CAST(round(endtime * 1000) AS BIGINT) AS e
  FROM cur WHERE recid IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL),
seen AS (
  SELECT *, max(e) OVER (PARTITION BY recid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ms WHERE e > s),
lab AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY recid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
per AS (
  SELECT recid, island, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n_utts FROM lab GROUP BY recid, island),
gap AS (
  SELECT recid, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY recid ORDER BY start_ms) AS end_ms FROM per)
"""

QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}
ORACLE = {
    "p3_found": _ISLANDS + """
SELECT 'period' AS kind, recid, start_ms, end_ms FROM per WHERE n_utts >= 2
UNION ALL SELECT 'gap' AS kind, recid, start_ms, end_ms FROM gap WHERE end_ms IS NOT NULL AND end_ms - start_ms <= 3600000""",
    "p3_periods": _ISLANDS + """
SELECT 'period' AS kind, recid, start_ms, end_ms, CAST(n_utts AS BIGINT) AS n_utts FROM per
UNION ALL SELECT 'gap' AS kind, recid, start_ms, end_ms, CAST(0 AS BIGINT) AS n_utts FROM gap WHERE end_ms IS NOT NULL""",
}
