"""Utterance records in JSON: {"utts": {id: {"input": [...], "output": [...], ...}}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<name:string, feat:string, filetype:string, shape:array<bigint>, text:string, token:string, tokenid:string>"
RECORD = f"struct<input:array<{PART}>, output:array<{PART}>, utt2spk:string, lang:string>"


def read_json_utts(spark: SparkSession, path: str) -> DataFrame:
    """(uttid, input, output, utt2spk, lang) of files with one object each; fields that are missing are null."""
    whole = spark.read.text(path, wholetext=True)
    utts = F.from_json("value", f"struct<utts: map<string, {RECORD}>>", {"mode": "FAILFAST"})["utts"]
    return whole.select(F.explode(utts).alias("uttid", "r")).select("uttid", "r.*")


def join_payloads(utts: DataFrame, payloads: DataFrame) -> DataFrame:
    """(uttid, name, side, payload...) of the parts of each utterance joined to rows (feat, ...) by path."""
    sides = [utts.select("uttid", F.lit(s).alias("side"), F.explode(s).alias("p")).select("uttid", "side", "p.name", "p.feat") for s in ("input", "output")]
    return sides[0].union(sides[1]).join(payloads, "feat")
