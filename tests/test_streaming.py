import os

from pyspark.sql import functions as F

from voxloom.streaming import stateful as X
from voxloom.streaming.runs import run_available


def _stream(spark, folder, batches):
    schema = "k string, seq bigint, v double, fin boolean"
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        os.utime(f"{folder}/{i}", (i + 1, i + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_frames_across_batches(spark, tmp_path):
    rows = [("a", i, float(i), i == 9) for i in range(10)] + [("b", 0, None, True)]
    s = _stream(spark, str(tmp_path / "in"), [rows[:3], rows[3:7], rows[7:]])
    out = sorted((r.k, r.frame, list(r["values"])) for r in run_available(X.framed(s, "k", "seq", "v", "fin", 4, 2)).collect())
    assert out == [("a", 0, [0, 1, 2, 3]), ("a", 1, [2, 3, 4, 5]), ("a", 2, [4, 5, 6, 7]), ("a", 3, [6, 7, 8, 9]), ("b", 0, [0, 0, 0, 0])]


def test_segments_and_restart(spark, tmp_path):
    values = [0, 0, 9, 9, 0, 9, 0, 0, 0, 0, 9, 0]
    rows = [("a", i, float(v), i == 11) for i, v in enumerate(values)] + [("a", 12, 9.0, True)]
    s = _stream(spark, str(tmp_path / "in"), [rows[:6], rows[6:]])
    out = sorted((r.first, r.last) for r in run_available(X.segmented(s, "k", "seq", "v", "fin", 5.0, 3, 1, 1)).select(F.col("first"), F.col("last")).collect())
    assert out == [(0, 0), (1, 6), (9, 11)]


def test_capped_accumulation(spark, tmp_path):
    s = _stream(spark, str(tmp_path / "in"), [[("a", i, float(i), i == 5) for i in range(6)]])
    r = run_available(X.accumulated(s, "k", "seq", "v", "fin", 3)).first()
    assert r.n == 6 and list(r["values"]) == [3, 4, 5]
