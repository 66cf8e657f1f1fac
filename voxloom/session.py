"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """Session settings the engine is tuned for; a cluster overrides master and sizes."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if (here := sc.getCheckpointDir()) is not None:
        return here
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxloom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; partitions and their order stay as they are."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table: columnar and compressed, for wide or reused rows."""
    return cut_table_at(df)[0]


def cut_table_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table and its path, for ``drop_table``."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class CacheBudget:
    """Keeps tables in memory while their estimated sizes stay below a limit; there is no eviction.

    The estimate is the optimiser's for the table's plan, so nothing runs to get it. A table
    that does not fit is given back as it is and computed where it is read.
    """

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0

    def keep(self, df: DataFrame) -> DataFrame:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if self.used + size > self.limit:
            return df
        self.used += size
        return df.persist()
