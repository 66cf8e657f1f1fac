"""Reading tables as streams, and running a stream over what there is to a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxloom.session import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream over one table, a file or a folder of files; timestamps without zone become timestamps."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    zoneless = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoneless})


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and reads its output back from the shared folder."""
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start()
    else:  # each batch is a full (complete) or changed (update) state; the last complete one counts

        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
