"""Dense positions in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut


def global_index(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """Adds a dense 0-based position by ``order``, which should be total (end it with a key).

    Range partitions are sorted where they are; each row's position is its place in its
    partition plus the sizes of the partitions before, a broadcast table of one row per
    partition. The checkpoint keeps the partitions the same for both reads.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    pid, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(pid.alias("__pid")).agg(F.count("*").alias("__n"))
    before = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    joined = ordered.withColumn("__pid", pid).join(F.broadcast(before), "__pid")
    return joined.withColumn(name, F.col("__before") + place).drop("__pid", "__before", "__at")


def seeded_order(key: str, seed: int | Column) -> list[Column]:
    """A reproducible pseudo-random order: MD5 of key and seed, then the key."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), s.cast("string"))), F.col(key)]
