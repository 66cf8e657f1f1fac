"""Current version of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_version(df: DataFrame, keys: list[str], order: str = "loaded_at", keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (nulls lowest).

    Rows with a null in a key are dropped, as they name nothing. Ties of ``order`` are
    resolved by the remaining kept columns, so the result does not depend on row order.
    ``row_number() <= 1`` lets Spark cut every partition to one row per key before the
    shuffle (WindowGroupLimit), so a key with a third of all rows does not become one task.
    """
    keep = keep or [c for c in df.columns if c not in keys and c != order]
    ties = [F.col(c).desc_nulls_last() for c in keep]
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *ties)
    return (
        df.select(*keys, order, *keep)
        .filter(known)
        .withColumn("__rank", F.row_number().over(w))
        .filter("__rank = 1")
        .drop("__rank")
    )
