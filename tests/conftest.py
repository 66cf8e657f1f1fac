import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from voxloom.session import builder

    # No coalescing, so that small tables still lie in several partitions.
    s = builder("local[4]", 4).config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


@pytest.fixture(scope="session")
def tables():
    """A DuckDB connection with the smallest tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, tables):
    """Compares a query with its SQL at the smallest scale, columns by name, rows as multisets."""

    def compare(f, sql: str):
        df = f(spark, str(DATA / "sf0.001"))
        cols = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
        rel = tables.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
        assert got == want

    return compare
