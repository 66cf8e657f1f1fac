"""Queries on mini-batch planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import batching as B
from voxloom.plans.relation_queries import CHAR_SHAPES, TRAIN_SHAPES, shape_sql, shapes

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def items(s, d):
    """(uttid, ilen, olen) of utterances with two usable shapes."""
    a = shapes(s, d, TRAIN_SHAPES).filter("size(shape) > 0").select("uttid", F.element_at("shape", 1).alias("ilen"))
    b = shapes(s, d, CHAR_SHAPES).filter("size(shape) > 0").select("uttid", F.element_at("shape", 1).alias("olen"))
    return a.join(b, "uttid").filter("ilen > 0 and olen > 0")


_ITEMS = f"{shape_sql('a', TRAIN_SHAPES)}, {shape_sql('b', CHAR_SHAPES)}, it AS (SELECT uttid, a.shape[1] AS ilen, b.shape[1] AS olen FROM a JOIN b USING (uttid) WHERE len(a.shape) > 0 AND len(b.shape) > 0 AND a.shape[1] > 0 AND b.shape[1] > 0)"
_ORD = "o AS (SELECT *, row_number() OVER (ORDER BY ilen, uttid) AS i FROM it), l AS (SELECT list(uttid ORDER BY i) AS u, list(ilen ORDER BY i) AS a, list(olen ORDER BY i) AS b FROM o)"


def _folded_sql(open_: str, stays: str, grown: str) -> str:
    """A recursive fold over the sorted items: state (n, x, y)."""
    return f"""WITH RECURSIVE {_ITEMS}, {_ORD},
f(i, batch, n, x, y) AS (
  SELECT 1::BIGINT, 0::BIGINT, 1::BIGINT, {open_} FROM (SELECT a, b, 1::BIGINT AS i FROM l) WHERE len(a) > 0
  UNION ALL
  SELECT i, CASE WHEN stays THEN batch ELSE batch + 1 END, CASE WHEN stays THEN n + 1 ELSE 1 END, CASE WHEN stays THEN gx ELSE ox END, CASE WHEN stays THEN gy ELSE oy END
  FROM (SELECT f.i + 1 AS i, batch, n, {stays} AS stays, {grown} FROM f, l WHERE f.i < len(l.a)))
SELECT l.u[f.i] AS uttid, batch FROM f, l"""


@query(f"WITH {_ITEMS}, o AS (SELECT uttid, row_number() OVER (ORDER BY uttid) - 1 AS r, count(*) OVER () AS n FROM it) SELECT uttid, CAST(((r + 1) * greatest(n // 16, 1) - 1) // n AS BIGINT) AS batch FROM o")
def batch_unsorted(s, d):
    """B1."""
    return B.even_batches(items(s, d), 16, ["uttid"]).select("uttid", "batch")


@query(f"WITH {_ITEMS}, o AS (SELECT uttid, row_number() OVER (ORDER BY ilen DESC, uttid) - 1 AS r, count(*) OVER () AS n FROM it) SELECT uttid, r // 16 AS batch FROM o WHERE r // 16 < n // 16")
def batch_sorted(s, d):
    """B2: by length, the rest dropped."""
    return B.build_batches("sorted", items(s, d), size=16, order=[F.desc("ilen"), F.col("uttid")], drop_last=True).select("uttid", "batch")


_SIZE = "greatest(1, 64 // (1 + greatest(l.a[{i}] // 200, l.b[{i}] // 80)))"


@query(_folded_sql(_SIZE.replace("l.", "").format(i="i") + ", 0::BIGINT", "n < x", f"x AS gx, y AS gy, {_SIZE.format(i='f.i + 1')} AS ox, 0::BIGINT AS oy"))
def batch_folded(s, d):
    """The size falls with the length of the first item."""
    return B.folded_batches(items(s, d), ["ilen", "olen"], [200, 80], 64, [F.col("ilen"), F.col("uttid")]).select("uttid", "batch")


_GROW = "greatest(x, l.a[f.i + 1]) AS gx, greatest(y, l.b[f.i + 1]) AS gy, l.a[f.i + 1] AS ox, l.b[f.i + 1] AS oy"


@query(_folded_sql("a[1], b[1]", "NOT (n * (x + y) > 20000 AND n >= 2)", _GROW))
def batch_length_bins(s, d):
    """Closed by the item that exceeds the bins."""
    return B.length_batches(items(s, d), ["ilen", "olen"], 20000, [F.col("ilen"), F.col("uttid")], least=2).select("uttid", "batch")


@query(_folded_sql("a[1], b[1]", "NOT (n * (x * 80 + y * 48) > 1500000)", _GROW))
def batch_numel(s, d):
    """Lengths times feature widths."""
    return B.numel_batches(items(s, d), ["ilen", "olen"], [80, 48], 1500000, [F.col("ilen"), F.col("uttid")]).select("uttid", "batch")


@query(_folded_sql("a[1], b[1]", "(n + 1) * (greatest(x, l.a[f.i + 1]) * 80 + greatest(y, l.b[f.i + 1]) * 48) <= 1500000", _GROW))
def batch_by_bin(s, d):
    """Closed before the item that would exceed the bins."""
    return B.bin_batches(items(s, d), "ilen", "olen", 80, 48, 1500000, [F.col("ilen"), F.col("uttid")]).select("uttid", "batch")


@query(_folded_sql("a[1], b[1]", "(n + 1) * greatest(x, l.a[f.i + 1]) <= 20000 AND (n + 1) * greatest(y, l.b[f.i + 1]) <= 4000", _GROW))
def batch_by_frame(s, d):
    """Limits on the frames of both sides."""
    return B.frame_batches(items(s, d), "ilen", "olen", 20000, 4000, 0, [F.col("ilen"), F.col("uttid")]).select("uttid", "batch")


@query(f"WITH {_ITEMS}, o AS (SELECT uttid, row_number() OVER (ORDER BY ilen, uttid) - 1 AS r, count(*) OVER () AS n FROM it), q AS (SELECT *, n // 100 AS full_, n % 100 AS rest FROM o) SELECT uttid, CASE WHEN rest = 0 OR rest >= 100 OR full_ = 0 THEN r // 100 WHEN rest <= full_ AND r < (full_ - rest) * 100 THEN r // 100 WHEN rest <= full_ THEN full_ - rest + (r - (full_ - rest) * 100) // 101 WHEN r < (rest % full_ = 0)::INT * 0 + (full_ - rest % full_) * (100 + rest // full_) THEN r // (100 + rest // full_) ELSE full_ - rest % full_ + (r - (full_ - rest % full_) * (100 + rest // full_)) // (101 + rest // full_) END AS batch FROM q")
def batch_tail_spread(s, d):
    """A short last batch is spread over those before it."""
    return B.spread_tail(B.fixed_batches(items(s, d), 100, [F.col("ilen"), F.col("uttid")]).drop("ordinal"), 100, [F.col("ilen"), F.col("uttid")]).select("uttid", "batch")


# The second input's place holds the number of the category, which begins a batch where it changes.
_BY_CATEGORY = _folded_sql("a[1], b[1]", "NOT (n * x > 20000) AND y = l.b[f.i + 1]", "greatest(x, l.a[f.i + 1]) AS gx, y AS gy, l.a[f.i + 1] AS ox, l.b[f.i + 1] AS oy").replace(
    _ORD, "o AS (SELECT *, dense_rank() OVER (ORDER BY split_part(uttid, '-', 1)) AS c, row_number() OVER (ORDER BY split_part(uttid, '-', 1), ilen, uttid) AS i FROM it), l AS (SELECT list(uttid ORDER BY i) AS u, list(ilen ORDER BY i) AS a, list(c ORDER BY i) AS b FROM o)"
)


@query(f"SELECT uttid, split_part(uttid, '-', 1) AS cat, batch FROM ({_BY_CATEGORY})")
def batch_by_category(s, d):
    """Batches within categories (the corpus code)."""
    rows = items(s, d).withColumn("cat", F.element_at(F.split("uttid", "-"), 1))
    return B.length_batches(rows, ["ilen"], 20000, [F.col("ilen"), F.col("uttid")], category="cat").select("uttid", "cat", "batch")
