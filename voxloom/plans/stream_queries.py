"""Queries that run streams over all events there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.session import read_table
from voxloom.streaming import stateful as X
from voxloom.streaming import windows as E
from voxloom.streaming.runs import run_available, stream_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def events(s, d):
    return stream_table(s, d, "events")


def ended_events(s, d):
    """Events with a mark on each user's last one."""
    last = read_table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("is_final", F.lit(True))
    return events(s, d).join(last, ["user_id", "event_id"], "left").select("user_id", "event_id", "value", "is_final")


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', any_value(ts)) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'")
def tumbling_events(s, d):
    """Extension: tumbling windows that the watermark has closed."""
    out = run_available(E.tumbling_counts(events(s, d), "ts", ["event_type"], "6 hours", "10 minutes"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT user_id, ts, sum((p IS NULL OR ts - p >= INTERVAL '30 minutes')::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"
)
def session_events(s, d):
    """X4 where gaps are in time: session windows."""
    out = run_available(E.sessions(events(s, d), "ts", "user_id", "30 minutes", "10 minutes"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def distinct_events(s, d):
    """Extension: duplicates dropped within a watermark wider than the data."""
    out = run_available(E.distinct_within(events(s, d), "ts", ["user_id", "event_type"], "3650 days"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_LISTS = "v AS (SELECT user_id, list(coalesce(value, 0) ORDER BY event_id) AS v FROM events GROUP BY user_id)"


@query(
    f"WITH {_LISTS}, n AS (SELECT user_id, v, CASE WHEN len(v) < 16 THEN 1 ELSE (len(v) - 16) // 8 + 1 + ((len(v) - 16) % 8 > 0)::INT END AS n FROM v) SELECT user_id, k AS frame, round(list_sum(v[k * 8 + 1 : k * 8 + 16]), 6) AS total FROM n, unnest(range(0, n)) t(k)"
)
def overlap_buffer(s, d):
    """Frames across micro-batches, the rest at the end, the state cleared."""
    out = run_available(X.framed(ended_events(s, d), "user_id", "event_id", "value", "is_final", 16, 8))
    return out.select("user_id", "frame", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    f"""WITH {_LISTS}, p AS (SELECT user_id, len(v) AS n, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM v),
a AS (SELECT *, lag(i) OVER w AS before FROM p WHERE x > 50 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT *, sum((before IS NULL OR i - before > 3)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM a),
s AS (SELECT user_id, g, min(i) AS lo, least(max(i) + 1, max(n) - 1) AS last FROM g GROUP BY user_id, g)
SELECT user_id, greatest(lo - 2, coalesce(lag(last) OVER (PARTITION BY user_id ORDER BY g) + 1, 0)) AS first, last FROM s"""
)
def activity_segments(s, d):
    """Stretches of activity with margins."""
    return run_available(X.segmented(ended_events(s, d), "user_id", "event_id", "value", "is_final", 50.0, 3, 2, 1))


@query(f"WITH {_LISTS} SELECT user_id, len(v) AS n, round(list_sum(v[greatest(len(v) - 20 + 1, 1) : len(v)]), 6) AS total FROM v")
def accumulated_windows(s, d):
    """Values kept up to a cap until the end."""
    out = run_available(X.accumulated(ended_events(s, d), "user_id", "event_id", "value", "is_final", 20))
    return out.select("user_id", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    f"WITH {_LISTS}, b AS (SELECT user_id, v, k, CASE WHEN 12 + 8 * k < len(v) THEN 12 + 8 * k ELSE len(v) END AS e FROM v, unnest(range(0, CASE WHEN len(v) <= 12 THEN 1 ELSE (len(v) - 12 + 7) // 8 + 1 END)) t(k)) SELECT user_id, k AS block, greatest(e - 16, 0) AS first, e AS \"end\", round(list_sum(v[greatest(e - 16, 0) + 1 : e]), 6) AS total FROM b"
)
def block_steps(s, d):
    """Blocks of 16 with a hop of 8 and 4 values of look-ahead."""
    out = run_available(X.blocks(ended_events(s, d), "user_id", "event_id", "value", "is_final", 16, 8, 4))
    return out.select("user_id", "block", "first", "end", F.round("total", 6).alias("total"))


@query()
def streamed_search(s, d):
    """Block-synchronous beam search over three scores a position, an end not trusted before the last block (tested against brute force)."""
    v = F.coalesce(F.col("value"), F.lit(0.0))
    scores = F.array((v % 7) - 6, (v % 11) - 5, (v % 13) - 6)
    e = ended_events(s, d).withColumn("scores", scores)
    return run_available(X.block_search(e, "user_id", "event_id", "scores", "is_final", 16, 8, 4, beam=4))
