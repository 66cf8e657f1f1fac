"""Queries on statistics, normalisation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import stats as A
from voxloom.plans.relation_queries import SPEAKERS, TEXTS, segments, speakers, texts
from voxloom.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


_LONG = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_MOM = "m AS (SELECT pos, sum(x) / count(*) AS mean, greatest(sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) ** 2, 0)), 1e-20) AS std FROM x GROUP BY pos)"


@query(f"WITH {_LONG} SELECT pos, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM x GROUP BY pos")
def cmvn_global(s, d):
    """A1, A2: statistics of each dimension, merged from partial ones."""
    e = read_table(s, d, "embeddings")
    parts = A.feature_stats(e.withColumn("job", F.col("vec_id") % 8), "embedding", ["job"])
    return A.merge_stats(parts).select("pos", "n", r6("total").alias("total"), r6("squares").alias("squares"))


@query(f"WITH {_LONG} SELECT label, pos, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM x GROUP BY label, pos")
def cmvn_by_label(s, d):
    """A3: statistics by speaker."""
    return A.feature_stats(read_table(s, d, "embeddings"), "embedding", ["label"]).select("label", "pos", "n", r6("total").alias("total"), r6("squares").alias("squares"))


@query(f"WITH {_LONG}, {_MOM} SELECT vec_id, list(round((x - mean) / std, 6) ORDER BY pos) AS feats FROM x JOIN m USING (pos) GROUP BY vec_id")
def mvn_apply(s, d):
    """M1, M3: global normalisation."""
    e = read_table(s, d, "embeddings")
    return A.normalise(e, "embedding", A.moments(A.feature_stats(e, "embedding"))).select("vec_id", F.transform("embedding", r6).alias("feats"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS feats FROM embeddings")
def mvn_inverse(s, d):
    """M3: normalised by label and back."""
    e = read_table(s, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    m = A.moments(A.feature_stats(e, "embedding", ["label"]), ["label"], floor_on="var")
    there = A.normalise(e, "embedding", m, ["label"])
    return A.normalise(there, "embedding", m, ["label"], reverse=True).select("vec_id", F.transform("embedding", r6).alias("feats"))


@query(f"WITH {_LONG}, m AS (SELECT vec_id, avg(x) AS mean, sqrt(greatest(sum(x * x) / count(*) - avg(x) ** 2, 1e-20)) AS std FROM x GROUP BY vec_id) SELECT vec_id, list(round((x - mean) / std, 6) ORDER BY pos) AS feats FROM x JOIN m USING (vec_id) GROUP BY vec_id")
def utterance_mvn(s, d):
    """M2, M4: each row by its own mean and deviation."""
    e = read_table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return e.select("vec_id", F.transform(A.row_normalise(F.col("x")), r6).alias("feats"))


@query(
    "SELECT event_type, round(avg(CASE WHEN event_id % 17 <> 0 THEN value END), 6) AS mean, round(sum(CASE WHEN event_id % 17 <> 0 THEN value * (event_id % 5) END) / nullif(sum(CASE WHEN event_id % 17 <> 0 THEN event_id % 5 END), 0), 6) AS weighted FROM events WHERE value IS NOT NULL GROUP BY event_type"
)
def weighted_metric_mean(s, d):
    """Means that leave NaN out."""
    v = F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value"))
    e = read_table(s, d, "events").filter("value is not null").withColumn("v", v).withColumn("w", (F.col("event_id") % 5).cast("double"))
    return e.groupBy("event_type").agg(r6(A.metric_average(F.col("v"))).alias("mean"), r6(A.metric_weighted(F.col("v"), F.col("w"))).alias("weighted"))


@query(
    "WITH r AS (SELECT event_id // 4 AS step, event_type AS metric, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), g AS (SELECT DISTINCT r.step, m.metric FROM r, (SELECT DISTINCT metric FROM r) m) SELECT step, metric, coalesce(value::VARCHAR, 'nan') AS value FROM g LEFT JOIN r USING (step, metric) WHERE value IS NULL"
)
def aligned_steps(s, d):
    """A5: the steps at which a metric is missing."""
    e = read_table(s, d, "events").filter("value is not null").select(F.floor(F.col("event_id") / 4).alias("step"), F.col("event_type").alias("metric"), "value")
    return A.align_steps(e, "step", "metric", "value").filter(F.isnan("value")).select("step", "metric", F.lit("nan").alias("value"))


@query("SELECT event_type, round(exp(sum(value) / sum(100 + event_id % 50)), 6) AS ppl FROM events WHERE value IS NOT NULL GROUP BY event_type")
def perplexity_by_type(s, d):
    """A8."""
    e = read_table(s, d, "events").filter("value is not null").withColumn("n", 100 + F.col("event_id") % 50)
    return A.perplexity(e, "value", "n", ["event_type"]).select("event_type", r6("ppl").alias("ppl"))


@query("WITH s AS (SELECT endtime - starttime AS audio FROM segments WHERE endtime > starttime) SELECT round(sum(audio), 4) AS audio_s, round(sum(audio * 1.5), 4) AS decode_s, round(sum(audio * 1.5) / sum(audio), 6) AS rtf, round(1000 * sum(audio * 1.5) / count(*), 4) AS latency_ms FROM s")
def decoding_rtf(s, d):
    """A9."""
    seg = read_table(s, d, "segments").filter("endtime > starttime").select((F.col("endtime") - F.col("starttime")).alias("audio"))
    out = A.real_time_factor(seg.withColumn("decode", F.col("audio") * 1.5), "decode", "audio")
    return out.select(F.round("audio_s", 4).alias("audio_s"), F.round("decode_s", 4).alias("decode_s"), r6("rtf").alias("rtf"), F.round("latency_ms", 4).alias("latency_ms"))


_GUESS = "CASE WHEN regexp_matches(text, '[а-я]') THEN 'ru' WHEN regexp_matches(text, '[あ-ん]') THEN 'ja' WHEN regexp_matches(text, '[äöü]') THEN 'de' WHEN regexp_matches(text, '[áñ]') THEN 'es' WHEN regexp_matches(text, '[èêîç]') THEN 'fr' ELSE 'en' END"


def _guessed(s, d):
    c = F.col("text")
    g = F.when(c.rlike("[а-я]"), "ru").when(c.rlike("[あ-ん]"), "ja").when(c.rlike("[äöü]"), "de").when(c.rlike("[áñ]"), "es").when(c.rlike("[èêîç]"), "fr").otherwise("en")
    return read_table(s, d, "documents").filter("text is not null and lang is not null").select("lang", g.alias("guess"))


@query(f"SELECT round(avg(CASE WHEN lang = {_GUESS} THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def language_accuracy(s, d):
    """A10."""
    return _guessed(s, d).agg(F.round(F.avg((F.col("lang") == F.col("guess")).cast("double")), 9).alias("accuracy"), F.count("*").alias("n"))


@query(
    f"WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), l AS (SELECT lang AS label FROM g UNION SELECT guess FROM g), c AS (SELECT label, (SELECT count(*) FROM g WHERE lang = label AND guess = label) AS tp, (SELECT count(*) FROM g WHERE guess = label AND lang <> label) AS fp, (SELECT count(*) FROM g WHERE lang = label AND guess <> label) AS fn FROM l) SELECT label, tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c"
)
def language_report(s, d):
    """A11."""
    return A.classification_report(_guessed(s, d), "lang", "guess").select("label", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most, count(*) AS n FROM documents GROUP BY lang")
def length_summary(s, d):
    """Mean, population deviation and extremes."""
    return read_table(s, d, "documents").groupBy("lang").agg(r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_pop("n_chars")).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count("*").alias("n"))


@query(f"WITH {_LONG} SELECT label, pos, round(CASE WHEN label % 2 = 0 THEN sum(x) ELSE avg(x) END, 6) AS value FROM x GROUP BY label, pos")
def averaged_parameters(s, d):
    """Means over models, whole parameters summed."""
    e = read_table(s, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return A.average_parameters(e, "embedding", ["label"], F.col("label") % 2 == 0).select("label", "pos", r6("value").alias("value"))


@query(
    f"WITH {_LONG}, c AS (SELECT label AS cid, pos, avg(x) AS c FROM x GROUP BY label, pos), d AS (SELECT vec_id, cid, round(sum(c * c) - 2 * sum(x * c), 9) AS d FROM x JOIN c USING (pos) GROUP BY vec_id, cid) SELECT vec_id, arg_min(cid, d) AS cid FROM d GROUP BY vec_id"
)
def kmeans_assign(s, d):
    """The nearest of given centroids."""
    e = read_table(s, d, "embeddings")
    st = A.moments(A.feature_stats(e, "embedding", ["label"]), ["label"]).select(F.col("label").alias("cid"), F.col("mean").alias("centre"))
    return A.assign_centroids(e, "vec_id", "embedding", st, "cid", "centre")


@query()
def kmeans_sizes(s, d):
    """A fitted model's cluster sizes (rows only: the fit is iterative)."""
    e = read_table(s, d, "embeddings")
    model = A.fit_kmeans(e, "embedding", 8, 1)
    centres = s.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cid int, centre array<double>")
    return A.assign_centroids(e, "vec_id", "embedding", centres, "cid", "centre").groupBy("cid").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_of_lines(s, d):
    """Grouping sets, as an extra."""
    return read_table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))


@query(
    f"WITH {TEXTS}, {SPEAKERS} SELECT spk, count(*) AS n_utts, sum(length(text)) AS chars, count(DISTINCT text) AS n_texts FROM spk JOIN txt USING (uttid) GROUP BY spk"
)
def speaker_summary(s, d):
    """A3's grouping by speaker on text lengths."""
    return speakers(s, d).join(texts(s, d), "uttid").groupBy("spk").agg(F.count("*").alias("n_utts"), F.sum(F.length("text")).alias("chars"), F.count_distinct("text").alias("n_texts"))


@query(
    "WITH e AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) // 7 AS epoch, avg(o_totalprice) AS v FROM orders GROUP BY 1), o AS (SELECT epoch, v FROM e), b AS (SELECT epoch, arg_min(epoch, v) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM o) SELECT epoch, best_epoch, epoch - best_epoch > 3 AS stop FROM b"
)
def early_stopping(s, d):
    """Epochs since the best so far."""
    o = read_table(s, d, "orders").groupBy(F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")) / 7).alias("epoch")).agg(F.avg("o_totalprice").alias("v"))
    return A.running_best(o, "epoch", "v", 3).select("epoch", "best_epoch", "stop")


_FRAMES = "f AS (SELECT recid, unnest(range(CAST(floor(starttime * 2) AS BIGINT), CAST(floor(endtime * 2) AS BIGINT))) AS frame, uttid FROM segments WHERE endtime > starttime AND recid IS NOT NULL AND uttid IS NOT NULL)"


@query(
    f"WITH {_FRAMES}, u AS (SELECT DISTINCT recid, frame, uttid, md5(uttid) < '8' AS sys FROM f), n AS (SELECT recid, frame, count(*) AS n_ref, count(*) FILTER (WHERE sys) AS n_sys FROM u GROUP BY ALL) SELECT sum(n_ref) AS scored, sum(greatest(n_ref - n_sys, 0)) AS miss, sum(greatest(n_sys - n_ref, 0)) AS false_alarm, sum(least(n_ref, n_sys) - n_sys) AS confusion, round(sum(greatest(n_ref - n_sys, 0) + greatest(n_sys - n_ref, 0)) / sum(n_ref), 9) AS der FROM n"
)
def diarization_error(s, d):
    """Error counters over frames of half a second; the system misses about half of the utterances."""
    seg = read_table(s, d, "segments").filter("endtime > starttime and recid is not null and uttid is not null")
    lo, hi = F.floor(F.col("starttime") * 2), F.floor(F.col("endtime") * 2)
    f = seg.filter(hi > lo).select("recid", "uttid", F.explode(F.sequence(lo, hi - 1)).alias("frame")).distinct()
    n_sys = F.count_if(F.md5("uttid") < "8")
    n = f.groupBy("recid", "frame").agg(F.count("*").alias("n_ref"), n_sys.alias("n_sys"), n_sys.alias("n_map"))
    return A.diarization_counts(n).withColumn("der", F.round("der", 9))
