"""Queries on frames, windows, islands, chunks and array transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import arrays as M
from voxloom.operators import sequence as W
from voxloom.operators.batching import greedy_groups
from voxloom.plans.relation_queries import SEGMENTS, TEXTS, segments, texts
from voxloom.plans.text_queries import WORDS
from voxloom.session import read_table

QUERIES, ORACLE = {}, {}
R6 = lambda v: F.round(v, 6)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def signals(s, d):
    return read_table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_X} SELECT vec_id, i AS frame, round(list_sum(x[i * 4 + 1 : i * 4 + 16]), 6) AS total FROM x, unnest(range(0, (len(x) - 16) // 4 + 1)) t(i)")
def framing(s, d):
    """Frames of 16 every 4."""
    f = signals(s, d).select("vec_id", F.posexplode(W.frames(F.col("x"), 16, 4)).alias("frame", "f"))
    return f.select("vec_id", F.col("frame").cast("bigint").alias("frame"), R6(F.aggregate("f", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(
    f"WITH {_X}, f AS (SELECT vec_id, i, list_sum(list_transform(x[i * 4 + 1 : i * 4 + 8], lambda v: v * v)) / 8 AS p FROM x, unnest(range(0, (len(x) - 8) // 4 + 1)) t(i)) SELECT vec_id, i AS frame, p > 0.5 * avg(p) OVER (PARTITION BY vec_id) AS voiced FROM f"
)
def voice_activity(s, d):
    """Frames above half of the mean power."""
    f = signals(s, d).select("vec_id", F.posexplode(W.voiced_frames(F.col("x"), 8, 4, 0.5)).alias("frame", "voiced"))
    return f.select("vec_id", F.col("frame").cast("bigint").alias("frame"), "voiced")


_LONG = "l AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS t FROM x)"


@query(
    f"WITH {_X}, {_LONG}, w AS (SELECT *, first_value(v) OVER o AS f, last_value(v) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, lead(v, 1) OVER o AS n1, lead(v, 2) OVER o AS n2, lag(v, 1) OVER o AS p1, lag(v, 2) OVER o AS p2 FROM l WINDOW o AS (PARTITION BY vec_id ORDER BY t)) SELECT vec_id, t, round((coalesce(n1, z) - coalesce(p1, f) + 2 * (coalesce(n2, z) - coalesce(p2, f))) / 10, 6) AS delta FROM w"
)
def delta_feats(s, d):
    """Regression deltas over two neighbours."""
    long = signals(s, d).select("vec_id", F.posexplode("x").alias("t", "v"))
    return W.deltas(long, ["vec_id"], "t", "v", 2).select("vec_id", F.col("t").cast("bigint").alias("t"), R6("delta").alias("delta"))


@query(f"WITH {_X}, b AS (SELECT vec_id, list_transform(x, lambda v: (v > 0)::INT) AS y FROM x) SELECT vec_id, list_transform(range(0, (len(y) - 8) // 4 + 1), lambda i: (list_sum(y[i * 4 + 1 : i * 4 + 8]) > 4)::INT) AS labels, list_transform(range(0, (len(y) - 8) // 4 + 1), lambda i: y[i * 4 + 5]) AS centres FROM b")
def frame_label_majority(s, d):
    """Labels of frames by majority, and by the centre."""
    y = signals(s, d).select("vec_id", F.transform("x", lambda v: (v > 0).cast("int")).alias("y"))
    return y.select("vec_id", W.frame_labels(F.col("y"), 8, 4).alias("labels"), W.centre_labels(F.col("y"), 8, 4).alias("centres"))


@query(
    f"WITH {_X}, {_LONG}, a AS (SELECT *, t - row_number() OVER (PARTITION BY vec_id ORDER BY t) AS g FROM l WHERE v > 0) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY min(t)) AS island, min(t) AS first, max(t) AS last, count(*) AS n FROM a GROUP BY vec_id, g"
)
def activity_islands(s, d):
    """Runs of active samples."""
    long = signals(s, d).select("vec_id", F.posexplode("x").alias("t", "v"))
    out = W.islands(long, ["vec_id"], "t", F.col("v") > 0)
    return out.select("vec_id", F.col("island").cast("bigint").alias("island"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n")


@query(
    f"WITH {_X}, {_LONG}, w AS (SELECT vec_id, t, list(v) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g FROM l) SELECT vec_id, t, round(list_sort(list_concat(g, list_resize([]::DOUBLE[], 5 - len(g), 0.0::DOUBLE)))[3], 6) AS median FROM w"
)
def median_filtered(s, d):
    """Medians of five, zeros beyond the edges."""
    long = signals(s, d).select("vec_id", F.posexplode("x").alias("t", "v"))
    return W.median_filter(long, ["vec_id"], "t", "v", 5).select("vec_id", F.col("t").cast("bigint").alias("t"), R6("median").alias("median"))


@query(
    f"WITH {_X}, {_LONG}, p AS (SELECT th FROM (VALUES (-0.1), (0.0), (0.1)) q(th)), e AS (SELECT label, th, avg((v > th)::INT) AS share FROM l JOIN x USING (vec_id), p GROUP BY ALL) SELECT label, th::DOUBLE AS th FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(abs(share - 0.5), 9), th) AS rn FROM e) WHERE rn = 1"
)
def threshold_sweep(s, d):
    """The best of a table of thresholds by label."""
    from voxloom.operators.splitting import top_per_group

    p = s.createDataFrame([(-0.1,), (0.0,), (0.1,)], "th double")
    long = signals(s, d).select("label", F.explode("x").alias("v")).crossJoin(F.broadcast(p))
    e = long.groupBy("label", "th").agg(F.avg((F.col("v") > F.col("th")).cast("int")).alias("share"))
    return top_per_group(e, ["label"], [F.round(F.abs(F.col("share") - 0.5), 9), F.col("th")], 1).select("label", "th")


@query(f"WITH {_X} SELECT vec_id, i * 5 AS start, round(list_sum(x[i * 5 + 1 : i * 5 + 20]), 6) AS total FROM x, unnest(range(0, (len(x) - 20) // 5 + 1)) t(i)")
def chunk_overlap(s, d):
    """Chunks of 20 with a step of a quarter."""
    c = signals(s, d).select("vec_id", F.explode(W.chunks(F.col("x"), 20, 0.25)).alias("c"))
    return c.select("vec_id", F.col("c.start").cast("bigint").alias("start"), R6(F.aggregate("c.values", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(
    f"WITH {TEXTS}, {SEGMENTS}, j AS (SELECT uttid, CAST(round((endtime - starttime) * 100) AS BIGINT) AS dur, {WORDS} AS w FROM txt JOIN seg USING (uttid) WHERE endtime > starttime AND text IS NOT NULL), k AS (SELECT uttid, dur, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM j WHERE len(w) > 0) SELECT uttid, i, word, i * (dur // n) AS start, CASE WHEN i = n - 1 THEN dur - (dur // n) * (n - 1) ELSE dur // n END AS duration FROM k"
)
def uniform_word_times(s, d):
    """Words evenly spread over their segment, in hundredths."""
    j = texts(s, d).filter("text is not null").join(segments(s, d).filter("endtime > starttime"), "uttid")
    w = j.select("uttid", F.round((F.col("endtime") - F.col("starttime")) * 100).cast("bigint").alias("dur"), T.words(F.col("text")).alias("w"))
    out = w.select("uttid", F.posexplode(W.uniform_times(F.col("w"), F.col("dur"))).alias("i", "t"))
    return out.select("uttid", F.col("i").cast("bigint").alias("i"), "t.word", "t.start", "t.duration")


@query(
    f"""WITH RECURSIVE {SEGMENTS},
o AS (SELECT recid, endtime - starttime AS dur, row_number() OVER (PARTITION BY recid ORDER BY starttime, uttid) AS i FROM seg WHERE recid IS NOT NULL AND endtime > starttime),
l AS (SELECT recid, list(dur ORDER BY i) AS v FROM o GROUP BY recid),
f(recid, i, g, total) AS (
  SELECT recid, 1::BIGINT, 0::BIGINT, v[1] FROM l
  UNION ALL
  SELECT recid, f.i + 1, g + (total + l.v[f.i + 1] > 60)::INT, CASE WHEN total + l.v[f.i + 1] > 60 THEN l.v[f.i + 1] ELSE total + l.v[f.i + 1] END FROM f JOIN l USING (recid) WHERE f.i < len(l.v)),
r AS (SELECT recid, g, count(*) AS n, round(sum(l.v[f.i]), 3) AS total FROM f JOIN l USING (recid) GROUP BY recid, g)
SELECT CAST(row_number() OVER (ORDER BY recid, g) - 1 AS BIGINT) AS segment, recid, n, total FROM r"""
)
def greedy_segments(s, d):
    """Consecutive utterances of a recording up to 60 seconds; the total restarts at each cut."""
    seg = segments(s, d).filter("recid is not null and endtime > starttime").select("recid", "uttid", "starttime", (F.col("endtime") - F.col("starttime")).alias("dur"))
    return greedy_groups(seg, "recid", ["starttime", "uttid"], "dur", 60.0).groupBy("recid", "batch").agg(F.count("*").alias("n"), F.round(F.sum("dur"), 3).alias("total")).select("recid", F.col("batch").alias("segment"), "n", "total")


@query(f"WITH {TEXTS}, w AS (SELECT uttid, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM txt) SELECT uttid, word, pos, row_number() OVER (PARTITION BY uttid, word ORDER BY pos) - 1 AS occurrence FROM w")
def occurrence_numbers(s, d):
    """The how-manieth of equal words of an utterance."""
    w = texts(s, d).select("uttid", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    return W.occurrence_number(w, ["uttid", "word"], ["pos"]).select("uttid", "word", "pos", F.col("occurrence").cast("bigint").alias("occurrence"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn <= 2")
def n_best_events(s, d):
    """The two best of each group, nulls last."""
    from voxloom.operators.splitting import top_per_group

    e = read_table(s, d, "events")
    return top_per_group(e, ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")], 2).select("user_id", "event_id", "value")


@query()
def dtw_cost(s, d):
    """Exact dynamic time warping of each whole vector with its reverse (rows only)."""
    x = signals(s, d).select("vec_id", F.col("x").alias("a"), F.reverse("x").alias("b"))
    return W.dtw(x, "vec_id", "a", "b").select("vec_id", R6("cost").alias("cost"), R6("mean_cost").alias("mean_cost"))


@query(
    f"WITH {_X}, p AS (SELECT vec_id, list_transform(x, lambda v: v * v > list_max(list_transform(x, lambda u: u * u)) * 0.1) AS loud FROM x) SELECT vec_id, greatest(list_position(loud, true) - 1 - 2, 0) AS start, least(len(loud) - list_position(list_reverse(loud), true) + 1 + 2, len(loud)) AS \"end\" FROM p"
)
def silence_trim(s, d):
    """The stretch louder than the loudest less 10 dB, two samples wider."""
    t = signals(s, d).select("vec_id", W.trim_bounds(F.col("x"), 10.0, 2).alias("t"))
    return t.select("vec_id", F.col("t.start").cast("bigint").alias("start"), F.col("t.end").cast("bigint").alias("end"))


_DW = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_DW} SELECT doc_id, i AS window, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') AS text FROM w, unnest(range(0, greatest(len(w) // 40, 1))) t(i)")
def text_windows(s, d):
    """Windows of 50 words, ten of them shared."""
    w = read_table(s, d, "documents").filter("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.posexplode(W.text_windows(F.col("w"), 50, 10)).alias("window", "text")).withColumn("window", F.col("window").cast("bigint"))


@query(f"WITH {_X}, {_LONG} SELECT vec_id, t AS pos, round(v, 6) AS value FROM l WHERE t < ((64 - 20) // 5) * 5 + 20")
def overlap_stitching(s, d):
    """Chunks stitched together again by averaging."""
    c = signals(s, d).select("vec_id", F.explode(W.chunks(F.col("x"), 20, 0.25)).alias("c")).select("vec_id", "c.*")
    return W.overlap_add(c, ["vec_id"], "start", "values").select("vec_id", F.col("pos").cast("bigint").alias("pos"), R6("value").alias("value"))


@query(
    f"WITH {SEGMENTS}, o AS (SELECT recid, uttid, starttime, endtime, coalesce(lag(endtime) OVER (PARTITION BY recid ORDER BY starttime, endtime, uttid), 0) AS gap FROM seg WHERE recid IS NOT NULL AND endtime > starttime), a AS (SELECT recid, uttid AS label, starttime AS st, endtime AS et FROM o UNION ALL SELECT recid, 'sil', gap, starttime FROM o WHERE starttime > gap) SELECT recid, label, round(st, 3) AS start, CAST(floor(et * 16000 / 256 + 0.5) AS BIGINT) - CAST(floor(st * 16000 / 256 + 0.5) AS BIGINT) AS frames FROM a"
)
def phone_durations(s, d):
    """Durations in frames from rounded boundaries, gaps as silence."""
    seg = segments(s, d).filter("recid is not null and endtime > starttime")
    out = W.frame_durations(seg, ["recid"], "starttime", "endtime", "uttid", 16000, 256)
    return out.select("recid", "label", F.round("start", 3).alias("start"), "frames")


# Array transforms


@query(f"WITH {_X}, c AS (SELECT vec_id, label, x[1 : 1 + vec_id % 10] AS y FROM x), m AS (SELECT *, max(len(y)) OVER (PARTITION BY label) AS most FROM c) SELECT vec_id, len(y) AS y_lengths, list_transform(list_resize(y, most, 0.0::DOUBLE), lambda v: round(v, 6)) AS y, list_transform(range(0, most), lambda i: i >= len(y)) AS mask FROM m")
def collated_batches(s, d):
    """M5, M6: padding within a batch, and the mask of padded places."""
    c = signals(s, d).select("vec_id", "label", F.expr("slice(x, 1, int(1 + vec_id % 10))").alias("y"))
    out = M.collate(c, ["label"], "y", M.PAD_FLOAT)
    return out.select("vec_id", F.col("y_lengths").cast("bigint").alias("y_lengths"), F.transform("y", R6).alias("y"), M.pad_mask(F.col("y_lengths"), F.size("y")).alias("mask"))


def _u(k: str, seed: int) -> str:
    return f"('0x' || substr(md5(vec_id::VARCHAR || '|{seed}|' || ({k} // 8)), 4 * ({k} % 8) + 1, 4))::BIGINT / 65536"


@query(
    f"WITH {_X}, r AS (SELECT vec_id, x, 0.75 * ({_u('0', 5)}) AS ratio FROM x), n AS (SELECT vec_id, ratio, x, list_transform(range(0, 8), lambda k: sqrt(-2 * ln({_u('k', 3)} + pow(2.0, -17))) * cos(({_u('k', 4)}) * 2 * pi())) AS n FROM r) SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN n[(i - 1) % 8 + 1] > ratio THEN round(v, 6) ELSE 0.0 END) AS x FROM n"
)
def band_dropped(s, d):
    """Pseudo-random bands of eight cut from frames, the same in every run."""
    f = signals(s, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("x", i * 8 + 1, F.lit(8))).alias("f"))
    return f.select("vec_id", F.transform(F.flatten(M.bands_dropped(F.col("f"), "vec_id", 8, 0.0, 0.75, 3)), R6).alias("x"))


@query(f"WITH {_X} SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN i - 1 >= vec_id % 50 AND i - 1 < vec_id % 50 + 8 THEN 0.0 ELSE round(v, 6) END) AS x FROM x")
def span_masked(s, d):
    """M7: a masked span at a given place."""
    x = signals(s, d)
    return x.select("vec_id", F.transform(M.span_mask(F.col("x"), F.col("vec_id") % 50, F.lit(8)), R6).alias("x"))


_SEEDED = "('0x' || substr(md5(vec_id::VARCHAR || '|1|{k}'), 1, 12))::BIGINT"


@query(
    f"WITH {_X}, h AS (SELECT vec_id, x, {_SEEDED.format(k=0)} AS a, {_SEEDED.format(k=1)} AS b FROM x), p AS (SELECT vec_id, x, a % 12 AS wa, b % 12 AS wb, (a // 12) % greatest(64 - a % 12, 1) AS sa, (b // 12) % greatest(64 - b % 12, 1) AS sb FROM h) SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN (i - 1 >= sa AND i - 1 < sa + wa) OR (i - 1 >= sb AND i - 1 < sb + wb) THEN 0.0 ELSE v END) AS x FROM p"
)
def seeded_masks(s, d):
    """M7: two pseudo-random masks, the same in every run."""
    return M.seeded_spans(signals(s, d), "x", "vec_id", 2, 12, 1).select("vec_id", "x")


@query(f"WITH {_X} SELECT vec_id, list_transform(x, lambda v: round(v * pow(10, (vec_id % 7 - 3) / 20), 6)) AS louder, list_transform(x, lambda v: round(v / list_max(list_transform(x, lambda u: abs(u))), 6)) AS peak FROM x")
def gains(s, d):
    """A gain in dB, and peak normalisation."""
    x = signals(s, d)
    return x.select("vec_id", F.transform(M.gain_db(F.col("x"), F.col("vec_id") % 7 - 3), R6).alias("louder"), F.transform(M.peak_normalised(F.col("x")), R6).alias("peak"))


@query(
    f"WITH {_X}, n AS (SELECT vec_id, x, list_transform(x, lambda v, i: x[64 - (i - 1) % 10]) AS f FROM x), s AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / (list_sum(list_transform(f, lambda v: v * v)) + 1e-20) * 0.1) AS k FROM n) SELECT vec_id, list_transform(x, lambda v, i: round(v + f[i] * k, 6)) AS noisy, list_transform(x, lambda v, i: round(v + 0.5 * x[65 - i], 6)) AS mix FROM s"
)
def noise_and_mixture(s, d):
    """Noise at 10 dB, wrapped; a mixture with the reversed signal."""
    x = signals(s, d).withColumn("noise", F.slice(F.reverse("x"), 1, 10)).withColumn("back", F.reverse("x"))
    return x.select("vec_id", F.transform(M.with_noise(F.col("x"), F.col("noise"), F.lit(10.0)), R6).alias("noisy"), F.transform(M.mixed(F.col("x"), F.col("back"), 0.5), R6).alias("mix"))


@query("SELECT event_id, CASE WHEN value > 0 THEN ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(((round_even(12 * log2(value / (440 * pow(2, -4.75))), 0) % 12 + 12) % 12) AS BIGINT) + 1] || '_' || CAST(floor(round_even(12 * log2(value / (440 * pow(2, -4.75))), 0) / 12) AS BIGINT) ELSE 'Sil' END AS note FROM events WHERE value IS NOT NULL")
def semitone_labels(s, d):
    """Note names of frequencies."""
    return read_table(s, d, "events").filter("value is not null").select("event_id", M.semitone(F.col("value")).alias("note"))


@query(f"WITH {_X} SELECT vec_id, list_transform(range(0, 12), lambda i: CASE WHEN i < 2 THEN 1 WHEN i < 7 THEN 2 ELSE 3 END) AS frames, greatest(floor(8 * (vec_id % 9) / 7.0 * 2 + 0.5) / 8, 1 / 16) AS beats FROM x")
def expanded_durations(s, d):
    """Values repeated by durations; note lengths to an eighth."""
    x = signals(s, d)
    e = W.expand_durations(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 5, 5))))
    return x.select("vec_id", e.alias("frames"), M.quantised((F.col("vec_id") % 9) / 7.0, F.lit(2)).alias("beats"))


@query(
    f"WITH {_X}, c AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS r, list_transform(x, lambda v, i: (v + 0.1 * (i % 3)) - (list_avg(x) + 0.1 * (22 * 1 + 21 * 2) / 64)) AS e FROM x), p AS (SELECT vec_id, list_sum(list_transform(r, lambda v: v * v)) AS rr, list_sum(list_transform(e, lambda v: v * v)) AS ee, list_sum(list_transform(r, lambda v, i: v * e[i])) AS re FROM c) SELECT vec_id, round(10 * log10((re * re / rr) / (ee - re * re / rr)), 5) AS si_snr FROM p"
)
def signal_to_noise(s, d):
    """Scale-invariant signal-to-noise ratio."""
    x = signals(s, d).withColumn("est", F.transform("x", lambda v, i: v + 0.1 * ((i + 1) % 3)))
    return x.select("vec_id", F.round(M.si_snr(F.col("x"), F.col("est")), 5).alias("si_snr"))


@query()
def log_mel_features(s, d):
    """Log-mel features (rows only: numpy FFT)."""
    return M.log_mel(signals(s, d), "vec_id", "x", 16000, 16, 4, 8)


@query(f"WITH {_X} SELECT vec_id, list_transform(x, lambda v: round(v, 5)) AS x FROM x")
def stft_round_trip(s, d):
    """The transform and back."""
    return M.inverse_stft(signals(s, d), "vec_id", "x", 16, 4).select("vec_id", F.transform("x", lambda v: F.round(v, 5)).alias("x"))


@query()
def intelligibility(s, d):
    """Short-time intelligibility of signals repeated to half a second, with growing noise (tested on properties)."""
    x = signals(s, d).select("vec_id", F.flatten(F.array_repeat("x", 80)).alias("x"))
    noisy = F.transform("x", lambda v, i: v + 0.02 * (F.col("vec_id") % 5) * F.sin(i * i))
    return M.stoi_scores(x.select("vec_id", "x", noisy.alias("y")), "vec_id", "x", "y").select("vec_id", F.round("stoi", 6).alias("stoi"))


@query()
def augmented_signals(s, d):
    """Speed, room and time warping (rows only)."""
    x = signals(s, d)
    y = M.convolved(M.speed_perturbed(x, "vec_id", "x", 1.1), "vec_id", "x", [1.0, 0.5, 0.25])
    return M.time_warped(y, "vec_id", "x", 5, 1)
