"""Queries on chains of sample functions, tokenizers, collation, scorers, tasks and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.tokenizers import build_tokenizer
from voxloom.operators import batching as B
from voxloom.operators import chains as H
from voxloom.operators import enhancement as E
from voxloom.plans.relation_queries import TEXTS, texts
from voxloom.plans.scoring_queries import _PAIRS, versions
from voxloom.plans.sequence_queries import _X, signals
from voxloom.plans.text_queries import UPPER, WORDS
from voxloom.session import read_table

QUERIES, ORACLE = {}, {}
#: A public SentencePiece model, where the box has one; the path is a parameter of the tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


_VOCABULARY = ["<blank>", "<unk>", "THE", "A", "AND", "OF", "DER", "DE", "LA"]


@query(
    f"WITH {TEXTS}, u AS (SELECT uttid, trim(regexp_replace({UPPER.format(c='text')}, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM txt WHERE text IS NOT NULL), w AS (SELECT uttid, {WORDS} AS w FROM u), k AS (SELECT uttid, w FROM w WHERE len(w) BETWEEN 1 AND 200) SELECT uttid, array_to_string(list_transform(w, lambda x: coalesce(list_position({_VOCABULARY!r}, x) - 1, 1)), ' ') AS ids FROM k"
)
def preprocess_chain(s, d):
    """texts cleaned, parted, filtered and numbered by a chain from a configuration."""
    chain = H.Chain.of({"process": [{"type": "clean", "cleaners": ["upper", "whitespace"]}, {"type": "tokens", "kind": "word"}, {"type": "length_filter", "column": "tokens", "least": 1, "most": 200}, {"type": "ids", "vocabulary": _VOCABULARY}]}, key="uttid")
    return chain(texts(s, d).filter("text is not null")).select("uttid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {_X}, a AS (SELECT vec_id, list_transform(x, lambda v: v * pow(10, 0.3)) AS x FROM x), b AS (SELECT vec_id, list_transform(x, lambda v: v * 0.5 / list_max(list_transform(x, lambda u: abs(u)))) AS x FROM a) SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN i BETWEEN 11 AND 15 THEN 0.0 ELSE round(v, 6) END) AS x FROM b")
def transform_chain(s, d):
    """Gain, peak and mask one after another, from a configuration."""
    chain = H.Chain.of({"mode": "sequential", "process": [{"type": "gain", "db": 6.0}, {"type": "peak", "target": 0.5}, {"type": "span_mask", "start": 10, "width": 5}]}, key="vec_id")
    return chain(signals(s, d)).select("vec_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query(f"WITH {_X}, c AS (SELECT vec_id, vec_id // 8 AS batch, x[1 : 1 + vec_id % 10] AS y FROM x), m AS (SELECT *, max(len(y)) OVER (PARTITION BY batch) AS most FROM c) SELECT batch, list(vec_id ORDER BY vec_id) AS keys, list(len(y) ORDER BY vec_id) AS y_lengths, list(list_transform(list_resize(y, most, -1.0::DOUBLE), lambda v: round(v, 6)) ORDER BY vec_id) AS y FROM m GROUP BY batch")
def collated_samples(s, d):
    """one row a mini-batch, padded, with lengths."""
    rows = signals(s, d).select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), F.expr("slice(x, 1, int(1 + vec_id % 10))").alias("y"))
    out = H.collated(rows, "batch", "vec_id", {"y": -1.0})
    return out.select("batch", "keys", F.transform("y_lengths", lambda n: n.cast("bigint")).alias("y_lengths"), F.transform("y", lambda x: F.transform(x, lambda v: F.round(v, 6))).alias("y"))


@query(f"WITH {TEXTS} SELECT uttid, len(regexp_extract_all(text, '(?s).')) AS n_char, len({WORDS}) AS n_word, len(string_split(text, ' ')) AS n_phn, replace(text, ' ', '') AS joined FROM txt WHERE text IS NOT NULL")
def tokenizer_protocol(s, d):
    """Tokenizers by name; phonemes are what blanks part."""
    made = {k: build_tokenizer(k) for k in ("char", "word", "phn")}
    t = texts(s, d).filter("text is not null").select("uttid", *[made[k].tokens(F.col("text")).alias(k) for k in made])
    return t.select("uttid", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in made], made["phn"].text(F.col("phn")).alias("joined"))


@query()
def subword_tokens(s, d):
    """Pieces of a public model and the text they give again (tested against the public library)."""
    made = build_tokenizer("bpe", path=PIECES)
    t = texts(s, d).filter("text is not null").select("uttid", made.tokens(F.col("text")).alias("tokens"))
    return t.select("uttid", "tokens", made.text(F.col("tokens")).alias("text"))


@query(
    "WITH c AS (SELECT user_id, event_type, event_id, -value + 0.5 * (event_id % 11) AS f, 2.0 * (event_id % 7) AS p FROM events WHERE value IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY f DESC, event_id) AS r FROM c), t AS (SELECT *, round(f + p, 9) AS score FROM s WHERE r <= 5), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id) AS q FROM t) WHERE q <= 3) SELECT user_id, event_id, score, rank FROM (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM k) WHERE rank <= 3"
)
def scored_step(s, d):
    """a search step with two full scorers and one that scores what they leave."""
    e = read_table(s, d, "events").filter("value is not null").select("event_id", "user_id", "event_type", "value", F.lit(0.0).alias("prev"))
    scorers = [H.Scorer("am", lambda: -F.col("value")), H.Scorer("lm", lambda: (F.col("event_id") % 11).cast("double"), 0.5), H.Scorer("ctc", lambda: (F.col("event_id") % 7).cast("double"), 2.0, partial=True)]
    out = H.scored_step(e, "user_id", "event_type", "prev", scorers, k=3, pre=5)
    return out.select("user_id", "event_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"WITH {TEXTS}, t AS (SELECT uttid, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM txt WHERE text IS NOT NULL), c AS (SELECT uttid, list_transform({WORDS}, lambda x: coalesce(list_position(['<blank>', '<unk>', 'the', 'and', 'de'], x) - 1, 1)) AS ids FROM t), o AS (SELECT *, (row_number() OVER (ORDER BY len(ids), uttid) - 1) // 32 AS batch FROM c) SELECT batch, count(*) AS n, max(len(ids)) AS longest, sum(list_sum(ids))::BIGINT AS total FROM o GROUP BY batch"
)
def task_batches(s, d):
    """F8: a task's samples joined, checked, preprocessed, batched and collated."""
    chain = H.Chain.of({"process": [{"type": "clean", "cleaners": ["whitespace"]}, {"type": "tokens", "kind": "word"}, {"type": "ids", "vocabulary": ["<blank>", "<unk>", "the", "and", "de"]}]})
    fixed = lambda df: B.fixed_batches(df.select("uttid", "ids", F.size("ids").alias("n")), 32, [F.col("n"), F.col("uttid")])
    task = H.Task(required=("text",), preprocess=chain, batches=fixed, collate={"ids": -1})
    out = task.iterate([texts(s, d).filter("text is not null").select("uttid", "text")])
    total = F.aggregate(F.flatten("ids"), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x >= 0, x).otherwise(0))
    return out.select(F.col("batch").cast("bigint").alias("batch"), F.size("keys").cast("bigint").alias("n"), F.array_max("ids_lengths").cast("bigint").alias("longest"), total.alias("total"))


@query(
    f"WITH {_X}, m AS (SELECT vec_id, list_transform(x, lambda v, i: v + 0.5 * x[65 - i]) AS mix, x FROM x), z AS (SELECT vec_id, mix, x, sqrt(list_sum(list_transform(mix, lambda v: v * v)) / (64 + 1e-20) * 0.1) AS k FROM m), y AS (SELECT vec_id, x, list_transform(mix, lambda v, i: v + k * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) AS y FROM z), p AS (SELECT *, list_max(list_transform(y, lambda v: abs(v))) AS peak FROM y) SELECT vec_id, list_transform(y, lambda v: round(v * 0.9 / peak, 6)) AS mixture, list_transform(x, lambda v: round(v * 0.9 / peak, 6)) AS first FROM p"
)
def enhancement_mixtures(s, d):
    """Two sources with room responses, their early parts, noise, and one scale for all signals."""
    x = signals(s, d)
    rirs = F.array(F.array(F.lit(1.0)), F.array(F.lit(0.5)))
    rows = x.select("vec_id", F.array(F.col("x"), F.reverse("x")).alias("src"), rirs.alias("rir"), F.array(F.lit(1.0), F.lit(-1.0)).alias("noise"))
    out = E.enhancement_mix(rows, "vec_id", "src", "rir", "noise", 16000)
    r6 = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.select("vec_id", r6("mixture").alias("mixture"), r6(F.get("references", 0)).alias("first"))


@query(f"WITH {_X} SELECT vec_id, ref, 3 - ref AS hyp, round(10 * log10((list_sum(list_transform(x, lambda v: v * v)) + 1e-20) / (list_sum(list_transform(x, lambda v, i: pow(CASE WHEN ref = 1 THEN 0.1 * (i % 3) ELSE 0.05 * v END, 2))) + 1e-20)), 5) AS snr FROM x, (VALUES (1::BIGINT), (2)) v(ref)")
def matched_metrics(s, d):
    """Metrics of each reference with the estimate matched to it; estimates come in reverse."""
    x = signals(s, d)
    off = F.transform("x", lambda v, i: v + 0.1 * ((i + 1) % 3))
    back = F.transform("x", lambda v: v * 1.05)
    rows = x.select("vec_id", F.array(F.col("x"), F.reverse("x")).alias("r"), F.array(F.reverse(back), off).alias("e"))
    return E.separation_scores(rows, "vec_id", "r", "e").select("vec_id", "ref", "hyp", F.round("snr", 5).alias("snr"))


@query(f"WITH {_X} SELECT vec_id, stream, i AS at, round(CASE WHEN stream = 0 THEN x[i + 1] ELSE -x[64 - i] END, 6) AS value FROM x, unnest(range(0, 64)) t(i), (VALUES (0), (1)) v(stream)")
def stitched_streams(s, d):
    """Segments of two streams in changing order, permuted by their overlap, averaged and checked."""
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    rows = signals(s, d).select("vec_id", "x", F.transform(F.reverse("x"), lambda v: -v).alias("y"), k)
    cut = lambda c: F.expr(f"concat(slice({c}, k * 16 + 1, 24), array_repeat(0D, 24 - size(slice({c}, k * 16 + 1, 24))))")
    segs = rows.select("vec_id", "k", F.when((F.col("k") * F.col("vec_id")) % 2 == 0, F.array(cut("x"), cut("y"))).otherwise(F.array(cut("y"), cut("x"))).alias("streams"), F.lit(64).alias("length"))
    out = E.stitched_streams(segs, "vec_id", "k", "streams", 2, 16, 8, "length")
    return out.select("vec_id", "stream", F.col("at").cast("bigint").alias("at"), F.round("value", 6).alias("value"))


@query(
    f"""WITH {_PAIRS}, c AS (SELECT row_number() OVER () AS row, regexp_extract_all(regexp_replace(coalesce(ref, ''), '[ \\t\\n\\r\\x0b\\f]', '', 'g'), '(?s).') AS r, regexp_extract_all(regexp_replace(coalesce(hyp, ''), '[ \\t\\n\\r\\x0b\\f]', '', 'g'), '(?s).') AS h FROM pr),
n AS (SELECT unnest(range(1, 7)) AS n),
g AS (SELECT row, n, 0 AS side, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], ''))) AS g FROM c, n WHERE len(r) >= n UNION ALL SELECT row, n, 1, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i : i + n - 1], ''))) FROM c, n WHERE len(h) >= n),
k AS (SELECT row, n, g, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM g GROUP BY ALL),
s AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS a, sum(b) AS b FROM k GROUP BY n),
f AS (SELECT avg(m / b) AS p, avg(m / a) AS r FROM s)
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM f"""
)
def chrf_score(s, d):
    """The character n-gram F score of versions."""
    from voxloom.operators.scoring import chrf

    return chrf(versions(s, d), "ref", "hyp").select(F.round("chrf", 6).alias("chrf"))


@query()
def translation_edit_rate(s, d):
    """Edits with shifts and the longest common subsequence of versions (tested on fixed texts and by brute force)."""
    from voxloom.functions import text as T
    from voxloom.operators.scoring import sequence_scores

    v = versions(s, d).select("uttid", T.words(F.col("ref")).alias("r"), T.words(F.col("hyp")).alias("h"))
    return sequence_scores(v, "uttid", "r", "h").select("uttid", "n_ref", "edits", F.round("rouge_l", 9).alias("rouge_l"))
