"""Queries on scoring and search steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import scoring as C
from voxloom.plans.relation_queries import TEXTS, texts
from voxloom.plans.text_queries import W as WORDS_OF
from voxloom.plans.text_queries import WORDS
from voxloom.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def versions(s, d):
    """(uttid, ref, hyp): the current text as truth, the earliest version as hypothesis."""
    rows = read_table(s, d, "utt_text").filter("uttid is not null")
    w = Window.partitionBy("uttid").orderBy(F.col("loaded_at").asc_nulls_last(), F.col("text").asc_nulls_last())
    old = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("uttid", F.col("text").alias("hyp"))
    return texts(s, d).select("uttid", F.col("text").alias("ref")).join(old, "uttid")


_PAIRS = f"{TEXTS}, old AS (SELECT uttid, text AS hyp FROM (SELECT *, row_number() OVER (PARTITION BY uttid ORDER BY loaded_at NULLS LAST, text NULLS LAST) AS rn FROM utt_text WHERE uttid IS NOT NULL) WHERE rn = 1), pr AS (SELECT uttid, text AS ref, hyp FROM txt JOIN old USING (uttid))"


def _coded(units: str, of: str) -> str:
    """Common table expressions that end in ed(uttid, n_ref, edits).

    Units (words, characters) become single characters, numbered within their pair after the
    parts that both ends share are cut off, so that the character distance is theirs. A pair
    with more different units than there are characters of one byte raises an error.
    """
    r, h = units.format(c=of.format(c="ref")), units.format(c=of.format(c="hyp"))
    equal = "list_transform(range(1, least(len(r), len(h)) + 1), lambda i: r[i] = h[i])"
    cut = f"coalesce(list_position({equal}, false), least(len(r), len(h)) + 1)"
    code = "array_to_string(list_transform({x}, lambda x: chr(CAST(list_position(v, x) AS INT))), '')"
    return f"""{_PAIRS}, wd AS (SELECT uttid, ref, hyp, {r} AS r, {h} AS h FROM pr),
f1 AS (SELECT uttid, len(r) AS n_ref, r = h AS same, list_reverse(r[{cut} : ]) AS r, list_reverse(h[{cut} : ]) AS h FROM wd),
f2 AS (SELECT uttid, n_ref, same, r[{cut} : ] AS r, h[{cut} : ] AS h FROM f1),
cd AS (SELECT *, list_sort(list_distinct(list_concat(r, h))) AS v FROM f2),
ed AS (SELECT uttid, n_ref, CASE WHEN same THEN 0 WHEN len(v) > 127 THEN CAST(error('too many different units in ' || uttid) AS BIGINT) ELSE levenshtein({code.format(x="r")}, {code.format(x="h")}) END AS edits FROM cd)"""


_CODED = _coded(WORDS_OF, "coalesce({c}, '')")
_CODED_CHARS = _coded("regexp_extract_all({c}, '(?s).')", "replace({c}, ' ', '')")


@query(f"WITH {_CODED} SELECT uttid, n_ref, CAST(edits AS BIGINT) AS edits FROM ed")
def word_edits(s, d):
    """Word edit distance of versions."""
    p = versions(s, d).select("uttid", T.words(F.coalesce("ref", F.lit(""))).alias("r"), T.words(F.coalesce("hyp", F.lit(""))).alias("h"))
    e = C.word_errors(p, "uttid", "r", "h")
    return e.select("uttid", "n_ref", (F.col("n_sub") + F.col("n_del") + F.col("n_ins")).alias("edits"))


@query(f"WITH {_CODED} SELECT CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n_ref) AS BIGINT) AS length, round(sum(edits) / sum(n_ref), 9) AS rate FROM ed")
def wer_micro(s, d):
    """The word error rate over all versions."""
    e = word_edits(s, d)
    return C.error_rate(e, F.col("edits"), F.col("n_ref")).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_CODED_CHARS} SELECT uttid, CAST(edits AS BIGINT) AS edits, n_ref AS n FROM ed")
def char_edits(s, d):
    """Character edit distance without blanks; null where a text is."""
    p = versions(s, d)
    return p.select("uttid", C.char_distance(F.col("ref"), F.col("hyp")).cast("bigint").alias("edits"), F.length(F.replace("ref", F.lit(" "))).cast("bigint").alias("n"))


@query()
def edit_operations(s, d):
    """Correct, substituted, deleted and inserted words (rows only: ties are our own)."""
    p = versions(s, d).select("uttid", T.words(F.coalesce("ref", F.lit(""))).alias("r"), T.words(F.coalesce("hyp", F.lit(""))).alias("h"))
    return C.word_errors(p, "uttid", "r", "h")


def pair_scores(s, d):
    h = lambda a: F.pmod(F.col("doc_id") * (F.col("ref") * 31 + F.col("hyp") * 17 + a) * 7919, F.lit(20))
    n = s.createDataFrame([(r, q) for r in (1, 2) for q in (1, 2)], "ref int, hyp int")
    rows = read_table(s, d, "documents").select("doc_id").crossJoin(F.broadcast(n))
    return rows.select("doc_id", "ref", "hyp", *[h(a).alias(x) for a, x in enumerate("csdi")])


_PS = "ps AS (SELECT doc_id, ref, hyp, " + ", ".join(f"(doc_id * (ref * 31 + hyp * 17 + {a}) * 7919) % 20 AS {x}" for a, x in enumerate("csdi")) + " FROM documents, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) v(ref, hyp))"
_PERM = f"{_PS}, pm AS (SELECT * FROM (VALUES (0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 1)) q(perm, ref, hyp)), sm AS (SELECT doc_id, perm, sum(c) AS c, sum(s) AS s, sum(d) AS d, sum(i) AS i FROM ps JOIN pm USING (ref, hyp) GROUP BY doc_id, perm)"


@query(f"WITH {_PERM}, rt AS (SELECT *, (s + d + i) / nullif(c + s + d, 0) AS rate FROM sm) SELECT doc_id, perm, c::BIGINT AS c, s::BIGINT AS s, d::BIGINT AS d, i::BIGINT AS i, round(rate, 9) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(rate, 'inf'::DOUBLE), perm) AS rn FROM rt) WHERE rn = 1")
def perm_free_error(s, d):
    """The best permutation of two speakers."""
    return C.permutation_free_error(pair_scores(s, d), "doc_id", 2).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_PS}, a AS (SELECT doc_id, sum(CASE WHEN ref = hyp THEN (s + d + i) / (c + s + d + 1) END) AS straight, sum(CASE WHEN ref <> hyp THEN (s + d + i) / (c + s + d + 1) END) AS crossed FROM ps GROUP BY doc_id) SELECT doc_id, r AS ref, CASE WHEN crossed < straight - 1e-12 THEN 3 - r ELSE r END AS hyp FROM a, (VALUES (1::BIGINT), (2)) v(r)")
def assigned_speakers(s, d):
    """Assignment on the rates of pairs."""
    p = pair_scores(s, d).withColumn("rate", (F.col("s") + F.col("d") + F.col("i")) / (F.col("c") + F.col("s") + F.col("d") + 1))
    return C.assignment(p, "doc_id", "rate")


@query(f"WITH {_PERM}, rt AS (SELECT *, (s + d + i) / nullif(c + s + d, 0) AS rate FROM sm), b AS (SELECT doc_id, perm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(rate, 'inf'::DOUBLE), perm) AS rn FROM rt) WHERE rn = 1) SELECT doc_id, ref, hyp FROM b JOIN pm USING (perm)")
def reordered_hypotheses(s, d):
    """Hypotheses in the order of the chosen permutation."""
    p = pair_scores(s, d)
    return C.reorder(p, C.permutation_free_error(p, "doc_id", 2), "doc_id", 2)


@query(f"WITH {_PERM}, l AS (SELECT doc_id, perm, avg(c * 0.5 + s) AS loss FROM ps JOIN pm USING (ref, hyp) GROUP BY ALL) SELECT doc_id, perm, loss FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loss, perm) AS rn FROM l) WHERE rn = 1")
def least_permutation_loss(s, d):
    """C4."""
    p = pair_scores(s, d).withColumn("loss", F.col("c") * 0.5 + F.col("s"))
    return C.least_pair_loss(p, "doc_id", "loss", 2)


@query(
    f"WITH {_PAIRS}, t AS (SELECT uttid, unnest({WORDS_OF.format(c='ref')}) AS w FROM pr), g AS (SELECT uttid, unnest({WORDS_OF.format(c='hyp')}) AS w FROM pr), a AS (SELECT uttid, w, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT uttid, w, count(*) AS m FROM g GROUP BY ALL), j AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b USING (uttid, w)) SELECT CAST(sum(least(n, m)) AS BIGINT) AS tp, CAST(sum(m - least(n, m)) AS BIGINT) AS fp, CAST(sum(n - least(n, m)) AS BIGINT) AS fn, round(2 * sum(least(n, m)) / (sum(n) + sum(m)), 9) AS f1 FROM j"
)
def entity_f1(s, d):
    """Words of versions compared as multisets."""
    v = versions(s, d)
    side = lambda c: v.select("uttid", F.explode(T.words(F.col(c))).alias("w"))
    return C.entity_scores(side("ref"), side("hyp"), ["uttid", "w"]).withColumn("f1", F.round("f1", 9))


@query("WITH u AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS rn FROM u) SELECT user_id, rn AS n, 'target1[' || rn || ']' AS name, event_type, value FROM r WHERE rn <= 3")
def nbest_merged(s, d):
    """The best distinct hypotheses as one list, unfolded."""
    e = read_table(s, d, "events").filter("value is not null")
    n = C.nbest_lists(e, "user_id", "value", 3, ["event_type"])
    return n.select("user_id", F.posexplode("output").alias("n", "h")).select("user_id", (F.col("n") + 1).cast("bigint").alias("n"), "h.name", "h.event_type", F.col("h.score").alias("value"))


@query("WITH c AS (SELECT user_id, event_type, event_id, round(-value + 0.3 * (event_id % 11), 9) AS score FROM events WHERE value IS NOT NULL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id) AS p FROM c) WHERE p <= 4) SELECT user_id, event_id, score, rank FROM (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM k) WHERE rank <= 4")
def beam_step(s, d):
    """L3: one step of a beam of four."""
    e = read_table(s, d, "events").filter("value is not null").select("user_id", "event_type", "event_id", F.lit(0.0).alias("prev"), (-F.col("value")).alias("am"), (F.col("event_id") % 11).cast("double").alias("lm"))
    e = e.select("event_id", "user_id", "event_type", "prev", F.round(F.col("am") + 0.3 * F.col("lm"), 9).alias("joint"))
    return C.beam_step(e, "user_id", "event_type", "prev", {"joint": 1.0}, 4).select("user_id", "event_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("WITH p AS (SELECT user_id, event_id % 20 AS len, max(value) AS s FROM events WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, max(s) AS top, max(len) AS longest FROM p GROUP BY user_id) SELECT user_id, count(*) = 3 AND bool_and(s - top < -10) AS ended FROM p JOIN t USING (user_id) WHERE len > longest - 3 GROUP BY user_id")
def search_end(s, d):
    """L4: the last lengths all worse than the best by a margin."""
    e = read_table(s, d, "events").filter("value is not null").select("user_id", (F.col("event_id") % 20).alias("len"), "value")
    return C.search_ended(e, "user_id", "len", "value", 3, -10.0)


_GRAMS = " UNION ALL ".join(f"SELECT uttid, {n} AS n, unnest(list_transform(range(1, len({{x}}) - {n - 2}), lambda i: array_to_string({{x}}[i : i + {n - 1}], ' '))) AS g FROM wd" for n in range(1, 5))


@query(
    f"""WITH {_PAIRS}, wd AS (SELECT uttid, {WORDS_OF.format(c="coalesce(ref, '')")} AS r, {WORDS_OF.format(c="coalesce(hyp, '')")} AS h FROM pr), a AS (SELECT uttid, n, g, count(*) AS k FROM ({_GRAMS.format(x='r')}) GROUP BY ALL), b AS (SELECT uttid, n, g, count(*) AS k FROM ({_GRAMS.format(x='h')}) GROUP BY ALL),
p AS (SELECT n, sum(least(coalesce(a.k, 0), b.k)) / sum(b.k) AS p FROM b LEFT JOIN a USING (uttid, n, g) GROUP BY n), l AS (SELECT sum(len(r)) AS r, sum(len(h)) AS h FROM wd), bp AS (SELECT CASE WHEN h >= r THEN 1.0 ELSE exp(1 - r / h) END AS bp FROM l)
SELECT round(bp * exp((SELECT avg(ln(p)) FROM p)), 9) AS bleu, round(bp, 9) AS bp FROM bp"""
)
def corpus_bleu(s, d):
    """T19."""
    p = versions(s, d).select(T.words(F.coalesce("ref", F.lit(""))).alias("r"), T.words(F.coalesce("hyp", F.lit(""))).alias("h"))
    return C.bleu(p, "r", "h").select(F.round("bleu", 9).alias("bleu"), F.round("bp", 9).alias("bp"))


@query(
    f"""WITH {_PAIRS}, wd AS (SELECT uttid, {WORDS_OF.format(c="coalesce(ref, '')")} AS r, {WORDS_OF.format(c="coalesce(hyp, '')")} AS h FROM pr), a AS (SELECT uttid, g, count(*) AS k FROM (SELECT uttid, unnest(r) AS g FROM wd) GROUP BY ALL), b AS (SELECT uttid, g, count(*) AS k FROM (SELECT uttid, unnest(h) AS g FROM wd) GROUP BY ALL), c AS (SELECT uttid, sum(least(a.k, b.k)) AS hit FROM a JOIN b USING (uttid, g) GROUP BY uttid)
SELECT uttid, round(CASE WHEN len(r) + len(h) > 0 THEN 2 * coalesce(hit, 0) / (len(r) + len(h)) ELSE 0 END, 9) AS f1 FROM wd LEFT JOIN c USING (uttid)"""
)
def rouge_one(s, d):
    """ROUGE-1 of each utterance."""
    p = versions(s, d).select("uttid", T.words(F.coalesce("ref", F.lit(""))).alias("r"), T.words(F.coalesce("hyp", F.lit(""))).alias("h"))
    return C.rouge(p, "uttid", "r", "h", 1).select("uttid", F.round("f1", 9).alias("f1"))


@query(
    f"WITH {TEXTS}, w AS (SELECT uttid, {WORDS} AS w FROM txt WHERE text IS NOT NULL), x AS (SELECT uttid, w[i] AS word, CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END AS context FROM w, unnest(range(1, len(w) + 1)) t(i)), u AS (SELECT word, ln(count(*) / (SELECT count(*) FROM x)) AS u FROM x GROUP BY word HAVING count(*) > 1), b AS (SELECT context, word, ln(count(*) / sum(count(*)) OVER (PARTITION BY context)) AS b, count(*) AS n FROM x GROUP BY context, word) SELECT uttid, round(sum(coalesce(CASE WHEN n > 1 THEN b END, u - 0.5, -20)), 6) AS logp FROM x LEFT JOIN b USING (context, word) LEFT JOIN u USING (word) GROUP BY uttid"
)
def bigram_language_model(s, d):
    """Bigram scores with back-off."""
    t = texts(s, d).filter("text is not null").select("uttid", T.words(F.col("text")).alias("w"))
    x = t.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("<s>")), "w").alias("context"), F.col("w").alias("word"))).alias("p")).select("p.*").filter("word is not null")
    n2 = x.groupBy("context", "word").agg(F.count("*").alias("n"))
    total = n2.agg(F.sum("n").alias("t"))
    u = n2.groupBy("word").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("word", F.log(F.col("n") / F.col("t")).alias("logp"), "n").filter("n > 1")
    ctx = n2.groupBy("context").agg(F.sum("n").alias("c"))
    b = n2.join(ctx, "context").filter("n > 1").select("context", "word", F.log(F.col("n") / F.col("c")).alias("logp"))
    return C.bigram_scores(t, "uttid", "w", u, b, -20.0, -0.5).select("uttid", F.round("logp", 6).alias("logp"))


@query()
def ctc_alignment(s, d):
    """Forward scores and aligned segments over frame-wise log probabilities (rows only)."""
    e = read_table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    frame = lambda i: F.transform(F.slice("x", i * 8 + 1, F.lit(8)), lambda v: v - 2.5)
    p = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), frame).alias("p"), F.array(*map(F.lit, (1, 2, 2))).alias("y"))
    return C.ctc_scores(p, "vec_id", "p", "y").select("vec_id", F.round("score", 6).alias("score"), F.size("segments").alias("n"))
