"""Numeric queries without SQL against plain loops, and fixed texts for cleaners."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import arrays as M
from voxloom.registry import collect
from voxloom.session import CacheBudget, cut_table_at, drop_table

QUERIES, _ = collect()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}


def test_warping_costs(spark, vectors):
    out = {r.vec_id: (r.cost, r.mean_cost) for r in QUERIES["dtw_cost"](spark, SMALL).collect()}
    assert set(out) == set(vectors)
    for k in sorted(vectors)[:10]:
        a = vectors[k]
        b = a[::-1]
        cost = np.full((len(a) + 1, len(b) + 1), np.inf)
        cost[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
        assert math.isclose(out[k][0], cost[-1, -1], abs_tol=1e-5)


def test_log_mel_by_plain_sums(spark, vectors):
    out = {r.vec_id: r.x for r in QUERIES["log_mel_features"](spark, SMALL).collect()}
    n, hop, mels, fs = 16, 4, 8, 16000
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(fs / 2) * i / (mels + 1) / 2595) - 1) for i in range(mels + 2)]
    for k in sorted(vectors)[:5]:
        v = list(vectors[k])
        y = v[8:0:-1] + v + v[-2:-10:-1]
        want = []
        for at in range(0, len(y) - n + 1, hop):
            f = [y[at + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / n)) for i in range(n)]
            mag = [abs(sum(f[i] * complex(math.cos(2 * math.pi * i * q / n), -math.sin(2 * math.pi * i * q / n)) for i in range(n))) for q in range(n // 2 + 1)]
            for m in range(mels):
                lo, mid, hi = edges[m : m + 3]
                w = [max(0.0, min((q * fs / n - lo) / (mid - lo), (hi - q * fs / n) / (hi - mid))) for q in range(n // 2 + 1)]
                want.append(math.log10(max(1e-10, sum(a * b for a, b in zip(mag, w)))))
        assert np.allclose(out[k], want, atol=1e-6)


def test_speed_and_room(spark, vectors):
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in list(vectors.items())[:5]] + [(-1, []), (-2, None)], "k bigint, x array<double>")
    fast = {r.k: r.x for r in M.speed_perturbed(df, "k", "x", 1.1).collect()}
    room = {r.k: r.x for r in M.convolved(df, "k", "x", [1.0, 0.5, 0.25]).collect()}
    for k, v in list(vectors.items())[:5]:
        at = [i * 1.1 for i in range(int((len(v) - 1) / 1.1) + 1)]
        assert np.allclose(fast[k], [v[int(t)] + (t - int(t)) * ((v[int(t) + 1] if int(t) + 1 < len(v) else 0) - v[int(t)]) for t in at])
        y = [v[i] + 0.5 * (v[i - 1] if i else 0) + 0.25 * (v[i - 2] if i > 1 else 0) for i in range(len(v))]
        assert np.allclose(room[k], np.array(y) * math.sqrt(sum(v**2) / sum(x * x for x in y)))


def test_cubic_resizing():
    v = np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    assert np.array_equal(M.cubic_resized(v, 5), v)
    assert np.allclose(M.cubic_resized(np.full(7, 2.5), 11), 2.5) and np.allclose(M.cubic_resized(np.full(40, 2.5), 9), 2.5)
    # Twice the length: each new value lies a quarter beside an old one.
    k = lambda d: (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0
    up = M.cubic_resized(v, 10)
    for i in range(10):
        w = [k(abs((i + 0.5) / 2 - (j + 0.5))) for j in range(5)]
        assert math.isclose(up[i], sum(a * b for a, b in zip(w, v)) / sum(w))
    warped = M.cubic_resized(np.arange(12.0).reshape(6, 2), 9)
    assert warped.shape == (9, 2) and np.all(np.diff(warped[:, 0]) > 0)


def test_warped_arrays_keep_their_length(spark, vectors):
    out = {r.vec_id: r.x for r in QUERIES["augmented_signals"](spark, SMALL).collect()}
    assert set(out) == set(vectors) and {len(x) for x in out.values()} == {58}
    assert out == {r.vec_id: r.x for r in QUERIES["augmented_signals"](spark, SMALL).collect()}


def test_intelligibility():
    rnd = np.random.default_rng(5)
    t = np.arange(12_000) / 10_000
    x = sum(np.sin(2 * np.pi * f * t) * (1 + 0.8 * np.sin(2 * np.pi * (3 + i) * t)) for i, f in enumerate((200, 500, 1100, 2500)))
    scores = [M.stoi(x, x + g * rnd.normal(size=len(x))) for g in (0.0, 0.5, 2.0, 8.0)]
    assert math.isclose(scores[0], 1.0, abs_tol=1e-9) and all(a > b for a, b in zip(scores, scores[1:]))
    assert math.isclose(M.stoi(x, 3.0 * x), 1.0, abs_tol=1e-9) and math.isnan(M.stoi(x[:100], x[:100])) and math.isnan(M.stoi(x[:1000], x[:1000]))
    with pytest.raises(ValueError):
        M.stoi(x, x, 16_000)


def test_edit_operations_add_up(spark):
    from voxloom.operators.scoring import edit_counts
    from voxloom.plans.scoring_queries import versions

    n_hyp = {r.uttid: r.n for r in versions(spark, SMALL).select("uttid", F.size(T.words(F.coalesce("hyp", F.lit("")))).alias("n")).collect()}
    edits = {r.uttid: r.edits for r in QUERIES["word_edits"](spark, SMALL).collect()}
    for r in QUERIES["edit_operations"](spark, SMALL).collect():
        assert r.n_cor + r.n_sub + r.n_del == r.n_ref and r.n_cor + r.n_sub + r.n_ins == n_hyp[r.uttid] and r.n_sub + r.n_del + r.n_ins == edits[r.uttid]
    assert edit_counts(list("abcd"), list("abxd")) == (3, 1, 0, 0) and edit_counts([], list("ab")) == (0, 0, 0, 2) and edit_counts(list("ab"), []) == (0, 0, 2, 0)
    long = [f"w{i % 7}" for i in range(9000)]
    assert edit_counts(long, ["z", *long]) == (9000, 0, 0, 1)


def test_clusters_hold_their_nearest(spark, vectors):
    sizes = {r.cid: r.n for r in QUERIES["kmeans_sizes"](spark, SMALL).collect()}
    assert sum(sizes.values()) == len(vectors) and len(sizes) <= 8


@pytest.mark.parametrize(
    "cleaner,text,want",
    [
        ("tacotron", "(Hello-World);   &  jr. & dr.", "HELLO WORLD, AND JUNIOR AND DOCTOR"), ("tacotron", "Mr. Café paid 1,250 for the 21st [box]", "MISTER CAFE PAID ONE THOUSAND TWO HUNDRED FIFTY FOR THE TWENTY FIRST BOX"),
        ("tacotron", "pi is 3.14, at 12:30", "PI IS THREE POINT ONE FOUR, AT TWELVE,THIRTY"), ("tacotron", "1000000007 x86 1234567890123", "ONE BILLION SEVEN X86 ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE ZERO ONE TWO THREE"),
        ("jaconv", "ﾃｽﾄ〜Ａ１", "テストーA1"), ("jaconv", "“a”", "``a\""), ("korean_cleaner", " aZc9é ", "에이지씨구é"), ("tacotron", "", ""), ("tacotron", None, None), ("jaconv", None, None),
    ],
)
def test_cleaners(spark, cleaner, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.clean(F.col("t"), [cleaner]).alias("c")).first().c == want


def test_tables_within_a_budget(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    budget = CacheBudget(size + 10)
    kept = budget.keep(df)
    other = budget.keep(df.filter("id > 5"))
    assert kept.is_cached and not other.is_cached and budget.used == size
    kept.unpersist()


def test_dropped_tables_are_gone(spark):
    import os

    df, path = cut_table_at(spark.range(5))
    assert df.count() == 5
    at = path.replace("file:", "")
    assert os.path.exists(at)
    drop_table(spark, path)
    assert not os.path.exists(at)


def test_translation_edits():
    from voxloom.operators.scoring import edit_counts, longest_common, translation_edits

    ref = "saudi arabia denied this week information published in the american new york times".split()
    hyp = "this week the saudis denied information published in the new york times".split()
    assert translation_edits(ref, hyp) == 4  # the published example: one shift, three edits, of 13 words
    assert translation_edits(list("abcdef"), list("defabc")) == 1 and translation_edits([], list("ab")) == 2 and translation_edits(list("ab"), []) == 2 and translation_edits(list("ab"), list("ab")) == 0
    rnd = np.random.default_rng(6)
    for _ in range(150):
        a, b = (rnd.integers(0, 5, rnd.integers(0, 9)).tolist() for _ in range(2))
        assert translation_edits(a, b) <= sum(edit_counts(a, b)[1:]) and (translation_edits(a, b) == 0) == (a == b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert longest_common(a, b) == table[-1][-1]


def test_rows_of_sequence_scores(spark):
    from voxloom.operators.scoring import sequence_scores

    df = spark.createDataFrame([("a", ["x", "y"], ["y", "x"]), ("b", None, ["x"]), ("c", None, None), ("a", ["x", "y"], ["y", "x"])], "r string, ref array<string>, h array<string>")
    out = sorted((r.r, r.n_ref, r.edits, r.rouge_l) for r in sequence_scores(df, "r", "ref", "h").collect())
    assert out == [("a", 2, 1, 0.5), ("a", 2, 1, 0.5), ("b", 0, 1, 0.0), ("c", 0, 0, 1.0)]
    assert sequence_scores(df.limit(0), "r", "ref", "h").count() == 0
