import math
import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import batching as B
from voxloom.operators import relations as R
from voxloom.operators import scoring as C
from voxloom.operators import sequence as W
from voxloom.operators import splitting as S
from voxloom.operators import stats as A
from voxloom.operators.intervals import merge_intervals
from voxloom.operators.ordering import global_index
from voxloom.operators.versions import current_version


def brute_islands(rows):
    out = []
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, ivs in by.items():
        ivs.sort()
        cur = None
        for s, t in ivs:
            if cur is None or s > cur[1]:
                if cur:
                    out += [("period", e, *cur), ("gap", e, cur[1], s, 0)]
                cur = [s, t, 1]
            else:
                cur = [cur[0], max(cur[1], t), cur[2] + 1]
        out.append(("period", e, *cur))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_merge_intervals_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(60)]), rnd.choice([None, *range(80)])) for _ in range(400)]
    rows += [("long", 0, 10**6)] + [("long", i * 10, i * 10 + 3) for i in range(300)] + rows[:20]
    # columns that the operator itself uses inside are not in its way
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "e string, s bigint, t bigint, pid int, lo int, kind string").repartition(7)
    got = sorted(tuple(r) for r in merge_intervals(df, "e", "s", "t").collect())
    assert got == brute_islands(rows)


def test_merge_intervals_of_nothing(spark):
    df = spark.createDataFrame([], "e string, s bigint, t bigint")
    assert merge_intervals(df, "e", "s", "t").collect() == []


def test_current_version(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), (None, 9, "x"), ("b", None, "y"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, loaded_at int, v string")
    assert {(r.k, r.v) for r in current_version(df, ["k"]).collect()} == {("a", "new"), ("b", "y"), ("c", None)}


def test_global_index_is_dense_under_skew(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1), (None, 3)], "k string, i int").repartition(5)
    rows = sorted(global_index(df, [F.col("k").asc_nulls_first(), F.col("i")]).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(502))
    assert [(r.k, r.i) for r in rows[:3]] == [(None, 3), ("a", 1), ("hot", 0)]
    assert global_index(df.limit(0), ["k"]).count() == 0


def test_joins_and_mismatches(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3)], "k string, v int")
    with pytest.raises(R.KeyMismatch):
        R.strict_join([a, b], "k")
    assert [tuple(r) for r in R.strict_join([a, b], "k", keys=b).collect()] == [("x", 1, 3)]
    with pytest.raises(Exception, match="key not found"):
        R.lookup_join(a, [b], "k").collect()
    assert sorted(map(tuple, R.last_writer_union([a, b], "k").collect())) == [("x", 3), ("y", 2)]
    assert sorted(r.k for r in R.suffixed_union([a, b], "k").collect()) == ["x", "x.1", "y"]
    with pytest.raises(ValueError, match="missing"):
        R.check_columns(a, ["k", "z"])
    assert sorted(map(tuple, R.symmetric_difference(a, a.union(b)).collect())) == [("x", 3)]


def test_contains_join_against_all_pairs(spark):
    needles = ["ab", "abcdefghij", "", "zz", None, "ab"]
    hays = ["xxabyy", "abcdefghijk", "", None, "zz"]
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    h = spark.createDataFrame([(x,) for x in hays], "h string")
    want = sorted((x, y) for x in needles for y in hays if x and y is not None and x in y)
    assert sorted((r.n, r.h) for r in R.contains_join(n, h, "n", "h").collect()) == want


def fold_loop(items, fold):
    out, state, at = [], None, -1
    for v in items:
        new = fold.add(state, v) if state is not None else None
        if new is None:
            at, new = at + 1, fold.open(v)
        state = new
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_folds_over_partitions_equal_one_loop(spark, seed):
    rnd = random.Random(seed)
    rows = sorted((rnd.choice([5, 5, 5, rnd.randint(1, 60)]), i, rnd.randint(1, 30)) for i in range(300))
    df = spark.createDataFrame(rows, "a int, i int, b int").repartition(6)

    def got(f):
        return [r.batch for r in sorted(f.collect(), key=lambda r: (r.a, r.i))]

    add = lambda s, v: None if s[0] * (s[1] + s[2]) > 200 and s[0] >= 2 else [s[0] + 1, max(s[1], v[0]), max(s[2], v[1])]
    assert got(B.length_batches(df, ["a", "b"], 200, ["a", "i"], least=2)) == fold_loop([(a, b) for a, _, b in rows], B.Fold(lambda v: [1, *v], add))
    assert got(B.greedy_groups(df.withColumn("g", F.lit("x")), "g", ["a", "i"], "b", 55)) == fold_loop([(b,) for *_, b in rows], B.Fold(lambda v: [v[0]], lambda s, v: [s[0] + v[0]] if s[0] + v[0] <= 55 else None))


def test_folded_batches_golden(spark):
    one = {"a": 1000, "b": 400, "c": 800, "d": 789, "e": 1023, "f": 999}
    two = {"a": 30, "b": 50, "c": 39, "d": 49, "e": 44, "f": 99}
    df = spark.createDataFrame([(k, one[k], two[k]) for k in one], "k string, x int, y int")
    rows = B.folded_batches(df, ["x", "y"], [500, 80], 2, ["x", "k"]).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, set()).add(r.k)
    assert [batches[i] for i in sorted(batches)] == [{"b", "d"}, {"c"}, {"f"}, {"a"}, {"e"}]
    with pytest.raises(ValueError, match="no batch type"):
        B.build_batches("none", df)


def test_chunks_golden(spark):
    df = spark.createDataFrame([("a", list(range(8))), ("b", list(range(8, 13))), ("c", [1, 2]), ("d", None), ("e", [])], "k string, x array<int>")
    n = {r.k: r.n for r in df.select("k", F.size(W.chunks(F.col("x"), 3, 0.5)).alias("n")).collect()}
    assert n["a"] == 6 and n["b"] == 3 and n["c"] in (-1, None) and n["d"] in (-1, None)
    with pytest.raises(ValueError):
        W.chunks(F.col("x"), 3, 0.1)


def test_text_functions_golden(spark):
    df = spark.createDataFrame([("He[foo]llo",), ("  a  b ",), ("",), (None,)], "t string")
    rows = df.select(T.char_tokens(F.col("t"), ["[foo]"]).alias("c"), T.words(F.col("t")).alias("w"), T.grouped_chars(F.col("t"), 2).alias("g")).collect()
    assert rows[0].c == ["H", "e", "[foo]", "l", "l", "o"]
    assert rows[1].w == ["a", "b"] and rows[1].g == ["<space><space>", "a<space>", "<space>b", "<space>"]
    assert rows[2].c == [] and rows[2].w == [] and rows[3].c is None and rows[3].w is None
    jp = spark.createDataFrame([("あ い う",), ("あ あ う",), ("か き く",)], "t string")
    from voxloom.functions.vocabulary import sorted_tokens

    v = {r.token: r.id for r in sorted_tokens(jp, T.words(F.col("t")), 0, 100).collect()}
    assert v == {"<unk>": 1, "あ": 2, "い": 3, "う": 4, "か": 5, "き": 6, "く": 7}
    with pytest.raises(ValueError):
        T.clean(F.col("t"), ["none"])
    assert spark.range(1).select(T.korean_clean(F.lit(" a1 ")).alias("k")).first().k == "에이일"


def test_splits_and_best(spark):
    df = spark.createDataFrame([(i, "hot" if i < 80 else None) for i in range(100)], "i int, l string")
    rows = S.stratified(df, "l", "i", 1, [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).collect()
    count = {}
    for r in rows:
        count[r.l, r.split] = count.get((r.l, r.split), 0) + 1
    assert len(rows) == 100 and count["hot", "train"] == 64 and count[None, "test"] == 2
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None), (4, 0.5)], "k int, v double")
    assert [r.k for r in S.keep_best(nan, [("v", True)], 1, "k").collect()] == [4]
    assert S.epoch_slice(df.limit(0).withColumn("ordinal", F.lit(0)), 0, 3, 1).count() == 0
    many = S.epoch_slice(global_index(df.limit(3), ["i"]), 3, 7, 1).collect()
    assert sorted((r.place, r.ordinal) for r in many) == [(p, (7 + p) % 3) for p in range(7)]


def test_metrics(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (nan, 1.0), (inf, 1.0)], "v double, w double")
    r = df.select(A.metric_average(F.col("v")).alias("a"), A.metric_weighted(F.col("v"), F.col("w")).alias("b")).first()
    assert r.a == inf and r.b == 2.5
    none = df.limit(0).select(A.metric_average(F.col("v")).alias("a"), A.metric_weighted(F.col("v"), F.col("w")).alias("b")).first()
    assert math.isnan(none.a) and math.isnan(none.b)
    e = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 4.0), (4, nan), (5, 6.0)], "epoch int, v double")
    assert [(r.best_epoch, r.stop) for r in A.running_best(e, "epoch", "v", 2).orderBy("epoch").collect()] == [(1, False), (2, False), (2, False), (2, False), (2, True)]
    assert A.real_time_factor(spark.createDataFrame([(5186.688, 693.7)], "d double, a double"), "d", "a").select(F.round("rtf", 3).alias("r")).first().r == 7.477


def test_permutations_and_assignment(spark):
    rnd = random.Random(4)
    rows = [(u, r, h, *[rnd.randint(0, 19) for _ in range(4)]) for u in ("x", "y") for r in (1, 2) for h in (1, 2)]
    df = spark.createDataFrame(rows, "id string, ref int, hyp int, c int, s int, d int, i int")
    table = {(u, r, h): v for u, r, h, *v in rows}
    for r in C.permutation_free_error(df, "id", 2).collect():
        rates = []
        for perm in ((1, 2), (2, 1)):
            c, s, d, i = (sum(table[r.id, k + 1, perm[k]][j] for k in range(2)) for j in range(4))
            rates.append((s + d + i) / (c + s + d))
        assert r.perm == rates.index(min(rates)) and abs(r.rate - min(rates)) < 1e-12
    a = spark.createDataFrame([("x", 1, 1, 0.1), ("x", 2, 1, 0.0), ("x", 3, 1, None)], "id string, ref int, hyp int, cost double")
    assert [tuple(r) for r in C.assignment(a, "id", "cost").collect()] == [("x", 2, 1)]


def test_edit_counts():
    assert C.edit_counts("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert C.edit_counts([], ["a"]) == (0, 0, 0, 1) and C.edit_counts(["a"], []) == (0, 0, 1, 0) and C.edit_counts([], []) == (0, 0, 0, 0)


def test_ctc_forward_sums_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(3), size=4))
    total = 0.0
    for path in itertools.product(range(3), repeat=4):
        out = [p for i, p in enumerate(path) if (i == 0 or p != path[i - 1]) and p != 0]
        if out == [1, 2]:
            total += math.exp(sum(logp[t, p] for t, p in enumerate(path)))
    assert abs(C.ctc_forward(logp, [1, 2]) - math.log(total)) < 1e-9


def warped_by_cells(a, b):
    """(cost, steps) of the best path; of equal costs the fewest steps."""
    best = {(-1, -1): (0.0, 0)}
    for i in range(len(a)):
        for j in range(len(b)):
            c, n = min(best.get(p, (math.inf, 0)) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
            best[i, j] = (c + abs(a[i] - b[j]), n + 1)
    return best[len(a) - 1, len(b) - 1]


def test_warping_against_all_cells():
    import numpy as np

    rnd = random.Random(12)
    for n, m in [(1, 1), (1, 7), (7, 1), (5, 5), (13, 40), (64, 64)]:
        for draw in (lambda: float(rnd.randint(0, 3)), rnd.random):
            a, b = [draw() for _ in range(n)], [draw() for _ in range(m)]
            cost, steps = W.dtw_cost(np.array(a)[:, None], np.array(b)[:, None])
            want = warped_by_cells(a, b)
            assert abs(cost - want[0]) < 1e-9 and steps == want[1]


def test_whole_vectors_are_warped(spark, tmp_path):
    from voxloom.plans.sequence_queries import QUERIES

    rnd = random.Random(13)
    rows = [(i, 0, [rnd.random() if k >= 24 else 0.0 for k in range(64)]) for i in range(4)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.cost, r.mean_cost) for r in QUERIES["dtw_cost"](spark, str(tmp_path)).collect()}
    for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect():
        cost, steps = warped_by_cells(r.embedding, r.embedding[::-1])
        assert abs(got[r.vec_id][0] - cost) < 1e-5 and abs(got[r.vec_id][1] - cost / steps) < 1e-5
