import os
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxloom.functions import vocabulary as V
from voxloom.functions.tokenizers import build_tokenizer
from voxloom.operators import chains as H
from voxloom.operators import enhancement as E
from voxloom.operators.relations import contains_join, uneven_keys
from voxloom.operators.scoring import best_assignment, chrf, shared_grams
from voxloom.plans.chain_queries import PIECES


def test_configurations_are_checked_before_anything_runs():
    for bad, error in ((dict(type="nothing"), ValueError), (dict(type="gain", db=1, loud=2), TypeError), (dict(type="gain"), TypeError)):
        with pytest.raises(error):
            H.Chain((bad,))
    with pytest.raises(TypeError):
        H.Chain(({"type": "seeded_masks", "n": 1, "widest": 3},))  # nothing gives the key
    H.Chain(({"type": "seeded_masks", "n": 1, "widest": 3},), key="k")
    with pytest.raises(NotImplementedError):
        H.Chain.of({"mode": "parallel", "process": []})
    with pytest.raises(ValueError):
        build_tokenizer("nothing")
    with pytest.raises(ValueError):
        build_tokenizer("phn", g2p="some_program")


def test_chain_of_seeded_stages_is_the_same_in_every_run(spark):
    df = spark.createDataFrame([("a", [1.0] * 30, "x"), ("b", [2.0] * 30, None), ("c", None, "y"), ("d", [], "z")], "uttid string, x array<double>, text string").repartition(3)
    chain = H.Chain(({"type": "seeded_masks", "n": 2, "widest": 9, "seed": 4}, {"type": "peak"}), key="uttid")
    one, two = ({r.uttid: r.x for r in chain(df.repartition(n)).collect()} for n in (1, 4))
    assert one == two and one["c"] is None and one["d"] == [] and set(one["a"]) <= {0.0, 1.0}


def test_collated_batches(spark):
    rows = [(1, "b", [1, 2]), (1, "a", [3]), (2, "c", None), (2, None, [9, 9, 9]), (3, "d", [])]
    df = spark.createDataFrame(rows, "batch int, k string, x array<int>")
    out = {r.batch: (r["keys"], r.x, r.x_lengths) for r in H.collated(df, "batch", "k", {"x": -1}).collect()}
    assert out == {1: (["a", "b"], [[3, -1], [1, 2]], [1, 2]), 2: ([None, "c"], [[9, 9, 9], [-1, -1, -1]], [3, 0]), 3: (["d"], [[]], [0])}
    assert H.collated(df.limit(0), "batch", "k", {"x": -1}).count() == 0
    with pytest.raises(ValueError):
        H.collated(df.withColumn("x_lengths", F.lit(1)), "batch", "k", {"x": -1})


def test_tasks_check_their_columns(spark):
    df = spark.createDataFrame([("a", "x")], "uttid string, text string")
    with pytest.raises(ValueError):
        H.Task(required=("speech",)).samples([df])
    with pytest.raises(ValueError):
        H.Task(required=()).samples([df])
    assert H.Task(required=(), optional=("text",)).samples([df]).count() == 1


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no public model here")
def test_subwords_equal_the_public_libraries(spark):
    import sentencepiece
    import tokenizers

    texts = ["Hello world", "", None, "naïve café 漢字", "x" * 3000, "a\tb  c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    made = build_tokenizer("bpe", path=PIECES)
    got = {r.i: (r.p, r.b) for r in df.select("i", made.tokens(F.col("t")).alias("p")).select("i", "p", made.text(F.col("p")).alias("b")).collect()}
    assert got == {i: (None, None) if t is None else (sp.encode(t, out_type=str), sp.decode(sp.encode(t))) for i, t in enumerate(texts)}
    path = PIECES.replace("piece_bpe_32k.model", "byte_bpe_50k.json")
    hf = tokenizers.Tokenizer.from_file(path)
    made = build_tokenizer("hugging_face", path=path)
    got = {r.i: (r.p, r.b) for r in df.select("i", made.tokens(F.col("t")).alias("p")).select("i", "p", made.text(F.col("p")).alias("b")).collect()}
    assert all(got[i] == ((None, None) if t is None else (hf.encode(t, add_special_tokens=False).tokens, t)) for i, t in enumerate(texts))


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_ids_by_lookup_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_SENT", most)
    df = spark.createDataFrame([("a", ["x", "y", "z", "x"]), ("b", []), ("c", None), ("d", [None, "y"]), ("e", ["q"])], "k string, t array<string>").repartition(3)
    vocab = spark.createDataFrame([("x", 5), ("y", 6), ("<eos>", 7)], "token string, id bigint")
    ids = {r.k: r.ids for r in V.token_ids(df, "k", F.col("t"), vocab, 1).collect()}
    assert ids == {"a": [5, 6, 1, 5], "d": [1, 6], "e": [1]}
    back = spark.createDataFrame([("a", [5, 6, 7]), ("b", [7]), ("c", None), ("d", [9, 6])], "k string, i array<bigint>")
    assert {r.k: r.text for r in V.ids_to_text(back, "k", "i", vocab).collect()} == {"a": "x y", "d": "y"}


def test_needles_with_a_common_beginning(spark):
    needles = [f"corpus-of-speech-{i:03}" for i in range(60)] + ["ab", "", None, "corpus-of-speech-007"]
    hay = [f"/data/{n}/x.wav" for n in needles[:60:3]] + ["abab", None, "corpus-of-speech-"] * 2
    a = spark.createDataFrame([(n, i) for i, n in enumerate(needles)], "n string, id int")
    b = spark.createDataFrame([(h,) for h in hay], "h string")
    want = sorted((n, h) for n in needles if n for h in hay if h and n in h)
    assert sorted((r.n, r.h) for r in contains_join(a, b, "n", "h").collect()) == want
    assert contains_join(a.limit(0), b, "n", "h").count() == 0 and contains_join(a, b.limit(0), "n", "h").count() == 0


def test_uneven_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "k string, k2 int")
    assert {tuple(r) for r in uneven_keys([a, b], "k").collect()} == {("x", 2, 1), ("z", 0, 1), (None, 1, 0)}


def test_assignment_against_all_permutations():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n, m = sorted(rnd.integers(1, 6, 2))
        cost = rnd.integers(-5, 9, (n, m)).astype(float)
        got = best_assignment(cost)
        assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), int(n)))
    assert len(best_assignment(rnd.random((60, 80)))) == 60  # far beyond what subsets could do


def test_mixture_with_early_parts():
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=50), rnd.normal(size=40)
    h = np.concatenate([[0.1, 1.0], np.zeros(8), [0.5]])
    mix, refs, noise = E.mix_signals([a, b], [h, np.ones(1)], rnd.normal(size=7), fs=100, snr_db=5.0, scale=0.7, early_ms=50)
    assert np.isclose(np.abs(mix).max(), 0.7) and len(mix) == 50
    k = refs[1][0] / b[0]  # one scale for all signals
    early = np.convolve(a, h[:7])[:50]
    late = np.convolve(a, h)[:50]
    assert np.allclose(refs[0], early * k) and np.allclose(mix - noise, (late + np.pad(b, (0, 10))) * k)
    assert np.isclose(10 * np.log10(((mix - noise) ** 2).sum() / (noise**2).sum()), 5.0)
    assert E.mix_signals([], None, None, 100, 0.0, 0.5)[0].size == 0


def test_missing_speakers_are_filled_only_where_allowed(spark):
    df = spark.createDataFrame([(1, [[1.0, -1.0, 2.0], [0.5, 0.0, -0.5]], [[0.9, -1.1, 2.0]])], "k int, r array<array<double>>, e array<array<double>>")
    out = {r.ref: r.hyp for r in E.separation_scores(df, "k", "r", "e", flexible=True).collect()}
    assert out == {1: 1, 2: 2}
    with pytest.raises(PySparkException):
        E.separation_scores(df, "k", "r", "e").collect()


def test_segments_must_reach_the_length(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], 3), (2, 0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], 4)], "s int, k int, x array<array<double>>, n int")
    assert E.stitched_streams(df.filter("s = 1"), "s", "k", "x", 2, 2, 1, "n").count() == 6
    with pytest.raises(PySparkException):
        E.stitched_streams(df, "s", "k", "x", 2, 2, 1, "n").collect()


def test_chrf_of_equal_and_of_empty_texts(spark):
    same = spark.createDataFrame([("the cat", "the cat"), (None, "")], "r string, h string")
    assert abs(chrf(same, "r", "h").first()[0] - 100) < 1e-9
    assert chrf(same.limit(0), "r", "h").first()[0] == 0.0


def plain_chrf(pairs, most=6, beta=2.0):
    p, r = [], []
    for n in range(1, most + 1):
        m = a = b = 0
        for x, y in (["".join(re.split("[ \t\n\x0b\f\r]", t or "")) for t in pair] for pair in pairs):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
            m, a, b = m + (x & y).total(), a + x.total(), b + y.total()
        p, r = p + [m / b] * (b > 0), r + [m / a] * (a > 0)
    p, r = sum(p) / max(len(p), 1), sum(r) / max(len(r), 1)
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r)


def test_chrf_counts_each_pair_where_it_lies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abé語\U0001f600 \n", k=rng.randint(0, 30)))
    pairs = [(word(), word()) for _ in range(300)]
    pairs += [(x, x) for x, _ in pairs[:50]] + [(None, "ab"), ("aaaa", "aa"), ("ab", None), ("ab" * 4000, "ba" * 3000)]
    df = spark.createDataFrame(pairs, "r string, h string").repartition(3)
    assert abs(chrf(df, "r", "h").first()[0] - plain_chrf(pairs)) < 1e-9
    # What is shuffled is one row a length and partition, whatever the texts are.
    plan = chrf(df, "r", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.index("Aggregate [n#") < plan.index("MapInPandas")
    parts = [(x or "", y or "") for x, y in pairs]
    assert (shared_grams(parts, 6) == sum(shared_grams([p], 6) for p in parts)).all()


def plain_search(scores, block, hop, ahead, beam, end):
    """The search with all positions at hand: what the stream must give whatever its micro-batches."""
    rows, running, ended, at, k, n = [], [(0.0, ())], [], 0, 0, len(scores)
    stops = list(range(block - ahead, n + 1, hop))
    stops += [n] if not stops or stops[-1] != n else []
    for stop in stops:
        while at < stop and running:
            made = sorted(((s + x, (*t, c)) for s, t in running for c, x in enumerate(scores[at])), key=lambda h: (-h[0], h[1]))[:beam]
            if made[0][1][-1] == end and stop != n:
                break
            running, ended, at = [h for h in made if h[1][-1] != end], ended + [h for h in made if h[1][-1] == end], at + 1
        listed = sorted([*((False, h) for h in running), *(((True, h) for h in ended) if stop == n else ())], key=lambda x: (-x[1][0], x[1][1]))
        rows += [(k, at, e, list(h[1]), round(h[0], 9)) for e, h in listed[:beam]]
        k += 1
    return rows


def test_streamed_search(spark, tmp_path):
    from voxloom.streaming import stateful as X
    from voxloom.streaming.runs import run_available

    rnd = random.Random(3)
    schema = "k string, seq bigint, x array<double>, fin boolean"
    keys = {f"k{i}": [[rnd.choice([-3.0, -1.0, -0.5]), rnd.random(), rnd.random()] for _ in range(rnd.randint(1, 30))] for i in range(8)}
    keys["early"] = [[5.0, 0.0, 0.0]] * 12  # the end is best from the first position on
    rows = [(k, i, x, i == len(v) - 1) for k, v in keys.items() for i, x in enumerate(v)]
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i, part in enumerate((0, 5, 14)):
        stop = (5, 14, 99)[i]
        spark.createDataFrame([r for r in rows if part <= r[1] < stop], schema).coalesce(1).write.parquet(f"{folder}/{i}")
        os.utime(f"{folder}/{i}", (i + 1, i + 1))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = {}
    for r in run_available(X.block_search(s, "k", "seq", "x", "fin", 8, 4, 2, beam=3)).collect():
        got.setdefault(r.k, []).append((r.block, r.place, r.ended, list(r.tokens), r.score))
    order = lambda x: sorted(x, key=lambda r: (r[0], -r[4], r[3]))
    for k, v in keys.items():
        assert order(got.get(k, [])) == order(plain_search(v, 8, 4, 2, 3, 0)), k


def test_writers_leave_out_nulls(spark, tmp_path):
    from voxloom.sources import binary, sinks

    df = spark.createDataFrame([("a.npy", [1.0, 2.0]), ("b.npy", None), (None, [3.0]), ("c.npy", [])], "n string, x array<double>")
    assert sinks.write_files(df, f"file://{tmp_path}/npy", "n", "x", binary.encode_npy) == 2
    assert sorted((os.path.basename(r.path), r["shape"], r["values"]) for r in binary.read_npy(spark, f"{tmp_path}/npy").collect()) == [("a.npy", [2], [1.0, 2.0]), ("c.npy", [0], [])]
    assert sinks.write_ark(df, str(tmp_path / "ark"), "n", "x") == 2
    assert {r.uttid: r["values"] for r in binary.read_ark(spark, str(tmp_path / "ark")).collect()} == {"a.npy": [1.0, 2.0], "c.npy": []}
    assert list(binary.decode_ark(binary.encode_ark("k", np.array([3, -4]))))[0][1].tolist() == [3, -4]


def test_container_of_sounds(spark, tmp_path):
    from voxloom.sources import binary, sinks

    df = spark.createDataFrame([("a", [[1, -2, 3], [4, 5, 40000]]), ("b", [[]]), (None, [[1]]), ("c", None)], "k string, x array<array<int>>")
    sinks.write_sounds(df, str(tmp_path / "s"), "k", "x", 8000)
    got = {r.key: (r.length, r.rate, r.samples) for r in binary.read_sounds(spark, str(tmp_path / "s"), normalise=False).collect()}
    assert got == {"a": (3, 8000, [[1.0, -2.0, 3.0], [4.0, 5.0, 32767.0]]), "b": (0, 8000, [[]])}
