import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm.encode import DEFAULT_RANKS, PATTERN, Encoder, encode_corpus
from voxloom.llm.leaks import align, leaked_items
from voxloom.llm.lookalike import consistent_forms, look_alike
from voxloom.llm.overlap import WordIndex, cross_split_links, cross_split_pairs, edit_distances, spans_of
from voxloom.llm.packing import best_fit_plan, pack
from voxloom.llm.personal import Finder, Lexicon, count_words, find_personal, iban, luhn, redact
from voxloom.llm.pieces import Limits, RangeMaximum, cut_item, cut_pieces, cut_units, strengths
from voxloom.llm.queries import ORACLE, QUERIES, current_texts
from voxloom.llm.splits import components, grouped_splits, place_block, speaker_splits, tied_speakers
from voxloom.llm.terms import frequent_ngrams, marked_terms, ngram_counts, suffix_array
from voxloom.llm.words import comparison_words
from voxloom.operators.versions import current_version

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


# 1. Splits


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(1)
    edges = {"chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "star": [("hub", f"l{i}") for i in range(80)], "random": [(f"r{rnd.randint(0, 60)}", f"r{rnd.randint(0, 60)}") for _ in range(40)], "none": []}[shape]
    df = spark.createDataFrame([*edges, *edges[:3], (None, "x"), ("y", "y")], "a string, b string")
    assert {r.node: r.root for r in components(df).collect()} == brute_components([e for e in edges if e[0] != e[1]])


def test_tied_speakers_and_splits(spark):
    rows = [("u1", " Ann "), ("u1", "bob"), ("u2", "sp0.9-cy"), ("u3", "SP1.1-cy"), ("u4", "unk"), ("u5", None), ("sp0.9-u5", "<NA>"), (None, "dan"), (None, "ann"), ("u6", "sp1.1-bob"), ("u1", "bob"), ("u7", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "uttid string, spkid string, component int")
    got = {r.speaker: r.component for r in tied_speakers(df).collect()}
    assert got["ann"] == got["bob"] == got["sp1.1-bob"] and got["sp0.9-cy"] == got["sp1.1-cy"] and got["dan"] == "dan" and len(got) == 6
    labels = spark.createDataFrame([("u1", "x"), ("u9", "y")], "uttid string, label string")
    split = {r.uttid: r.split for r in speaker_splits(df, labels, {"train": 0.5, "test": 0.5}).collect()}
    assert set(split) == {"u1", "u2", "u3", "u4", "u5", "sp0.9-u5", "u6", "u7"}
    assert split["u1"] == split["u6"] and split["u2"] == split["u3"] and split["u5"] == split["sp0.9-u5"]
    empty = df.limit(0)
    assert tied_speakers(empty).count() == 0 and speaker_splits(empty, labels, {"train": 1.0}).count() == 0


def test_grouped_splits_are_stratified_and_whole(spark):
    rnd = random.Random(2)
    rows = [(f"r{i}", f"c{rnd.randint(0, 400)}", rnd.choice("aaab")) for i in range(6000)] + [(f"z{i}", f"rare{i % 40}", "rare") for i in range(200)] + [("n1", None, None)]
    df = spark.createDataFrame(rows, "record string, component string, label string").repartition(5)
    out = {r.record: r.split for r in grouped_splits(df, {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()}
    assert len(out) == len(rows)
    by_comp, share = {}, {}
    for r, c, lab in rows:
        if c:
            by_comp.setdefault(c, set()).add(out[r])
        share.setdefault(lab, []).append(out[r])
    assert all(len(s) == 1 for s in by_comp.values())
    for lab in "ab":
        assert abs(share[lab].count("train") / len(share[lab]) - 0.8) < 0.02
    assert abs(share["rare"].count("test") / 200 - 0.1) < 0.03


def test_components_are_placed_by_their_own_vectors():
    # Alike in size and rarest label, unlike in the rest: the common labels must be shared out too.
    vectors = {f"c{i:03}": {"rare": 1, ("x" if i % 2 else "y"): 9} for i in range(200)}
    total = {"rare": 200, "x": 900, "y": 900}
    shares = [0.8, 0.1, 0.1]
    out = place_block(vectors, {k: [n * p for p in shares] for k, n in total.items()}, [2000 * p for p in shares], shares)
    for label, n in total.items():
        got = [sum(v.get(label, 0) for c, v in vectors.items() if out[c] == s) for s in range(3)]
        assert all(abs(g - n * p) <= (1 if label == "rare" else 0.05 * n) for g, p in zip(got, shares)), (label, got)


@pytest.mark.parametrize("block", [60, 100_000])
def test_worst_deviation_of_any_label(spark, monkeypatch, block):
    """However many blocks and stages, each label's shares are met within its largest component."""
    monkeypatch.setattr("voxloom.llm.splits.BLOCK", block)
    monkeypatch.setattr("voxloom.llm.splits.LARGE", 100)
    monkeypatch.setattr("voxloom.llm.splits.STAGE", 4)
    rnd = random.Random(12)
    rows = []
    for c in range(900):
        for k in range(min(int(rnd.paretovariate(0.9)), 600)):
            rows.append((f"r{c}-{k}", f"c{c}", rnd.choices(["a", "b", "c", "d", f"tail{c % 70}"], [50, 20, 10, 5, 1])[0]))
    rows += [(f"hot{k}", "hot", "a") for k in range(len(rows) // 2)]  # a third of all rows
    df = spark.createDataFrame(rows, "record string, component string, label string").repartition(6)
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    out = grouped_splits(df, shares).collect()
    assert len(out) == len(rows)
    where, label_of = {r.record: r.split for r in out}, {r: x for r, _, x in rows}
    of_comp, largest, total = {}, {}, {}
    for r, c, x in rows:
        of_comp.setdefault(c, set()).add(where[r])
    assert all(len(s) == 1 for s in of_comp.values())
    for (c, x), n in Counter((c, x) for _, c, x in rows).items():
        largest[x] = max(largest.get(x, 0), n)
        total[x] = total.get(x, 0) + n
    got = Counter((where[r], x) for r, x in label_of.items())
    for x in "abcd":
        assert all(abs(got[s, x] - p * total[x]) <= max(0.03 * total[x], largest[x]) for s, p in shares.items() if s != "train" or x != "a"), (x, total[x], {s: got[s, x] for s in shares})
    whole = Counter(where.values())
    assert all(abs(whole[s] - p * len(rows)) <= 0.02 * len(rows) for s, p in shares.items()), whole


# 2. Pieces


def test_range_maximum_breaks_ties_rightward():
    rnd = random.Random(3)
    import numpy as np

    v = np.array([rnd.randint(0, 3) for _ in range(200)])
    t = RangeMaximum(v, 64)
    for _ in range(500):
        i = rnd.randint(0, 190)
        j = min(199, i + rnd.randint(0, 60))
        assert t.query(i, j) == max(range(i, j + 1), key=lambda k: (v[k], k))


def distinct(n):
    return "".join(chr(0x4E00 + i) for i in range(n))


def plain_cuts(value, longest, overlap, share):
    """The rule of cut_units by looking at every position."""
    best = lambda i, j: max(range(i, j + 1), key=lambda k: (value[k], k))
    n, out, start = len(value) - 1, [], 0
    while n - start > longest:
        low = start + max(overlap + 1, int(longest * share))
        end = best(low, start + longest)
        if value[end] <= 0 and low - 1 > start + overlap and value[best(start + overlap + 1, low - 1)] > value[end]:
            end = best(start + overlap + 1, low - 1)
        out.append((start, end))
        begin = best(max(start + 1, end - 2 * overlap), end - overlap)
        start = begin if value[begin] > 0 else next((i for i in range(end - overlap + 1, end) if value[i] > 0), begin)
    return [*out, (start, n)]


def test_cuts_equal_the_rule_by_brute_force():
    rnd = random.Random(31)
    import numpy as np

    for _ in range(300):
        v = np.array([rnd.choice([0, 0, 0, 0, -2, -1, 2, 3, 4]) for _ in range(rnd.randint(1, 400))], dtype=np.int8)
        longest = rnd.randint(4, 80)
        overlap = rnd.randint(1, longest // 3)
        assert cut_units(v, longest, overlap, 0.5) == plain_cuts(v.tolist(), longest, overlap, 0.5)


def check_pieces(text, start, end, pieces, lim):
    """Limits, cover, overlap, one array for text and time, no empty piece, no needless cut inside words."""
    value = strengths(text or "")
    timed = start is not None and end is not None and end > start
    ms, at, last = (end - start if timed else 0), 0, None
    for k, (t, a, b) in enumerate(pieces):
        if timed:
            assert 0 < b - a <= lim.ms and (last is None or a < last)
            last = b
        if not text:
            continue
        assert t and len(t) <= lim.chars
        if timed:
            p = round((a - start) * len(text) / ms - 0.5 + 1e-9) if ms * 4 > lim.ms * len(text) else round((a - start) * len(text) / ms)
        else:
            p = text.find(t, max(0, at - 2 * lim.overlap_chars))
        assert 0 <= p <= at and text[p : p + len(t)] == t
        q = p + len(t)
        for cut in (p, q):
            if 0 < cut < len(text) and ms * 4 <= lim.ms * len(text):
                assert value[cut] != -2 or (value[max(1, cut - 8) : cut + 1] == -2).all()
        at = max(at, q)
    assert not text or at == len(text)
    assert not timed or (pieces[0][1] == start and pieces[-1][2] == end)


@pytest.mark.parametrize(
    "text,start,end",
    [
        (" ".join(f"word{i}" for i in range(300)), None, None), (distinct(2000), 0, 50_000), (" ".join(f"Hallo Welt{i}." for i in range(90)), 1000, 95_000), (None, 0, 95_500), ("ab", 0, 200_000), ("", 5, 30_006),
        ("。".join(distinct(800)), None, None), (" ".join(f"a{i}" for i in range(9000)), 0, 10**7), (distinct(401), 0, 7_200_000), ("hello world", 0, 90_000), (" ".join(chr(0x4E00 + i) + "\u0301\u0323" for i in range(300)), 7, 61_007), ("x" * 390 + "\u0301" * 30 + "y" * 100, None, None),
    ],
)
def test_pieces_cover_and_stay_within_limits(text, start, end):
    pieces = cut_item(text, start, end, Limits())
    assert len(pieces) > 1
    check_pieces(text, start, end, pieces, Limits())
    if start is not None:  # a second or more is shared, and the pieces' times are those of their texts
        assert all(x[2] - y[1] >= 999 for x, y in zip(pieces, pieces[1:]))


def test_words_and_letters_stay_whole():
    text = " ".join("wörd" * 3 + str(i) for i in range(200))
    words = set(text.split())
    for t, *_ in cut_item(text, 0, 120_000, Limits()):
        assert set(t.split()) <= words
    marks = "e\u0301o\u0323\u0300" * 300
    for t, *_ in cut_item(marks, None, None, Limits()):
        assert t[0] in "eo" and (t[-1] in "\u0301\u0300")


def test_all_pieces_of_the_tables(spark):
    rows = QUERIES["p2_pieces"](spark, SMALL).collect()
    seg = {r.uttid: (r.starttime, r.endtime) for r in current_version(spark.read.parquet(f"{SMALL}/segments.parquet"), ["uttid"], keep=["starttime", "endtime"]).collect()}
    texts = {r.uttid: r.text for r in current_texts(spark, SMALL).collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.uttid, r.piece)):
        got.setdefault(r.uttid, []).append((r.text, r.start_ms, r.end_ms))
    assert set(got) == set(seg) | set(texts)
    for u, pieces in got.items():
        s, e = (None if x is None or x != x else int(x * 1000 + 0.5) for x in seg.get(u, (None, None)))
        if len(pieces) == 1:
            assert pieces[0][0] == texts.get(u) and len(texts.get(u) or "") <= 400
        else:
            check_pieces(texts.get(u), s, e, pieces, Limits())


def test_piece_rows(spark):
    rows = [("a", "x" * 400, 0, 30_000), ("b", "y" * 401, None, None), ("c", None, 0, 30_001), ("d", None, None, None), ("e", "z", 5, 3), ("b", "y" * 401, None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "uttid string, text string, start_ms bigint, end_ms bigint, piece int")
    out = cut_pieces(df).groupBy("uttid").agg(F.count("*").alias("n")).collect()
    assert {r.uttid: r.n for r in out} == {"a": 1, "b": 4, "c": 2, "d": 1, "e": 1}
    assert cut_pieces(df.limit(0)).count() == 0


# 4. Terms


@pytest.mark.parametrize("max_n", [1, 3, 6])
def test_ngram_counts_against_counting(spark, max_n):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcA") for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [None, "", " \t\n", "a\ta\ra  a", "a b", "hot " * 500]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(3)
    occ, rec, n_rec = {}, {}, 0
    for t in texts:
        w = [x for x in re.split("[ \t\n\r]+", t or "") if x]
        n_rec += bool(w)
        grams = [(n, " ".join(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
        for g in grams:
            occ[g] = occ.get(g, 0) + 1
        for g in set(grams):
            rec[g] = rec.get(g, 0) + 1
    got = {(r.n, r.term): (r.occurrences, r.records) for r in ngram_counts(df, "text", max_n).collect()}
    assert got.pop((0, None))[1] == n_rec
    assert got == {g: (occ[g], rec[g]) for g in occ}
    assert marked_terms(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("most_pairs", [3, 1_000_000])
def test_frequent_ngrams_lose_none(spark, monkeypatch, most_pairs):
    monkeypatch.setattr("voxloom.llm.terms.MOST_PAIRS", most_pairs)
    rnd = random.Random(15)
    texts = [" ".join(rnd.choice("aabcdefg") for _ in range(rnd.randint(0, 14))) for _ in range(150)] + [None, "", "x y z x y z x y z", "x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    every = {(r.n, r.term): (r.occurrences, r.records) for r in ngram_counts(df, "text", 5).collect() if r.n and r.occurrences >= 4}
    assert {(r.n, r.term): (r.occurrences, r.records) for r in frequent_ngrams(df, "text", 5, 4).collect()} == every and max(n for n, _ in every) >= 3
    assert frequent_ngrams(df.limit(0), "text", 5, 4).count() == 0


def test_suffix_array_against_sorting():
    rnd = random.Random(11)
    import numpy as np

    for _ in range(60):
        records = [[rnd.choice([0, 0, 1, 2]) for _ in range(rnd.randint(1, 30))] for _ in range(rnd.randint(1, 12))] * rnd.randint(1, 2)
        ids = np.array([x for r in records for x in r])
        record = np.repeat(np.arange(len(records)), [len(r) for r in records])
        suffix = [r[i:] for r in records for i in range(len(r))]
        want = sorted(range(len(suffix)), key=lambda i: (suffix[i], i))
        order, shared = suffix_array(ids, record)
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = suffix[want[k - 1]], suffix[want[k]]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# 5. Packing


def test_plan_packs_every_item_within_capacity():
    rnd = random.Random(6)
    hist = {}
    for _ in range(3000):
        x = rnd.choice([7, 7, 7, rnd.randint(1, 100)])
        hist[x] = hist.get(x, 0) + 1
    load, seen = {}, {}
    for length, a, b, first, per in best_fit_plan(100, list(hist.items())):
        for r in range(a, b + 1):
            load[first + (r - a) // per] = load.get(first + (r - a) // per, 0) + length
            seen.setdefault(length, set()).add(r)
    assert {k: len(v) for k, v in seen.items()} == hist and max(load.values()) <= 100
    assert len(load) <= 1.01 * -(-sum(load.values()) // 100) + 1


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_pack_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr("voxloom.llm.packing.CHUNK", chunk)
    rows = [(1, 10, f"i{i:03}", 3) for i in range(200)] + [(1, 10, "big", 25), (1, 10, "dup", 4), (1, 10, "dup", 4), (2, 7, "x", 7), (1, 10, "none", None), (1, 10, "zero", 0), (3, None, "y", 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "bin_set bigint, capacity bigint, item string, load bigint, container int").repartition(4)
    out = pack(df).collect()
    assert len(out) == 200 + 3 + 2 + 1
    load = {}
    for r in out:
        load[r.bin_set, r.container] = load.get((r.bin_set, r.container), 0) + r.part_load
    assert all(v <= {1: 10, 2: 7}[k[0]] for k, v in load.items())
    assert sorted(r.part_load for r in out if r.item == "big") == [5, 10, 10]
    assert {r.item for r in out if r.n_parts > 1} == {"big"}
    assert pack(df.limit(0)).count() == 0


# 6. Overlap


def test_index_finds_every_run():
    rnd = random.Random(7)
    texts = [[rnd.choice("abcd") for _ in range(rnd.randint(3, 12))] for _ in range(30)]
    index = WordIndex.from_bytes(WordIndex(texts).to_bytes())
    import pyarrow as pa

    query = [rnd.choice("abcde") for _ in range(60)]
    for n in (1, 3, 4):
        at = np.arange(60 - n)
        low, high = index.runs(index.numbers(pa.array(query)), at, np.full(len(at), n))
        assert (high - low).tolist() == [sum(t[j : j + n] == query[i : i + n] for t in texts for j in range(len(t) - n + 1)) for i in range(60 - n)]


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within_edits(a, b, most):
    return word_distance(a, b) <= most


def test_edit_distances_of_many_pairs():
    rnd = random.Random(21)
    xs = [[rnd.randint(0, 4) for _ in range(rnd.randint(1, 25))] for _ in range(400)]
    ys = [[y for v in x for y in rnd.choice([[v], [v], [v], [], [v, 9], [7]])] or [1] for x in xs]
    most = np.array([rnd.randint(0, 8) for _ in xs])
    got = edit_distances([np.array(x) for x in xs], [np.array(y) for y in ys], most)
    for x, y, m, g in zip(xs, ys, most, got):
        d = word_distance(x, y)
        assert g == d if d <= m else g > m


def test_spans():
    assert spans_of(np.array([1, 2, 3, 4, 9, 5, 6, 7]), np.array([1, 2, 3, 4, 5, 6, 7]), 2) == (2, 7)


def test_cross_split_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(25)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(8, 40))] for _ in range(25)]
    rows = []
    for i, b in enumerate(base):
        for k in range(4):
            w = list(b)
            for _ in range(rnd.randint(0, len(b) // 4)):
                p = rnd.randrange(len(w))
                w[p : p + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[p], rnd.choice(vocab)]])
            rows.append((f"u{i}-{k}", rnd.random() < 0.4, " ".join(w).title() + "."))
    rows += [("n", True, None), ("m", None, rows[0][2]), ("e", True, ""), ("d1", True, rows[0][2].upper()), ("d2", False, rows[0][2])]
    df = spark.createDataFrame([(*r, "en", "x") for r in rows], "k string, ev boolean, text string, lang string, words string").repartition(3)
    w = {k: comparison_words(t) for k, _, t in rows}

    def near(a, b):
        return len(a) >= 10 and len(b) >= 10 and within_edits(a, b, max(len(a), len(b)) // 5)

    want = {(a, b) for a, ea, _ in rows if ea for b, eb, _ in rows if eb is False and near(w[a], w[b])}
    got = {(r.eval_key, r.train_key) for r in cross_split_pairs(df, "k", "text", "lang", "ev").collect()}
    assert got == want and ("d1", "d2") in got
    links = {r.k: r.n_links for r in cross_split_links(df, "k", "text", "lang", "ev").collect()}
    assert set(links) == {k for k, e, _ in rows if e is not None and len(w[k]) >= 10}
    assert all(n == sum(k in p for p in want) for k, n in links.items())
    assert cross_split_pairs(df.filter("ev"), "k", "text", "lang", "ev").count() == 0 and cross_split_pairs(df.limit(0), "k", "text", "lang", "ev").count() == 0


def test_report_counts_the_pairs(spark):
    pairs = QUERIES["p6_pairs"](spark, SMALL).groupBy("dset", "source").agg(F.count("*").alias("p"), F.countDistinct("eval_key").alias("u")).collect()
    assert {tuple(r) for r in pairs} == {tuple(r) for r in QUERIES["p6_report"](spark, SMALL).collect()}


# 7. Look-alikes


@pytest.mark.parametrize(
    "odd,lang,form",
    [
        ("ｍorninｇ", "en", "morning"), ("pre­fix a​b", "en", "prefix ab"), ("a b　c d", "en", "a b c d"), ("éţ", "fr", "éţ"), ("Τhe сat", "en", "The cat"), ("МНМ", "en", "MHM"), ("лемyй", "ru", "лемуй"),
        ("В шал asr", "ru", "В шал asr"), ("слово in text", "en", "слово in text"), ("on с тобой", "en", "on с тобой"), ("ẹ́", "yo", "ẹ́"), ("ﾘﾄﾞ 形空で", "ja", "リド 形空で"), ("👩‍🚀 ok", "en", "👩‍🚀 ok"), ("plain", "en", "plain"), ("", "en", ""), (None, "en", None),
        ("κalo", "en", "kalo"), ("ӏist", "en", "list"), ("Ꭺpple", "en", "Apple"), ("ɑpple", "en", "apple"), ("ℌello", "en", "Hello"), ("𝐡ello", "en", "hello"), ("ab\ufe0f", "en", "ab"), ("❤\ufe0f 1\ufe0f\u20e3", "en", "❤\ufe0f 1\ufe0f\u20e3"), ("[ɡɑːt]", "en", "[ɡɑːt]"), ("x\U000e0041", "en", "x"), ("ᎪᎻᏼ", None, "ᎪᎻᏼ"), ("ℓ = 2 ℃", "en", "l = 2 ℃"),
    ],
)
def test_look_alike(odd, lang, form):
    assert look_alike(odd, lang) == form


def test_classes_of_plain_and_other_values(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a\u0488b"), (3, "cd"), (4, "c\u0301d")], "id int, text string")
    assert {r.id: r.form for r in consistent_forms(df, "id", "text").collect()} == {1: "ab", 2: "ab", 3: "cd", 4: "ćd"}


def test_forms_are_equal_for_equal_looks(spark):
    rows = [(1, "café no", "fr"), (2, "café no", "fr"), (3, "café nо", "fr"), (4, "cafe no", "fr"), (5, None, "fr"), (6, "", None), (7, "Café no", "fr"), (1, "café no", "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, text string, lang string, mapped string")
    out = consistent_forms(df, "id", "text", "lang").collect()
    form = {r.id: r.form for r in out}
    assert len(out) == 8 and form[1] == form[2] == form[3] == "café no" and form[4] == "cafe no" and form[5] is None and form[6] == "" and form[7] == "Café no"
    assert consistent_forms(df.limit(0), "id", "text").count() == 0


# 8. Encoding


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_library(spark, reference):
    rnd = random.Random(9)
    parts = ["a", "b", " ", "  ", "'s", "é", "\n", "\t", "\r", "\x1c", " ", "　", "12", ".", "漢", "🙂", "<|endoftext|>", "aaaaaaa", "﷐"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", None, "hot", "hot", "x" * 20_000, " " * 5000 + "y", "word " * 9000]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, key string").repartition(5)
    out = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert len(out) == len(texts) and all(out[i] == reference.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert encode_corpus(df.limit(0)).count() == 0


def test_a_full_memory_changes_nothing(reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("voxloom.llm.encode.MEMORY_CHARS", 50)
    encoder = Encoder(open(DEFAULT_RANKS, "rb").read())
    rnd = random.Random(14)
    for _ in range(20):
        texts = [" ".join(rnd.choice(["alpha", "beta", "longer words", "x" * 40, "é"]) for _ in range(rnd.randint(0, 9))) for _ in range(10)]
        assert encoder.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_real_documents_round_trip(spark, reference):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in encode_corpus(docs).collect():
        assert reference.decode(r.ids) == (texts[r.doc_id] or "")


# 9. Leaks


def test_alignment_scores_edited_copies():
    a = "x x one two three four FIVE six seven eight y y".split()
    b = "one two three four five six seven eight".split()
    assert align(a, b) == (13, 7, 4)
    assert align(["q"], b) == (0, 0, 0)
    assert align("one two three nine four five six".split(), "one two three four five six".split()) == (11, 6, 3)


def test_leaks_against_search(spark):
    rnd = random.Random(10)
    vocab = [f"v{i}" for i in range(400)]
    items = [[rnd.choice(vocab) for _ in range(rnd.randint(12, 60))] for _ in range(30)] + [["same"] * 20, vocab[:4], []]
    prefix = "please read the following passage in your natural voice".split()
    items = [prefix + w if i % 2 else w for i, w in enumerate(items)]
    docs = []
    for i in range(200):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))] + (prefix if i % 3 == 0 else [])
        it = rnd.choice(items)
        n = rnd.randint(9, 16)
        if len(it) >= n:
            p = rnd.randint(0, len(it) - n)
            w[len(w) // 2 : len(w) // 2] = it[p : p + n]
        docs.append(("\n" if i % 2 else " ").join(w).upper())
    docs += [None, "", "same, " * 30, docs[0], "w " * 30_000 + " ".join(items[0])]
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(docs)], "doc_id bigint, text string, lang string, words string, item int").repartition(4)
    q = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(items)] + [(99, None, None)], "item_id bigint, text string, lang string")

    def holds(t, w):
        t = f" {' '.join(comparison_words(t))} "
        return any(f" {' '.join(w[k : k + 12])} " in t for k in range(len(w) - 11))

    want = {(i, j) for i, t in enumerate(docs) for j, w in enumerate(items) if holds(t, w)}
    out = leaked_items(d, q)
    assert {(r.doc_id, r.item_id) for r in out.filter("longest_run >= 12").collect()} == want
    assert leaked_items(d.limit(0), q).count() == 0 and leaked_items(d, q.limit(0)).count() == 0


def edited(words, step, first):
    """Every step-th word from the first one replaced."""
    return [f"zz{i}" if i % step == first else w for i, w in enumerate(words)]


def test_edited_copies_beside_an_exact_one(spark):
    item = [f"q{i}" for i in range(60)]
    texts = {0: item, **{k: edited(item, 7, 3) for k in range(1, 9)}, 9: [f"other{i}" for i in range(80)], 10: edited(item, 5, 4)}
    d = spark.createDataFrame([(k, " ".join(w), "en") for k, w in texts.items()], "doc_id bigint, text string, lang string").repartition(3)
    q = spark.createDataFrame([(1, " ".join(item), "en")], "item_id bigint, text string, lang string")
    want = {k: align(w, item) for k, w in texts.items() if k < 9}
    assert {r.doc_id: (r.score, r.equal_words, r.longest_run) for r in leaked_items(d, q).collect()} == want
    alone = {r.doc_id: (r.score, r.equal_words, r.longest_run) for r in leaked_items(d.filter("doc_id > 0"), q).collect()}
    assert alone == {k: v for k, v in want.items() if k}


def test_edited_copies_of_a_recurring_passage(spark):
    item = [f"q{i}" for i in range(40)]
    copy = edited(item, 11, 5)
    texts = {k: [f"a{k}x{i}" for i in range(5)] + copy + [f"b{k}x{i}" for i in range(5)] for k in range(60)}
    q = spark.createDataFrame([(1, " ".join(item), "en")], "item_id bigint, text string, lang string")
    for n in (10, 60):  # the number of copies makes no difference to any of them
        d = spark.createDataFrame([(k, " ".join(texts[k]), "en") for k in range(n)], "doc_id bigint, text string, lang string").repartition(3)
        assert {r.doc_id: (r.score, r.equal_words, r.longest_run) for r in leaked_items(d, q).collect()} == {k: align(texts[k], item) for k in range(n)}


def test_short_items_are_their_own_seeds(spark):
    items = {1: "alpha beta", 2: "gamma", 3: "one two three four", 4: "one two three four five six", 5: " "}
    docs = {1: "x alpha beta y", 2: "beta alpha", 3: "so gamma", 4: "one two three four", 5: "one two three", 6: "zero one two three four five", 7: ""}
    d = spark.createDataFrame([(k, t, "en") for k, t in docs.items()], "doc_id bigint, text string, lang string")
    q = spark.createDataFrame([(k, t, "en") for k, t in items.items()], "item_id bigint, text string, lang string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, q).collect()} == {(1, 1), (3, 2), (4, 3), (6, 3), (6, 4)}


def test_recall_of_edited_copies(spark):
    """Copies of 12 to 60 words of which a fifth or less is inserted, deleted or replaced."""
    rnd = random.Random(13)
    items = [[f"q{i}w{rnd.randint(0, 50)}" for _ in range(rnd.randint(12, 60))] for i in range(60)]
    docs = []
    for k in range(1200):
        w = list(items[k % 60])
        for _ in range(rnd.randint(0, len(w) // 5)):
            p = rnd.randrange(len(w))
            w[p : p + 1] = rnd.choice([[], [f"new{k}"], [w[p], f"more{k}"]])
        docs.append((k, " ".join([f"a{k}x{i}" for i in range(30)] + w + [f"b{k}x{i}" for i in range(30)]), "en"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    q = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(items)], "item_id bigint, text string, lang string")
    found = {(r.doc_id, r.item_id) for r in leaked_items(d, q).collect()}
    recall = sum((k, k % 60) in found for k in range(1200)) / 1200
    print("recall of edited copies", recall)
    assert recall >= 0.95 and all(i == k % 60 for k, i in found)


# 10. Personal information

LEX = Lexicon.of(["Vervok", "Tandek", "Rerkovsky", "Surkovsky", "Lorkovsky", "Ilolmarez"])


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail a.b+c@lab.example.net now", ["email"]), ("x at post dot invalid", ["email"]), ("a dot b [at] lab [dot] example", ["email"]), ("A_B(at)x.org", ["email"]), ("q＠example.org", ["email"]), ("mailto:z@y.com", ["email"]),
        ("reply to @speaker_04", []), ("lr@7.0026 with warmup", []), ("we met at noon", []),
        ("call me back on +44 (0)1632 960 962 ext. 28", ["phone"]), ("Tel. 01632\n960123", ["phone"]), ("(299) 555-0176", ["phone"]), ("0012555550192", ["phone"]), ("text two zero six five five five zero one nine three", ["phone"]),
        ("model hash 8101-0941-8789", []), ("checkpoint 20210947-3358", []), ("at 192.0.2.179", []), ("00:00:10,074 --> 00:00:15,000", []), ("version 2.1.13 on 2023-01-09", []),
        ("passport\nno. 961-79-3861", ["idnum"]), ("Steuer-ID: 23248271Z", ["idnum"]), ("tax id is k-203 777 86 that", ["idnum"]), ("carte d'identité no 0648\n4472 3887", ["idnum"]), ("passport control is open", []), ("catalogue number 8456-058", []),
        ("i live at 96 chidour lane", ["address"]), ("Adresse: Vaintstr. 46", ["address"]), ("habite au 230 bis, avenue Grunt", ["address"]), ("vive en Calle Slud 9, 1º B", ["address"]), ("A road recording of 6 epochs The long street", []), ("they moved to 12 Tandek Street, Flat 3", ["address"]),
        ("the reader was Tandek Rerkovsky, recorded at home", ["name"]), ("my name is Rerkovsky, Vervok", ["name"]), ("thank you Dr. Nooo, go on", ["name"]), ("mein Name ist Foo B. Barsen", ["name"]), ("this is nolo patz speaking", ["name"]), ("lu par leshida oroddelson", ["name"]), ("lu par un ami", []),
        ("the Tandek corpus has 68 hours", []), ("see the Rerkovsky recipe for details", []), ("thank you very much", []), ("this is the end", []), ("vervok.rerkovsky@example.org", ["email"]), ("", []),
    ],
)
def test_found_kinds(text, kinds):
    spans = Finder(LEX).spans(text, "en")
    assert sorted({k for _, _, k in spans}) == kinds


@pytest.mark.parametrize("text", ["text five, five, zero, one, nine, three, two", "call vier-acht-zwei-drei-neun-sechs-eins", "al uno\ndos\ntres\ncuatro\nseis\nocho\nnueve", "un deux trois quatre cinq six sept"])
def test_spoken_numbers_however_parted(text):
    assert [k for *_, k in Finder(LEX).spans(text, "en")] == ["phone"]


def test_a_number_far_behind_its_cue_is_redacted_whole():
    text = "phone: " + "- " * 14 + "01632 960 9621 then"
    assert redact(text, Finder(LEX).spans(text, "en")) == "phone: " + "- " * 14 + "[PHONE] then"


REAL = Lexicon.of(
    "Anna Maria John Peter Thomas Michael Sarah Laura Julia Daniel Olga Pierre Carlos Kowalski Müller Schmidt Fernandez Garcia Martinez Johnson Williams Dubois Lefebvre Moreau Schneider Wagner Petrov Ivanova Smith Nilsson".split(),
    ["We looked at the garden before noon and nobody asked whether the station was closed. Several people noticed how quickly the weather changed near the river last summer."],
)
# Wordings written for this test alone; no cue or shape of the finder was chosen from them.
UNSEEN = [
    ("You can write to us under helpdesk@city-library.example.", "email"), ("drop a line: k.meyer (at) mail.example.de", "email"), ("forward it to rosa underscore lind at posteo dot example", "email"), ("<a href='mailto:info+news@shop.example.fr'>", "email"), ("cc: J.O'Neil%40corp.example.com", "email"),
    ("our hotline +49 30 901820 is open", "phone"), ("Rückruf unter 0171/2345678 erbeten", "phone"), ("joignable au 01 42 68 53 00", "phone"), ("dial (415) 555-0132 for the desk", "phone"), ("fax 020 7946 0018", "phone"), ("ring nine one one five five five zero one two", "phone"),
    ("Mi móvil es 612 345 678", "phone"), ("WhatsApp: +34 612 345 678", "phone"),
    ("card number 5555 5555 5555 4444 expires in May", "idnum"), ("IBAN GB82 WEST 1234 5698 7654 32", "idnum"), ("social security 219-09-9999", "idnum"), ("NIF 12345678Z del cliente", "idnum"), ("n° de sécurité sociale 2 69 05 49 588 157 80", "idnum"), ("Personalausweis L01X00T47", "idnum"), ("his passport C01X00T478 was lost", "idnum"),
    ("deliver it to 221 Baker Street", "address"), ("Sie zog in die Goethestraße 12", "address"), ("rendez-vous au 14 rue des Lilas", "address"), ("quedamos en calle Mayor 5", "address"), ("the shop at 1600 Pine Avenue", "address"), ("Büro: Lindenallee 4a, 10115 Berlin", "address"),
    ("Professor Okafor opened the session", "name"), ("a talk given by Anna Petrov", "name"), ("Frau Schönberger hat angerufen", "name"), ("Mme Lachapelle est absente", "name"), ("Yours truly, Peter Schmidt", "name"), ("regards, Imogen Hathaway", "name"), ("the author is Tobias Lindqvist", "name"), ("la señora Echeverría no vino", "name"),
    ("hosted by Femi Adeyemi", "name"), ("Michael Obuya won the race", "name"), ("ich bin Laura Neumann", "name"), ("we met Sarah Johnson there", "name"), ("narrated by Quentin Abernathy", "name"), ("Ludwig van Moreau sang", "name"), ("Smith, John was absent", "name"), ("It was written by Olga Brandt", "name"),
]
UNSEEN_NONE = [
    "Thank you Everyone, go on", "This is Radio speaking", "see you at noon at example dot com", "the build 4.1.2 took 12:30:45", "order 1234-5678-9012-3456 shipped", "row 4111111111111112 is wrong", "at 10.0.0.1 on 2021-03-04", "the Anna corpus has 40 hours", "a model by the Smith toolkit", "we drove down the long road", "ping @anna_k for help",
    "the report was read by everyone", "thanks to all of you", "Hello World, this is a test", "sha 9f86d081 and 884c7d65", "chapter 3 place 2", "page 100-22-13 of 7", "dear readers of this page", "the passport office is closed", "ISBN 978-3-16-148410-0", "GB82 WEST 1234 5698 7654 33", "von Anfang an dabei", "la calle estaba vacía", "asked twice before lunch", "interview with the manager",
]


def test_wordings_not_chosen_from():
    finder = Finder(REAL)
    missed = [t for t, kind in UNSEEN if kind not in {k for *_, k in finder.spans(t, "en")}]
    false = [(t, s) for t in UNSEEN_NONE if (s := finder.spans(t, "en"))]
    extra = [t for t, kind in UNSEEN if {k for *_, k in finder.spans(t, "en")} - {kind}]
    assert len(missed) <= len(UNSEEN) // 10 and len(false) <= 1 and len(extra) <= 1, (missed, false, extra)


def test_loose_cues_need_a_word_like_a_name(spark):
    # Against the words of documents, as in the query: with few words the classifier tells little.
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null and lang = 'en'").collect()]
    finder = Finder(Lexicon.of(REAL.names, texts))
    names = lambda t: [t[a:b] for a, b, k in finder.spans(t, "en") if k == "name"]
    assert names("we met with New York and This is Green Energy") == [] and names("met Sarah Oakley") == ["Sarah Oakley"] and names("interview with Imogen Quirke") == ["Imogen Quirke"]


def test_numbers_pass_their_own_check():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert iban("DE89 3704 0044 0532 0130 00".lower()) and not iban("de88 3704 0044 0532 0130 00")
    kinds = lambda t: [k for *_, k in Finder(REAL).spans(t, "en")]
    assert kinds("12345678Z") == ["idnum"] and kinds("12345678A") == [] and kinds("078-05-1120") == ["idnum"] and kinds("666-05-1120") == []
    assert kinds("dni 12345678A") == ["idnum"]  # a cue vouches for a mistyped number


def test_classifier_of_names_on_names_it_was_not_fitted_on(spark):
    names = sorted({r.name.lower() for r in spark.read.parquet(f"{SMALL}/name_lexicon.parquet").collect() if r.name})
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").collect()]
    half = Lexicon.of(names[::2], texts)
    assert sum(half.value(n) > 0 for n in names[1::2]) >= 0.85 * len(names[1::2])
    plain = "garden curtain thursday weather bottle morning quickly however nobody station between".split()
    assert sum(half.value(w) > 0 for w in plain) <= 1


def test_redaction_keeps_the_rest():
    text = "Hi Ｘ​! mail a​b@x.org or +1 204 555 0147\n002\tnext"
    assert redact(text, Finder(LEX).spans(text, "en")) == "Hi Ｘ​! mail [EMAIL] or [PHONE]\n002\tnext"


def test_personal_rows(spark):
    rows = [(1, "a@b.org", "en"), (2, None, None), (3, "", "en"), (4, "x " * 50_000 + "a@b.org", None), (1, "a@b.org", "en")]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id bigint, text string, lang string, kinds string, key int")
    lex = spark.createDataFrame([("Tandek",), (None,)], "name string")
    out = sorted(((r.doc_id, r.text[-7:] if r.text else r.text, r.kinds, r.n_found) for r in find_personal(df, lex).collect()), key=str)
    assert out == sorted([(1, "[EMAIL]", ["email"], 1), (2, None, [], 0), (3, "", [], 0), (4, "[EMAIL]", ["email"], 1), (1, "[EMAIL]", ["email"], 1)], key=str)
    assert find_personal(df.limit(0), lex.limit(0)).count() == 0


def test_the_classifier_of_names_is_fitted_on_all_words(spark):
    names = "Lorkovsky Surkovsky Rerkovsky Anna Maria Tandek".split()
    # Words that end as names do, far behind in one of many documents.
    rng = random.Random(3)
    alike = sorted({"".join(rng.choices("bdfgklmnprstz", k=2)) + rng.choice("aeiou") + "rkovsky" for _ in range(900)})
    texts = ["they saw Mirkovsky Tandovsky there"] + [f"plain words of number {i}" for i in range(700)]
    long = "and so on " * 600 + " ".join(alike)
    lex = spark.createDataFrame([(n,) for n in names], "name string")
    found = lambda ts: next(r.kinds for r in find_personal(spark.createDataFrame([(i, t, "en") for i, t in enumerate(ts)], "doc_id int, text string, lang string").repartition(5), lex).collect() if r.doc_id == 0)
    assert found(texts) == ["name"] and found([*texts, long]) == []


def test_counted_words_give_the_classifier_of_the_words(spark):
    names = sorted({r.name for r in spark.read.parquet(f"{SMALL}/name_lexicon.parquet").collect() if r.name})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    words = {w for r in docs.collect() if r.text for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*", Finder._copy(r.text, r.lang)[0].lower()) if len(w) > 2}
    whole, counted = Lexicon(names, words), Lexicon(names, counted=count_words(docs.repartition(7).union(docs), names))
    assert counted._n_not == whole._n_not and counted.parts == whole.parts
    assert all(abs(counted.odds(w) - whole.odds(w)) < 1e-9 for w in words)
