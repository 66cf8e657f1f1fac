"""Held-out passages that leak into corpus documents.

Method: n-gram seeds and local alignment. One pass over the corpus finds every n-gram of words
that a document shares with any item. Each of them is a seed, however many documents hold it:
whether a document and an item are aligned depends on the two alone, not on what else lies in
the table. Every pair with a seed is aligned by Smith-Waterman over words, many pairs at once,
which also scores edited and paraphrased copies. A run of SEED words or more is never missed;
an item of fewer words is its own seed, and found where a document holds it whole.

The items are a stated query set. They are taken in blocks of bounded size, each broadcast to
one pass over the corpus, so a larger set takes more passes and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import comparison_words

#: Words of an n-gram seed, of the run that makes a leak, and kept around the n-grams found.
SEED, RUN, AROUND = 5, 12, 20
#: Items in one block.
BLOCK_ITEMS = 20_000
#: Pairs of words that one round of alignments compares at most (one pair of texts at least).
ROUND_CELLS = 2_000_000
#: Pairs gathered before they are aligned.
ROUND_PAIRS = 20_000
#: Scores of the alignment: a pair of equal words, of different words, a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit mark for the n-gram at each position (wrapping arithmetic on mixed ids)."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64)
        g = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            g = g * np.uint64(0x100000001B3) + x[k : k + m]
        return g.view(np.int64)


def align_many(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, equal words on the best path, longest run of equal words anywhere) of pairs of word ids.

    Ids of ``ys`` are 0 or more; -1 in ``xs`` is a word of no item. Smith-Waterman by rows of x,
    all pairs abreast (last axis): the running gap along a row is a prefix maximum. Shorter texts
    are padded with ids that equal nothing, which never raises a score.
    """
    n, m, k = max(map(len, xs)), max(map(len, ys)), len(xs)
    x, y = np.full((n, k), -1, dtype=np.int32), np.full((m, k), -2, dtype=np.int32)
    for j, (a, b) in enumerate(zip(xs, ys)):
        x[: len(a), j], y[: len(b), j] = a, b
    place = np.arange(m + 1, dtype=np.int32)[:, None]
    ramp = place * np.int32(-GAP)
    score, equal, run, longest = (np.zeros((m + 1, k), dtype=np.int32) for _ in range(4))
    best, best_equal, pair = np.zeros(k, dtype=np.int32), np.zeros(k, dtype=np.int32), np.arange(k)
    for i in range(n):
        same = y == x[i]
        new_run = np.zeros_like(run)
        new_run[1:] = (run[:-1] + 1) * same
        run = new_run
        np.maximum(longest, run, out=longest)
        diag = score[:-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        up = score[1:] + np.int32(GAP)
        new, new_equal = np.zeros_like(score), np.zeros_like(equal)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        new_equal[1:] = np.where(diag >= up, equal[:-1] + same, equal[1:]) * (new[1:] > 0)
        # Gaps along the row: the best earlier cell less the distance.
        lifted = new + ramp
        top = np.maximum.accumulate(lifted, axis=0)
        source = np.maximum.accumulate((lifted == top) * place, axis=0)
        # A cell without a better earlier one is its own source.
        score, equal = top - ramp, np.take_along_axis(new_equal, source, axis=0)
        j = score.argmax(axis=0)
        s = score[j, pair]
        better = s > best
        best, best_equal = np.where(better, s, best), np.where(better, equal[j, pair], best_equal)
    return best, best_equal, longest.max(axis=0)


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(score, equal words on the best path, longest run of equal words anywhere) of two word lists."""
    number = {w: i for i, w in enumerate(dict.fromkeys(b))}
    score, equal, run = align_many([np.array([number.get(w, -1) for w in a])], [np.array([number[w] for w in b])])
    return int(score[0]), int(equal[0]), int(run[0])


def _rounds(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Indexes of pairs to align abreast: of like lengths, within ROUND_CELLS with their padding."""
    take, n, m = [], 0, 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        a, b = max(n, sizes[i][0]), max(m, sizes[i][1])
        if take and (len(take) + 1) * a * b > ROUND_CELLS:
            yield take
            take, a, b = [], *sizes[i]
        take.append(i)
        n, m = a, b
    if take:
        yield take


def _aligned(docs: DataFrame, vocab: dict[str, int], items: list[tuple[int, np.ndarray]], kind: str) -> DataFrame:
    """(doc, item, score, equal_words, longest_run, item_words): the stretches of documents around
    n-grams of the items, aligned with every item that holds one of these n-grams."""
    seeds = []  # of each length: the grams, and the items that hold them
    for n in sorted({min(len(ids), SEED) for _, ids in items}):
        some = [i for i, (_, ids) in enumerate(items) if min(len(ids), SEED) == n]
        found = [np.unique(_grams(items[i][1], n)) for i in some]
        grams, holder = np.concatenate(found), np.repeat(some, [len(g) for g in found])
        order = np.argsort(grams, kind="stable")
        grams, first = np.unique(grams[order], return_index=True)
        seeds.append((n, grams, np.append(first, len(order)), holder[order]))
    shared = docs.sparkSession.sparkContext.broadcast((vocab, items, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, stated, seeds = shared.value
        least = seeds[0][0]
        get = number.get
        for b in batches:
            keys = b.column(0)
            texts = [comparison_words(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            size = np.array([len(w) for w in texts], dtype=np.int64)
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            ids = np.full(int(begin[-1]), -1, dtype=np.int64)
            for w, s in zip(texts, begin.tolist()):
                if len(w) >= least:
                    ids[s : s + len(w)] = [get(x, -1) for x in w]
            known = ids >= 0
            places, marks = [], []
            for k, (n, wanted, *_) in enumerate(seeds):
                whole = np.ones(max(len(ids) - n + 1, 0), dtype=bool)
                for j in range(n):
                    whole &= known[j : j + len(whole)]
                at = np.flatnonzero(whole)
                g = _grams(ids, n)[at]
                p = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                hit = wanted[p] == g
                places.append(at[hit])
                marks.append(p[hit] * len(seeds) + k)
            at, p = np.concatenate(places), np.concatenate(marks)
            if not len(at):
                continue
            if len(seeds) > 1:
                order = np.argsort(at, kind="stable")
                at, p = at[order], p[order]
            doc = np.searchsorted(begin, at, side="right") - 1
            head = np.ones(len(at), dtype=bool)
            head[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > AROUND)
            heads = np.append(np.flatnonzero(head), len(at))

            def scored(pairs: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
                for take in _rounds([(hi - lo, len(stated[i][1])) for _, i, lo, hi in pairs]):
                    some = [pairs[t] for t in take]
                    score, equal, longest = align_many([ids[lo:hi] for *_, lo, hi in some], [stated[i][1] for _, i, *_ in some])
                    item = pa.array([stated[i][0] for _, i, *_ in some], pa.int64())
                    words = pa.array([len(stated[i][1]) for _, i, *_ in some], pa.int32())
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([d for d, *_ in some])), item, *(pa.array(c, pa.int32()) for c in (score, equal, longest)), words], names=["doc", "item", "score", "equal_words", "longest_run", "item_words"])

            pairs = []
            for s, e in zip(heads[:-1].tolist(), heads[1:].tolist()):
                d = int(doc[s])
                lo = max(int(begin[d]), int(at[s]) - AROUND)
                hi = min(int(begin[d] + size[d]), int(at[e - 1]) + SEED + AROUND)
                # Every item with one of the stretch's n-grams, common or rare.
                with_it = np.unique(np.concatenate([seeds[k][3][seeds[k][2][q] : seeds[k][2][q + 1]] for q, k in (divmod(x, len(seeds)) for x in np.unique(p[s:e]).tolist())]))
                pairs += [(d, i, lo, hi) for i in with_it.tolist()]
                if len(pairs) >= ROUND_PAIRS:
                    yield from scored(pairs)
                    pairs = []
            yield from scored(pairs)

    return docs.mapInArrow(run, f"doc {kind}, item bigint, score int, equal_words int, longest_run int, item_words int")


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_key, item_key, score, equal_words, longest_run, item_words) of aligned documents and items.

    One row per document and item that share SEED consecutive words, or all words of a shorter
    item; of several stretches the best counts. ``longest_run`` is the longest run of
    consecutive equal words. Null, empty and blank texts share nothing. Repeated keys are merged.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    rows = docs.select(F.col(doc_key).alias("doc"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    stated = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("item is not null")
    blocks = -(-stated.count() // BLOCK_ITEMS)
    out = None
    for block in range(blocks):
        part = stated.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        part = [(r["item"], w) for r in part if (w := comparison_words(r["text"], r["lang"]))]
        if not part:
            continue
        vocab = {w: i for i, w in enumerate(sorted({w for _, ws in part for w in ws}))}
        aligned = _aligned(rows, vocab, [(item, np.array([vocab[w] for w in ws])) for item, ws in part], kind)
        out = aligned if out is None else out.union(aligned)
    if out is None:
        return spark.createDataFrame([], f"{doc_key} {kind}, {item_key} bigint, score int, equal_words int, longest_run int, item_words int")
    best = out.groupBy("doc", "item").agg(F.max(F.struct("score", "equal_words")).alias("b"), F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words"))
    return best.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "b.score", "b.equal_words", "longest_run", "item_words")
