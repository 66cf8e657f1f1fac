"""Same or nearly same records across splits.

Method: a full-text index of the evaluation texts (suffix order and Burrows-Wheeler transform
over words, in shards of bounded size). The training texts are streamed through backward
search. Each hit is widened to a maximal match, and the matches of a pair of texts are merged
to spans and counted, once the pair is known to be near.

A pair within k edits shares a part unchanged of any k + 1 parts without overlap, as each edit
spoils one of them at most. So a text is cut into one part more than a near text may have
edits, and only these parts are searched: of three words or more, as k is at most a fifth of
the words of the longer text. Of three ways to cut, which give the spare words to different
parts, the one with the fewest hits is taken where the first has more than FEW_HITS. Pairs with a hit at a possible distance are compared by an
exact, banded edit distance, many pairs abreast. No pair is lost, however common its words.

Equal texts are compared once: the index holds, and the stream brings, one row per distinct
text, and members are joined back to the pairs of texts found.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import comparison_words
from voxloom.session import checkpoint_dir, cut_table

RUN = 3
#: Words in one shard of the index, and training words held at once.
SHARD_WORDS, BLOCK_WORDS = 500_000, 1_000_000
#: Hits expanded at once; blocks with more are expanded in slices. Pairs compared abreast.
SLICE_HITS, ABREAST, ABREAST_WORDS = 2_000_000, 4_000, 400_000
#: Hits of a text up to which no other way to cut it is tried.
FEW_HITS = 16


class WordIndex:
    """Full-text index over word sequences: backward search with one sorted array.

    ``keys`` holds (symbol before a suffix, row of the suffix), sorted: the number of keys below
    (c, row) is both where the suffixes that start with c begin and how often c stands before
    the rows above, which is the step of backward search.
    """

    def __init__(self, texts: list[list[str]]):
        vocab = sorted({w for t in texts for w in t})
        number = {w: i + 1 for i, w in enumerate(vocab)}  # 0 parts the texts
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols = np.zeros(int(self.start[-1]), dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[self.start[1:] - 1] = False
        symbols[inside] = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
        rank, depth, n = symbols.copy(), 1, len(symbols)
        while depth < n:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - depth] = rank[depth:] + 1
            new = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            if new.max() == n - 1 or np.array_equal(new, rank):
                rank = new
                break
            rank, depth = new, depth * 2
        self.suffixes = np.argsort(rank, kind="stable")
        before = symbols[self.suffixes - 1]
        self.keys = np.sort(before * n + np.arange(n))
        self.symbols, self.vocab, self._number, self._heads = symbols, vocab, number, None

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Symbols of words; -1 where the index does not hold the word."""
        coded = words.dictionary_encode()
        get = self._number.get
        table = np.fromiter((get(w, -1) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        return table[coded.indices.to_numpy()]

    def runs(self, symbols: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, end row) of the runs of symbols that begin at ``at``; equal where the index holds none."""
        n = len(self.symbols)
        if self._heads is None:  # where the suffixes that start with each symbol begin
            self._heads = np.searchsorted(self.keys, np.arange(len(self.vocab) + 2) * n)
        last = symbols[at + length - 1]
        low, high = self._heads[np.maximum(last, 0)], self._heads[np.maximum(last, 0) + 1]
        low[last <= 0] = high[last <= 0] = 0
        live = np.flatnonzero(low < high)
        for k in range(1, int(length.max()) if len(at) else 0):
            # The k-th symbol from the end of each run that is that long.
            live = live[length[live] > k]
            c = symbols[at[live] + length[live] - 1 - k]
            low[live[c <= 0]] = high[live[c <= 0]] = 0
            live, c = live[c > 0], c[c > 0] * n
            low[live] = a = np.searchsorted(self.keys, c + low[live])
            high[live] = b = np.searchsorted(self.keys, c + high[live])
            live = live[a < b]
        return low, np.maximum(low, high)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, start=self.start, suffixes=self.suffixes, keys=self.keys, symbols=self.symbols, vocab=np.frombuffer("\n".join(self.vocab).encode(), dtype=np.uint8))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> WordIndex:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data), allow_pickle=False)
        self.start, self.suffixes, self.keys, self.symbols = z["start"], z["suffixes"], z["keys"], z["symbols"]
        self.vocab = z["vocab"].tobytes().decode().split("\n")
        self._number, self._heads = {w: i + 1 for i, w in enumerate(self.vocab)}, None
        return self


def edit_distances(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Words to insert, delete or replace between pairs of texts; anything above ``most`` where it is more.

    All pairs abreast (last axis), by rows of x, over the diagonals within the greatest ``most``.
    """
    k, band = len(xs), int(most.max())
    nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    rows, far = int(nx.max()), np.int32(1 << 20)
    x, y = np.full((rows, k), -1, dtype=np.int64), np.full((max(rows + 2 * band, int(ny.max()) + band) + 1, k), -2, dtype=np.int64)
    for j, (a, b) in enumerate(zip(xs, ys)):
        x[: len(a), j], y[band : band + len(b), j] = a, b
    # Cell d of row i stands for i words of x and i + d - band of y.
    offset = np.arange(2 * band + 1)[:, None]
    cost = np.where(offset >= band, offset - band, far).astype(np.int32) * np.ones(k, dtype=np.int32)
    out = np.where(nx == 0, ny, far)
    ramp = offset.astype(np.int32)
    for i in range(1, rows + 1):
        place = i + offset - band  # words of y
        window = y[i - 1 : i + 2 * band]  # word of y before each place
        new = cost + (window != x[i - 1])
        new[place[:, 0] <= 0] = far
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        if i <= band:
            new[band - i] = i
        new[place[:, 0] < 0] = far
        # Insertions along the row: the least earlier cell plus the distance.
        cost = np.minimum.accumulate(new - ramp, axis=0) + ramp
        done = np.flatnonzero(nx == i)
        if len(done):
            d = ny[done] - i + band
            ok = (d >= 0) & (d <= 2 * band)
            out[done[ok]] = cost[d[ok], done[ok]]
    return out


def spans_of(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int]:
    """(maximal matches, matched words) of RUN words or more, on the diagonals that ``most`` edits reach."""
    spans = words = 0
    for d in range(-most, most + 1):
        a, b = (x[-d:], y) if d < 0 else (x, y[d:])
        m = min(len(a), len(b))
        if m < RUN:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], a[:m] == b[:m], [False]])))
        run = edge[1::2] - edge[::2]
        run = run[run >= RUN]
        spans, words = spans + len(run), words + int(run.sum())
    return spans, words


def most_edits(n: np.ndarray, share_pct: int) -> np.ndarray:
    """Edits allowed between a text of n words and the longest text that can be near it."""
    longest = n.copy()
    while (more := longest + 1 - (longest + 1) * share_pct // 100 <= n).any():
        longest = longest + more
    return longest * share_pct // 100


def parts_of(n: np.ndarray, share_pct: int) -> np.ndarray:
    """Number of parts of which one stays unchanged: one more than the edits allowed."""
    return most_edits(n, share_pct) + 1


def _seeds(index: WordIndex, symbols: np.ndarray, begin: np.ndarray, share_pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first row, end row) of the parts searched, of the cut with the fewest hits."""
    n = np.diff(begin)
    parts = parts_of(n, share_pct)

    def cut(some: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
        of = np.repeat(parts[some], parts[some])
        text = np.repeat(some, parts[some])
        first = np.repeat(np.cumsum(parts[some]) - parts[some], parts[some])
        number = np.arange(len(text)) - first
        # All words are used: some parts are one word longer than others.
        length = n[text] // of + ((number + turn * of // 3) % of < n[text] % of)
        at = np.cumsum(length) - length
        at += begin[text] - at[first]
        low, high = index.runs(symbols, at, length)
        return text, at, low, high

    best = cut(np.flatnonzero(n), 0)
    for turn in (1, 2):
        hits = np.bincount(best[0], weights=best[3] - best[2], minlength=len(n))
        many = np.flatnonzero(hits > FEW_HITS)
        if len(many):
            other = cut(many, turn)
            fewer = np.bincount(other[0], weights=other[3] - other[2], minlength=len(n)) < hits
            old, new = ~(fewer & (hits > FEW_HITS))[best[0]], fewer[other[0]]
            best = tuple(np.concatenate([b[old], o[new]]) for b, o in zip(best, other))
    found = best[2] < best[3]
    order = np.argsort(best[0][found], kind="stable")
    return tuple(b[found][order] for b in best)


def _search(index: WordIndex, words: pa.Array, begin: np.ndarray, share_pct: int) -> Iterator[tuple[int, int, int, int]]:
    """(training text, index text, maximal matches, matched words) of near pairs in a block."""
    symbols = index.numbers(words)
    text, at, low, high = _seeds(index, symbols, begin, share_pct)
    there_begin, there_len = index.start[:-1], np.diff(index.start) - 1
    lengths = np.diff(begin)
    total = np.cumsum(high - low)
    seen: set[tuple[int, int]] = set()  # near pairs of texts whose hits lie in several slices
    edge = 0
    while edge < len(at):
        done = total[edge - 1] if edge else 0
        stop = max(edge + 1, int(np.searchsorted(total, done + SLICE_HITS, side="right")))
        n = high[edge:stop] - low[edge:stop]
        for first in range(0, int(n.max()), SLICE_HITS):  # one part with more hits is taken in slices too
            m = np.clip(n - first, 0, SLICE_HITS)
            rows = np.arange(m.sum()) + np.repeat(low[edge:stop] + first - (np.cumsum(m) - m), m)
            here, t = np.repeat(at[edge:stop], m), np.repeat(text[edge:stop], m)
            there = index.suffixes[rows]
            o = np.searchsorted(index.start, there, side="right") - 1
            a, b = lengths[t], there_len[o]
            most = np.maximum(a, b) * share_pct // 100
            # The texts' lengths, and what lies before and behind the hit, differ by no more than the edits.
            before = np.abs((here - begin[t]) - (there - there_begin[o]))
            behind = np.abs((begin[t + 1] - here) - (there_begin[o] + b - there))
            near = before + behind <= most
            pair = np.unique(t[near] * len(there_len) + o[near])
            t, o = pair // len(there_len), pair % len(there_len)
            order = np.lexsort((there_len[o], lengths[t]))
            size, s = lengths[t[order]], 0
            while s < len(order):
                e = min(s + ABREAST, len(order))
                while e > s + 1 and (e - s) * size[e - 1] > ABREAST_WORDS:
                    e = s + max(1, min(e - s - 1, ABREAST_WORDS // int(size[e - 1])))
                some, s = order[s:e], e
                xs = [symbols[begin[i] : begin[i + 1]] for i in t[some].tolist()]
                ys = [index.symbols[there_begin[j] : there_begin[j] + there_len[j]] for j in o[some].tolist()]
                most = np.maximum(lengths[t[some]], there_len[o[some]]) * share_pct // 100
                for i in np.flatnonzero(edit_distances(xs, ys, most) <= most).tolist():
                    if (key := (int(t[some[i]]), int(o[some[i]]))) not in seen:
                        seen.add(key)
                        yield *key, *spans_of(xs[i], ys[i], int(most[i]))
        edge = stop


def _shard_files(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[5:].replace("//", "/", 1) if path.startswith("file://") else path[5:]
    return fs.FileSystem.from_uri(path)


_indexes: OrderedDict[tuple, WordIndex] = OrderedDict()  # the few shards that a worker used last


def _shard(path: str, shard: int) -> WordIndex:
    if (key := (path, shard)) not in _indexes:
        files, root = _shard_files(path)
        table = pq.read_table(f"{root}/shard={shard}", filesystem=files, partitioning=None, columns=["texts", "index"])
        index = WordIndex.from_bytes(table.column("index")[0].as_py())
        index.names = table.column("texts")[0].as_py()
        _indexes[key] = index
        while len(_indexes) > 4:
            _indexes.popitem(last=False)
    _indexes.move_to_end(key)
    return _indexes[key]


def near_classes(evaluation: DataFrame, training: DataFrame, share_pct: int = 20) -> DataFrame:
    """(eval_class, train_class, spans, matched) for rows (class, words), words joined by blanks.

    All classes of distinct texts of which at most ``share_pct`` percent of the longer one's
    words must be inserted, deleted or replaced. Each shard of the index is built by one task
    from at most about SHARD_WORDS words and written to the shared folder; the tasks that
    stream training texts read the shards from there one by one.
    """
    spark = evaluation.sparkSession
    n_words = F.size(F.split("words", " "))
    total = evaluation.agg(F.sum(n_words).alias("n")).first()["n"] or 0
    empty = "eval_class string, train_class string, spans int, matched int"
    if not total:
        return spark.createDataFrame([], empty)
    shards = -(-int(total) // SHARD_WORDS)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("class")
        index = WordIndex([w.split(" ") for w in f["words"]])
        return pd.DataFrame({"shard": [f["shard"].iat[0]], "texts": [f["class"].tolist()], "index": [index.to_bytes()]})

    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    keyed = evaluation.select("class", "words", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"))
    keyed.groupBy("shard").applyInPandas(build, "shard int, texts array<string>, index binary").write.partitionBy("shard").parquet(path)
    built = sorted(r["shard"] for r in spark.read.parquet(path).select("shard").collect())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(names: list[str], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
            words = pa.array([w for t in texts for w in t], pa.string())
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for s in built:
                index = _shard(path, s)
                found = [(index.names[o], names[t], n, m) for t, o, n, m in _search(index, words, begin, share_pct)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["eval_class", "train_class", "spans", "matched"])

        names, texts, size = [], [], 0
        for b in batches:
            for name, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(name)
                texts.append(words.split(" "))
                size += len(texts[-1])
                if size >= BLOCK_WORDS:
                    yield from flush(names, texts)
                    names, texts, size = [], [], 0
        if texts:
            yield from flush(names, texts)

    return training.select("class", "words").mapInArrow(stream, empty)


def comparison_rows(df: DataFrame, key: str, text: str, lang: str, least_words: int, keep: list[str]) -> DataFrame:
    """(key, keep..., words): comparison words joined by blanks, of rows with enough of them."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [comparison_words(t, g) for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            ok = pa.array([len(w) >= least_words for w in words])
            rows = pa.RecordBatch.from_arrays([*b.columns[2:], pa.array([" ".join(w) for w in words], pa.string())], names=[key, *keep, "words"])
            yield rows.filter(ok)

    return df.select(F.col(text).alias("t"), F.col(lang).alias("l"), key, *keep).mapInArrow(run, f"{kinds}, words string")


def near_rows(df: DataFrame, key: str, text: str, lang: str, is_eval: str, least_words: int, share_pct: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(is_eval, key, class, keep...) of the rows that take part, and the near pairs of classes."""
    if share_pct >= 50 or least_words < 1 or parts_of(np.array([least_words]), share_pct)[0] > least_words:
        raise ValueError("so many edits leave no part of a text unchanged")
    rows = comparison_rows(df.filter(F.col(is_eval).isNotNull()), key, text, lang, least_words, [is_eval, *keep])
    # The digest stands for the text, so that words are shuffled once, to their class.
    rows = cut_table(rows.withColumn("class", F.md5("words")))
    classes = cut_table(rows.groupBy(is_eval, "class").agg(F.first("words").alias("words")))
    # Written, so that its size is known: Spark broadcasts it only if it is small.
    found = cut_table(near_classes(classes.filter(F.col(is_eval)), classes.filter(~F.col(is_eval)), share_pct))
    return rows.select(is_eval, key, "class", *keep), found


def cross_split_links(df: DataFrame, key: str, text: str, lang: str, is_eval: str, least_words: int = 10, share_pct: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(key, is_eval, class, keep..., n_links): one row per row that takes part.

    ``class`` is the digest of its comparison words, equal for equal texts; ``n_links`` counts
    the near rows of the other side, without listing them. Rows as in ``cross_split_pairs``.
    """
    keep = keep or []
    rows, found = near_rows(df, key, text, lang, is_eval, least_words, share_pct, keep)
    sizes = rows.groupBy(is_eval, "class").agg(F.count("*").alias("n"))
    pairs = found.select(F.col("eval_class"), F.col("train_class"))
    of_eval = pairs.join(sizes.filter(~F.col(is_eval)).select(F.col("class").alias("train_class"), "n"), "train_class").groupBy(F.col("eval_class").alias("class")).agg(F.sum("n").alias("n_links"))
    of_train = pairs.join(sizes.filter(F.col(is_eval)).select(F.col("class").alias("eval_class"), "n"), "eval_class").groupBy(F.col("train_class").alias("class")).agg(F.sum("n").alias("n_links"))
    links = of_eval.withColumn(is_eval, F.lit(True)).union(of_train.withColumn(is_eval, F.lit(False)))
    return rows.join(links, [is_eval, "class"], "left").select(key, is_eval, "class", *keep, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def cross_split_pairs(df: DataFrame, key: str, text: str, lang: str, is_eval: str, least_words: int = 10, share_pct: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(eval_key, train_key, keep of the evaluation row..., spans, matched) of all near pairs.

    ``is_eval`` names a boolean column; rows where it is null belong to neither side. Null and
    short texts take no part; texts equal but for case, punctuation and look-alike characters
    are near pairs; repeated rows give repeated pairs.
    """
    keep = keep or []
    members, found = near_rows(df, key, text, lang, is_eval, least_words, share_pct, keep)
    ev = members.filter(F.col(is_eval)).select(F.col(key).alias("eval_key"), F.col("class").alias("eval_class"), *keep)
    tr = members.filter(~F.col(is_eval)).select(F.col(key).alias("train_key"), F.col("class").alias("train_class"))
    return found.join(ev, "eval_class").join(tr, "train_class").select("eval_key", "train_key", *keep, "spans", "matched")
