"""Encoding of a corpus with a public byte-level BPE vocabulary (a file of token ranks).

Method: pair occurrence index. The words that a batch brings and the worker has not met are
laid out in one list of symbols. Every adjacent pair is mapped to all its positions; the
active ranks are applied in ascending order, each to all positions of its pair at once, and
only the lists of the pairs beside a merge are updated. Each distinct word is merged once
per worker, whatever its number of occurrences.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunks a worker remembers; beyond it the memory is emptied and filled anew.
MEMORY_CHUNKS = 600_000
#: Characters of them after which the memory begins anew, however few the chunks.
MEMORY_CHARS = 30_000_000

# A blank or line feed amid or at the end of white space: a cut before it would part a token.
_INNER = re.compile(r"(?<=\s)[ \n](?=\s|\Z)")
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INNER_RE2 = _SPACE + r"[ \n](?:" + _SPACE + r"|\z)"


def merge_words(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word by the pair occurrence index over all words together."""
    sym: list[bytes] = []
    nxt: list[int] = []
    prv: list[int] = []
    heads: list[int] = []
    for w in words:
        at, n = len(sym), len(w)
        heads.append(at if n else -1)
        sym.extend(w[i : i + 1] for i in range(n))
        prv.extend(range(at - 1, at + n - 1))
        nxt.extend(range(at + 1, at + n + 1))
        if n:
            prv[at] = nxt[-1] = -1
    where: dict[tuple[bytes, bytes], list[int]] = {}
    for i, j in enumerate(nxt):
        if j >= 0:
            where.setdefault((sym[i], sym[j]), []).append(i)
    active = [(r, p) for p in where if (r := ranks.get(p[0] + p[1])) is not None]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        places = where.pop(pair, None)
        if places is None:
            continue
        left, right = pair
        both = left + right
        places.sort()
        for i in places:
            j = nxt[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue  # an earlier merge took a part of this pair
            k = nxt[j]
            sym[i], sym[j], nxt[i] = both, b"", k
            h = prv[i]
            if k >= 0:
                prv[k] = i
            for a, p in ((h, (sym[h], both) if h >= 0 else None), (i, (both, sym[k]) if k >= 0 else None)):
                if p is None:
                    continue
                known = where.get(p)
                if known is not None:
                    known.append(a)
                elif (r := ranks.get(p[0] + p[1])) is not None:
                    where[p] = [a]
                    heapq.heappush(active, (r, p))
    out = []
    for i in heads:
        ids = []
        while i >= 0:
            ids.append(ranks[sym[i]])
            i = nxt[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes Arrow string arrays; keeps the ids of the words and chunks it has met."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, int] = {}  # chunk -> its place in the two arrays below
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.int32)
        self.used = 0
        self.chars = 0

    def _learn(self, chunks: list[str]) -> None:
        cut = [self.pattern.findall(c) for c in chunks]
        new = [w for w in set(chain.from_iterable(cut)) if w not in self.words]
        self.words.update(zip(new, merge_words([w.encode() for w in new], self.ranks)))
        get = self.words.__getitem__
        ids = [list(chain.from_iterable(map(get, ws))) for ws in cut]
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at, total = len(self.chunks), int(n.sum())
        while at + len(n) > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, self.begin]), np.concatenate([self.count, self.count])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.begin[at : at + len(n)] = self.used + np.cumsum(n) - n
        self.count[at : at + len(n)] = n
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=total)
        self.used += total
        self.chars += sum(map(len, chunks)) + sum(map(len, new))
        self.chunks.update(zip(chunks, range(at, at + len(n))))

    def _places(self, chunks: list[str]) -> np.ndarray:
        if len(self.chunks) + len(chunks) > MEMORY_CHUNKS or self.chars > MEMORY_CHARS:
            self._forget()
        known = self.chunks
        if new := [c for c in chunks if c not in known]:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """One list per text; the empty list for empty and null texts.

        A chunk is a stretch that the pattern cuts alike alone and in place. Cuts lie before
        blanks and line feeds; those amid white space, where a cut would part a token, are
        covered first with code points that none of the texts holds. A third such code point
        stands for a line feed that a cut precedes.
        """
        texts = pc.fill_null(texts, "")
        free = (c for c in map(chr, range(0xFDD0, 0x110000)) if not pc.any(pc.match_substring(texts, c)).as_py())
        blank, feed, mark = next(free), next(free), next(free)
        odd = pc.match_substring_regex(texts, _INNER_RE2)
        covered = pc.any(odd).as_py()
        if covered:
            cover = {" ": blank, "\n": feed}
            changed = [_INNER.sub(lambda m: cover[m[0]], t) for t in texts.filter(odd).to_pylist()]
            texts = pc.replace_with_mask(texts, odd, pa.array(changed, pa.string()))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " " + mark), " ")
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        bare = np.zeros(len(flat), dtype=np.int64)  # 1: without the blank that the cut took away
        bare[(ends[:-1] - ends[0])[np.diff(ends) > 0]] = 1
        coded = flat.dictionary_encode()
        values = coded.dictionary.to_pylist()
        key = coded.indices.to_numpy().astype(np.int64) * 2 + bare
        as_it_is = np.fromiter((v.startswith(mark) for v in values), dtype=bool, count=len(values))
        key[as_it_is[key >> 1]] |= 1
        values = [v.replace(mark, "\n") if a else v for v, a in zip(values, as_it_is)]
        if covered:
            values = [v.replace(blank, " ").replace(feed, "\n") for v in values]
        met = np.zeros(2 * len(values), dtype=bool)
        met[key] = True
        uniq = np.flatnonzero(met)
        places = np.zeros(2 * len(values), dtype=np.int64)
        # two keys may name one chunk; the memory holds it once
        names = [values[k >> 1] if k & 1 else " " + values[k >> 1] for k in uniq.tolist()]
        self._places(list(dict.fromkeys(names)))
        places[uniq] = np.fromiter(map(self.chunks.__getitem__, names), dtype=np.int64, count=len(names))
        p = places[key]
        n, begin = self.count[p], self.begin[p]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(total[-1]) + np.repeat(begin - total[:-1], n)
        return pa.ListArray.from_arrays(pa.array(total[ends - ends[0]], pa.int32()), pa.array(self.ids[take], pa.int32()))


_encoders: dict[int, Encoder] = {}  # one for each vocabulary in a worker, kept from task to task


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", rank_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids) of every row: the token ids of the whole text, without special tokens.

    Empty and null texts get the empty list; strings that look like special tokens are
    ordinary text; repeated rows stay. No shuffle: each partition is encoded where it is
    read. The rank file (fixed, under 1 MB) is read on the driver and broadcast.
    """
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = ranks.value
        if (encoder := _encoders.get(mark := hash(data))) is None:
            encoder = _encoders[mark] = Encoder(data)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.encode(b.column(1))], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")
