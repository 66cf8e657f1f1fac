"""Cutting oversized utterances into numbered pieces under two limits, at natural boundaries.

Method: every position of a text gets the strength of the boundary there (sentence end, clause
end, word end, inside a word, before a combining mark). A sparse table over the strengths
answers "strongest boundary between i and j" in constant time. Each cut is the strongest
boundary in the window of permissible lengths, the rightmost among equals; the next piece
starts the overlap before the cut.

Text and time share one array of boundaries: time runs evenly over the characters, and the
times of a piece are those of its first and last position. Where a few characters already
fill the time limit, the positions are parts of characters, and a piece holds every character
that it touches; a segment without text is one such stretch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that end a sentence or a clause.
SENTENCE_ENDS = ".!?。！？…"
CLAUSE_ENDS = ",;:、，；："


@dataclass(frozen=True)
class Limits:
    chars: int = 400
    ms: int = 30_000
    overlap_chars: int = 20
    overlap_ms: int = 1_000
    #: A piece is at least this share of the longest permissible one, so that pieces stay few.
    least_share: float = 0.5
    #: Positions within the time limit where characters are longer than a quarter of it.
    parts: int = 300


#: Strengths of boundaries.
SENTENCE, CLAUSE, WORD, INSIDE, PART, MARK = 4, 3, 2, 0, -1, -2


def _joins(code: int) -> bool:
    """Whether a character belongs to the one before it."""
    return unicodedata.category(chr(code))[0] == "M" or code in (0x200C, 0x200D) or 0x1F3FB <= code <= 0x1F3FF


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len."""
    n = len(text)
    s = np.zeros(n + 1, dtype=np.int8)
    if n == 0:
        return s
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, which = np.unique(codes, return_inverse=True)
    blank = np.array([chr(c).isspace() for c in kinds.tolist()])[which]
    joins = np.array([c > 127 and _joins(c) for c in kinds.tolist()])[which]
    s[1:n][blank[1:] & ~blank[:-1]] = WORD  # after a word, before the blank
    ends = np.isin(codes, [ord(c) for c in SENTENCE_ENDS])
    clause = np.isin(codes, [ord(c) for c in CLAUSE_ENDS])
    wide = codes >= 0x2E80  # scripts without blanks: the mark alone ends the sentence
    after = np.append(blank[1:], True) | wide
    s[1:][clause & after] = CLAUSE
    s[1:][ends & after] = SENTENCE
    s[:n][joins] = MARK
    s[1:][codes == 0x200D] = MARK
    return s


class RangeMaximum:
    """Sparse table: position of the greatest value in [i, j], the rightmost among equals.

    Row k holds, for each i, how far from i the place of the maximum of 2**k values lies: two
    bytes a value and row, for windows of up to ``widest`` values.
    """

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        kind = np.uint16 if widest <= 1 << 16 else np.uint32
        place = np.arange(len(values))
        self.table = [np.zeros(len(values), dtype=kind)]
        step = 1
        while 2 * step <= min(widest, len(values)):
            m = len(place) - step
            place = np.where(values[place[:m]] > values[place[step:]], place[:m], place[step:])
            self.table.append((place - np.arange(m)).astype(kind))
            step *= 2

    def query(self, i: int, j: int) -> int:
        k = min((j - i + 1).bit_length() - 1, len(self.table) - 1)
        r = j - (1 << k) + 1
        a, b = i + int(self.table[k][i]), r + int(self.table[k][r])
        return a if self.values[a] > self.values[b] else b


def cut_units(value: np.ndarray, longest: int, overlap: int, least_share: float) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``longest`` units over boundaries before units 0..n.

    An end or a start lies inside a word only where its window holds no boundary.
    """
    n = len(value) - 1
    table = RangeMaximum(value, longest)
    out, start = [], 0
    while n - start > longest:
        low = start + max(overlap + 1, int(longest * least_share))
        end = table.query(low, start + longest)
        if value[end] <= INSIDE and low > start + overlap + 1:
            early = table.query(start + overlap + 1, low - 1)
            end = early if value[early] > value[end] else end
        out.append((start, end))
        # The overlap reaches back to the last boundary before it, or else to the first within it.
        back, least = end - overlap, max(start + 1, end - 2 * overlap)
        begin = table.query(least, back) if back >= least else end
        if value[begin] <= INSIDE and back + 1 < end:
            inner = [i for i in range(back + 1, end) if value[i] > INSIDE]
            begin = inner[0] if inner else begin
        start = begin
    out.append((start, n))
    return out


def cut_item(text: str | None, start_ms: int | None, end_ms: int | None, limits: Limits) -> list[tuple]:
    """(piece text, piece start, piece end) of one utterance, or one piece where it is within the limits.

    Pieces are whole stretches of the text, never empty where the text is not, and together
    cover it. Consecutive ones share the longer of both overlaps, up to a third of a piece.
    """
    chars = len(text) if text else 0
    timed = start_ms is not None and end_ms is not None and end_ms > start_ms
    ms = end_ms - start_ms if timed else 0
    if chars <= limits.chars and ms <= limits.ms:
        return [(text, start_ms if timed else None, end_ms if timed else None)]
    value = strengths(text) if chars else np.zeros(2, dtype=np.int8)
    units, parts = max(chars, 1), 1
    if ms * 4 > limits.ms * units:  # parts of characters as positions
        parts = -(-ms * limits.parts // (units * limits.ms))
        fine = np.full(units * parts + 1, PART, dtype=np.int8)
        fine[::parts] = value
        value, units = fine, units * parts
    longest, overlap = limits.chars * parts, limits.overlap_chars * parts if parts == 1 else 0
    if timed:
        longest = min(longest, max((limits.ms - 1) * units // ms, 2))
        overlap = max(overlap, -(-limits.overlap_ms * units // ms))
    spans = cut_units(value, longest, min(overlap, longest // 3), limits.least_share)
    at = [(start_ms + round(p * ms / units), start_ms + round(q * ms / units)) if timed else (None, None) for p, q in spans]
    return [(text[p // parts : -(-q // parts)] if chars else text, a, b) for (p, q), (a, b) in zip(spans, at)]


def cut_pieces(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(uttid, piece, n_pieces, text, start_ms, end_ms) of rows (uttid, text, start_ms, end_ms).

    ``piece`` counts from 0. Items within both limits give one piece, the item itself; a null
    or empty text counts no characters, a missing, empty or reversed segment no time. No
    shuffle: each row is cut where it is.
    """
    kind = items.schema["uttid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            starts = [None if pd.isna(x) else int(x) for x in b["start_ms"]]
            ends = [None if pd.isna(x) else int(x) for x in b["end_ms"]]
            for u, t, s, e in zip(b["uttid"], b["text"], starts, ends):
                pieces = cut_item(t, s, e, limits)
                out.extend((u, k, len(pieces), *p) for k, p in enumerate(pieces))
            f = pd.DataFrame(out, columns=["uttid", "piece", "n_pieces", "text", "start_ms", "end_ms"])
            yield f.astype({"start_ms": "Int64", "end_ms": "Int64"})

    schema = f"uttid {kind}, piece int, n_pieces int, text string, start_ms bigint, end_ms bigint"
    return items.select("uttid", F.col("text").cast("string").alias("text"), F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms")).mapInPandas(run, schema)
