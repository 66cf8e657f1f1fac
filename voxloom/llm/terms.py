"""Occurrences of terms and word n-grams over a collection, and the number of records with each.

Method: suffix array with common-prefix intervals. Each partition sorts the suffixes of its
records, whole to the end of each record, by prefix doubling over the groups that are not yet
told apart, and finds how long a prefix neighbours share. The n-grams of any n are the
intervals in which neighbours share n tokens or more; an interval's length is the number of
occurrences. A record that occurs twice in an interval is counted once: for each suffix the
preceding suffix of the same record in the array is looked up, and where both lie in one
interval, one is subtracted. Single terms are the intervals for n = 1 of the same array. A
record lies in one partition whole, so the counts of the partitions add up; only one row per
n-gram and partition is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut_table

_BREAK = re.compile(r"[ \t\n\r]+")
#: Tokens that one suffix array takes; a partition with more of them gives several arrays.
ARRAY_TOKENS = 1_000_000
#: Rows of a batch of counts.
BATCH_ROWS = 20_000


def suffix_array(ids: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes in order, each up to the end of its record, and the number
    of tokens that each shares with the one before it.

    ``record`` does not decrease. Equal suffixes stay in text order, so by record.
    """
    size = len(ids)
    ends = np.flatnonzero(np.append(record[1:] != record[:-1], True)) + 1
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(size)  # tokens up to the end of the record

    def first_place(values: np.ndarray) -> np.ndarray:
        """For sorted values, the place of the first equal one."""
        head = np.ones(len(values), dtype=bool)
        head[1:] = values[1:] != values[:-1]
        return np.flatnonzero(head)[np.cumsum(head) - 1]

    # A rank is the place of the first suffix with the same first ``depth`` tokens.
    rank = np.empty(size, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    rank[order] = first_place(ids[order])
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        group = np.bincount(rank, minlength=size)
        open_ = np.flatnonzero(group[rank] > 1)
        if not (left[open_] > depth).any():
            break
        ahead = np.zeros(len(open_), dtype=np.int64)  # 0: the record ends before
        goes_on = left[open_] > depth
        ahead[goes_on] = rank[open_[goes_on] + depth] + 1
        key = rank[open_] * (size + 1) + ahead
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        base = rank[open_][by_key]
        rank[open_[by_key]] = base + first_place(key) - first_place(base)
        depth *= 2
        levels.append(rank.astype(np.int32))
    order = np.argsort(rank, kind="stable")
    # Shared prefixes from the ranks of all depths, the greatest first.
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(max(size - 1, 0), dtype=np.int64)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        # Beyond the end of either record nothing is compared; the last place stands in for it.
        same = (length < most) & (levels[k][np.minimum(a, size - 1)] == levels[k][np.minimum(b, size - 1)])
        step = np.where(same, np.minimum(1 << k, most - length), 0)
        length += step
        a += step
        b += step
    shared = np.zeros(size, dtype=np.int64)
    shared[1:] = length
    return order, shared


def count_ngrams(ids: np.ndarray, record: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, position of one occurrence, occurrences, records) of all n-grams up to max_n."""
    size = len(ids)
    if not size:
        return
    order, shared = suffix_array(ids, record)
    at = record[order]
    by_record = np.argsort(at, kind="stable")
    earlier = np.full(size, -1, dtype=np.int64)
    same = at[by_record[1:]] == at[by_record[:-1]]
    earlier[by_record[1:][same]] = by_record[:-1][same]
    for n in range(1, max_n + 1):
        whole = order + n - 1 < size
        whole &= record[np.minimum(order + n - 1, size - 1)] == at
        interval = np.cumsum(shared < n) - 1
        heads = np.flatnonzero(shared < n)
        keep = whole[heads]
        count = np.diff(np.append(heads, size))
        again = np.flatnonzero((earlier >= 0) & (interval[earlier] == interval))
        records = count - np.bincount(interval[again], minlength=len(heads))
        yield n, order[heads][keep], count[keep], records[keep]


def _frequent_runs(ids: np.ndarray, record: np.ndarray, terms: list[str], pairs: list[str]) -> np.ndarray:
    """How many pairs of neighbours from each position on are all among ``pairs``, within the record."""
    place = {t: i for i, t in enumerate(terms)}
    split = (p.split(" ") for p in pairs)
    codes = np.array([place[a] * len(terms) + place[b] for a, b in split if a in place and b in place], dtype=np.int64)
    good = np.zeros(len(ids), dtype=bool)
    good[:-1] = np.isin(ids[:-1] * len(terms) + ids[1:], codes) & (record[1:] == record[:-1])
    at = np.arange(len(ids))
    stop = np.minimum.accumulate(np.where(good, len(ids), at)[::-1])[::-1]
    return stop - at


def ngram_counts(df: DataFrame, text: str, max_n: int = 1, least_n: int = 1, pairs: list[str] | None = None) -> DataFrame:
    """(n, term, occurrences, records): every n-gram of 1 to max_n terms, over all rows.

    Terms are the pieces between blanks, tabs and line breaks, exactly as written; those of
    an n-gram are joined by one blank. A row is a record; null, empty and blank texts hold no
    terms. One more row with n = 0 and a null term gives the number of records with a term.
    With ``least_n`` shorter n-grams are left out, and with ``pairs`` those that hold a pair
    of neighbours not among them.
    """
    sent = df.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(words: list[str], lengths: list[int]) -> Iterator[pa.RecordBatch]:
            flat = pa.array(words, pa.string()).dictionary_encode()
            terms = flat.dictionary.to_pylist()
            # Ids in the order of the terms, so that the array is sorted as the texts are.
            place = np.argsort(np.argsort(np.array(terms, dtype=object), kind="stable"))
            ids = place[flat.indices.to_numpy()]
            record = np.repeat(np.arange(len(lengths)), lengths)
            runs = _frequent_runs(ids, record, sorted(terms), sent.value) if sent is not None else None
            out = {"n": [0], "term": [None], "occurrences": [len(words)], "records": [len(lengths)]}
            yield pa.RecordBatch.from_pydict(out, schema=_PARTIAL)
            for n, at, count, records in count_ngrams(ids, record, max_n):
                if n < least_n:
                    continue
                if runs is not None and n > 1:
                    keep = runs[at] >= n - 1
                    at, count, records = at[keep], count[keep], records[keep]
                for a in range(0, len(at), BATCH_ROWS):
                    names = pa.array([" ".join(words[i : i + n]) for i in at[a : a + BATCH_ROWS].tolist()], pa.string())
                    some = slice(a, a + BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), n, dtype=np.int32)), names, pa.array(count[some]), pa.array(records[some])], schema=_PARTIAL)

        words: list[str] = []
        lengths: list[int] = []
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and (w := [x for x in _BREAK.split(t) if x]):
                    words.extend(w)
                    lengths.append(len(w))
                    if len(words) >= ARRAY_TOKENS:
                        yield from flush(words, lengths)
                        words, lengths = [], []
        if words:
            yield from flush(words, lengths)

    part = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n int, term string, occurrences bigint, records bigint")
    return part.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


#: Most frequent pairs of neighbours that are sent to the tasks.
MOST_PAIRS = 1_000_000


def frequent_ngrams(df: DataFrame, text: str, max_n: int, least: int) -> DataFrame:
    """(n, term, occurrences, records) of the n-grams of 1 to max_n terms that occur ``least`` times or more.

    An n-gram occurs no more often than any pair of neighbours in it. So pairs are counted first,
    and of longer n-grams only those are shuffled whose pairs are all frequent enough: none is
    lost. Should there be more than MOST_PAIRS such pairs, all longer n-grams are shuffled.
    """
    enough = (F.col("n") > 0) & (F.col("occurrences") >= least)
    df = cut_table(df.select(F.col(text).cast("string").alias(text)))  # read twice
    short = cut_table(ngram_counts(df, text, min(max_n, 2)).filter(enough))
    if max_n <= 2:
        return short
    pairs = [r["term"] for r in short.filter("n = 2").select("term").limit(MOST_PAIRS + 1).collect()]
    return short.union(ngram_counts(df, text, max_n, 3, pairs if len(pairs) <= MOST_PAIRS else None).filter(enough))


_PARTIAL = pa.schema([("n", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def marked_terms(df: DataFrame, text: str, max_n: int = 1, rare_below: int = 3, common_above: float = 0.125) -> DataFrame:
    """(n, term, occurrences, records, mark): mark is ``rare``, ``common`` or null.

    Rare: in fewer than ``rare_below`` records; common: in more than the share
    ``common_above`` of the records with a term; rare holds where both would.
    """
    counts = cut_table(ngram_counts(df, text, max_n))  # read twice below
    total = counts.filter("n = 0").agg(F.sum("records").alias("n_records"))  # one row
    rows = counts.filter("n > 0").crossJoin(F.broadcast(total))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("n_records") * common_above, "common")
    return rows.withColumn("mark", mark).drop("n_records")
