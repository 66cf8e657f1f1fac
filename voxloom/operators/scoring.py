"""Scoring: edit distances, permutations, assignments, entities, n-best lists, language models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(correct, substituted, deleted, inserted) on a path of least edits; ties prefer diagonal, deletion, insertion."""
    if ref == hyp:
        return len(ref), 0, 0, 0
    # An equal end lies on the path; what remains keeps one byte a cell, not the costs.
    tail = 0
    while tail < min(len(ref), len(hyp)) and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[: len(ref) - tail], hyp[: len(hyp) - tail]
    n, m = len(ref), len(hyp)
    number = {w: i for i, w in enumerate(dict.fromkeys(hyp))}
    x, y = np.array([number.get(w, -1) for w in ref], dtype=np.int64), np.array([number[w] for w in hyp], dtype=np.int64)
    came = np.full((n + 1, m + 1), 2, dtype=np.uint8)  # 0 along the diagonal, 1 by a deletion, 2 by an insertion
    cost = ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, dtype=np.int64)
        row[0] = i
        straight, down = cost[:-1] + (y != x[i - 1]), cost + 1
        row[1:] = np.minimum(straight, down[1:])
        new = np.minimum.accumulate(row - ramp) + ramp  # insertions along the row
        came[i][new == down] = 1
        came[i, 1:][new[1:] == straight] = 0
        cost = new
    c, s, d, k = tail, 0, 0, 0
    i, j = n, m
    while i or j:
        if came[i, j] == 0:
            same = x[i - 1] == y[j - 1]
            c, s, i, j = c + same, s + (not same), i - 1, j - 1
        elif came[i, j] == 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return int(c), int(s), int(d), int(k)


def word_errors(df: DataFrame, key: str, ref: str, hyp: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., n_ref, n_cor, n_sub, n_del, n_ins) over arrays of words; null counts as empty."""
    keep = keep or []
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [[] if v is None else list(v) for v in b["__r"]]
            h = [[] if v is None else list(v) for v in b["__h"]]
            counts = pd.DataFrame([(len(x), *edit_counts(x, y)) for x, y in zip(r, h)], columns=["n_ref", "n_cor", "n_sub", "n_del", "n_ins"])
            yield pd.concat([b.drop(columns=["__r", "__h"]).reset_index(drop=True), counts], axis=1)

    return df.select(key, *keep, F.col(ref).alias("__r"), F.col(hyp).alias("__h")).mapInPandas(run, f"{kinds}, n_ref bigint, n_cor bigint, n_sub bigint, n_del bigint, n_ins bigint")


def char_distance(ref: Column, hyp: Column, most: int | None = None) -> Column:
    """Edit distance of characters without blanks; with ``most``, -1 beyond it."""
    a, b = F.replace(ref, F.lit(" ")), F.replace(hyp, F.lit(" "))
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def error_rate(df: DataFrame, edits: Column, length: Column, by: list[str] | None = None) -> DataFrame:
    """Micro-average: all edits over all reference lengths; null without any."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.sum(edits).alias("edits"), F.sum(length).alias("length")).withColumn("rate", F.when(F.col("length") > 0, F.col("edits") / F.col("length")))


def _permuted(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows (key, ref, hyp) with each permutation they are part of: perm numbered in lexical order. n! rows, n small."""
    if n > 6:
        raise ValueError("permutations are for few speakers; use assignment()")
    table = df.sparkSession.createDataFrame([(p, r + 1, h + 1) for p, perm in enumerate(permutations(range(n))) for r, h in enumerate(perm)], "perm int, ref int, hyp int")
    return df.withColumn("ref", F.col("ref").cast("int")).withColumn("hyp", F.col("hyp").cast("int")).join(F.broadcast(table), ["ref", "hyp"])


def permutation_free_error(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, perm, c, s, d, i, rate): the permutation of hypotheses with the least (s + d + i) / (c + s + d), the first among equals.

    Rows are (key, ref, hyp, c, s, d, i) with ref and hyp from 1 to n.
    """
    sums = _permuted(df, key, n).groupBy(key, "perm").agg(*[F.sum(x).alias(x) for x in "csdi"])
    rate = (F.col("s") + F.col("d") + F.col("i")) / F.nullif(F.col("c") + F.col("s") + F.col("d"), F.lit(0))
    best = sums.withColumn("rate", rate).groupBy(key).agg(F.min_by(F.struct("perm", *"csdi", "rate"), F.struct(F.coalesce("rate", F.lit(float("inf"))), "perm")).alias("b"))
    return best.select(key, "b.*")


def least_pair_loss(df: DataFrame, key: str, loss: str, n: int) -> DataFrame:
    """(key, perm, loss): the permutation with the least mean of pair losses, the first among equals."""
    means = _permuted(df, key, n).groupBy(key, "perm").agg(F.avg(loss).alias("loss"))
    return means.groupBy(key).agg(F.min_by(F.struct("perm", "loss"), F.struct(F.round("loss", 12), "perm")).alias("b")).select(key, "b.*")


def reorder(df: DataFrame, best: DataFrame, key: str, n: int) -> DataFrame:
    """(key, ref, hyp): which hypothesis each reference got in the chosen permutation."""
    pairs = F.create_map(*[x for p, perm in enumerate(permutations(range(n))) for x in (F.lit(p), F.array(*[F.lit(h + 1) for h in perm]))])
    return best.select(key, F.posexplode(F.element_at(pairs, F.col("perm").cast("int"))).alias("ref", "hyp")).withColumn("ref", F.col("ref") + 1)


def best_assignment(cost: np.ndarray) -> list[int]:
    """For each row its column in an assignment of least total cost (rows <= columns), in cubic time.

    Rows are added one by one along the shortest augmenting path over reduced costs.
    """
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=np.int64)  # row of each column, from 1; column 0 starts a path
    for r in range(1, n + 1):
        owner[0], j = r, 0
        slack, before, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            used[j] = True
            i = owner[j]
            reduced = cost[i - 1] - row_price[i] - col_price[1:]
            closer = ~used[1:] & (reduced < slack[1:])
            slack[1:][closer], before[1:][closer] = reduced[closer], j
            free = np.flatnonzero(~used[1:]) + 1
            k = int(free[np.argmin(slack[free])])
            step = slack[k]
            row_price[owner[used]] += step
            col_price[used] -= step
            slack[~used] -= step
            j = k
        while j:
            owner[j] = owner[before[j]]
            j = int(before[j])
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assignment(df: DataFrame, key: str, cost: str, missing: float = 1000.0) -> DataFrame:
    """(key, ref, hyp): references and hypotheses matched one to one with the least total cost.

    Either side may be larger; a missing or NaN cost counts as ``missing``. A key's pairs, few
    by nature (speakers of a session), are one group; the time grows with the cube of a side.
    """
    kind = df.schema[key].dataType.simpleString()

    def match(pairs: list) -> list[dict]:
        refs, hyps = sorted({p["ref"] for p in pairs}), sorted({p["hyp"] for p in pairs})
        table = np.full((len(refs), len(hyps)), missing)
        for p in pairs:
            c = p["cost"]
            table[refs.index(p["ref"]), hyps.index(p["hyp"])] = missing if c is None or c != c else c
        turned = len(refs) > len(hyps)
        chosen = best_assignment(table.T if turned else table)
        return [{"ref": refs[j], "hyp": hyps[i]} if turned else {"ref": refs[i], "hyp": hyps[j]} for i, j in enumerate(chosen)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "matched": [match(list(p)) for p in b["pairs"]]})

    pair = F.struct(F.col("ref").cast("bigint").alias("ref"), F.col("hyp").cast("bigint").alias("hyp"), F.col(cost).cast("double").alias("cost"))
    packed = df.filter("ref is not null and hyp is not null").groupBy(key).agg(F.collect_list(pair).alias("pairs"))
    return packed.mapInPandas(run, f"{key} {kind}, matched array<struct<ref:bigint,hyp:bigint>>").select(key, F.inline("matched"))


def entity_scores(truth: DataFrame, guess: DataFrame, by: list[str]) -> DataFrame:
    """One row of tp, fp, fn, f1 over rows compared as multisets (by..., equal rows told apart by number)."""
    number = lambda d, n: d.groupBy(*by).agg(F.count("*").alias(n))
    a, b = number(truth, "n_t"), number(guess, "n_g")
    j = a.join(b, by, "full").na.fill(0, ["n_t", "n_g"])
    both = F.least("n_t", "n_g")
    s = j.agg(F.sum(both).alias("tp"), F.sum(F.col("n_g") - both).alias("fp"), F.sum(F.col("n_t") - both).alias("fn"))
    return s.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def nbest_lists(df: DataFrame, key: str, score: str, n: int, fields: list[str]) -> DataFrame:
    """(key, output): the n best hypotheses as an array of (name, score, fields), distinct by fields."""
    one = df.groupBy(key, *fields).agg(F.max(score).alias(score))
    w = Window.partitionBy(key).orderBy(F.desc(score), *fields)
    top = one.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    packed = F.array_sort(F.collect_list(F.struct("__r", F.struct(F.concat(F.lit("target1["), F.col("__r").cast("string"), F.lit("]")).alias("name"), F.col(score).alias("score"), *fields).alias("h"))))
    return top.groupBy(key).agg(packed.alias("p")).select(key, F.col("p.h").alias("output"))


def beam_step(df: DataFrame, key: str, hyp: str, prev: str, scores: dict[str, float], k: int, pre: tuple[str, int] | None = None) -> DataFrame:
    """One search step over candidates (key, hyp, prev, score columns...): the k best a key by prev + weighted scores.

    First each hypothesis keeps its k best candidates (of the ``pre`` beam by one score, if given).
    """
    ties = [F.col(c) for c in df.columns if c not in scores]
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in scores.items()])
    if pre:
        w = Window.partitionBy(key, hyp).orderBy(F.desc(pre[0]), *ties)
        df = df.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= pre[1]).drop("__p")
    scored = df.withColumn("score", F.col(prev) + total)
    w1 = Window.partitionBy(key, hyp).orderBy(F.desc("score"), *ties)
    w2 = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    kept = scored.withColumn("__p", F.row_number().over(w1)).filter(F.col("__p") <= k).drop("__p")
    return kept.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def search_ended(df: DataFrame, key: str, length: str, score: str, last: int, margin: float) -> DataFrame:
    """(key, ended): whether the best score of each of the ``last`` lengths lies below the best of all by ``margin``."""
    per = df.groupBy(key, length).agg(F.max(score).alias("s"))
    top = per.groupBy(key).agg(F.max("s").alias("top"), F.max(length).alias("longest"))
    late = per.join(top, key).filter(F.col(length) > F.col("longest") - last)
    return late.groupBy(key).agg(((F.count("*") == last) & F.min(F.col("s") - F.col("top") < margin)).alias("ended"))


def bleu(df: DataFrame, ref: str, hyp: str, most: int = 4) -> DataFrame:
    """One row (bleu, bp, p1..): corpus BLEU over word arrays, counts clipped by the reference, without smoothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + 2 * most, dtype=np.int64)
        for b in batches:
            for r, h in zip(b["r"], b["h"]):
                r, h = [] if r is None else list(r), [] if h is None else list(h)
                total[0] += len(r)
                total[1] += len(h)
                for n in range(1, most + 1):
                    a, c = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
                    total[2 * n] += sum((a & c).values())
                    total[2 * n + 1] += max(len(h) - n + 1, 0)
        yield pd.DataFrame([total.tolist()], columns=[f"t{i}" for i in range(len(total))])

    cols = [f"t{i}" for i in range(2 + 2 * most)]
    part = df.select(F.col(ref).alias("r"), F.col(hyp).alias("h")).mapInPandas(run, ", ".join(f"{c} bigint" for c in cols))
    s = part.agg(*[F.sum(c).alias(c) for c in cols])
    p = [F.when(F.col(f"t{2 * n + 1}") > 0, F.col(f"t{2 * n}") / F.col(f"t{2 * n + 1}")).otherwise(0.0) for n in range(1, most + 1)]
    bp = F.when(F.col("t1") >= F.col("t0"), 1.0).otherwise(F.exp(1 - F.col("t0") / F.nullif(F.col("t1"), F.lit(0))))
    mean = F.exp(reduce(lambda a, b: a + b, [F.log(x) for x in p]) / most)
    ok = reduce(lambda a, b: a & b, [x > 0 for x in p])
    return s.select(F.when(ok, bp * mean).otherwise(0.0).alias("bleu"), bp.alias("bp"), *[x.alias(f"p{n}") for n, x in enumerate(p, 1)])


def _numbered(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers, without the beginning and end that they share."""
    head = 0
    while head < min(len(ref), len(hyp)) and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < min(len(ref), len(hyp)) - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]
    number = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    return np.array([number[w] for w in ref], dtype=np.int64), np.array([number[w] for w in hyp], dtype=np.int64)


def _costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distances of all beginnings of x and y."""
    ramp = np.arange(len(y) + 1)
    cost = np.empty((len(x) + 1, len(y) + 1), dtype=np.int32)
    cost[0] = ramp
    for i, v in enumerate(x, 1):
        row = np.empty(len(y) + 1, dtype=np.int64)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (y != v), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(row - ramp) + ramp
    return cost


def _aligned(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in y of each of x, whether x's words are wrong, whether y's are) on a path of least edits."""
    at, wrong_x, wrong_y = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool), np.ones(len(y), dtype=bool)
    i, j = len(x), len(y)
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            at[i] = j
            wrong_x[i] = wrong_y[j] = x[i] != y[j]
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            at[i] = j - 1  # after this word of y it would stand
        else:
            j -= 1
    return at, wrong_x, wrong_y


#: Longest stretch of words that one shift moves, and how far.
SHIFT_WORDS, SHIFT_FAR = 10, 50


def translation_edits(ref: list, hyp: list) -> int:
    """Shifts of stretches and edits of words that turn the hypothesis into the reference, greedily the fewest.

    The shift that lowers the word distance most is made first, of equals the longest, then the
    leftmost, as long as one lowers it. A stretch moves only where its words are wrong and
    the reference's same words are missed. What both share at their ends stays out of it.
    """
    x, y = _numbered(ref, hyp)
    shifts = 0
    while len(x) and len(y):
        cost = _costs(x, y)
        now = int(cost[-1, -1])
        at, wrong_x, wrong_y = _aligned(x, y, cost)
        best = None
        for i in range(len(y)):
            for j in np.flatnonzero(x == y[i]).tolist():
                if abs(int(at[j]) - i) > SHIFT_FAR:
                    continue
                for n in range(1, SHIFT_WORDS + 1):
                    if i + n > len(y) or j + n > len(x) or y[i + n - 1] != x[j + n - 1]:
                        break
                    if not wrong_y[i : i + n].any() or not wrong_x[j : j + n].any() or i <= at[j] < i + n:
                        continue
                    # Behind the word before it, or behind where any of its words would stand now.
                    for to in sorted({0 if q < 0 else int(at[q]) + 1 for q in range(j - 1, j + n)}):
                        if i <= to <= i + n:
                            continue
                        rest = np.concatenate([y[:i], y[i + n :]])
                        place = to - n if to > i else to
                        moved = np.concatenate([rest[:place], y[i : i + n], rest[place:]])
                        key = (now - int(_costs(x, moved)[-1, -1]), n, -i, -to)
                        if best is None or key > best[0]:
                            best = (key, moved)
        if best is None or best[0][0] <= 0:
            return shifts + now
        shifts, y = shifts + 1, best[1]
    return shifts + max(len(x), len(y))


def longest_common(ref: list, hyp: list) -> int:
    """Length of the longest common subsequence."""
    x, y = _numbered(ref, hyp)
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return int(row[-1]) + (len(ref) - len(x))


def sequence_scores(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """(key, n_ref, edits, rouge_l) over arrays of words: edits with shifts (for the translation edit rate, edits / n_ref), and the F measure of the longest common subsequence.

    Null counts as empty; two empty texts have an F measure of 1, one empty text 0.
    """
    kind = df.schema[key].dataType.simpleString()

    def scores(r: list, h: list) -> tuple[int, int, float]:
        if r == h:
            return len(r), 0, 1.0
        common = longest_common(r, h)
        return len(r), translation_edits(r, h), 2 * common / (len(r) + len(h))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scores([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(b["__r"], b["__h"])]
            yield pd.concat([b[["__k"]].rename(columns={"__k": key}).reset_index(drop=True), pd.DataFrame(rows, columns=["n_ref", "edits", "rouge_l"])], axis=1)

    rows = df.select(F.col(key).alias("__k"), F.col(ref).alias("__r"), F.col(hyp).alias("__h"))
    return rows.mapInPandas(run, f"{key} {kind}, n_ref bigint, edits bigint, rouge_l double")


#: Characters of pairs whose n-grams are numbered together; a longer pair is taken alone.
CHRF_CHARS = 500_000


def shared_grams(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """For each n up to ``most``, the n-grams of characters that the two texts of a pair share, counted as often as both hold them."""
    x = np.frombuffer("".join(r + h for r, h in pairs).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(t) for p in pairs for t in p], dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.cumsum(sizes)[text] - np.arange(len(x))
    number, ref, out = text // 2, text % 2 == 0, np.zeros(most, dtype=np.int64)
    for n in range(1, most + 1):
        # The number of an n-gram comes from that of its first n - 1 characters, at first its pair's, and the last.
        at = np.flatnonzero(left >= n)
        _, own = np.unique(number[at] * 0x110000 + x[at + n - 1], return_inverse=True)
        number[at] = own
        a, b = (np.bincount(own[side], minlength=len(own)) for side in (ref[at], ~ref[at]))
        out[n - 1] = np.minimum(a, b).sum()
    return out


def chrf(df: DataFrame, ref: str, hyp: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """One row (chrf): the character n-gram F score over all pairs, blanks left out.

    Counts of each length are summed over the pairs; precision and recall are averages over the
    lengths of which there are any, recall weighing ``beta`` times. Null texts count as empty.
    A pair is counted where it lies, so that no n-gram is shuffled.
    """
    lengths = np.arange(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, pairs, held = np.zeros((most, 3), dtype=np.int64), [], 0
        for b in batches:
            for r, h in zip(b["r"], b["h"]):
                total[:, 1] += np.maximum(len(r) - lengths, 0)
                total[:, 2] += np.maximum(len(h) - lengths, 0)
                if r == h:
                    total[:, 0] += np.maximum(len(r) - lengths, 0)
                    continue
                pairs.append((r, h))
                held += len(r) + len(h)
                if held >= CHRF_CHARS:
                    total[:, 0] += shared_grams(pairs, most)
                    pairs, held = [], 0
        total[:, 0] += shared_grams(pairs, most)
        yield pd.DataFrame([(n, *t) for n, t in enumerate(total.tolist(), 1)], columns=["n", "m", "a", "b"])

    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "")
    counts = df.select(bare(ref).alias("r"), bare(hyp).alias("h")).mapInPandas(run, "n int, m bigint, a bigint, b bigint")
    sums = counts.groupBy("n").agg(F.sum("m").alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    means = sums.agg(F.avg(F.col("m") / F.nullif(F.col("b"), F.lit(0))).alias("p"), F.avg(F.col("m") / F.nullif(F.col("a"), F.lit(0))).alias("r"))
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return means.select(F.coalesce(100 * (1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)), F.lit(0.0)).alias("chrf"))


def rouge(df: DataFrame, key: str, ref: str, hyp: str, n: int = 1) -> DataFrame:
    """(key, precision, recall, f1) of n-grams, clipped, over stored word arrays."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, r, h in zip(b["k"], b["r"], b["h"]):
                a, c = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in ([] if r is None else list(r), [] if h is None else list(h)))
                hit, na, nc = sum((a & c).values()), sum(a.values()), sum(c.values())
                p, q = hit / nc if nc else 0.0, hit / na if na else 0.0
                out.append((k, p, q, 2 * p * q / (p + q) if p + q else 0.0))
            yield pd.DataFrame(out, columns=[key, "precision", "recall", "f1"])

    return df.select(F.col(key).alias("k"), F.col(ref).alias("r"), F.col(hyp).alias("h")).mapInPandas(run, f"{key} {kind}, precision double, recall double, f1 double")


def bigram_scores(df: DataFrame, key: str, words: str, unigrams: DataFrame, bigrams: DataFrame, unknown: float, backoff: float) -> DataFrame:
    """(key, logp): sum of bigram log probabilities, backed off to unigrams, over a stored word array after <s>.

    Tables are (word, logp) and (context, word, logp); joins are on words, salted by nature.
    """
    pairs = df.select(key, F.explode(F.arrays_zip(F.concat(F.array(F.lit("<s>")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("context"), F.col(words).alias("word"))).alias("p")).select(key, "p.context", "p.word").filter("word is not null")
    counted = pairs.groupBy("context", "word", key).agg(F.count("*").alias("n"))
    u = unigrams.select("word", F.col("logp").alias("u"))
    b = bigrams.select("context", "word", F.col("logp").alias("b"))
    scored = counted.join(b, ["context", "word"], "left").join(u, "word", "left")
    return scored.groupBy(key).agg(F.sum(F.col("n") * F.coalesce("b", F.col("u") + backoff, F.lit(unknown))).alias("logp"))


def ctc_forward(logp: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log probability of a label sequence under frame-wise log probabilities (T x V): the forward recursion."""
    ext = [blank]
    for x in labels:
        ext += [x, blank]
    alpha = np.full(len(ext), -np.inf)
    alpha[0] = logp[0, blank]
    if len(ext) > 1:
        alpha[1] = logp[0, ext[1]]
    skip = np.array([i > 1 and ext[i] != blank and ext[i] != ext[i - 2] for i in range(len(ext))])
    for t in range(1, len(logp)):
        one = np.concatenate([[-np.inf], alpha[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], alpha[:-2]])[: len(ext)], -np.inf)
        alpha = np.logaddexp(np.logaddexp(alpha, one), two) + logp[t, ext]
    return float(np.logaddexp(alpha[-1], alpha[-2]) if len(ext) > 1 else alpha[-1])


def ctc_align(logp: np.ndarray, labels: list[int], blank: int = 0) -> list[tuple[int, int, float]]:
    """(first frame, last frame, mean log probability) of each label on the best path."""
    ext = [blank]
    for x in labels:
        ext += [x, blank]
    n, t_max = len(ext), len(logp)
    score, back = np.full((t_max, n), -np.inf), np.zeros((t_max, n), dtype=int)
    score[0, 0] = logp[0, blank]
    if n > 1:
        score[0, 1] = logp[0, ext[1]]
    for t in range(1, t_max):
        for i in range(n):
            best = [(score[t - 1, i], i)] + ([(score[t - 1, i - 1], i - 1)] if i else []) + ([(score[t - 1, i - 2], i - 2)] if i > 1 and ext[i] != blank and ext[i] != ext[i - 2] else [])
            s, j = max(best)
            score[t, i], back[t, i] = s + logp[t, ext[i]], j
    i = n - 1 if n < 2 or score[-1, n - 1] >= score[-1, n - 2] else n - 2
    path = [0] * t_max
    for t in range(t_max - 1, -1, -1):
        path[t] = i
        i = back[t, i]
    out = []
    for k in range(len(labels)):
        at = [t for t in range(t_max) if path[t] == 2 * k + 1]
        out.append((at[0], at[-1], float(np.mean([logp[t, labels[k]] for t in at]))) if at else (-1, -1, float("-inf")))
    return out


def ctc_scores(df: DataFrame, key: str, logp: str, labels: str, blank: int = 0) -> DataFrame:
    """(key, score, segments): the forward score and aligned segments of each row; null where an input is null or empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p, y in zip(b["k"], b["p"], b["y"]):
                if p is None or not len(p) or y is None:
                    out.append((k, None, None))
                    continue
                m, y = np.array([list(r) for r in p], dtype=float), [int(v) for v in y]
                segs = [{"first": a, "last": z, "confidence": c} for a, z, c in ctc_align(m, y, blank)]
                out.append((k, ctc_forward(m, y, blank), segs))
            yield pd.DataFrame(out, columns=[key, "score", "segments"])

    return df.select(F.col(key).alias("k"), F.col(logp).alias("p"), F.col(labels).alias("y")).mapInPandas(run, f"{key} {kind}, score double, segments array<struct<first:int,last:int,confidence:double>>")
