"""Train, validation and test splits that keep related records together.

Method: grouped iterative stratification. Entities that share a record or an origin form
components (alternating star contraction, all rows stay on the executors). Each component's
records are aggregated to its label vector. Whole components are placed by their own vectors:
the rarest outstanding label first, its largest components first, each into the split that
needs that label most, relative to its share and as far as the component fits there; every
placing lowers the needs for all labels of the component.

Placing runs in stages from large components to small ones. The few components above 1/LARGE
of all records are placed in one block; then follow sizes STAGE times smaller at each stage,
in blocks of components with the same rarest label, side by side on the executors. A block's
needs are its part of what the splits still need after the stages before, so what large
components leave uneven the smaller ones even out. A block holds about BLOCK label counts
however many components there are, and no number of labels or components is capped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import cut_table, cut_table_at, drop_table

#: What stands for no speaker.
PLACEHOLDERS = ("", "<na>", "unk")
#: Prefix of speed-perturbed copies: sp<factor>-, once or more.
COPY_PREFIX = r"^(sp[0-9]+(\.[0-9]+)?-)+"
#: Components of more than 1/LARGE of all records make the first stage; each further stage takes
#: sizes down to 1/STAGE of the last one's. BLOCK is the number of label counts in a block.
LARGE, STAGE, BLOCK = 2_000, 32, 100_000


def speaker_name(c: Column) -> Column:
    """Trimmed of blanks and in lower case; null where no speaker is named."""
    name = F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.when(~name.isin(*PLACEHOLDERS), name)


def without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, COPY_PREFIX, "")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of (a, b), root = the least node of each.

    Large-star and small-star contraction: the number of rounds grows with the logarithm of
    the number of nodes, a round moves each edge twice, and no node's neighbours are gathered
    in one task: each star needs only the least neighbour, which is aggregated map-side.
    """
    spark = edges.sparkSession
    edges, path = cut_table_at(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges, new_path = cut_table_at(small)
        drop_table(spark, path)
        path, last = new_path, mark
        # Ended when the edges are stars whose centres are their least nodes: no round changes
        # them. The edges are a set, so their number and two sums of hashes tell sets apart.
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("bigint"))).first())
        if mark == last or not mark[0]:
            break
    else:
        raise RuntimeError("the components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named_speakers(df: DataFrame, utt: str = "uttid", speaker: str = "spkid") -> DataFrame:
    """(u, s): each utterance with each speaker that it names, once; written, as it is read several times."""
    return cut_table(df.select(F.col(utt).alias("u"), speaker_name(F.col(speaker)).alias("s")).filter("s is not null").distinct())


def speaker_ties(named: DataFrame) -> DataFrame:
    """(a, b) edges that tie speakers: a shared utterance, or being copies of one speaker.

    A copy is tied to the name without its prefixes, whether or not that name is listed. An
    utterance ties all its speakers to the least of them, so one with many gives a star.
    """
    least = named.filter("u is not null").groupBy("u").agg(F.min("s").alias("a"), F.max("s").alias("z")).filter("a < z").select("u", "a")
    shared = named.join(least, "u").filter("s <> a").select("a", F.col("s").alias("b"))
    copies = named.select("s").distinct().select(without_prefix(F.col("s")).alias("a"), F.col("s").alias("b")).filter("a <> b")
    return shared.union(copies).distinct()


def tied_speakers(df: DataFrame, utt: str = "uttid", speaker: str = "spkid") -> DataFrame:
    """(speaker, component) of every listed speaker; one tied to no other is its own component."""
    named = named_speakers(df, utt, speaker)
    comp = components(speaker_ties(named))
    joined = named.select(F.col("s").alias("speaker")).distinct().join(comp.withColumnRenamed("node", "speaker"), "speaker", "left")
    return joined.select("speaker", F.coalesce("root", "speaker").alias("component"))


def place_block(vectors: dict[str, dict[str, int]], need: dict[str, list[float]], room: list[float], shares: list[float]) -> dict[str, int]:
    """Iterative stratification of the components of one block: the number of each one's split.

    ``vectors``: label counts of each component; ``need``: what each split needs of a label;
    ``room``: what it needs of records. A label of which no component fits a split's need
    cannot be told apart by it; such components go where most room is left.
    """
    need = {label: list(n) for label, n in need.items()}
    room = list(room)
    size = {c: sum(v.values()) for c, v in vectors.items()}
    holders, outstanding = defaultdict(list), defaultdict(int)
    for c, v in vectors.items():
        for label, n in v.items():
            holders[label].append(c)
            outstanding[label] += n
    total = dict(outstanding)
    usable = {label: n * min(shares) >= 1 for label, n in outstanding.items()}
    heap = [(n, label) for label, n in outstanding.items()]
    heapq.heapify(heap)
    out: dict[str, int] = {}
    splits = range(len(shares))
    while heap:
        n, label = heapq.heappop(heap)
        if n != outstanding[label]:
            if outstanding[label]:
                heapq.heappush(heap, (outstanding[label], label))
            continue
        for c in sorted((c for c in holders[label] if c not in out), key=lambda c: (-vectors[c][label], -size[c], c)):
            have, n = (need[label], vectors[c][label]) if usable[label] else (room, size[c])
            fits = [s for s in splits if have[s] >= n and room[s] >= size[c]]
            # The most needed as a part of the split's share, so that components of all sizes
            # go to all splits; where it fits in none, the greatest need. Splits less than this
            # component apart are told apart by the needs for all its labels.
            if fits:
                most = max(have[s] / shares[s] for s in fits) - n / min(shares)
                near = [s for s in fits if have[s] / shares[s] >= most]
                best = max(near, key=lambda s: (sum(k / total[x] ** 2 * need[x][s] for x, k in vectors[c].items()) / shares[s], room[s] / shares[s], shares[s], -s)) if len(near) > 1 else near[0]
            else:
                best = max(splits, key=lambda s: (have[s], room[s], shares[s], -s))
            out[c] = best
            room[best] -= size[c]
            for other, k in vectors[c].items():
                need[other][best] -= k
                outstanding[other] -= k
    return out


def _whole_rows(records: DataFrame) -> DataFrame:
    """(record, tied, component, label) without nulls in the last two."""
    own = F.concat(F.lit("record:"), F.col("record").cast("string"))
    return records.select("record", F.col("component").alias("tied"), F.coalesce("component", own).alias("component"), F.coalesce("label", F.lit("none")).alias("label"))


def _cells(rows: DataFrame) -> DataFrame:
    """The label vector of each component, in rows."""
    return rows.groupBy("component", "label").agg(F.count("*").alias("n"))


def grouped_splits(records: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(record, component, split) for rows (record, component, label), one row per record.

    Every component lies in one split. A record with a null component is a component of its
    own (its ``component`` is null in the result too); a null label counts as the label
    ``none``. An empty table gives no rows.
    """
    rows = cut_table(_whole_rows(records))
    placed = place_components(_cells(rows), shares)
    return rows.join(placed, "component").select("record", F.col("tied").alias("component"), "split")


def _placer(whole: list[float], shares: list[float]):
    """Places the components of one block, given as rows of label counts."""

    def place(f: pd.DataFrame) -> pd.DataFrame:
        vectors: dict[str, dict[str, int]] = defaultdict(dict)
        for c, label, n in zip(f["component"], f["label"], f["n"].tolist()):
            vectors[c][label] = n
        label = f.groupby("label", sort=False).agg(n=("n", "sum"), ratio=("ratio", "first"))
        need = {x: [n * float(r) for r in ratio] for x, n, ratio in zip(label.index, label["n"].tolist(), label["ratio"])}
        size = float(f["n"].sum())
        split = place_block(vectors, need, [size * w for w in whole], shares)
        out = f[["component", "label", "n"]].copy()
        out["place"] = [split[c] for c in f["component"]]
        out["head"] = f["label"] == f["rarest"]
        return out

    return place


def place_components(cells: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(component, split) for label vectors in rows (component, label, n)."""
    names, parts = list(shares), list(shares.values())
    cells = cut_table(cells)
    totals = cut_table(cells.groupBy("label").agg(F.sum("n").alias("of_label")))
    # The vectors stay in rows, each with its component's size, number of labels and rarest label.
    whole_component = Window.partitionBy("component")
    least = F.min(F.struct("of_label", "label")).over(whole_component)
    cells = cut_table(cells.join(totals, "label").select("component", "label", "n", F.sum("n").over(whole_component).alias("size"), F.count("*").over(whole_component).alias("entries"), least["label"].alias("rarest")))
    first = cells.agg(F.sum("n").alias("n"), F.max("size").alias("most")).first()
    empty = cells.sparkSession.createDataFrame([], "component string, split string")
    if not first["n"]:
        return empty
    bounds, low = [], first["n"] / LARGE
    while low >= 1:
        bounds.append(low)
        low /= STAGE
    done: list[DataFrame] = []  # (component, label, n, place, head) of the stages before
    high = None
    for low in [*bounds, 0.0]:
        stage = cells.filter((F.col("size") > low) & (F.col("size") <= high if high else F.lit(True)))
        high = low
        if low >= first["most"]:
            continue
        placed = done[0] if done else None
        for d in done[1:]:
            placed = placed.union(d)
        # What each split still needs of a label, as a share of what is still to be placed of it.
        of = lambda s: F.sum(F.when(F.col("place") == s, F.col("n")).otherwise(0))
        if placed is None:
            ratios = totals.select("label", F.array(*[F.lit(float(p)) for p in parts]).alias("ratio"))
            whole = [float(p) for p in parts]
        else:
            gone = placed.groupBy("label").agg(*[of(s).alias(f"p{s}") for s in range(len(parts))])
            rest = totals.join(gone, "label", "left").fillna(0, [f"p{s}" for s in range(len(parts))])
            left = F.col("of_label") - sum((F.col(f"p{s}") for s in range(len(parts))), F.lit(0))
            ratios = rest.select("label", F.array(*[(F.lit(float(p)) * F.col("of_label") - F.col(f"p{s}")) / F.greatest(left, F.lit(1)) for s, p in enumerate(parts)]).alias("ratio"))
            sums = placed.agg(*[of(s) for s in range(len(parts))]).first()
            remaining = max(first["n"] - sum(sums), 1)
            whole = [(p * first["n"] - g) / remaining for p, g in zip(parts, sums)]
        # Blocks: one for the first stage; then by the rarest label, labels with much in several
        # blocks, those with little together in one.
        if bounds and low != bounds[0]:
            per = stage.filter(F.col("label") == F.col("rarest")).groupBy("rarest").agg(F.sum("entries").alias("e"))
            few = per.filter(F.col("e") < BLOCK).agg(F.sum("e").alias("e")).first()["e"] or 0
            shared = max(1, -(-int(few) // BLOCK))
            blocks = per.select("rarest", F.ceil(F.col("e") / BLOCK).alias("salts"), (F.col("e") < BLOCK).alias("few"))
            block = F.when(F.col("few"), F.concat(F.lit("few:"), F.pmod(F.xxhash64("rarest"), F.lit(shared)).cast("string"))).otherwise(F.concat(F.lit("own:"), F.pmod(F.xxhash64("component"), F.col("salts")).cast("string"), F.lit(":"), F.col("rarest")))
            stage = stage.join(blocks, "rarest").withColumn("block", block)
        else:
            stage = stage.withColumn("block", F.lit("large"))

        entries = stage.join(ratios, "label").select("block", "component", "label", "n", "rarest", "ratio")
        done.append(cut_table(entries.groupBy("block").applyInPandas(_placer(whole, parts), "component string, label string, n bigint, place int, head boolean")))
    out = empty
    for d in done:
        out = out.union(d.filter("head").select("component", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("place") + 1).alias("split")))
    return out


def labelled_utterances(df: DataFrame, labels: DataFrame, tied: DataFrame, utt: str = "uttid", speaker: str = "spkid") -> DataFrame:
    """(record, component, label) of every utterance of a speaker list, each once.

    ``tied`` are the rows of ``tied_speakers``. An utterance without a named speaker goes with
    the speaker of the utterance it is a copy of, or else with its copies.
    """
    named = df.select(F.col(utt).alias("u"), speaker_name(F.col(speaker)).alias("speaker")).filter("u is not null")
    by_utt = named.groupBy("u").agg(F.min("speaker").alias("speaker"))
    utts = cut_table(by_utt.join(tied, "speaker", "left").select("u", without_prefix(F.col("u")).alias("base"), "component"))
    origin = utts.filter("component is not null").groupBy("base").agg(F.min("component").alias("origin"))
    loose = utts.filter("component is null").join(origin, "base", "left").select("u", F.coalesce("origin", F.concat(F.lit("utt:"), F.col("base"))).alias("component"))
    every = loose.union(utts.filter("component is not null").select("u", "component"))
    return every.join(labels.select(F.col(labels.columns[0]).alias("u"), F.col(labels.columns[1]).alias("label")), "u", "left").withColumnRenamed("u", "record")


def speaker_splits(df: DataFrame, labels: DataFrame, shares: dict[str, float], utt: str = "uttid", speaker: str = "spkid") -> DataFrame:
    """(utterance, component, split) of every utterance of a speaker list, each once.

    No speaker, nor any speaker tied to it, lies in two splits. ``labels`` has (utterance,
    label), one row per utterance. Null utterances are left out.
    """
    rows = labelled_utterances(df, labels, tied_speakers(df, utt, speaker), utt, speaker)
    return grouped_splits(rows, shares).select(F.col("record").alias(utt), "component", "split")


def speaker_places(df: DataFrame, labels: DataFrame, shares: dict[str, float], utt: str = "uttid", speaker: str = "spkid") -> DataFrame:
    """(speaker, component, split) of every listed speaker; split is null for one without utterances."""
    tied = cut_table(tied_speakers(df, utt, speaker))
    placed = place_components(_cells(_whole_rows(labelled_utterances(df, labels, tied, utt, speaker))), shares)
    return tied.join(placed, "component", "left").select("speaker", "component", "split")
