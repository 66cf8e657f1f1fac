"""Chunked processing of streams with explicit state per key.

Rows are (key, seq, value, is_final). Within a micro-batch they are taken in the order of
``seq``; batches are expected in that order too. A final row ends a key's stream: what is left
is emitted and the state cleared, so the same key may begin anew. Null values count as 0.

A key's part of one micro-batch is held as three plain columns, frame after frame, and stepped
as whole arrays; the source's limits on a micro-batch (files, rows, bytes a trigger) bound it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, np.ndarray, bool], list[tuple]]


def keyed_state(stream: DataFrame, key: str, seq: str, value: str, final: str, step: Step, start: Callable[[], dict], out: str, kind: str = "double") -> DataFrame:
    """Runs ``step(state, values, ends) -> rows`` over each key's values; ``out`` is the schema of the rows after the key.

    ``values`` are those up to a final row (``ends``) or to the end of the micro-batch. The
    state is a small dict, stored as JSON; ``start`` gives a new one. ``kind`` is the type of a
    value, a number or an array of numbers.
    """
    key_kind = stream.schema[key].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in out.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        inner = json.loads(state.get[0]) if state.exists else start()
        columns = [(f["seq"].to_numpy(), f["value"].to_numpy(), f["final"].to_numpy(dtype=bool)) for f in frames]
        at, values, ends = (np.concatenate(c) for c in zip(*columns))
        order = np.argsort(at, kind="stable")
        values, ends = values[order], ends[order]
        if kind == "double":
            values = np.nan_to_num(values.astype(float), nan=0.0)
        rows: list[tuple] = []
        begin = 0
        for stop in np.flatnonzero(ends).tolist():
            rows += step(inner, values[begin : stop + 1], True)
            inner, begin = start(), stop + 1
        if begin < len(values):
            rows += step(inner, values[begin:], False)
        if inner == start():
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(inner),))
        if rows:
            yield pd.DataFrame([(k[0], *r) for r in rows], columns=[key, *names])

    rows = stream.select(F.col(key).alias(key), F.col(seq).alias("seq"), F.col(value).cast(kind).alias("value"), F.coalesce(F.col(final), F.lit(False)).alias("final"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {key_kind}, {out}", "state string", "append", "NoTimeout")


def framed(stream: DataFrame, key: str, seq: str, value: str, final: str, win: int, hop: int) -> DataFrame:
    """(key, frame, values): frames of ``win`` every ``hop`` across micro-batches; at the end the rest is padded with zeros.

    The state holds at most ``win`` values; a hop beyond the frame counts as a whole frame.
    """
    hop = min(hop, win)

    def step(s: dict, v: np.ndarray, ends: bool) -> list[tuple]:
        x = np.concatenate([s["rest"], v])
        m = max((len(x) - win) // hop + 1, 0)
        rows = [(s["n"] + i, x[i * hop : i * hop + win].tolist()) for i in range(m)]
        s["fresh"] = len(x) - (m - 1) * hop - win if m else s["fresh"] + len(v)
        s["n"] += m
        s["rest"] = x[m * hop :].tolist()
        if ends and s["fresh"]:
            rows.append((s["n"], s["rest"] + [0.0] * (win - len(s["rest"]))))
        return rows

    return keyed_state(stream, key, seq, value, final, step, lambda: {"rest": [], "n": 0, "fresh": 0}, "frame bigint, values array<double>")


def segmented(stream: DataFrame, key: str, seq: str, value: str, final: str, threshold: float, least_blank: int, onset: int, offset: int) -> DataFrame:
    """(key, first, last): stretches of values above ``threshold``, closed by ``least_blank`` values below it.

    Positions count from 0; a stretch begins ``onset`` earlier and ends ``offset`` later than its
    active values, within what has been seen and after the stretch before.
    """

    def step(s: dict, v: np.ndarray, ends: bool) -> list[tuple]:
        active = s["at"] + np.flatnonzero(v > threshold)
        s["at"] += len(v)
        rows, newest = [], s["at"] - 1
        open_ = s["first"] is not None
        if open_:
            active = np.append(s["active"], active)
        if not len(active):
            return rows
        # A stretch ends where the next active value is more than the blanks away.
        cuts = np.flatnonzero(np.diff(active) > least_blank) + 1
        for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(active)])):
            first = s["first"] if open_ and i == 0 else max(int(active[a]) - onset, s["free"])
            last = int(active[b - 1])
            if b < len(active) or newest - last >= least_blank or ends:
                end = min(last + offset, last + least_blank, newest)
                rows.append((first, end))
                s["first"], s["free"] = None, end + 1
            else:
                s["first"], s["active"] = first, last
        return rows

    return keyed_state(stream, key, seq, value, final, step, lambda: {"at": 0, "first": None, "active": 0, "free": 0}, "first bigint, last bigint")


def accumulated(stream: DataFrame, key: str, seq: str, value: str, final: str, most: int) -> DataFrame:
    """(key, n, values): all values of a key when it ends; the state keeps the newest ``most``, ``n`` counts all."""

    def step(s: dict, v: np.ndarray, ends: bool) -> list[tuple]:
        s["v"] = (s["v"] + v[-most:].tolist())[-most:]
        s["n"] += len(v)
        return [(s["n"], s["v"])] if ends else []

    return keyed_state(stream, key, seq, value, final, step, lambda: {"v": [], "n": 0}, "n bigint, values array<double>")


def blocks(stream: DataFrame, key: str, seq: str, value: str, final: str, block: int, hop: int, ahead: int) -> DataFrame:
    """(key, block, first, end, total): block-synchronous steps: step k sees values up to block - ahead + hop k, at least one block back.

    ``total`` sums the values a step sees; the last step, at the end, sees what is left.
    """

    def step(s: dict, v: np.ndarray, ends: bool) -> list[tuple]:
        x = np.concatenate([s["v"], v])
        s["at"] += len(v)
        base, rows = s["at"] - len(x), []
        stops = list(range(block - ahead + hop * s["k"], s["at"] + 1, hop))
        if ends and (not stops or stops[-1] != s["at"]):
            stops.append(s["at"])
        for stop in stops:
            seen = x[max(0, stop - base - block) : stop - base]
            rows.append((s["k"], stop - len(seen), stop, float(seen.sum())))
            s["k"] += 1
        s["v"] = x[-block:].tolist()
        return rows

    return keyed_state(stream, key, seq, value, final, step, lambda: {"v": [], "at": 0, "k": 0}, "block bigint, first bigint, end bigint, total double")


def block_search(stream: DataFrame, key: str, seq: str, scores: str, final: str, block: int, hop: int, ahead: int, beam: int, end: int = 0) -> DataFrame:
    """(key, block, place, ended, tokens, score): the hypotheses after each step of a block-synchronous search.

    ``scores`` holds for each position the log scores of all tokens. Step k runs over the
    positions up to block - ahead + hop k. At a position each running hypothesis takes any
    token and the ``beam`` best go on; one that takes the token ``end`` is ended. Before more
    is known an end is not to be trusted: where the best hypothesis of a position ends within
    a step that is not the last, the step stops one position back and goes on from there with
    the next block. At the end of the stream what is left is searched, and ended and running
    hypotheses are given, the best first. Ties go to the earlier tokens.
    """

    def advance(running: list, ended: list, row: np.ndarray) -> tuple[list, list, bool]:
        made = [(h[0] + float(x), [*h[1], t]) for h in running for t, x in enumerate(row)]
        made.sort(key=lambda h: (-h[0], h[1]))
        best = made[:beam]
        return [h for h in best if h[1][-1] != end], ended + [h for h in best if h[1][-1] == end], bool(best) and best[0][1][-1] == end

    def step(s: dict, v: np.ndarray, ends: bool) -> list[tuple]:
        wait = s["wait"] + [[0.0 if x is None or x != x else float(x) for x in (r if r is not None else [])] for r in v]
        s["at"] += len(v)
        base, rows, done = s["at"] - len(wait), [], 0
        stops = list(range(block - ahead + hop * s["k"], s["at"] + 1, hop))
        if ends and (not stops or stops[-1] != s["at"]):
            stops.append(s["at"])
        for stop in stops:
            last = ends and stop == s["at"]
            while base + done < stop and s["running"]:
                running, ended, by_end = advance(s["running"], s["ended"], np.array(wait[done]))
                if by_end and not last:
                    break
                s["running"], s["ended"], done = running, ended, done + 1
            listed = [(False, h) for h in s["running"]] + ([(True, h) for h in s["ended"]] if last else [])
            listed.sort(key=lambda x: (-x[1][0], x[1][1]))
            rows += [(s["k"], base + done, e, list(h[1]), round(h[0], 9)) for e, h in listed[:beam]]
            s["k"] += 1
        s["wait"] = wait[done:] if s["running"] else []
        return rows

    out = "block bigint, place bigint, ended boolean, tokens array<int>, score double"
    return keyed_state(stream, key, seq, scores, final, step, lambda: {"wait": [], "at": 0, "k": 0, "running": [[0.0, []]], "ended": []}, out, "array<double>")
