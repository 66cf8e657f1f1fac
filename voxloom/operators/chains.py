"""Chains of named sample functions, collation, scorers and tasks: what a training set-up configures.

A stage is a function from DataFrame to DataFrame, registered under a name with the options it
takes; a chain is a list of names with options. Nothing is imported by a name given in a
configuration: what is not registered raises, and so does an option that a stage does not take,
before anything runs. Stages are declarative, so Spark plans a chain as one query.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions.tokenizers import build_tokenizer
from voxloom.operators import arrays as M
from voxloom.operators.relations import check_columns, strict_join
from voxloom.operators.scoring import beam_step
from voxloom.operators.stats import row_normalise

STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(name: str):
    """Registers a function (df, **options) -> DataFrame. An option ``key`` is given by the chain."""

    def keep(f: Callable[..., DataFrame]):
        if name in STAGES:
            raise ValueError(f"a stage is already named {name!r}")
        STAGES[name] = f
        return f

    return keep


@dataclass(frozen=True)
class Chain:
    """Stages one after another: ``[{"type": name, option: value, ...}, ...]``."""

    process: tuple[dict, ...]
    key: str | None = None

    def __post_init__(self) -> None:
        for spec in self.process:
            if (name := spec.get("type")) not in STAGES:
                raise ValueError(f"no stage is named {name!r}")
            takes = inspect.signature(STAGES[name]).parameters
            given = {k for k in spec if k != "type"}
            if unknown := given - set(takes):
                raise TypeError(f"{name} takes no option {sorted(unknown)}")
            needed = {n for n, p in takes.items() if p.default is p.empty} - {"df"} - ({"key"} if self.key else set())
            if missing := needed - given:
                raise TypeError(f"{name} needs the options {sorted(missing)}")

    @classmethod
    def of(cls, config: dict, key: str | None = None) -> Chain:
        """From ``{"mode": "sequential", "process": [...]}``; other modes raise."""
        if config.get("mode", "sequential") != "sequential":
            raise NotImplementedError(f"mode {config['mode']!r}")
        return cls(tuple(config["process"]), key)

    def __call__(self, df: DataFrame) -> DataFrame:
        for spec in self.process:
            f = STAGES[spec["type"]]
            options = {k: v for k, v in spec.items() if k != "type"}
            if self.key and "key" in inspect.signature(f).parameters:
                options.setdefault("key", self.key)
            df = f(df, **options)
        return df


# Stages on texts


@stage("clean")
def _clean(df: DataFrame, cleaners: list, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.clean(F.col(text), list(cleaners)))


@stage("tokens")
def _tokens(df: DataFrame, kind: str, text: str = "text", out: str = "tokens", options: dict | None = None) -> DataFrame:
    return df.withColumn(out, build_tokenizer(kind, **(options or {})).tokens(F.col(text)))


@stage("ids")
def _ids(df: DataFrame, vocabulary: list, tokens: str = "tokens", out: str = "ids", unknown: int = 1) -> DataFrame:
    """Places of tokens in a list of at most a few hundred entries; larger ones go through ``vocabulary.token_ids``."""
    listed = F.array(*[F.lit(v) for v in vocabulary])

    def place(t: Column) -> Column:
        p = F.array_position(listed, t)
        return F.when(p > 0, p - 1).otherwise(F.lit(unknown).cast("bigint"))

    return df.withColumn(out, F.transform(tokens, place))


@stage("text_filter")
def _text_filter(df: DataFrame, words: list, exclude: bool = True, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.filter_words(F.col(text), list(words), exclude))


@stage("length_filter")
def _length_filter(df: DataFrame, column: str, least: int = 0, most: int | None = None) -> DataFrame:
    n = F.size(column)
    return df.filter((n >= least) & (F.lit(True) if most is None else n <= most))


# Stages on arrays


@stage("gain")
def _gain(df: DataFrame, db: float, x: str = "x") -> DataFrame:
    return df.withColumn(x, M.gain_db(F.col(x), F.lit(float(db))))


@stage("peak")
def _peak(df: DataFrame, target: float = 1.0, x: str = "x") -> DataFrame:
    return df.withColumn(x, M.peak_normalised(F.col(x), target))


@stage("utterance_mvn")
def _mvn(df: DataFrame, norm_vars: bool = True, x: str = "x") -> DataFrame:
    return df.withColumn(x, row_normalise(F.col(x), norm_vars))


@stage("noise")
def _noise(df: DataFrame, noise: str, snr_db: float, x: str = "x") -> DataFrame:
    return df.withColumn(x, M.with_noise(F.col(x), F.col(noise), F.lit(float(snr_db))))


@stage("span_mask")
def _span(df: DataFrame, start: int, width: int, value: float = 0.0, x: str = "x") -> DataFrame:
    return df.withColumn(x, M.span_mask(F.col(x), F.lit(start), F.lit(width), value))


@stage("seeded_masks")
def _masks(df: DataFrame, key: str, n: int, widest: int, seed: int = 0, x: str = "x") -> DataFrame:
    return M.seeded_spans(df, x, key, n, widest, seed)


@stage("speed")
def _speed(df: DataFrame, key: str, factor: float, x: str = "x") -> DataFrame:
    return M.speed_perturbed(df, key, x, factor)


# Collation


def collated(df: DataFrame, batch: str, key: str, columns: dict[str, float]) -> DataFrame:
    """(batch, keys, each column, its lengths): one row a mini-batch, samples in key order.

    ``columns`` names the array columns and what pads each to the longest of the batch. A
    batch is bounded by what the batches were planned for. Null arrays count as empty; a
    column ``<name>_lengths`` in the input raises, as the name is taken.
    """
    if taken := [f"{c}_lengths" for c in columns if f"{c}_lengths" in df.columns]:
        raise ValueError(f"columns {taken} are reserved")
    # Null keys come first; equal keys are ordered by their arrays.
    filled = [F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) for c in columns]
    rows = df.select(batch, F.struct(key, *filled).alias("__s")).groupBy(batch).agg(F.sort_array(F.collect_list("__s")).alias("__s"))
    out = rows.select(batch, F.col(f"__s.{key}").alias("keys"), *[F.col(f"__s.{c}").alias(c) for c in columns])
    def filled(c: str, value: float) -> Column:
        kind = df.schema[c].dataType.elementType
        pad = lambda x: F.concat(x, F.array_repeat(F.lit(value).cast(kind), F.array_max(F.col(f"{c}_lengths")) - F.size(x)))
        return F.transform(c, pad)

    out = out.withColumns({f"{c}_lengths": F.transform(c, lambda x: F.size(x)) for c in columns})
    return out.withColumns({c: filled(c, value) for c, value in columns.items()})


# Scorers


@dataclass(frozen=True)
class Scorer:
    """A named score of an extension, as a Column of the candidate rows, with its weight.

    A partial scorer is used only for the extensions that the others' pre-selection leaves.
    """

    name: str
    score: Callable[[], Column]
    weight: float = 1.0
    partial: bool = False


def scored_step(df: DataFrame, key: str, hyp: str, prev: str, scorers: list[Scorer], k: int, pre: int | None = None) -> DataFrame:
    """One step of a beam search with scorers: the ``k`` best extensions of each key.

    With partial scorers, ``pre`` extensions of each hypothesis are selected by the full ones.
    """
    full, partial = [s for s in scorers if not s.partial and s.weight], [s for s in scorers if s.partial and s.weight]
    if partial and (pre is None or not full):
        raise ValueError("partial scorers need a pre-selection by full ones")
    rows = df.withColumns({s.name: s.score() for s in full})
    if partial:  # scored only after the selection
        best = sum((F.col(s.name) * s.weight for s in full), F.lit(0.0))
        w = Window.partitionBy(key, hyp).orderBy(F.desc(best), *[F.col(c) for c in df.columns])
        rows = rows.withColumn("__pre", F.row_number().over(w)).filter(F.col("__pre") <= pre).drop("__pre").withColumns({s.name: s.score() for s in partial})
    return beam_step(rows, key, hyp, prev, {s.name: s.weight for s in [*full, *partial]}, k)


# Tasks


@dataclass(frozen=True)
class Task:
    """What a task asks of its data: columns, the chain of samples, the batches and their collation."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    preprocess: Chain | None = None
    batches: Callable[[DataFrame], DataFrame] | None = None
    collate: dict[str, float] = field(default_factory=dict)
    key: str = "uttid"

    def samples(self, relations: list[DataFrame], check: bool = True) -> DataFrame:
        """The relations joined by key and preprocessed; missing and unknown columns raise."""
        df = check_columns(strict_join(relations, self.key, check=check), [self.key, *self.required], list(self.optional))
        return self.preprocess(df) if self.preprocess else df

    def iterate(self, relations: list[DataFrame], check: bool = True) -> DataFrame:
        """One row a mini-batch, in the order of the batches' numbers."""
        if self.batches is None or not self.collate:
            raise ValueError("the task has no batches or nothing to collate")
        return collated(self.batches(self.samples(relations, check)), "batch", self.key, self.collate)
