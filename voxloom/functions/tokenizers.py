"""Tokenizers behind one protocol: text to tokens and back, as Columns.

``build_tokenizer`` knows the kinds by name. Characters, words and phonemes parted by blanks are
plain expressions; subwords run a public model in Arrow batches, loaded once a worker from a
path that every executor can read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxloom.functions import text as T


class Tokenizer(Protocol):
    def tokens(self, text: Column) -> Column:
        """Array of tokens; null for a null text."""

    def text(self, tokens: Column) -> Column:
        """The text of an array of tokens."""


@dataclass(frozen=True)
class Chars:
    """Characters; symbols stay whole, a blank becomes ``space``."""

    symbols: tuple[str, ...] = ()
    space: str = "<space>"

    def tokens(self, text: Column) -> Column:
        return T.char_tokens(text, list(self.symbols), self.space)

    def text(self, tokens: Column) -> Column:
        return T.tokens_to_text(tokens, self.space)


@dataclass(frozen=True)
class Words:
    """White-space words, or the fields of a delimiter (empty ones kept)."""

    delimiter: str | None = None

    def tokens(self, text: Column) -> Column:
        return T.words(text) if self.delimiter is None else T.delimited(text, self.delimiter)

    def text(self, tokens: Column) -> Column:
        return F.array_join(tokens, " " if self.delimiter is None else self.delimiter)


@dataclass(frozen=True)
class Phonemes:
    """Phonemes that the text already holds, parted by single blanks; blanks beyond give empty tokens.

    Conversion of letters to phonemes needs a model or program of its own and is not part of it.
    """

    g2p: str | None = None

    def __post_init__(self) -> None:
        if self.g2p is not None:
            raise ValueError(f"no conversion to phonemes is named {self.g2p!r}")

    def tokens(self, text: Column) -> Column:
        return F.when(text == "", F.array(F.lit(""))).otherwise(F.split(text, " ", -1))

    def text(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")


_models: dict[str, object] = {}


def _model(path: str):
    """A model of a public library, by the ending of its path; kept by the worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import tokenizers

            made = tokenizers.Tokenizer.from_file(path)
            made.encode_special_tokens = True
            _models[path] = made
    return _models[path]


@dataclass(frozen=True)
class Subwords:
    """Pieces of a public model: a SentencePiece file (``.model``) or a tokenizer in JSON."""

    path: str

    def tokens(self, text: Column) -> Column:
        path = self.path

        @pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            m, held = _model(path), s.notna()
            some = s[held].tolist()
            made = m.encode(some, out_type=str) if path.endswith(".model") else [e.tokens for e in m.encode_batch(some, add_special_tokens=False)]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[held] = pd.Series(made, index=s.index[held], dtype=object)
            return out

        return run(text)

    def text(self, tokens: Column) -> Column:
        path = self.path

        @pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            m = _model(path)
            if path.endswith(".model"):
                return s.map(lambda t: None if t is None else m.decode_pieces(list(t)))
            return s.map(lambda t: None if t is None else m.decode([m.token_to_id(x) for x in t], skip_special_tokens=False))

        return run(tokens)


TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {"char": Chars, "word": Words, "phn": Phonemes, "bpe": Subwords, "hugging_face": Subwords}


def build_tokenizer(kind: str, **options) -> Tokenizer:
    """A tokenizer by the name of its kind; unknown kinds and options raise."""
    if kind not in TOKENIZERS:
        raise ValueError(f"no tokenizer is named {kind!r}")
    return TOKENIZERS[kind](**options)
