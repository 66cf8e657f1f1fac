"""Text functions on Columns: fields, tokens, vocabularies' building blocks, cleaning, JSON.

Null texts give null results unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that part words: those of Python's and Java's plain white space.
BREAKS = "[ \\t\\n\\r]+"


def words(c: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(c, BREAKS), lambda t: t != "")


def delimited(c: Column, delimiter: str) -> Column:
    """Tokens between an explicit delimiter; empty ones are kept."""
    return F.split(c, re.escape(delimiter), -1)


def field_slice(c: Column, first: int, last: int | None = None) -> Column:
    """Fields first..last of a line (1-based, both included), joined by a blank."""
    w = words(c)
    n = F.lit(last - first + 1) if last is not None else F.greatest(F.size(w), F.lit(1))
    return F.array_join(F.slice(w, first, n), " ")


def char_tokens(c: Column, symbols: list[str] | None = None, space: str = "<space>") -> Column:
    """Characters; the given symbols stay whole (the longest first), a blank becomes ``space``."""
    alternatives = "|".join(re.escape(s) for s in sorted(symbols or [], key=len, reverse=True))
    pattern = f"(?s)({alternatives}|.)" if alternatives else "(?s)(.)"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda t: F.when(t == " ", space).otherwise(t))


def tokens_to_text(tokens: Column, space: str = "<space>") -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t == space, " ").otherwise(t)), "")


def grouped_chars(c: Column, n: int, symbols: list[str] | None = None, space: str = "<space>") -> Column:
    """Character tokens of a text joined n by n; the last group may be shorter."""
    one = "|".join([*(re.escape(s) for s in sorted(symbols or [], key=len, reverse=True)), "."])
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s)((?:{one}){{1,{n}}})"), F.lit(1)), lambda t: F.replace(t, F.lit(" "), F.lit(space)))


def filter_words(c: Column, vocabulary: list[str], exclude: bool, unknown: str = "<UNK>") -> Column:
    """Words in (``exclude``) or not in the vocabulary become empty, or ``unknown``; positions are kept."""
    listed = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    replace = (lambda w: F.when(F.array_contains(listed, w), "").otherwise(w)) if exclude else (lambda w: F.when(F.array_contains(listed, w), w).otherwise(unknown))
    return F.array_join(F.transform(words(c), replace), " ")


#: Names of digits and of Latin letters in Hangul, 0-9 and A-Z in order.
HANGUL_DIGITS = "영 일 이 삼 사 오 육 칠 팔 구".split()
HANGUL_LETTERS = "에이 비 씨 디 이 에프 지 에이치 아이 제이 케이 엘 엠 엔 오 피 큐 알 에스 티 유 브이 더블유 엑스 와이 지".split()


def korean_clean(c: Column) -> Column:
    """Trimmed, digits and the letters A-Z and a-z spelled in Hangul; all else stays as it is."""
    names = {str(i): n for i, n in enumerate(HANGUL_DIGITS)} | {chr(65 + i): n for i, n in enumerate(HANGUL_LETTERS)}
    names |= {k.lower(): n for k, n in names.items()}
    spelled = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    chars = F.regexp_extract_all(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(chars, lambda x: F.coalesce(F.try_element_at(spelled, x), x)), "")


# Abbreviations and signs spelled out in English texts.
ABBREVIATIONS = {
    "mrs": "misess", "mr": "mister", "dr": "doctor", "st": "saint", "co": "company", "jr": "junior", "maj": "major", "gen": "general", "drs": "doctors", "rev": "reverend",
    "lt": "lieutenant", "hon": "honorable", "sgt": "sergeant", "capt": "captain", "esq": "esquire", "ltd": "limited", "col": "colonel", "ft": "fort",
}
SIGNS = {";": ",", ":": ",", "-": " ", "&": "and"}


def english_clean(c: Column) -> Column:
    """English texts for speech: no accents, abbreviations, signs and numbers spelled out, no brackets and quotes, upper case.

    Whole numbers below 10**12, decimals and ordinals are read as words in Arrow batches; all
    else are expressions.
    """
    c = F.lower(F.regexp_replace(_decomposed(c), r"\p{M}", ""))
    c = _numbers_read(c)
    for short, long in ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\.", long)
    for sign, name in SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(name))
    c = F.regexp_replace(c, r"[()\[\]<>\"]+", "")
    return F.trim(F.upper(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _numbers_read(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else read_numbers(t))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
_NUMBER = re.compile(r"(?<![\w.])(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(st|nd|rd|th)?(?!\w)")


def number_words(n: int) -> str:
    """A whole number below 10**12 in English words."""
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return f"{number_words(n // size)} {name}" + (f" {number_words(rest)}" if rest else "")
    if n < 20:
        return _ONES[n]
    return _TENS[n // 10 - 2] + (f" {_ONES[n % 10]}" if n % 10 else "")


def read_numbers(text: str) -> str:
    """Numbers of a text in words; those of more than twelve digits are read digit by digit."""

    def read(m: re.Match) -> str:
        digits = m[1].replace(",", "")
        words = number_words(int(digits)) if len(digits) <= 12 else " ".join(_ONES[int(d)] for d in digits)
        if m[2]:
            words += " point " + " ".join(_ONES[int(d)] for d in m[2][1:])
        if m[3]:
            head, _, last = words.rpartition(" ")
            last = _ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
            words = f"{head} {last}".strip()
        return words

    return _NUMBER.sub(read, text)


def japanese_clean(c: Column) -> Column:
    """Dashes, waves and quotes of Japanese texts made one each, then compatibility forms composed."""
    c = F.translate(c, "〜～﹣－—―━─’”‐˗֊‑‒–⁃⁻₋−", "ーーーーーーーー'\"----------")
    return _composed(F.replace(c, F.lit("“"), F.lit("``")))


CLEANERS = {
    "tacotron": english_clean,
    "jaconv": japanese_clean,
    "upper": F.upper,
    "lower": F.lower,
    "whitespace": lambda c: F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " ")),
    "korean_cleaner": korean_clean,
    "no_tags": lambda c: F.regexp_replace(c, r"\[[^\]]*\]|<[^>]*>", ""),
}


def clean(c: Column, cleaners: list[str]) -> Column:
    """A chain of named cleaners; an unknown name raises."""
    for name in cleaners:
        if name not in CLEANERS:
            raise ValueError(f"no cleaner is named {name!r}")
        c = CLEANERS[name](c)
    return c


def normalise_trn(c: Column) -> Column:
    """Upper case, single blanks, double opening parentheses made one."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), " +", " "), r"\(\(", "(")


def strip_marks(c: Column) -> Column:
    """Without parentheses, word-piece marks and repeated or outer blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[()▁]", ""), " +", " "))


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")


def key_fields(c: Column) -> Column:
    """Parts of a key between - and _."""
    return F.split(c, "[-_]", -1)


def hundredths(c: Column) -> Column:
    """Digits that count hundredths, as seconds with two decimals."""
    n = c.cast("bigint")
    return F.format_string("%d.%02d", F.floor(n / 100), n % 100)


def parse_shape(c: Column) -> Column:
    """``[3, 5]`` or ``3,5`` as whole numbers; anything else fails."""
    return F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.cast("bigint"))


def bigram_shift(tokens: Column, begin: str = "<sos>", end: str = "<eos>") -> Column:
    """struct(input, target): the tokens after ``begin`` and before ``end``."""
    return F.struct(F.concat(F.array(F.lit(begin)), tokens).alias("input"), F.concat(tokens, F.array(F.lit(end))).alias("target"))


def collapse_repeats(tokens: Column, drop: list) -> Column:
    """Without immediate repeats, then without the dropped values."""
    before = F.concat(F.array(F.lit(None).cast("string")), tokens)
    pairs = F.zip_with(tokens, before, lambda v, p: F.when(~v.eqNullSafe(p) & ~v.isin(*drop), v))
    return F.array_compact(pairs)


def ngrams(tokens: Column, n: int) -> Column:
    """Joined n-grams in order; none if there are fewer tokens. ``tokens`` should be a stored column."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))).when(tokens.isNotNull(), F.array().cast("array<string>"))
