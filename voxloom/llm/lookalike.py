"""One consistent form for texts that look alike but hold different characters.

Method: every text is mapped letter by letter to the script of its word (width forms and font
variants folded, blanks unified, invisible characters dropped, look-alike letters replaced,
accents composed). The mapped values are grouped under the accent-sensitive Unicode collation
in SQL, which holds canonically equal strings together; each class gets one member as its
form, and the form is joined back. Two ASCII values are equal under the collation only if
they are the same, so those are grouped only that equal a value with other characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut_table

# Letters of other scripts that imitate Latin ones, in pairs "other Latin".
_CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw"
_CYRILLIC_MORE = "ӀI ӏl"
_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi κk νv οo ρp υu"
_ARMENIAN = "ՕO ՏS ԼL ՍU հh ոn սu օo ցg զq յj"
_CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"
# Phonetic letters in the place of plain ones, in words of otherwise plain letters.
_PHONETIC = {"ɑ": "a", "ɡ": "g", "ı": "i", "ꞓ": "c"}
# Scripts of the languages met in speech corpora; others go by the text itself.
_SCRIPT_OF = {"en": "Latin", "es": "Latin", "de": "Latin", "fr": "Latin", "yo": "Latin", "ru": "Cyrillic", "el": "Greek", "ja": "Kana"}
# Latin letters that no ordinary letter of the other script looks like.
_NOT_RUSSIAN = set("SIJQWsijhdqw")

_PHONETIC_TABLE = {ord(a): b for a, b in _PHONETIC.items()}
_TO_LATIN = {p[0]: p[1] for p in f"{_CYRILLIC} {_CYRILLIC_MORE} {_GREEK} {_ARMENIAN} {_CHEROKEE}".split()}


def _into(pairs: str, without: set[str] = frozenset()) -> dict[str, str]:
    own = {p[1]: p[0] for p in pairs.split() if p[1] not in without}
    return own | {a: own[b] for a, b in _TO_LATIN.items() if b in own and a not in own.values()}


_INTO = {"Latin": _TO_LATIN, "Cyrillic": _into(_CYRILLIC, _NOT_RUSSIAN), "Greek": _into(_GREEK)}
_SCRIPTS = {"Latin": regex.compile(r"\p{Latin}"), "Cyrillic": regex.compile(r"\p{Cyrillic}"), "Greek": regex.compile(r"\p{Greek}"), "Armenian": regex.compile(r"\p{Armenian}"), "Cherokee": regex.compile(r"\p{Cherokee}"), "Kana": regex.compile(r"[\p{Katakana}\p{Hiragana}\p{Han}]")}
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_WIDTH = re.compile(r"[\uff01-\uffee]+")
_BLANK = re.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_INVISIBLE = re.compile(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufeff\uffa0\ufff9-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a]")
# Selectors and tags mean something behind signs and in flags; behind plain characters they are invisible.
_SELECTOR = regex.compile(r"(?<=[\x00-\x7f]|^)(?![\ufe0f]\u20e3)[\ufe00-\ufe0f\U000e0000-\U000e0fff]+")
_FONT = regex.compile(r"[\u2102-\u2138\u2145-\u2149\U0001d400-\U0001d7ff]+")
_PHONETIC_WORD = regex.compile(r"(?<![\p{L}\p{M}ˈˌː/\[])(?=\p{L}*[a-zA-Z]{2})[a-zA-Zɑɡıꞓ]*[ɑɡꞓ][a-zA-Zɑɡıꞓ]*(?![\p{L}\p{M}ˈˌː/\]])")
# Joiners mean something between emoji and in scripts that join; elsewhere they are invisible.
_JOINER = regex.compile(r"(?<![\p{Extended_Pictographic}\ufe0f\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Emoji_Modifier}])[\u200c\u200d]")
_ODD = regex.compile(r"[\p{Cc}\p{Cf}\u034f\u115f\u1160\u3164\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\uff01-\uffee\ufe00-\ufe0f\u2102-\u2149ɑɡꞓ\U0001d173-\U0001d17a\U0001d400-\U0001d7ff\U0001bca0-\U0001bca3\U000e0000-\U000e0fff]")


def _font(m: regex.Match) -> str:
    """Letters and digits of another font as plain ones; other signs stay."""
    return "".join(unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith("<font>") else c for c in m[0])


def _scripts(word: str) -> dict[str, int]:
    return {s: n for s, p in _SCRIPTS.items() if (n := len(p.findall(word)))}


def _unmask(text: str, lang: str | None) -> str:
    """Letters that imitate those of their word's script, replaced by these."""
    total = _scripts(text)
    if len(total) < 2 and (not total or _SCRIPT_OF.get(lang) in (None, *total)):
        return text
    home = _SCRIPT_OF.get(lang) or max(total, key=total.get)
    words = _WORD.findall(text)
    honest: set[str] = set()  # scripts of which the text holds a word that imitates nothing
    into_home = _INTO.get(home, {})
    for w in words:
        s = _scripts(w)
        if len(s) == 1 and home not in s and not all(c in into_home or unicodedata.combining(c) for c in w):
            honest |= s.keys()

    def one(m: regex.Match) -> str:
        w = m[0]
        s = _scripts(w)
        if not s or list(s) == [home]:
            return w
        for target in dict.fromkeys((home, max(s, key=s.get))):
            if target not in s and (len(s) > 1 or honest & s.keys()):
                continue
            table, own = _INTO.get(target, {}), _SCRIPTS.get(target)
            if own and all(c in table or own.match(c) or not any(p.match(c) for p in _SCRIPTS.values()) for c in w):
                return "".join(c if own.match(c) else table.get(c, c) for c in w)
        return w

    return _WORD.sub(one, text)


def look_alike(text: str | None, lang: str | None = None) -> str | None:
    """The mapped value of one text; null stays null."""
    if text is None or (text.isascii() and not _INVISIBLE.search(text) and (lang is None or _SCRIPT_OF.get(lang, "Latin") == "Latin")):
        return text
    if not text.isascii():
        if _ODD.search(text):
            text = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
            text = _BLANK.sub(" ", text)
            text = _JOINER.sub("", text)
            text = _INVISIBLE.sub("", text)
            text = _SELECTOR.sub("", text)
            text = _FONT.sub(_font, text)
            text = _PHONETIC_WORD.sub(lambda m: m[0].translate(_PHONETIC_TABLE), text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    else:
        text = _INVISIBLE.sub("", text)
    return unicodedata.normalize("NFC", t) if (t := _unmask(text, lang)) is not text else text


def consistent_forms(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, text, form) of every row; equal-looking texts get equal forms.

    Null texts have a null form; the empty text is its own form. ``lang`` names a column of
    language codes; without it, or where it is null or unknown, the script that most letters
    of a text belong to counts as its own. Only the classes of more than one member are
    joined back, so the table of forms stays small however often a text occurs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mapped = [look_alike(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mapped, pa.string())], names=["k", "t", "mapped"])

    # Written once, as the mapped values are read twice.
    mapped = cut_table(rows.mapInArrow(run, f"k {kind}, t string, mapped string"))
    values = cut_table(mapped.filter(r"mapped RLIKE '[^\\x00-\\x7F]'").select("mapped").distinct())
    bare = F.regexp_replace("mapped", r"[^\x00-\x7F]", "")
    plain = cut_table(values.select(bare.alias("plain"), "mapped").filter("plain COLLATE UNICODE = mapped COLLATE UNICODE").select("plain").distinct())
    values = values.union(mapped.join(plain, F.col("mapped") == F.col("plain"), "left_semi").select("mapped").distinct())
    variants = spark.sql(
        """
        SELECT explode(members) AS mapped, form FROM (
          SELECT collect_set(mapped) AS members, min_by(mapped, struct(length(mapped), mapped)) AS form
          FROM {values} GROUP BY mapped COLLATE UNICODE)
        WHERE size(members) > 1
        """,
        values=values,
    ).filter("mapped <> form")
    # Written too, so that its size is known: Spark broadcasts it only if it is small.
    variants = cut_table(variants)
    joined = mapped.join(variants, "mapped", "left")
    return joined.select(F.col("k").alias(key), F.col("t").alias(text), F.coalesce("form", "mapped").alias("form"))
