"""Words of a text for comparisons: case, punctuation and look-alike characters do not count."""

from __future__ import annotations

import regex

from voxloom.llm.lookalike import look_alike

_DROPPED = bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace()))
_MARKS = regex.compile(r"[^\p{L}\p{M}\p{N}\s]+")


def comparison_words(text: str | None, lang: str | None = None) -> list[str]:
    """Lower-case words without punctuation; the empty list for null, empty and blank texts.

    Punctuation is taken out of words, so a mark inside a word does not part it.
    """
    if not text:
        return []
    if text.isascii():
        return text.encode().lower().translate(None, _DROPPED).decode().split()
    return _MARKS.sub("", look_alike(text, lang)).casefold().split()
