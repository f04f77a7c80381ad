"""Plain-Python helpers on single strings, shared by the Arrow-batched operators."""

from __future__ import annotations

import re
import unicodedata

#: Characters that are never visible (soft hyphen, combining grapheme joiner, Arabic letter mark,
#: Hangul and Khmer fillers, Mongolian separators, zero-width and directional marks, invisible operators, byte order mark).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︎️﻿"
_DROP_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))


def visible(text: str) -> str:
    """Invisible characters removed."""
    return text.translate(_DROP_INVISIBLE)


def compatible(text: str) -> str:
    """Compatibility composition (NFKC) without invisible characters; plain ASCII is returned as it is."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", visible(text))


def bare(text: str) -> str:
    """Case folded, accents off, đ as d; the rest is kept."""
    folded = text.casefold()
    if folded.isascii():
        return folded
    decomposed = unicodedata.normalize("NFD", folded.replace("đ", "d"))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


_SPACE = re.compile(r"\s+")


def one_line(text: str) -> str:
    """White space collapsed and trimmed."""
    return _SPACE.sub(" ", text).strip()
