"""Text normalisers and text functions as Column expressions.

All of them are built-in expressions, so they stay inside whole-stage code generation and can be pushed into scans.
A null input gives null; an empty text gives an empty text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def fold_pairs() -> tuple[str, str]:
    """(from, to) for ``translate``: every letter below U+2000 whose compatibility decomposition is one ASCII character
    plus marks, and the marks themselves (dropped). Built by rule from the Unicode database, with đ/Đ added."""
    source, target, dropped = ["đ", "Đ"], ["d", "D"], []
    for code in range(0x80, 0x2000):
        char = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x)]
        if unicodedata.combining(char):
            dropped.append(char)
        elif len(base) == 1 and base[0] != char and base[0].isascii() and base[0] != " ":
            source.append(char)
            target.append(base[0])
    return "".join(source + dropped), "".join(target)


def fold_accents(c: Column | str) -> Column:
    """Accents off, case kept; characters without an ASCII base stay."""
    return F.translate(_col(c), *fold_pairs())


def collapse_spaces(c: Column | str) -> Column:
    """Runs of white space become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"[\s\x{A0}]+", " "))


def ascii_key(c: Column | str) -> Column:
    """Accent-free lower-case ASCII; other characters are dropped, white space collapses to one space, ends are kept (N1)."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^\x00-\x7F]", ""), r"\s+", " ")


def ascii_key_trimmed(c: Column | str) -> Column:
    """:func:`ascii_key` with trimmed ends (N2)."""
    return F.trim(ascii_key(c))


@lru_cache(maxsize=None)
def _vietnamese_pairs() -> tuple[str, str]:
    """Lower-case precomposed Vietnamese letters and their base letters."""
    letters = {}
    tones = ["", "̀", "́", "̉", "̃", "̣"]
    for base, marks in (("a", ["", "̂", "̆"]), ("e", ["", "̂"]), ("i", [""]), ("o", ["", "̂", "̛"]), ("u", ["", "̛"]), ("y", [""])):
        for mark in marks:
            for tone in tones:
                composed = unicodedata.normalize("NFC", base + mark + tone)
                if composed != base:
                    letters[composed] = base
    letters["đ"] = "d"
    return "".join(letters), "".join(letters.values())


def query_key(c: Column | str) -> Column:
    """Lower case and the precomposed Vietnamese letters by table; all else is kept, also white space (N3)."""
    return F.translate(F.lower(_col(c)), *_vietnamese_pairs())


def match_key(c: Column | str) -> Column:
    """Lower case, no accents, punctuation and underscores to spaces, collapsed (N4)."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(_col(c))), r"(?U)[^\p{L}\p{N}]+", " "))


def eval_key(c: Column | str) -> Column:
    """Lower case, no accents, decimal comma to point, only ``a-z0-9%/.<>=+-`` kept, collapsed (N5)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(fold_accents(F.lower(_col(c))), ",", "."), r"[^a-z0-9%/.<>=+\-]+", " "), r"\s+", " "))


def lower_key(c: Column | str) -> Column:
    """Lower case with collapsed white space (N6)."""
    return F.lower(collapse_spaces(c))


def tidy_lines(c: Column | str) -> Column:
    """CR to LF, blanks and tabs collapsed, three or more line feeds to two, trimmed (N7)."""
    text = F.regexp_replace(F.translate(_col(c), "\r", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def slug(c: Column | str) -> Column:
    """Accent-free lower case with runs of other characters as one underscore, none at the ends (TXT04)."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def to_double(c: Column | str) -> Column:
    """A number with decimal point or comma; null where it is none (NUM06)."""
    text = F.trim(F.translate(_col(c), ",", "."))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
