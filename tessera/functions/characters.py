"""Look-alike letters and the consistent form of single characters."""

from __future__ import annotations

import re
import unicodedata

from tessera.functions.plain import INVISIBLE

#: Letters of other alphabets and the Latin letters they look like.
CYRILLIC = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "ï", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "ë",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ї": "Ï", "Ј": "J", "Ѕ": "S", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ё": "Ë", "Ү": "Y", "ү": "y",
}
GREEK = {
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
LATIN_LOOKALIKES = {"ɑ": "a", "ɡ": "g", "ı": "i", "ꞓ": "c", "ᴏ": "o", "ᴄ": "c", "ѕ": "s"}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L"}
LOOKALIKES = CYRILLIC | GREEK | ARMENIAN | LATIN_LOOKALIKES
#: The way back, for Latin letters inside Cyrillic words.
TO_CYRILLIC = {latin: other for other, latin in reversed(CYRILLIC.items()) if other in "авекмнорстухАВЕКМНОРСТУХ"}

IGNORABLE = frozenset(INVISIBLE)


def script(char: str) -> str:
    """``L`` Latin, ``C`` Cyrillic, ``G`` Greek, ``A`` Armenian, else ``-``."""
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L" if char.isalpha() else "-"
    if 0x400 <= code < 0x530:
        return "C"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G" if char.isalpha() else "-"
    if 0x530 <= code < 0x590:
        return "A"
    if char in LATIN_LOOKALIKES:
        return "L"
    return "-"


def to_latin(text: str) -> str:
    """Every look-alike replaced by its Latin letter."""
    return text.translate(_LATIN)


_LATIN = str.maketrans(LOOKALIKES)

#: Spaces other than ASCII white space.
OTHER_SPACES = "".join(chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")) + "\x85"
_SPACES = str.maketrans({c: ("\n" if c in "\x85  " else " ") for c in OTHER_SPACES} | {c: None for c in IGNORABLE})
#: A run of letters with the marks on them.
TOKEN = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")
#: Lower-case Greek letters that stand alone as symbols.
SYMBOLS = frozenset("αικνρτυχ")
#: Letters that Russian lacks; a word of look-alikes with one of them is not Russian.
NOT_RUSSIAN = frozenset("іїјѕһԁԛԝѵӏІЇЈЅҺԀԚԜѴӀҮү")


def compose(text: str) -> str:
    """Compatibility composition, ASCII spaces, nothing invisible; letters of other alphabets stay."""
    return unicodedata.normalize("NFKC", text.translate(_SPACES))
