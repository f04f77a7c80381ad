"""Text decoded with the wrong character encoding (problem 10).

Characters are mapped back to the bytes of a legacy encoding; an automaton over the byte classes of UTF-8 (lead bytes
with one, two or three continuation bytes) finds the maximal well-formed spans, and only those are decoded again. The
automaton of each encoding is compiled to a regular expression over characters. Text garbled several times is undone
level by level.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 is read by mistake. ``cp1252`` also stands for Latin-1: its gaps are the C1 controls.
LEGACY = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp1258")
LOST = "�"


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[str, int]:
    """Characters to bytes above 0x7F."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            pass
    if encoding in ("cp1252", "cp1250", "cp1258"):
        for byte in range(0x80, 0xA0):
            table.setdefault(chr(byte), byte)
    if encoding == "cp1252":
        for byte in range(0xA0, 0x100):
            table.setdefault(chr(byte), byte)
    return table


def _classes(encoding: str) -> dict[str, str]:
    """Character classes of the automaton's inputs."""
    table = byte_table(encoding)
    pick = lambda low, high: "".join(re.escape(c) for c, b in table.items() if low <= b <= high)
    return {"c": pick(0x80, 0xBF), "two": pick(0xC2, 0xDF), "three": pick(0xE0, 0xEF), "four": pick(0xF0, 0xF4)}


@lru_cache(maxsize=None)
def unit_pattern(encoding: str) -> re.Pattern:
    """One well-formed multibyte character."""
    k = _classes(encoding)
    return re.compile(f"[{k['two']}][{k['c']}]|[{k['three']}][{k['c']}]{{2}}|[{k['four']}][{k['c']}]{{3}}")


@lru_cache(maxsize=None)
def span_pattern(encoding: str) -> re.Pattern:
    """A maximal run of well-formed multibyte characters."""
    return re.compile(f"(?:{unit_pattern(encoding).pattern})+")


#: Letters of Latin Extended-A that hardly occur in text but often by chance.
_UNLIKELY = frozenset("ĲĳĿŀĸŉĴĵĶķĹĺĻļĽľſŊŋĦħŦŧ")
_TYPOGRAPHIC = frozenset("‐‑‒–—―‘’‚“”„†‡•…‰′″‹›€₫№™→←↑↓⇒∂∆∏∑−√∞∫≈≠≤≥◊⁄ﬁﬂˆ˜˘˙˚˝ˇƒ")


def likely(char: str) -> bool:
    """Characters that real text of the languages at hand may have beyond ASCII."""
    code = ord(char)
    if code < 0xA0:
        return code >= 0x80
    if code < 0x180:
        return char not in _UNLIKELY
    if char in "ƠơƯưȘșȚțƒ" or 0x1EA0 <= code <= 0x1EF9 or 0x300 <= code <= 0x341:
        return True
    if 0x386 <= code <= 0x3CE or 0x400 <= code <= 0x45F or code in (0x490, 0x491):
        return True
    if char in _TYPOGRAPHIC or 0x2000 <= code <= 0x206F or 0x2190 <= code <= 0x22FF or 0x2500 <= code <= 0x27BF:
        return True
    if 0x3000 <= code <= 0x30FF or 0x4E00 <= code <= 0x9FFF or 0xFF00 <= code <= 0xFFEF or code in (0xFEFF, 0xFFFD, 0xFE0F, 0xF8FF):
        return True
    return 0x1F000 <= code <= 0x1FAFF


def _is_line(char: str) -> bool:
    return 0x2500 <= ord(char) <= 0x257F


def _alphabet(char: str) -> str:
    if not char or not char.isalpha():
        return ""
    code = ord(char)
    return "C" if 0x400 <= code < 0x530 else "G" if 0x370 <= code < 0x400 else "L" if code < 0x370 or 0x1E00 <= code < 0x1F00 else ""


def decode_span(span: str, encoding: str, before: str, after: str) -> str | None:
    """The text behind a maximal span, or None where the span is more likely meant as it is.

    Refused: what is no valid UTF-8; unlikely characters; letters that would stand beside letters of another alphabet;
    Cyrillic letters taken for bytes beside Cyrillic letters that aren't; line drawing that touches no letter; one or
    two letters of another alphabet from letters.
    """
    table = byte_table(encoding)
    try:
        text = bytes(table[c] for c in span).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not all(map(likely, text)):
        return None
    if all(map(_is_line, span)) and not ((before.isalpha() or after.isalpha()) and any(c.isalpha() for c in text)):
        return None
    if span.isalpha() and any(ord(c) > 0x2FFF for c in text):
        return None
    if encoding != "cp1251" and span.isalpha() and len(text) < 3 and any(_alphabet(c) in ("C", "G") for c in text):
        return None
    if encoding == "cp1251" and (_alphabet(before) == "C" or _alphabet(after) == "C" or (text == "Ÿ" and span.isalpha())):
        return None
    for near, own in ((before, text[0]), (after, text[-1])):
        a, b = _alphabet(near), _alphabet(own)
        if a and b and a != b and not (b == "G" or a == "G"):
            return None
    return text


#: A multibyte character of which a byte was lost or became a space. Cyrillic letters count only where no other Cyrillic
#: letter stands beside them, and box drawing not where it may be a line of a tree.
_BROKEN = re.compile(
    "[a-zđ][ÃÂ](?= )|á[º»](?=[^\\W\\d_])|(?<=[^\\W\\d_])áº|á»(?=[\\x80-\\x9f])|[ÄÆ][\\x80-\\x9f‘\\xa0°¡]|â€|Ã[\\x80-\\x9f]|ï¿½|ï»¿|ß[║╗]|├[│┐┤║╕-╝╡-╣░-▓]?(?=[^\\W\\d_])|ƒ[ëê]"
    "|(?<=[A-Za-zđĐ])б[єв»](?![Ѐ-ӿ])|(?<![Ѐ-ӿ])б[єв»](?=[A-Za-z])|(?<![Ѐ-ӿ])вЂ(?![Ѐ-ӿ])"
)
#: Words of accented Latin-1 letters only: single bytes of another alphabet.
_ONE_BYTE = re.compile("(?<![^\\W\\d_])[\\xc0-\\xff\\xb8\\xa8]{4,}(?![^\\W\\d_])")
_VOWEL_ACCENTS = frozenset("éèêëàâîïôûùçœæ")
#: A vowel followed by what the Vietnamese encoding has as a tone mark and Latin-1 as a letter, and đ as ð.
_TONE_LETTER = re.compile("(?<=[aâeêioôuyãõýAÂEÊIOÔUYÃÕÝ])[ÌÒÞ]|(?<=[aâêôyãõý])[ìò]|(?<=[ei])ò(?=[^\\W\\d_])")
_ETH = re.compile("(?<![^\\W\\d_])[ðÐ](?=[aâeêioôuyãõýìòéèúùíàáóAÂEÊIOÔUY])")


#: One such place is enough: a tone letter of the other case, or after a vowel that never stands before it.
_SURE_TONE = re.compile("(?<=[aâeêioôuyãõý])[ÌÒÞ]|(?<=[AÂEÊIOÔUYÃÕÝ])[ìò]|(?<=[âêôõý])[ìò]|(?<=[ÂÊÔ])[ÌÒÞ](?=[^\\W\\d_])")
_CYRILLIC = re.compile("[А-яЁё]{3}")
_SHORT_ONE_BYTE = re.compile("(?<![^\\W\\d_])[\xc0-\xff\xb8\xa8]{3,}(?![^\\W\\d_])")
#: Share of each letter in Russian text, in percent.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.98, 8.48, 7.99, 7.36, 6.7, 6.31, 5.47, 4.75, 4.53, 4.34, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.9, 1.74, 1.7, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.33, 0.26, 0.04, 0.2)))
_LOG = {letter: math.log(share / 100) for letter, share in RUSSIAN.items()}
#: By how much the mean log share must rise for another reading of Cyrillic letters.
CYRILLIC_GAIN = 0.1
_CYRILLIC_WORD = re.compile("[А-яЁёЈј]+")


def one_byte_words(text: str) -> list[str]:
    words = [w for w in _ONE_BYTE.findall(text) if not set(w.lower()) <= _VOWEL_ACCENTS]
    if sum(map(len, words)) >= 8:
        return words
    return [w for w in _SHORT_ONE_BYTE.findall(text) if not set(w.lower()) <= _VOWEL_ACCENTS] if _CYRILLIC.search(text) else []


def _mean_log(text: str) -> float:
    letters = [_LOG.get(c, -9.0) for c in text.lower() if c.isalpha()]
    return sum(letters) / len(letters) if letters else -9.0


def other_cyrillic(text: str) -> list[tuple[str, str]]:
    """(word, reading) of Cyrillic words that are more likely another Cyrillic encoding's bytes.

    In it the cases are swapped; only texts with such words are looked at, and the words' letters must become much
    more like Russian in total.
    """
    if not _SWAPPED.search(text):
        return []
    words, found = set(_CYRILLIC_WORD.findall(text)), []
    for word in words:
        if word[1:].islower() or (len(word) == 1 and word.islower()):
            continue
        try:
            reading = word.encode("cp1251").decode("koi8_r")
        except UnicodeError:
            continue
        if reading[1:].islower() or len(reading) == 1:
            found.append((word, reading))
    before, after = _mean_log("".join(w for w, _ in found)), _mean_log("".join(r for _, r in found))
    return found if found and sum(len(w) for w, _ in found) >= 6 and after - before > CYRILLIC_GAIN else []


_SWAPPED = re.compile("[а-яё][А-ЯЁ]|[А-ЯЁ]{3}")


def repair_level(text: str) -> tuple[str, int]:
    """(text with one level of wrong decoding undone, number of spans decoded)."""
    best: tuple[int, str, int] | None = None
    for encoding in LEGACY:
        count = gain = 0

        def decode(m: re.Match) -> str:
            nonlocal count, gain
            span = m[0]
            whole = decode_span(span, encoding, text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])
            if whole is None:
                return span
            count += 1
            gain += len(span)
            return whole

        fixed = span_pattern(encoding).sub(decode, text)
        if count and (best is None or gain > best[0]):
            best = (gain, fixed, count)
    return (best[1], best[2]) if best else (text, 0)


def repair(text: str) -> tuple[str, bool]:
    """(restored text, whether anything garbled was found); what can't be restored stays as it is."""
    garbled = LOST in text
    while (level := repair_level(text))[1]:  # each level makes the text shorter
        text, garbled = level[0], True
    if one_byte_words(text):
        garbled = True
        text = _undo_one_byte(text)
    other = dict(other_cyrillic(text))
    if other:
        garbled = True
        text = _CYRILLIC_WORD.sub(lambda m: other.get(m[0], m[0]), text)
    tones = len(_TONE_LETTER.findall(text))
    if tones >= 2 or _SURE_TONE.search(text) or (tones and _ETH.search(text)):
        garbled = True
        text = _undo_tone_letters(text)
    return text, garbled or bool(_BROKEN.search(text))


def is_garbled(text: str) -> bool:
    """The second result of :func:`repair`; stops at the first evidence."""
    if LOST in text:
        return True
    for encoding in LEGACY:
        for m in span_pattern(encoding).finditer(text):
            if decode_span(m[0], encoding, text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]) is not None:
                return True
    if one_byte_words(text) or other_cyrillic(text):
        return True
    tones = len(_TONE_LETTER.findall(text))
    return tones >= 2 or bool(_SURE_TONE.search(text)) or bool(tones and _ETH.search(text)) or bool(_BROKEN.search(text))


def _undo_tone_letters(text: str) -> str:
    """Words with tone letters, and those around them, read in the Vietnamese Windows encoding."""

    def decode(m: re.Match) -> str:
        try:
            return unicodedata.normalize("NFC", m[0].encode("cp1252").decode("cp1258"))
        except UnicodeError:
            return m[0]

    return re.sub("[^\\W\\d_]+", lambda m: decode(m) if re.search("[ðÐÌÒÞìòãõýÃÕÝ]", m[0]) else m[0], text)


def _undo_one_byte(text: str) -> str:
    """Runs of accented Latin-1 words read as the Cyrillic encoding that gives the most common letters."""
    common = frozenset("оеаинтсрвлкмдпу")

    def decode(m: re.Match) -> str:
        readings = []
        for encoding in ("cp1251", "koi8_r"):
            try:
                readings.append(m[0].encode("cp1252", "strict").decode(encoding))
            except UnicodeError:
                continue
        return max(readings, key=lambda r: sum(c in common for c in r), default=m[0])

    return re.sub("[\\xc0-\\xff\\xb8\\xa8]+(?![a-z])", lambda m: decode(m) if len(m[0]) > 1 or not unicodedata.normalize("NFC", m[0]).isascii() else m[0], text)


@lru_cache(maxsize=None)
def _suspects() -> tuple[re.Pattern, ...]:
    """Patterns of which every garbled text has one: a unit of any encoding, one-byte words, broken units, tone letters.

    Each begins with a character class, so that the search skips over all other characters at once.
    """
    leads, units = "", []
    for encoding in LEGACY:
        k = _classes(encoding)
        units += [f"(?<=[{k['two']}])[{k['c']}]", f"(?<=[{k['three']}])[{k['c']}]{{2}}", f"(?<=[{k['four']}])[{k['c']}]{{3}}"]
        leads += k["two"] + k["three"] + k["four"]
    return (
        re.compile(f"[{leads}](?:{'|'.join(units)})"),
        re.compile("[\xc0-\xff\xb8\xa8]{3}"),
        _SWAPPED,
        re.compile("[ÃÂá](?:(?<=[a-zđ][ÃÂ]) |(?<=á)[º»])"),
        re.compile("[ÄÆâÃïß├ƒбв](?:(?<=[ÄÆ])[\\x80-\\x9f‘\\xa0°¡]|(?<=â)€|(?<=Ã)[\\x80-\\x9f]|(?<=ï)(?:¿½|»¿)|(?<=ß)[║╗]|(?<=├)[│┐┤║╕-╝╡-╣░-▓]?(?=[^\\W\\d_])|(?<=ƒ)[ëê]|(?<=б)[єв»]|(?<=в)Ђ)"),
        re.compile("[ÌÒÞìò](?<=[aâeêioôuyãõýAÂEÊIOÔUYÃÕÝ].)"),
    )


def suspect(text: str) -> bool:
    """False for surely clean texts."""
    return not text.isascii() and (LOST in text or any(p.search(text) for p in _suspects()))


def garbled_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", restore: bool = True) -> DataFrame:
    """(id, restored, restorable), without ``restore`` only (id): the documents with garbled text, whole texts, with what could be restored.

    Null, empty and blank texts are clean. ``restorable`` is false where lost characters or other garbled places remain. The scan's stage drops
    texts of ASCII only; the rest is repaired in Arrow batches, without any shuffle.
    """

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[suspect(t) and (restore or is_garbled(t)) for t in batch["text"]]]
            if not restore:
                yield batch[["id"]]
                continue
            done = [repair(t) for t in batch["text"]]
            out = pd.DataFrame({"id": batch["id"], "restored": [t for t, _ in done], "restorable": [not is_garbled(t) for t, _ in done]})
            yield out[[g for _, g in done]]

    kind = dict(df.dtypes)[id_column]
    candidates = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).where(F.octet_length("text") > F.length("text"))
    return candidates.mapInPandas(fix, f"id {kind}, restored string, restorable boolean" if restore else f"id {kind}")
