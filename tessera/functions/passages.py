"""Passage-level text functions: sections, headings, hints, clean-up, splitting and value extraction, all as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ascii_key, ascii_key_trimmed, collapse_spaces

# Keywords of the sections in the order in which they are tried, words for comparison signs, redactions.
SECTIONS = {
    "definition": ["khai niem", "dinh nghia"],
    "classification": ["phan loai", "kdigo", "giai doan", "stage"],
    "pathology": ["mo benh hoc", "ton thuong mo benh hoc", "kinh hien vi", "mien dich huynh quang", "hien vi dien tu"],
    "treatment": ["dieu tri", "nguyen tac dieu tri", "lieu dung", "thuoc"],
    "diagnosis_criteria": ["chan doan", "tieu chuan chan doan"],
    "clinical_features": ["lam sang", "can lam sang", "trieu chung"],
    "progression": ["tien trien", "tien luong"],
    "complications": ["bien chung"],
    "follow_up": ["theo doi", "tai kham", "phong ngua", "du phong"],
}
OPERATOR_WORDS = {"tren": ">", "cao tren": ">", "tang tren": ">", "duoi": "<", "giam duoi": "<"}
GREETING = r"(?iu)^\s*(?:hi|hello|hey|xin\s+chào|chào\s+bạn|chào)\s*[,!.\-:;]*\s+"
REDACTIONS = [r"\[\s*nguồn\s*\d+\s*\]", r"\(\s*nguồn\s*\d+\s*\)", r"\[source_id=[^\]]+\]", r"\[document_id=[^\]]+\]", r"\btrang\s+\d+\b", r"\bpage\s*(?:number|index)?\s*[:=]?\s*\d+\b", r"\bscore\s*[:=]\s*[0-9.]+\b"]
# End of fixed values.


def any_contains(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def first_match(tests: Mapping[str, Column], otherwise: str | None = None) -> Column:
    """The first key, in order, whose test holds."""
    out = F.lit(otherwise).cast("string")
    for key, test in reversed(tests.items()):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(key)).otherwise(out)
    return out


def lines(text: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def section_type(text: Column) -> Column:
    """Section by keyword in the first two lines, then in the first six, else ``general``; null for null."""
    preview = lambda n: ascii_key(F.array_join(F.slice(lines(text), 1, n), " "))
    tests = {f"{n}|{k}": any_contains(preview(n), w) for n in (2, 6) for k, w in SECTIONS.items()}
    return F.when(text.isNotNull(), F.coalesce(F.split_part(first_match(tests), F.lit("|"), F.lit(2)), F.lit("general")))


def keyword_in(text: Column, word: str) -> Column:
    """A phrase or a word of more than four letters as substring, a shorter one only with boundaries. ``text`` is folded."""
    if " " in word or len(word) > 4:
        return F.contains(text, F.lit(word))
    return text.rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])")


def hint(text: Column, hints: Mapping[str, Sequence[str]]) -> Column:
    """The first key, in order, of which a word is in the folded text."""
    folded = ascii_key_trimmed(text)
    return first_match({k: reduce(lambda a, b: a | b, (keyword_in(folded, w) for w in words)) for k, words in hints.items()})


def heading_number(text: Column) -> Column:
    """``4.1.2`` of a first line that begins so; null otherwise."""
    number = F.regexp_extract(F.coalesce(F.try_element_at(lines(text), F.lit(1)), F.lit("")), r"^([0-9]+(?:\.[0-9]+)*)\.?\s+", 1)
    return F.when(number != "", number)


def uppercase_title(text: Column) -> Column:
    """Up to 120 characters with more than 70 % capitals among the letters."""
    trimmed = F.trim(text)
    letters = F.length(F.regexp_replace(trimmed, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(trimmed, r"[^\p{Lu}]", ""))
    return (trimmed != "") & (F.length(trimmed) <= 120) & (letters > 0) & (capitals > 0.7 * letters)


def without_greeting(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(text), GREETING, "")
    return F.when(cleaned != "", cleaned).otherwise(F.trim(text))


def primary_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(lines(text), F.lit(1)), F.trim(text))


def redacted(text: Column) -> Column:
    """Source marks, page numbers and scores out of an answer; spaces and punctuation tidied."""
    for pattern in REDACTIONS:
        text = F.regexp_replace(text, f"(?iu){pattern}", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\(\s*\)", ""), r"\s+([,.;:])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def trimmed_at_word(text: Column, size: int) -> Column:
    """At most ``size`` characters, cut after the last whole word, with dots."""
    head = F.substring(text, 1, size)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.when(cut != "", F.rtrim(cut)).otherwise(head), F.lit("...")))


def operator_sign(text: Column) -> Column:
    """Comparison words as signs; signs stay."""
    folded = ascii_key(text)
    return F.coalesce(first_match({f"{sign}": folded.isin([w for w, s in OPERATOR_WORDS.items() if s == sign]) for sign in (">", "<")}), folded)


def rule_condition(text: Column) -> Column:
    """STRUCT<low, high, op> of ``a <= x <= b``, ``a <= x < b`` and ``x op v``; op ``unknown`` for anything else."""
    cleaned = F.translate(ascii_key(text), ",", ".")
    number = r"([0-9]+(?:\.[0-9]+)?)"
    both = rf"{number}\s*<=\s*[a-z_]+\s*<=?\s*{number}"
    single = rf"[a-z_]+\s*(<=|>=|<|>)\s*{number}"
    get = lambda pattern, group: F.regexp_extract(cleaned, pattern, group)
    number_of = lambda pattern, group: get(pattern, group).try_cast("double")
    between = get(both, 1) != ""
    one = get(single, 1) != ""
    return F.struct(
        F.when(between, number_of(both, 1)).when(one, number_of(single, 2)).alias("low"),
        F.when(between, number_of(both, 2)).alias("high"),
        F.when(between, F.lit("between")).when(one, get(single, 1)).otherwise(F.lit("unknown")).alias("op"),
    )


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences with collapsed white space of at least ``least`` characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: collapse_spaces(x))
    return F.filter(parts, lambda x: F.length(x) >= least)


def facts(text: Column, most: int = 8) -> Column:
    """The first facts of an answer: parts at sentence ends and semicolons, of 18 characters or more, without bullets."""
    parts = F.split(collapse_spaces(text), r"(?<=[.!?。])\s+|;\s+")
    stripped = F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \-•]+|[ \-•]+$", ""))
    return F.slice(F.filter(stripped, lambda x: F.length(x) >= 18), 1, most)


def blocks(text: Column, least: int = 30) -> Column:
    """Blocks that begin at numbered heading lines, of ``least`` characters or more."""
    marked = F.regexp_replace(text, r"(?m)^[ \t]*(?=[0-9]+(?:\.[0-9]+)*\.?[ \t]+\S)", "\x1e")
    return F.filter(F.transform(F.split(marked, "\x1e"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)


def stripped_lines(text: Column) -> Column:
    """Non-blank lines without white space of any kind at their ends; every line separator of Unicode counts."""
    found = F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")), lambda x: x != "")


def bullet_units(found: Column) -> Column:
    """Lines of :func:`stripped_lines` grouped to units: each begins at a line with a bullet, the first one anyhow."""
    return F.filter(F.split(F.array_join(found, "\n"), r"\n(?=[–•-])"), lambda x: x != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed_units(block: Column, least: int = 1100, most: int = 900, units: int = 2) -> Column:
    """Pieces of a block of ``least`` characters or more: its bullet units, at most ``units`` or ``most`` characters each.

    A numbered heading line is repeated in every piece and counts towards its length; a unit that is too long alone is a
    piece. Smaller blocks and those of fewer than three units stay whole.
    """

    def pack(found: Column, heading: Column) -> Column:
        begin = F.coalesce(F.length(heading), F.lit(0))
        piece = lambda n, size, text: F.struct(n.alias("n"), size.alias("size"), text.alias("text"))

        def add(acc: Column, unit: Column) -> Column:
            last = F.element_at(acc, -1)
            full = (last["n"] >= units) | (last["size"] + F.length(unit) > most)
            alone = F.array(piece(F.lit(1), begin + F.length(unit), unit))
            longer = F.array(piece(last["n"] + 1, last["size"] + F.length(unit), F.concat(last["text"], F.lit("\n"), unit)))
            return F.when(F.size(acc) == 0, alone).when(full, F.concat(acc, alone)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), longer))

        folded = F.aggregate(found, F.array().cast("array<struct<n:int,size:int,text:string>>"), add)
        return F.transform(folded, lambda p: F.concat_ws("\n", heading, p["text"]))

    def split(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        heading = F.when(first.rlike(r"(?U)^\d+(?:\.\d+)*\.?\s+.+$"), first)
        body = F.when(heading.isNotNull(), F.slice(found, 2, F.size(found))).otherwise(found)
        return _let(bullet_units(body), lambda us: F.when(F.size(us) >= 3, pack(us, heading)).otherwise(F.array(block)))

    return F.when(F.length(block) >= least, _let(stripped_lines(block), split)).otherwise(F.array(block))


def inline_thresholds(text: Column) -> Column:
    """ARRAY<STRUCT<op, value, unit>> of the comparisons with a number and a known unit, in order."""
    pattern = r"(?i)(<=|>=|≤|≥|<|>)\s*([0-9]+(?:[.,][0-9]+)?)\s*(g/24h|g/l|mmol/l|mg/g|mg/mmol|mg/dl|ml/ph/1[.,]73m2|ml/ph|mmhg|%)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("op"),
            F.translate(F.regexp_extract(x, pattern, 2), ",", ".").cast("double").alias("value"),
            F.lower(F.regexp_extract(x, pattern, 3)).alias("unit"),
        ),
    )
