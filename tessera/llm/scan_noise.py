"""Texts of scanned pages back into readable paragraphs (problem 2).

A noisy channel: the page's words were changed by the printer's line breaks, by running headers and page numbers between
the lines and by confused characters. One pass over all texts counts words, pairs of neighbouring words and repeated
short lines of each source file; the second undoes the damage text by text. Confused characters are decoded by Viterbi
over the candidate words of each line, with confusion probabilities times n-gram likelihood at every step.

All counts are kept, however rare a word is. Words that confusions can turn into each other share a signature, so the
candidates of a word are found by an equi-join. Where the counts are few enough they go to every task; beyond that each
text gets those of its own words and pairs by a join. Both ways give the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.plain import bare, one_line
from tessera.llm.consistent import Consistent
from tessera.session import checkpointed

HYPHENATION, MISREAD, HEADER, PAGE = "hyphenation", "misread", "running_header", "page_number"
#: What the scanner reads, what stands there, and the probability of the first given the second.
CONFUSIONS = (
    ("¢", "c", 0.3), ("0", "o", 0.3), ("9", "g", 0.3), ("!", "i", 0.3), ("!", "l", 0.1), ("1", "l", 0.3), ("1", "i", 0.1), ("|", "l", 0.3), ("|", "i", 0.1),
    ("5", "s", 0.3), ("8", "b", 0.3), ("6", "b", 0.1), ("$", "s", 0.2), ("@", "a", 0.2), ("€", "e", 0.2), ("£", "e", 0.1),
    ("li", "h", 0.05), ("ii", "u", 0.05), ("rn", "m", 0.05), ("cl", "d", 0.05), ("vv", "w", 0.05), ("m", "rn", 0.02),
)
#: Words and pairs up to which the counts are sent to every task; beyond that they are joined to the texts.
MAX_SHARED = 1_000_000
#: Words this common that have no other reading are not looked up by a join; so many of them are sent to every task.
COMMON = 50_000
#: A word must occur this often to be what another one was misread from.
LEAST = 3
#: Weight of a word's own share where its pair with the word before was never seen.
BACKOFF = 0.4
#: Stands for every number among words and pairs.
NUMBER = "#"
#: A line is a header of its source if it recurs at this rate among the source's short lines, which lines that are alike by
#: chance don't at any size; a longer line that begins with a header from so many occurrences on. So large a part of a
#: header's occurrences must be in its source.
LINE_RATE = 0.001
LINE_MIN = 5
LINE_OWN = 0.9
#: Headers of up to this many rows are broadcast; beyond that they are joined by shuffling.
BROADCAST_ROWS = 100_000
#: Counters of a task are handed on when they have this many entries.
FLUSH = 1_000_000

TOKEN = re.compile(r"[\w¢!|$@€£]+")
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = re.compile(r"[^\x00-\x7f\xa1-\xac\xae-\xb1\xb6\xb7\xbb-ıĴ-žƠơƯưА-яЁёα-δμẠ-ỹ–—‘-”•€≤≥]")
_SOFT = re.compile("­(?=\\s*\\n)")
#: A volume number, a year or a remark after a title in a file name.
_TITLE_END = re.compile(r"\s+(?:tập|vol|quyển|phần|volume|part)\.?\s*\d|\s*\(|\s+-\s+\d|\.\w{2,4}$", re.I)
#: What stands around a title in a header.
_BEFORE_TITLE = r"(?:(?:chapter|chương|phần|part)\s+\w{1,4}\s*[-|:–]\s*|[~*|]\s*)?"
_AFTER_TITLE = r"(?:\s*[~*|]?\s*(?:\(?\s*lưu\s+hành\s+nội\s+bộ(?:\s*,\s*tập\s+\d+)?\s*\)?|bản\s+in\s+lần\s+\d+))?(?:\s+\d{1,2}(?=\s|$|\())?(?:\s*\(tiếp\))?"
_CITED = re.compile(r"(?:xem|thêm|see|also)[ \t]+$", re.I)
_PAGE_FORMS = re.compile(
    r"(?<!\w)(?:trang|page)\s+(?P<a>\d{1,5})(?![\d.,]*\d|\w)|(?<![\w-])-\s(?P<b>\d{1,5})\s-(?!\w)|\[(?P<c>\d{1,5})\]|(?<!\w)\((?P<d>\d{1,5})\)|(?<!\S)\|\s(?P<e>\d{1,5})(?!\S)"
    r"|(?<!\S)\.\s\.\s\.\s(?P<f>\d{1,5})(?!\S)|(?<![\w.,/])(?P<g>\d{1,5})\s/\s(?P<h>\d{1,5})(?![\w/]|[.,]\d)",
    re.I,
)
_MARK = re.compile("[-‐‑¬]")
#: Compounds written in one line.
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+-[^\W\d_]+(?![\w-])")
#: The halves beside a mark; signs that stand for letters belong to them.
_LEFT = re.compile(r"[\w¢!|]*[^\W\d_][¢!|0-9]?$")
_RIGHT = re.compile(r"(\s*)((?=[\w¢!|]*[^\W\d_])[\w¢!|]+)")


def title_of(source: str) -> str:
    """The book's title in the name of its file."""
    return one_line(_TITLE_END.split(source, maxsplit=1)[0])


def line_key(line: str) -> str:
    return one_line(re.sub(r"\d+", "#", bare(line)))


def candidate_line(line: str) -> bool:
    """Short lines that begin like a heading and end like none of the running text."""
    text = line.strip()
    if not 6 <= len(text) <= 80 or text[-1] in ".;:,!?%" or ":" in text:
        return False
    first = next((c for c in text if c.isalnum()), "")
    return bool(first) and (first.isupper() or first.isdigit() and " " in text) and 2 <= len(text.split()) <= 12


def settle(text: str, form: Consistent) -> str:
    """Consistent characters; soft hyphens at line ends become hyphens first."""
    if text.isascii() or not _PLAIN.search(text):
        return text
    return form(_SOFT.sub("-", text))


def words_of(lower: str) -> list[str]:
    """Words of a text in lower case, each number as :data:`NUMBER`."""
    return [NUMBER if t.isdigit() else t for t in TOKEN.findall(lower)]


def corpus_counts(records: DataFrame) -> DataFrame:
    """(kind, a, b, n): words (w, word, ''), compounds (c, compound, ''), pairs of neighbours (p, word, word), candidate lines (h, source, line).

    All texts are counted. Each task counts for itself and hands its sums on, so what is shuffled has the size of the
    vocabulary, not of the texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Consistent()
        words: Counter = Counter()
        compounds: Counter = Counter()
        pairs: Counter = Counter()
        lines: Counter = Counter()

        def out() -> Iterator[pd.DataFrame]:
            for kind, counter in (("w", ((w, "", n) for w, n in words.items())), ("c", ((w, "", n) for w, n in compounds.items())), ("p", ((a, b, n) for (a, b), n in pairs.items())), ("h", ((s, x, n) for (s, x), n in lines.items()))):
                rows = list(counter)
                for i in range(0, len(rows), 50_000):
                    part = rows[i : i + 50_000]
                    yield pd.DataFrame({"kind": kind, "a": [r[0] for r in part], "b": [r[1] for r in part], "n": [r[2] for r in part]})
            for counter in (words, compounds, pairs, lines):
                counter.clear()

        for batch in batches:
            for source, text in zip(batch["source"], batch["text"]):
                if not text:
                    continue
                lower = settle(text, form).lower()
                tokens = words_of(lower)
                words.update(tokens)
                if "-" in lower:
                    compounds.update(_COMPOUND.findall(lower))
                pairs.update(zip(tokens, tokens[1:]))
                if source is not None and "\n" in text:
                    lines.update((source, line_key(x)) for x in text.split("\n") if candidate_line(x))
            if len(words) + len(compounds) + len(pairs) + len(lines) > FLUSH:
                yield from out()
        yield from out()

    parts = records.select("source", "text").mapInPandas(count, "kind string, a string, b string, n long")
    return parts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _canonical() -> dict[str, str]:
    """The signature of each character: characters that stand for one another have the same, a character that stands for
    several has theirs."""
    group: dict[str, str] = {}

    def root(char: str) -> str:
        while group.get(char, char) != char:
            char = group[char]
        return char

    for read, stands, _ in CONFUSIONS:
        if len(read) == len(stands) == 1:
            low, high = sorted((root(read), root(stands)))
            group[high] = low
    several = {min(pair, key=len): max(pair, key=len) for pair in ((r, s) for r, s, _ in CONFUSIONS) if len(pair[0]) != len(pair[1])}
    singles = {c for read, stands, _ in CONFUSIONS for c in read + stands}
    return {c: "".join(map(root, several.get(c, c))) for c in singles}


_SIGNATURE = str.maketrans(_canonical())


def signature(token: str) -> str:
    """Equal for a word and whatever confusions make of it."""
    return token.translate(_SIGNATURE)


def _steps() -> dict[str, list[tuple[str, str, float]]]:
    """Confusions by the first character read, as (read, stands, log probability); the characters of a pair may be confused too."""
    single: dict[str, list[tuple[str, float]]] = {}
    for read, stands, p in CONFUSIONS:
        if len(read) == len(stands) == 1:
            single.setdefault(stands, []).append((read, p))
    found: dict[tuple[str, str], float] = {}
    for read, stands, p in CONFUSIONS:
        forms = [("", p)]
        for char in read if len(read) > 1 else "":
            forms = [(f + c, q * r) for f, q in forms for c, r in [(char, 1.0), *single.get(char, [])]]
        for form, q in forms if len(read) > 1 else [(read, p)]:
            found[form, stands] = max(found.get((form, stands), 0.0), q)
    steps: dict[str, list[tuple[str, str, float]]] = {}
    for (read, stands), p in found.items():
        steps.setdefault(read[0], []).append((read, stands, math.log(p)))
    return steps


_STEPS = _steps()


def channel(token: str, word: str) -> float | None:
    """Log probability of reading ``word`` as ``token``; None where confusions don't lead from one to the other."""
    level: dict[tuple[int, int], float] = {(0, 0): 0.0}
    best: float | None = None
    for i in range(len(token) + 1):  # states are taken in order of the place in the token
        for (at, j), score in [x for x in level.items() if x[0][0] == i]:
            if i == len(token):
                if j == len(word) and (best is None or score > best):
                    best = score
                continue
            options = [(1, 1, 0.0)] if word[j : j + 1] == token[i] else []
            options += [(len(r), len(s), p) for r, s, p in _STEPS.get(token[i], ()) if token.startswith(r, i) and word.startswith(s, j)]
            for di, dj, p in options:
                state = (i + di, j + dj)
                if score + p > level.get(state, -math.inf):
                    level[state] = score + p
    return best


@dataclass
class Model:
    """Counts of words and of the pairs in which a word may be misread; of the whole corpus or of what one text needs."""

    words: dict[str, int]
    total: int
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    memo: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    classes: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.classes:
            for word, n in self.words.items():
                if n >= LEAST:
                    self.classes.setdefault(signature(word), []).append(word)

    def readings(self, token: str) -> list[tuple[str, float]]:
        """(word, log probability of reading it as ``token``): more frequent words that confusions turn into ``token``."""
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > MAX_SHARED:
                self.memo.clear()
            n = max(LEAST - 1, self.words.get(token, 0))
            found = [(other, cost) for other in self.classes.get(signature(token), ()) if self.words[other] > n and (cost := channel(token, other)) is not None]
            self.memo[token] = known = sorted(found, key=lambda x: (-x[1], x[0]))
        return known

    def log_next(self, before: str | None, word: str, own: int, pair_own: int) -> float:
        """Log likelihood of ``word`` after ``before``, backing off to the word's share; ``own`` and ``pair_own`` are occurrences of
        the place itself, which prove nothing."""
        seen = self.pairs.get((before, word), 0) - pair_own if before is not None else 0
        if seen > 0:
            return math.log(seen / max(seen, self.words.get(before, 0)))
        return math.log(BACKOFF * (max(0, self.words.get(word, 0) - own) + 0.5) / self.total)

    def decode(self, tokens: list[str], at: list[int]) -> dict[int, str]:
        """Viterbi over the readings of the tokens at the places ``at``; the changed places with their words.

        Runs of such places are decoded together with the words on both sides; ``at`` is sorted.
        """
        changed: dict[int, str] = {}
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] == at[j] + 1:
                j += 1
            first, last = at[i], at[j]
            before = tokens[first - 1] if first else None
            states: dict[str | None, tuple[float, list[str]]] = {before: (0.0, [])}
            for place in range(first, last + 1):
                token, previous_token = tokens[place], tokens[place - 1] if place else None
                states = {
                    word: max(
                        (
                            (score + self.log_next(previous, word, word == token, word == token and previous == previous_token) + cost, [*path, word])
                            for previous, (score, path) in states.items()
                        ),
                        key=lambda x: x[0],
                    )
                    for word, cost in [(token, 0.0), *self.readings(token)]
                }
            after = tokens[last + 1] if last + 1 < len(tokens) else None
            ended = ((score + (self.log_next(word, after, 0, word == tokens[last]) if after else 0.0), way) for word, (score, way) in states.items())
            path = max(ended, key=lambda x: x[0])[1]
            changed |= {place: word for place, word in zip(range(first, last + 1), path) if word != tokens[place]}
            i = j + 1
        return changed


class Repair:
    """Finds and undoes the damage of one text at a time."""

    def __init__(self, model: Model):
        self.use(model)
        self.form = Consistent()
        self.titles: dict[str, tuple[re.Pattern, re.Pattern] | None] = {}
        self.headers: dict[str, tuple[str, re.Pattern]] = {}

    def use(self, model: Model) -> None:
        self.model = model
        #: Words seen that have no other reading.
        self.good: set[str] = set()

    def title(self, source: str) -> tuple[re.Pattern, re.Pattern] | None:
        """(title in lower case, whole header)."""
        if source not in self.titles:
            words = title_of(source).split()
            quick = re.compile(r"\s+".join(re.escape(w.lower()) for w in words))
            pattern = r"\s+".join(map(re.escape, words))
            self.titles[source] = (quick, re.compile(f"{_BEFORE_TITLE}(?<!\\w){pattern}(?!\\w){_AFTER_TITLE}", re.I)) if len(words) > 1 else None
        return self.titles[source]

    def header(self, key: str) -> tuple[str, re.Pattern]:
        """(its longest word, pattern in the folded text) of a learned header."""
        if key not in self.headers:
            if len(self.headers) > COMMON:
                self.headers.clear()
            words = [w for w in re.split(r"(#)|\s+", key) if w]
            self.headers[key] = (max((w for w in words if w != "#"), key=len, default=""), re.compile(r"\s*".join(r"\d+" if w == "#" else re.escape(w) for w in words)))
        return self.headers[key]

    def spans(self, text: str, lower: str, source: str | None, page: int | None, headers: Iterable[str]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of headers and page numbers."""
        out: list[tuple[int, int, str]] = []
        if source is not None:
            title = self.title(source)
            if title and title[0].search(lower):
                out += [(m.start(), m.end(), HEADER) for m in title[1].finditer(text)]
            folded = None
            for header in headers:
                folded = folded or lower.translate(FOLD)
                first, pattern = self.header(header)
                if first in folded:
                    out += [(m.start(), m.end(), HEADER) for m in pattern.finditer(folded)]
        number = str(page) if page is not None else None
        if number not in text if number is not None else "\n" not in text:
            return out
        for m in _PAGE_FORMS.finditer(text):
            value = m[m.lastgroup] if m.lastgroup != "h" else m["g"]
            if number is not None and value != number:
                continue
            if m["h"] is not None and int(m["h"]) < int(m["g"]):
                continue
            alone = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() and not text[m.end() :].split("\n", 1)[0].strip()
            if number is None and alone or number is not None and not (m["a"] and _CITED.search(text[max(0, m.start() - 20) : m.start()])):
                out.append((m.start(), m.end(), PAGE))
        if number is not None:
            if "\n" in text:
                out += [(m.start(), m.end(), PAGE) for m in re.finditer(rf"(?m)^[ \t\r]*{number}[ \t\r]*$", text)]
            for start, end, kind in list(out):
                if kind != HEADER:
                    continue
                tail = re.compile(rf"[ \t]*(?:\([^)\n]*\))?[ \t]*(?<=[\s)]){number}(?![\w.,/]*\d|\s*/)").match(text, end)
                if tail:
                    out.append((end, tail.end(), PAGE))
                head = re.search(rf"(?:^|\n)[ \t]*{number}[ \t]+$", text[:start])
                if head:
                    out.append((head.start(), start, PAGE))
                if len(number) > 1 and re.search(rf"(?<!\d){number}$", text[start:end]):
                    out.append((end, end, PAGE))
        return out

    def __call__(self, text: str, source: str | None, page: int | None, headers: Iterable[str], compose: bool = True) -> tuple[str, set[str]]:
        """(repaired text, kinds of damage); without ``compose`` the lines are not joined to paragraphs."""
        return self.finish(*self.prepare(text, source, page, headers), compose)

    def prepare(self, text: str, source: str | None, page: int | None, headers: Iterable[str]) -> tuple[str, set[str]]:
        """(text without headers and page numbers, kinds of damage); needs no counts."""
        text = settle(text, self.form)
        noise: set[str] = set()
        lower = text.lower()
        spans = self.spans(text, lower, source, page, headers)
        if spans:
            noise.update(k for _, _, k in spans)
            kept, done = [], 0
            for start, end, _ in sorted(spans):  # spans may overlap
                kept.append(text[done:start])
                done = max(done, end)
            text = "".join(kept) + text[done:]
            text = re.sub(r"\n[ \t\r]*(?=\n)", "\n", text)
        return text, noise

    def finish(self, text: str, noise: set[str], compose: bool) -> tuple[str, set[str]]:
        """(repaired text, kinds of damage) of a text without page matter."""
        if "-" in text or "¬" in text or "‐" in text:
            text, broken = self.join(text)
            if broken:
                noise.add(HYPHENATION)
        found = set(TOKEN.findall(text.lower())) - self.good
        if found:
            odd = {t for t in found if _LETTER.search(t) and self.model.readings(t)}
            self.good |= found - odd
            if odd:
                text, wrong = self.correct(text, odd)
                if wrong:
                    noise.add(MISREAD)
            if len(self.good) > MAX_SHARED:
                self.good.clear()
        return paragraphs(text) if compose else text, noise

    def known(self, word: str) -> int:
        """Count of a word or of its best reading."""
        lower = word.lower()
        return max([self.model.words.get(lower, 0), *(self.model.words[r] for r, cost in self.model.readings(lower) if cost > -6)])

    def join(self, text: str) -> tuple[str, bool]:
        out, done = [], 0
        for start, end, left, mark, space, right in halves(text):
            if self.splits(left[max(0, done - start) :], mark, space, right):
                out.append(text[done : start + len(left)])
                done = end
        return ("".join(out) + text[done:], True) if done else (text, False)

    def splits(self, left: str, mark: str, space: str, right: str) -> bool:
        """Whether the halves are one word."""
        words = self.model.words
        parts = min(words.get(left.lower(), 0), words.get(right.lower(), 0))
        if not space and mark != "¬":
            # No break is left: only a common word whose halves hardly stand alone.
            return words.get((left + right).lower(), 0) >= max(20, 50 * parts)
        if mark == "¬":
            return True
        whole, compound = self.known(left + right), words.get(f"{left}-{right}".lower(), 0)
        if whole:
            return whole > max(1, compound)
        return parts <= 1 and not compound and ("\n" in space or len(space) > 1)

    def correct(self, text: str, odd: set[str]) -> tuple[str, bool]:
        out, wrong = [], False
        for line in text.split("\n"):
            matches = list(TOKEN.finditer(line))
            tokens = [NUMBER if m[0].isdigit() else m[0].lower() for m in matches]
            at = [i for i, t in enumerate(tokens) if t in odd and not self.punctuated(t)]
            if at:
                changed = self.model.decode(tokens, at)
                if changed:
                    wrong = True
                    for i in sorted(changed, reverse=True):
                        m = matches[i]
                        word = changed[i]
                        word = word.upper() if m[0].isupper() and len(m[0]) > 2 else word[:1].upper() + word[1:] if m[0][:1].isupper() else word
                        line = line[: m.start()] + word + line[m.end() :]
            out.append(line)
        return "\n".join(out), wrong

    def punctuated(self, token: str) -> bool:
        """A word of the vocabulary with signs around it that were not meant as letters."""
        core = token.strip("!|")
        return core != token and self.model.words.get(core, 0) > 0.05 * max(self.model.words[r] for r, _ in self.model.readings(token))


def halves(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, left, mark, space, right) of every mark between two runs of letters; ``end`` is where the right one begins."""
    for m in _MARK.finditer(text):
        begin = m.start()
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_¢!|"):
            begin -= 1
        left, right = _LEFT.search(text, begin, m.start()), _RIGHT.match(text, m.end())
        if left and right:
            yield left.start(), right.start(2), left[0], m[0], right[1], right[2]


class _Fold(dict):
    """``bare`` of single characters, for ``translate``; places stay the same."""

    def __missing__(self, code: int) -> str:
        self[code] = folded = (bare(chr(code)) or " ")[0]
        return folded


FOLD = _Fold()

_BULLET = re.compile(r"\s*(?:[-–•*·]\s|\d+[.)]\s|[a-zA-Z][.)]\s)")


def paragraphs(text: str) -> str:
    """Lines of running text joined; blank lines, bullets and short heading-like lines keep their breaks."""
    if "\n" not in text:
        return re.sub(r"[ \t]+", " ", text).strip()
    lines = [re.sub(r"[ \t\r]+", " ", x).strip() for x in text.split("\n")]
    width = max(map(len, lines))
    out, current = [], ""
    for previous, line in zip(["", *lines], lines):
        if not line:
            if current and current[-1] in ".!?:;":
                out.append(current)
                current = ""
            continue
        begins = _BULLET.match(line) or (len(previous) < 0.6 * width and (not current or current[-1] in ".!?:;" or not line[:1].islower()))
        if current and begins:
            out.append(current)
            current = line
        else:
            current = f"{current} {line}" if current else line
    if current:
        out.append(current)
    return "\n".join(out)


def scanned_records(thresholds: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_table, record_id, source, page, text) of both tables; null texts hold no damage and are left out."""
    first = thresholds.select(F.lit("thresholds_extra").alias("source_table"), F.col("row_id").cast("string").alias("record_id"), F.col("source_file").alias("source"), F.col("page"), F.col("source_text").alias("text"))
    second = documents.select(F.lit("medical_documents").alias("source_table"), F.col("document_id").alias("record_id"), F.col("metadata.source_file").alias("source"), F.col("metadata.page").alias("page"), F.col("content").alias("text"))
    return first.unionByName(second).where(F.col("text").isNotNull())


def learned_headers(counts: DataFrame) -> DataFrame:
    """(source, headers): lines that recur in one source file and hardly anywhere else, and those that begin with them."""
    lines = counts.where("kind = 'h'").select(F.col("a").alias("source"), F.col("b").alias("line"), "n")
    everywhere = lines.groupBy("line").agg(F.sum("n").alias("all_n"), F.max("n").alias("most")).where((F.col("most") >= LINE_MIN) & (F.col("most") >= LINE_OWN * F.col("all_n")))
    kept = lines.join(everywhere, "line").where(F.col("n") == F.col("most")).join(lines.groupBy("source").agg(F.sum("n").alias("own_n")), "source").select("source", "line", "n", "own_n")
    first = kept.where(F.col("n") >= LINE_RATE * F.col("own_n")).select("source", "line")
    words = F.split("line", " ")
    starts = kept.select("source", "line", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("start"))
    longer = starts.join(first.select("source", F.col("line").alias("start")), ["source", "start"], "left_semi").select("source", "line")
    return longer.distinct().groupBy("source").agg(F.sort_array(F.collect_list("line")).alias("headers"))


def signature_column(column: Column) -> Column:
    """:func:`signature` as an expression."""
    table = _canonical()
    for char, several in sorted(table.items()):
        if len(several) > 1:
            column = F.replace(column, F.lit(char), F.lit(several))
    single = {c: o for c, o in table.items() if len(o) == 1 and c != o}
    return F.translate(column, "".join(single), "".join(single.values()))


def confusable(counts: DataFrame) -> DataFrame:
    """(token): words that confusions make of a more frequent word. Candidates meet by their signature; distinct spellings only."""
    words = counts.where("kind = 'w'").select(F.col("a").alias("token"), "n", signature_column(F.col("a")).alias("sig"))
    others = words.where(F.col("n") >= LEAST).select(F.col("token").alias("other"), F.col("n").alias("m"), "sig")

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_LETTER.search(t) is not None and channel(t, o) is not None for t, o in zip(batch["token"], batch["other"])]][["token"]]

    return words.join(others, "sig").where("m > n").select("token", "other").mapInPandas(reachable, "token string").distinct()


def pairs_in_doubt(counts: DataFrame) -> DataFrame:
    """(a, b, n, key): the pairs whose signatures are those of a pair in which a word is confusable; ``key`` are the signatures."""
    key = F.concat_ws(" ", signature_column(F.col("a")), signature_column(F.col("b")))
    pairs = counts.where("kind = 'p'").select("a", "b", "n", key.alias("key"))
    odd = checkpointed(confusable(counts))
    keys = pairs.join(odd.withColumnRenamed("token", "a"), "a", "left_semi").select("key").unionByName(pairs.join(odd.withColumnRenamed("token", "b"), "b", "left_semi").select("key"))
    return pairs.join(keys.distinct(), "key", "left_semi")


def repaired(records: DataFrame, compose: bool = True, max_shared: int = MAX_SHARED) -> DataFrame:
    """(source_table, record_id, paragraphs, noise) of every record: its text repaired and the kinds of damage it had.

    Empty texts stay empty; records with null source or page are repaired as far as that can be told without them.
    Repeated records are repaired alike. Statistics cover all records and all their words; texts are handled whole. Up to
    ``max_shared`` words and pairs the texts are not shuffled.
    """
    counts = checkpointed(corpus_counts(records))
    total = max(1, counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0)
    pairs = checkpointed(pairs_in_doubt(counts))
    vocabulary = counts.where("kind in ('w', 'c')").select(F.col("a").alias("word"), "n")
    headers = checkpointed(learned_headers(counts))
    if headers.count() <= BROADCAST_ROWS:
        headers = F.broadcast(headers)
    joined = records.join(headers, "source", "left").select("source_table", "record_id", "source", "page", "text", "headers")
    few = vocabulary.limit(max_shared + 1).count() + pairs.limit(max_shared + 1).count() <= max_shared
    return _with_all_counts(joined, vocabulary, pairs, total, compose) if few else _with_own_counts(joined, vocabulary, pairs, total, compose)


_REPAIRED = "source_table string, record_id string, paragraphs string, noise array<string>"


def _prepared(engine: Repair, batch: pd.DataFrame) -> list[tuple[str, set[str]]]:
    return [
        engine.prepare(text, source, None if page is None or page != page else int(page), () if known is None else known)
        for text, source, page, known in zip(batch["text"], batch["source"], batch["page"], batch["headers"])
    ]


def _with_all_counts(records: DataFrame, vocabulary: DataFrame, pairs: DataFrame, total: int, compose: bool) -> DataFrame:
    """Few counts: all of them go to every task."""
    words = {r[0]: r[1] for r in vocabulary.collect()}
    shared = records.sparkSession.sparkContext.broadcast((words, total, {(r[0], r[1]): r[2] for r in pairs.select("a", "b", "n").collect()}))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = Repair(Model(*shared.value))
        for batch in batches:
            done = [engine.finish(text, noise, compose) for text, noise in _prepared(engine, batch)]
            yield pd.DataFrame({"source_table": batch["source_table"], "record_id": batch["record_id"], "paragraphs": [d[0] if compose else None for d in done], "noise": [sorted(d[1]) for d in done]})

    return records.mapInPandas(fix, _REPAIRED)


def _with_own_counts(records: DataFrame, vocabulary: DataFrame, pairs: DataFrame, total: int, compose: bool) -> DataFrame:
    """Many counts: each text is joined with those of its own words and pairs.

    A text asks for the signatures of its words, of the halves beside its marks and of its neighbouring words; common words
    without another reading are left out before anything is shuffled, so that no hot word is joined. The other side of the
    join has one row per signature.
    """
    classes = vocabulary.where(~F.col("word").contains("-")).groupBy(signature_column(F.col("word")).alias("key")).agg(F.collect_list(F.struct("word", F.lit("").alias("b"), "n")).alias("facts"))
    compounds = vocabulary.where(F.col("word").contains("-")).select(F.col("word").alias("key"), F.array(F.struct("word", F.lit("").alias("b"), "n")).alias("facts"))
    near = pairs.groupBy("key").agg(F.collect_list(F.struct(F.col("a").alias("word"), "b", "n")).alias("facts"))
    facts = classes.unionByName(compounds).unionByName(near)
    # Words alone in their class have no other reading; so many of the most frequent of them are known to every task.
    alone = classes.where(F.size("facts") == 1).select(F.col("facts")[0]["word"].alias("word"), F.col("facts")[0]["n"].alias("n"))
    common = records.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in alone.orderBy(F.desc("n"), "word").limit(COMMON).collect()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, known = Repair(Model({}, total)), common.value
        for batch in batches:
            out: dict[str, list] = {"source_table": [], "record_id": [], "text": [], "noise": [], "keys": []}
            for table, record, (text, noise) in zip(batch["source_table"], batch["record_id"], _prepared(engine, batch)):
                keys: set[str] = set()
                joined = text
                for start, end, left, _, _, right in reversed(list(halves(text))):
                    keys |= {signature(left.lower()), signature(right.lower()), signature((left + right).lower()), f"{left}-{right}".lower()}
                    joined = joined[: start + len(left)] + joined[end:]
                for version in {text, joined}:
                    for line in version.split("\n"):
                        tokens = words_of(line.lower())
                        signs = [None if t in known else signature(t) for t in tokens]
                        keys.update(s for s in signs if s)
                        keys.update(f"{a or signature(t)} {b or signature(u)}" for (t, a), (u, b) in zip(zip(tokens, signs), zip(tokens[1:], signs[1:])) if a or b)
                for column, value in zip(out, (table, record, text, sorted(noise), sorted(keys))):
                    out[column].append(value)
            yield pd.DataFrame(out)

    asked = checkpointed(records.mapInPandas(ask, "source_table string, record_id string, text string, noise array<string>, keys array<string>"))
    me = ["source_table", "record_id", "text_hash"]
    asked = asked.withColumn("text_hash", F.xxhash64("text"))
    wanted = asked.select(*me, F.explode("keys").alias("key")).distinct()
    answers = wanted.join(facts, "key").select(*me, F.explode("facts").alias("fact")).groupBy(*me).agg(F.collect_set("fact").alias("facts"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = Repair(Model({}, total))
        for batch in batches:
            done = []
            for text, noise, found in zip(batch["text"], batch["noise"], batch["facts"]):
                found = [] if found is None else found
                words = {t: n for t in {NUMBER, *TOKEN.findall(text.lower())} if (n := common.value.get(t))}
                words |= {f["word"]: f["n"] for f in found if not f["b"]}
                engine.use(Model(words, total, {(f["word"], f["b"]): f["n"] for f in found if f["b"]}))
                done.append(engine.finish(text, set(noise), compose))
            yield pd.DataFrame({"source_table": batch["source_table"], "record_id": batch["record_id"], "paragraphs": [d[0] if compose else None for d in done], "noise": [sorted(d[1]) for d in done]})

    return asked.join(answers, me, "left").select("source_table", "record_id", "text", "noise", "facts").mapInPandas(fix, _REPAIRED)


def scan_damage(records: DataFrame) -> DataFrame:
    """(source_table, record_id, noise): each kind of damage of each record once."""
    return repaired(records, compose=False).select("source_table", "record_id", F.explode("noise").alias("noise")).distinct()
