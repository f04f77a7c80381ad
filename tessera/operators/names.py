"""Freely typed names to the entries of a reference list.

The distinct names are found first (combined on the map side), so each is searched once, however often it was typed. A
search walks a trie of the reference entries with a Levenshtein automaton and gives every entry within the distance that
the entry's length allows; aliases, other languages, turned word order and the usual additions are further paths to the
same entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.characters import compose, to_latin
from tessera.functions.plain import bare, one_line
from tessera.operators.automaton import Trie

UNMATCHED = "unmatched"
#: Largest number of reference rows that is sent to every task.
MAX_REFERENCE = 100_000
#: Words put before or after a name on request forms, without accents.
BEFORE = ("xet nghiem", "chi so", "dinh luong", "nong do", "xn", "test", "kq")
AFTER = ("result", "level", "test", "mau")
_REPEAT = re.compile(r" (?:lan|dot|no|so) \d+$")
_BRACKETS = re.compile(r"[(\[{]([^)\]}]*)[)\]}]?")
_PUNCTUATION = re.compile(r"[^\w+]|_")


def normal(name: str) -> str:
    """Comparable form of a name: no accents, case, punctuation, look-alikes or invisible characters."""
    text = name if name.isascii() else to_latin(compose(name))
    return one_line(_PUNCTUATION.sub(" ", bare(text)))


def allowed(length: int) -> int:
    """Errors allowed for a reference form of this length: none up to 3 characters, then one, two from 7, three from 12."""
    return 0 if length <= 3 else 1 if length <= 6 else 2 if length <= 11 else 3


def reach(length: int) -> int:
    """Most errors with which a typed form of this length may be meant: an entry may be longer by its own errors."""
    return max((d for d in range(1, allowed(1 << 30) + 1) if d <= allowed(length + d)), default=0)


def turned(form: str) -> list[str]:
    """The form and its rotations by one word in either direction."""
    words = form.split(" ")
    return [form] if len(words) < 2 else list(dict.fromkeys([form, " ".join(words[-1:] + words[:-1]), " ".join(words[1:] + words[:1])]))


class NameMatcher:
    """Finds the reference entries that a typed name may mean. ``rows``: (id, canonical, names and aliases)."""

    def __init__(self, rows: list[tuple[int, str, list[str]]]):
        self.canonical = {i: c for i, c, _ in rows}
        entries: dict[tuple[str, int], None] = {}
        for i, canonical, names in rows:
            for name in (canonical, *names):
                form = normal(name)
                if form:
                    for path in turned(form):
                        entries[(path, i)] = None
        self.trie = Trie(entries)

    def variants(self, name: str) -> list[str]:
        """Forms to look for, the most telling first."""
        text = name if name.isascii() else compose(name)
        inside = [normal(x) for x in _BRACKETS.findall(text)]
        outside = normal(_BRACKETS.sub(" ", text))
        found = [outside, normal(text)] if inside else [outside]
        for form in list(found):
            cut = _REPEAT.sub("", form)
            for word in BEFORE:
                if cut.startswith(word + " "):
                    found.append(cut[len(word) + 1 :])
            for word in AFTER:
                if cut.endswith(" " + word):
                    found.append(cut[: -len(word) - 1])
            found.append(cut)
        return [x for x in dict.fromkeys([*found, *inside]) if x]

    def entries(self, name: str) -> list[tuple[int, int]]:
        """(distance, id) of every entry within the distance that its length allows of any form of the name, the pick first.

        A form that is an entry's own comes before forms with errors, an earlier form's before a later one's; of equal
        distances the smallest id is picked.
        """
        least: dict[int, int] = {}
        exact: int | None = None
        for form in self.variants(name):
            for distance, path, i in self.trie.search(form, reach(len(form))):
                if distance <= allowed(len(path)):
                    least[i] = min(distance, least.get(i, distance))
            if exact is None and (own := self.trie.exact(form)):
                exact = min(i for _, i in own)
        return sorted(((d, i) for i, d in least.items()), key=lambda x: (x[1] != exact, x))

    def match(self, name: str) -> str:
        found = self.entries(name)
        return self.canonical[found[0][1]] if found else UNMATCHED


def reference_rows(reference: DataFrame) -> list[tuple[int, str, list[str]]]:
    """The reference list on the driver; refused beyond :data:`MAX_REFERENCE` rows, as it goes to every task."""
    rows = reference.select("biomarker_id", "biomarker", "name_vi", "name_en", "aliases").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows; split it by first letter and search the parts")
    return [(r[0], r[1], [x for x in (r[2], r[3], *(r[4] or [])) if x]) for r in rows if r[1]]


def closest_entries(names: DataFrame, reference: DataFrame, column: str = "name") -> DataFrame:
    """(name, biomarker, distance, picked): every entry that each distinct non-null name may mean; one of them is ``picked``.

    A name with no entry close enough, as an empty one, has one row, ``unmatched`` with a null distance. The names are
    spread over all tasks by number, as their search takes time and not space.
    """
    rows = reference_rows(reference)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = NameMatcher(rows)
        for batch in batches:
            out: list[tuple[str, str, int | None, bool]] = []
            for name in batch["name"]:
                found = matcher.entries(name)
                out += [(name, matcher.canonical[i], d, k == 0) for k, (d, i) in enumerate(found)] or [(name, UNMATCHED, None, True)]
            frame = pd.DataFrame(out, columns=["name", "biomarker", "distance", "picked"])
            frame["distance"] = frame["distance"].astype("Int32")
            yield frame

    distinct = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of the name: a repartitioning by the name itself would be dropped as redundant and its partitions merged by size.
    return distinct.repartition(parts, F.xxhash64("name")).mapInPandas(search, "name string, biomarker string, distance int, picked boolean")


def resolve_names(names: DataFrame, reference: DataFrame, column: str = "name") -> DataFrame:
    """(name, biomarker) of each distinct non-null name in ``column``: the entry picked of :func:`closest_entries`."""
    return closest_entries(names, reference, column).where("picked").select("name", "biomarker")
