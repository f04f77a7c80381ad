"""One consistent form for texts that look alike but differ in characters (problem 6).

Spaces, invisible characters, compatibility forms and decomposed accents are settled per character. A token with
letters of another alphabet or other look-alikes walks the trie of the corpus vocabulary with a weighted edit automaton in
which a look-alike and an ignorable cost nothing; the most frequent spelling it shows is its canonical one. A token that
the vocabulary does not show is settled by the look-alike table.

The vocabulary is that of all texts. A token and the words it may show have the same skeleton, so they meet in an
equi-join, each skeleton's words in a trie of their own; no task holds the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.characters import IGNORABLE, LOOKALIKES, NOT_RUSSIAN, SYMBOLS, TO_CYRILLIC, TOKEN, _SPACES, script
from tessera.session import checkpointed

#: Spellings of tokens up to which they are sent to every task; beyond that they are joined to the texts.
MAX_SHARED = 200_000
#: Costs of the automaton: a look-alike or an ignorable character costs nothing, any other edit one.
EDIT = 1.0
#: A spelling is taken up to this cost, so that no letter is changed into one that doesn't look like it.
LIMIT = 0.5
#: Counters of a task are handed on when they have this many entries.
FLUSH = 1_000_000

#: Letters by the Latin letter they look like, lower case.
_SHOWS: dict[str, frozenset[str]] = {}


def shows(char: str) -> frozenset[str]:
    """Lower-case letters that a character may stand for: itself, the Latin letter it looks like and what else looks like that."""
    known = _SHOWS.get(char)
    if known is None:
        latin = LOOKALIKES.get(char, char)
        twins = {char.casefold(), latin.casefold()}
        for letter in (latin, char):
            if letter in TO_CYRILLIC:
                twins.add(TO_CYRILLIC[letter].casefold())
        _SHOWS[char] = known = frozenset(twins)
    return known


def skeleton(word: str) -> str:
    """Equal for a word and every token that shows it: look-alikes as Latin letters, lower case, accents and ignorables off."""
    letters = (c for c in unicodedata.normalize("NFKD", word) if c not in IGNORABLE and not unicodedata.combining(c))
    return "".join(LOOKALIKES.get(c, c) for c in letters).casefold().translate(_LOWER_LATIN)


_LOWER_LATIN = str.maketrans({k.casefold(): v.casefold() for k, v in LOOKALIKES.items()})


class LookalikeTrie:
    """Vocabulary words, decomposed and in lower case, with their counts."""

    def __init__(self, words: Mapping[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for char in unicodedata.normalize("NFKD", word.casefold()):
                node = node.setdefault(char, {})
            node[""] = node.get("", 0) + n

    def search(self, token: str, limit: float = LIMIT) -> list[tuple[float, str, int]]:
        """(cost, decomposed word, count) of every word within ``limit`` of the decomposed ``token``."""
        size = len(token)
        drop = [0.0 if c in IGNORABLE else EDIT for c in token]
        row = [0.0]
        for cost in drop:
            row.append(row[-1] + cost)
        found, stack = [], [(self.root, "", row)]
        while stack:
            node, path, row = stack.pop()
            if "" in node and row[-1] <= limit:
                found.append((row[-1], path, node[""]))
            for char, following in node.items():
                if not char:
                    continue
                new = [row[0] + EDIT]
                for i in range(size):
                    match = 0.0 if char in shows(token[i]) else EDIT
                    new.append(min(row[i] + match, row[i + 1] + EDIT, new[i] + drop[i]))
                if min(new) <= limit:
                    stack.append((following, path + char, new))
        return sorted(found)


def letters_of(token: str) -> list[str]:
    return [c for c in token if not unicodedata.combining(c) and c not in IGNORABLE]


def in_doubt(token: str) -> bool:
    """Whether a decomposed token has letters of another alphabet or look-alikes; Greek letters as symbols are not in doubt."""
    letters = letters_of(token)
    if not any(c in LOOKALIKES or script(c) in "CGA" for c in letters):
        return False
    return len(letters) > 1 or script(letters[0]) != "G" or (letters[0] in LOOKALIKES and letters[0] not in SYMBOLS)


def genuine_text(tokens: Iterable[str]) -> bool:
    """Whether a text has words that are surely of another alphabet."""
    return any(script(c) in "CA" and c not in LOOKALIKES for t in tokens for c in t)


def spell(token: str, word: str) -> str:
    """``word`` in the case of the decomposed ``token`` that shows it."""
    out, place = [], 0
    for char in token:
        if char in IGNORABLE:
            continue
        target = word[place] if place < len(word) else ""
        place += 1
        options = [char, LOOKALIKES.get(char, char), TO_CYRILLIC.get(char, char), TO_CYRILLIC.get(LOOKALIKES.get(char, char), char)]
        out.append(next((o for o in options if o.casefold() == target), target.upper() if char.isupper() else target))
    return "".join(out)


def canonical(tries: Sequence[LookalikeTrie | None], token: str) -> str | None:
    """The canonical spelling of a decomposed token in doubt: the most frequent of the cheapest words that the first of the
    ``tries`` with any shows; None where none does, and for a Greek letter alone, which every case of it would show."""
    letters = letters_of(token)
    if len(letters) == 1 and script(letters[0]) == "G":
        return None
    for trie in tries:
        hits = trie.search(token) if trie else []
        if hits:
            return spell(token, max((h for h in hits if h[0] == hits[0][0]), key=lambda h: (h[2], h[1]))[1])
    return None


class Consistent:
    """Brings one text at a time to its consistent form.

    ``spellings`` gives the canonical spelling of (token in doubt, genuine); ``vocabulary`` does so by the tries of its words:
    first those of texts that surely have words of another alphabet (True) or not (False), as the text itself.
    """

    def __init__(self, vocabulary: Mapping[bool, Mapping[str, int]] | None = None, spellings: Mapping[tuple[str, bool], str] | None = None):
        self.tries = {g: LookalikeTrie(words) for g, words in (vocabulary or {}).items()}
        self.spellings = spellings or {}
        self.latin = str.maketrans(LOOKALIKES)
        self.cyrillic = str.maketrans(TO_CYRILLIC)

    def token(self, token: str, genuine: bool) -> str:
        """``genuine``: the text has words that are surely of another alphabet. ``token`` is decomposed."""
        if not in_doubt(token):
            return token
        spelling = self.spellings.get((token, genuine))
        if spelling is None and self.tries:
            spelling = canonical([self.tries.get(genuine), self.tries.get(not genuine)], token)
        return self.by_table(token, genuine) if spelling is None else spelling

    def by_table(self, token: str, genuine: bool) -> str:
        letters = letters_of(token)
        scripts = [script(c) for c in letters]
        others, latin = sum(s in "CGA" for s in scripts), scripts.count("L")
        shown = all(s not in "CGA" or c in LOOKALIKES for c, s in zip(letters, scripts))
        if latin:
            twins = any(s == "C" for s in scripts) and all(c in TO_CYRILLIC or s == "C" for c, s in zip(letters, scripts))
            marked = any(unicodedata.combining(c) and c not in "\u0306\u0308" for c in token)
            if shown and (not genuine or latin >= others or not twins or marked or any(c in NOT_RUSSIAN for c in letters)):
                return token.translate(self.latin)
            return token.translate(self.cyrillic) if twins else token
        if not shown or (len(letters) == 1 and letters[0] in SYMBOLS):
            return token
        return token.translate(self.latin) if not genuine or any(c in NOT_RUSSIAN for c in letters) else token

    def tokens(self, text: str) -> tuple[str, set[str], bool]:
        """(text with its characters settled, decomposed; its tokens in doubt; whether it has words surely of another alphabet)."""
        spread = unicodedata.normalize("NFKD", text.translate(_SPACES))
        tokens = {t for t in TOKEN.findall(spread) if in_doubt(t)} if not spread.isascii() else set()
        return spread, tokens, genuine_text(tokens)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        spread, tokens, genuine = self.tokens(text)
        changed = {t: n for t in tokens if (n := self.token(t, genuine)) != t}
        if changed:
            spread = TOKEN.sub(lambda m: changed.get(m[0], m[0]), spread)
        return unicodedata.normalize("NFC", spread)


#: Characters that every consistent form may have: ASCII, composed Latin letters, and symbols that stand for themselves.
_PLAIN = (
    "\x00-\x7f\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0130\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    "\u01a0\u01a1\u01af\u01b0\u1ea0-\u1ef9\u2010\u2012-\u2016\u2018-\u201f\u2020-\u2022\u20ac\u2190-\u21ff\u2264\u2265\u25a0-\u25ffαβγδμπΔΩ"
)
_CHANGES = re.compile(f"[^{_PLAIN}]")


def may_change(text: Column) -> Column:
    """False only for texts that are surely in their consistent form; decided in the scan's stage."""
    return text.rlike(f"[^{_PLAIN}]")


def corpus_words(values: DataFrame) -> DataFrame:
    """(word, skeleton, doubt, genuine, n): words of all texts and tokens in doubt, with their counts in texts that surely have
    words of another alphabet (``genuine``) and in others.

    values: (text). Words of another alphabet count in the former texts only, tokens of mixed letters never. Each task counts
    for itself, so what is shuffled has the size of the vocabulary.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Consistent()
        words: Counter = Counter()
        others: Counter = Counter()

        def out() -> Iterator[pd.DataFrame]:
            rows = [(w, False, False, n) for w, n in words.items()] + [(*k, n) for k, n in others.items()]
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pd.DataFrame({"word": [r[0] for r in part], "skeleton": [skeleton(r[0]) for r in part], "doubt": [r[1] for r in part], "genuine": [r[2] for r in part], "n": [r[3] for r in part]})
            words.clear()
            others.clear()

        for batch in batches:
            for text in batch["text"]:
                if text.isascii() or not _CHANGES.search(text):
                    words.update(_WORD.findall(text.lower()))
                    continue
                spread, tokens, genuine = form.tokens(text)
                for token in TOKEN.findall(spread):
                    if token in tokens:
                        others[token, True, genuine] += 1
                        if not genuine or not all(script(c) in "CA" for c in letters_of(token)):
                            continue
                    others[unicodedata.normalize("NFC", token.lower()), False, genuine] += 1
            if len(words) + len(others) > FLUSH:
                yield from out()
        yield from out()

    parts = values.select("text").mapInPandas(count, "word string, skeleton string, doubt boolean, genuine boolean, n long")
    return parts.groupBy("word", "skeleton", "doubt", "genuine").agg(F.sum("n").alias("n"))


#: Tokens of texts that have no decomposed letters.
_WORD = re.compile(r"[^\W\d_]+")


def canonical_spellings(counts: DataFrame) -> DataFrame:
    """(token, genuine, spelling) of the tokens in doubt that the vocabulary shows; counts: as of :func:`corpus_words`.

    Only words that share a skeleton with a token in doubt are brought together with it, in one sorted pass over each
    partition of skeletons; a skeleton has few spellings.
    """
    doubts = counts.where("doubt")
    words = counts.where("not doubt").join(doubts.select("skeleton").distinct(), "skeleton", "left_semi").groupBy("skeleton", "word", "doubt", "genuine").agg(F.sum("n").alias("n"))
    both = words.unionByName(doubts.select("skeleton", "word", "doubt", "genuine", "n"))
    ordered = both.repartition("skeleton").sortWithinPartitions("skeleton", "doubt", "word", "genuine")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: str | None = None
        vocabulary: dict[bool, dict[str, int]] = {}
        tries: dict[bool, LookalikeTrie] = {}
        for batch in batches:
            out: list[tuple[str, bool, str]] = []
            for key, word, doubt, genuine, n in zip(batch["skeleton"], batch["word"], batch["doubt"], batch["genuine"], batch["n"]):
                if key != current:
                    current, vocabulary, tries = key, {}, {}
                if not doubt:
                    vocabulary.setdefault(bool(genuine), {})[word] = n
                elif vocabulary:
                    tries = tries or {g: LookalikeTrie(words) for g, words in vocabulary.items()}
                    if (found := canonical([tries.get(bool(genuine)), tries.get(not genuine)], word)) is not None:
                        out.append((word, bool(genuine), found))
            yield pd.DataFrame(out, columns=["token", "genuine", "spelling"])

    return ordered.mapInPandas(walk, "token string, genuine boolean, spelling string")


def consistent_texts(df: DataFrame, id_column: str, fields: Sequence[str], vocabulary: DataFrame | None = None, max_shared: int = MAX_SHARED) -> DataFrame:
    """(id, field, text, consistent) of the non-null values of ``fields`` that are not in their consistent form.

    Empty texts are consistent. Ids may repeat: each row is reported. Words of all values and those of ``vocabulary``
    (word, n) make up the vocabulary. Up to ``max_shared`` spellings go to every task; more are joined to the texts that
    have their tokens, with the same rows.
    """
    every = F.array(*(F.col(f"`{f}`") for f in fields))
    counts = corpus_words(df.select(F.explode(every).alias("text")).where("text is not null"))
    if vocabulary is not None:

        def reference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["skeleton"] = [skeleton(w) for w in batch["word"]]
                yield batch

        more = vocabulary.select("word", "n").mapInPandas(reference, "word string, n long, skeleton string")
        counts = counts.unionByName(more.select("word", "skeleton", F.lit(False).alias("doubt"), F.lit(False).alias("genuine"), "n"))
    spellings = checkpointed(canonical_spellings(checkpointed(counts)))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.when(may_change(F.col(f"`{f}`")), F.col(f"`{f}`")).alias("text")) for f in fields))
    values = df.select(F.col(f"`{id_column}`").alias("id"), F.inline(F.filter(pairs, lambda p: p["text"].isNotNull())))
    schema = f"id {dict(df.dtypes)[id_column]}, field string, text string, consistent string"
    if spellings.limit(max_shared + 1).count() <= max_shared:
        shared = df.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in spellings.collect()})

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            form = Consistent(spellings=shared.value)
            for batch in batches:
                batch["consistent"] = [form(t) for t in batch["text"]]
                yield batch[batch["text"] != batch["consistent"]]

        return values.mapInPandas(settle, schema)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Consistent()
        for batch in batches:
            found = [form.tokens(t) for t in batch["text"]]
            batch["tokens"] = [sorted(f[1]) for f in found]
            batch["genuine"] = [f[2] for f in found]
            yield batch

    def settle_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = [{(p["token"], p["genuine"]): p["spelling"] for p in found} if found is not None else {} for found in batch["found"]]
            batch["consistent"] = [Consistent(spellings=k)(t) for t, k in zip(batch["text"], known)]
            yield batch.loc[batch["text"] != batch["consistent"], ["id", "field", "text", "consistent"]]

    asked = values.mapInPandas(ask, f"id {dict(df.dtypes)[id_column]}, field string, text string, tokens array<string>, genuine boolean").withColumn("hash", F.xxhash64("text"))
    me = ["id", "field", "hash"]
    answers = asked.select(*me, "genuine", F.explode("tokens").alias("token")).distinct().join(spellings, ["token", "genuine"]).groupBy(*me).agg(F.collect_set(F.struct("token", "genuine", "spelling")).alias("found"))
    return asked.join(answers, me, "left").select("id", "field", "text", "found").mapInPandas(settle_own, schema)


def reference_words(reference: DataFrame) -> DataFrame:
    """(word, n): the words of the biomarker reference list."""
    names = reference.select(F.lower(F.concat_ws(" ", "biomarker", "name_vi", "name_en", F.array_join("aliases", " "))).alias("t"))
    return names.select(F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
