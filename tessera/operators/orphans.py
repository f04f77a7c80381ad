"""References to records that do not exist (problem 3).

Keys are dictionary-encoded per key range, and facts about them (referenced in a month, came into being in a month,
ended in a month) become compressed bitmaps, one per key range and month. ``reference AND NOT parent`` then discards nearly
all references; the surviving bits are decoded and their references checked exactly.

Scale: the facts of a key are merged on the map side into one row (at most three facts a month), so a key that holds a third
of all references is shuffled once per task. Key ranges are hash ranges; a range is sorted (spilling if needed) and streamed,
never collected. A block of a range covers 65,536 keys and has at most three containers a month.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

REF, BORN, ENDED = "r", "b", "e"
#: Month of facts without a time: before any month.
ALWAYS = "0000-00"
MONTH = "yyyy-MM"
BLOCK_BITS = 65536
#: A container of up to this many keys is a sorted array, a larger one a bitmap of the same size in bytes.
ARRAY_LIMIT = 4096


def _month(column: str):
    return F.coalesce(F.date_format(F.col(column), MONTH), F.lit(ALWAYS))


class Container:
    """A set of 16-bit codes, as a sorted array where it is sparse and as a bitmap where it is dense."""

    __slots__ = ("array", "bits")

    def __init__(self, codes: np.ndarray | None = None, bits: np.ndarray | None = None):
        """``codes`` are sorted and distinct."""
        if bits is not None:
            codes = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint16)
        self.array: np.ndarray | None = codes.astype(np.uint16)
        self.bits: np.ndarray | None = None
        if len(codes) > ARRAY_LIMIT:
            self.bits = bits if bits is not None else np.packbits(np.bincount(codes, minlength=BLOCK_BITS).astype(bool), bitorder="little")
            self.array = None

    def codes(self) -> np.ndarray:
        return self.array if self.array is not None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)

    def __or__(self, other: Container) -> Container:
        if self.array is not None and other.array is not None:
            return Container(np.union1d(self.array, other.array))
        return Container(bits=self._dense() | other._dense())

    def andnot(self, other: Container) -> Container:
        if self.array is not None:
            return Container(self.array[~other.has(self.array)])
        return Container(bits=self._dense() & ~other._dense())

    def has(self, codes: np.ndarray) -> np.ndarray:
        if self.array is not None:
            return np.isin(codes, self.array, assume_unique=True)
        return (self.bits[codes >> 3] >> (codes & 7).astype(np.uint8)) & 1 == 1

    def _dense(self) -> np.ndarray:
        return self.bits if self.bits is not None else np.packbits(np.bincount(self.array, minlength=BLOCK_BITS).astype(bool), bitorder="little")


def _survivors(kinds: np.ndarray, months: np.ndarray, codes: np.ndarray) -> list[tuple[int, str]]:
    """(code, month) of references AND NOT parents alive all through the month, of one block's facts."""
    sets: dict[str, dict[str, Container]] = {}
    order = np.lexsort((codes, kinds, months))
    kinds, months, codes = kinds[order], months[order], codes[order]
    starts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (months[1:] != months[:-1])) + 1), len(codes)]
    for start, end in zip(starts, starts[1:]):
        if end > start:
            sets.setdefault(months[start], {})[kinds[start]] = Container(codes[start:end])
    born = ended = Container(np.zeros(0, np.uint16))
    out = []
    for month in sorted(sets):
        here = sets[month]
        ended = ended | here[ENDED] if ENDED in here else ended
        if BORN in here and month == ALWAYS:
            born = born | here[BORN]
        if REF in here:
            out += [(int(c), month) for c in here[REF].andnot(born.andnot(ended)).codes()]
        if BORN in here:
            born = born | here[BORN]
    return out


def orphan_candidates(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(space, key, month): keys referenced in a month through all of which no parent is known to be alive.

    refs: (space, key, at); parents: (space, key, born, ended). A superset of the orphans: a parent that comes or
    goes within the month leaves its bit set.
    """
    fact = lambda df, kind, at: df.select("space", "key", F.concat(F.lit(kind), _month(at)).alias("fact"))
    facts = fact(refs, REF, "at").unionByName(fact(parents, BORN, "born")).unionByName(fact(parents.where(F.col("ended").isNotNull()), ENDED, "ended"))
    # One row per key, hash ranges of keys as partitions; keys without a reference can't be orphans.
    keys = facts.where(F.col("key").isNotNull()).groupBy("space", "key").agg(F.collect_set("fact").alias("facts")).where(F.exists("facts", lambda f: f.startswith(REF)))
    ordered = keys.sortWithinPartitions("space", "key")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: list[str] = []
        names: list[str] = []  # the dictionary of the block: a key's code is its place
        facts: list[tuple[str, str, int]] = []

        def block() -> pd.DataFrame:
            kinds, months, codes = (np.array(x) for x in zip(*facts))
            found = _survivors(kinds, months, codes)
            frame = pd.DataFrame({"space": [spaces[c] for c, _ in found], "key": [names[c] for c, _ in found], "month": [m for _, m in found]}, dtype=object)
            for part in (spaces, names, facts):
                part.clear()
            return frame

        for batch in batches:
            for space, key, own in zip(batch["space"], batch["key"], batch["facts"]):
                facts.extend((f[0], f[1:], len(names)) for f in own)
                spaces.append(space)
                names.append(key)
                if len(names) == BLOCK_BITS:
                    yield block()
        if facts:
            yield block()

    return ordered.mapInPandas(scan, "space string, key string, month string")


def _lives(parents: DataFrame) -> DataFrame:
    """(space, key, lives, first_end): disjoint spans of time (born, ended) in order in which a key has a living version, and when one ended first.

    Versions that came at the same time are merged on the map side. A null ``born`` is before any time, a null ``ended`` after any.
    """
    never, always = F.lit("9999-12-31 00:00:00").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")
    filled = parents.select("space", "key", F.coalesce("born", always).alias("born"), F.coalesce("ended", never).alias("last"), F.col("ended").alias("first"))
    merged = filled.groupBy("space", "key", "born").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    spans = merged.groupBy("space", "key").agg(F.array_sort(F.collect_list(F.struct("born", "last"))).alias("spans"), F.min("first").alias("first_end"))
    empty = F.array().cast("array<struct<born:timestamp,last:timestamp>>")

    def add(done, span):
        previous = F.element_at(done, -1)
        longer = F.slice(done, 1, F.size(done) - 1)
        wider = F.array(F.struct(previous["born"].alias("born"), F.greatest(previous["last"], span["last"]).alias("last")))
        return F.when((F.size(done) > 0) & (span["born"] <= previous["last"]), F.concat(longer, wider)).otherwise(F.concat(done, F.array(span)))

    return spans.select("space", "key", F.aggregate("spans", empty, add).alias("lives"), "first_end")


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_table, ref_id, target_id, reason, period): every reference without a living parent, once.

    refs: (ref_table, ref_id, space, key, at); parents: (space, key, born, ended), where ``space`` separates key
    spaces. The reason is ``missing`` (no such key), ``deleted`` (the parent had ended at or before ``at``) or ``late``
    (it came into being after ``at``). Keys are compared exactly. A null key refers to nothing; a null ``born`` means
    always there, a null ``ended`` still there; a reference with a null time is checked against existence only and has
    a null period. Of several versions of a parent one living version is enough; else ``deleted`` wins over ``late``.
    Repeated rows count once, empty tables give an empty report.

    The candidates are written once. Each key's versions are merged to spans before they meet its references, so that no
    reference is paired with each version; a key has one row on that side of the join.
    """
    refs = refs.select("ref_table", "ref_id", "space", "key", "at")
    parents = parents.select("space", "key", "born", "ended").where(F.col("key").isNotNull())
    candidates = checkpointed(orphan_candidates(refs, parents))
    suspects = refs.withColumn("month", _month("at")).join(candidates, ["space", "key", "month"]).distinct()
    lives = _lives(parents.join(candidates.select("space", "key").distinct(), ["space", "key"], "left_semi"))
    checked = suspects.join(lives, ["space", "key"], "left")
    at = F.col("at")
    alive = F.col("lives").isNotNull() & (at.isNull() | F.exists("lives", lambda s: (s["born"] <= at) & (at < s["last"])))
    reason = F.when(F.col("lives").isNull(), "missing").when(F.col("first_end") <= at, "deleted").otherwise("late")
    return checked.where(~alive).select("ref_table", "ref_id", F.col("key").alias("target_id"), reason.alias("reason"), F.date_format("at", MONTH).alias("period")).distinct()


def knowledge_orphans(qa: DataFrame, documents: DataFrame, thresholds: DataFrame, formulas: DataFrame) -> DataFrame:
    """:func:`orphan_report` of the evaluation cases and of the indexed documents."""
    none = F.lit(None).cast("timestamp")
    case_refs = qa.select(F.lit("threshold_qa").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("document").alias("space"), F.explode("relevant_document_ids").alias("key"), F.col("asked_at").cast("timestamp").alias("at"))
    doc_refs = documents.where(F.col("source_type").isin("threshold", "formula")).select(
        F.lit("medical_documents").alias("ref_table"), F.col("document_id").alias("ref_id"), F.col("source_type").alias("space"), F.col("source_id").alias("key"), F.col("created_at").cast("timestamp").alias("at")
    )
    parents = documents.select(F.lit("document").alias("space"), F.col("document_id").alias("key"), F.col("created_at").cast("timestamp").alias("born"), F.col("deleted_at").cast("timestamp").alias("ended"))
    parents = parents.unionByName(thresholds.select(F.lit("threshold").alias("space"), F.col("threshold_id").alias("key"), none.alias("born"), none.alias("ended")))
    parents = parents.unionByName(formulas.select(F.lit("formula").alias("space"), F.col("formula_id").alias("key"), none.alias("born"), none.alias("ended")))
    return orphan_report(case_refs.unionByName(doc_refs).where(F.col("key").isNotNull()), parents)
