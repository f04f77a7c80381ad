"""Records that differ in formatting only (problem 4).

Every record becomes one canonical string: case, white space and punctuation of the free texts removed, named fields
sorted, all other columns as they are. It is hashed to 128 bits, with 64 further bits as collision check, and counted
with map-side combining. All of it is built-in expressions; the texts themselves never leave the scan's stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: A bullet or quote before the text.
_LEAD = r"^[\s\p{Z}\"'“”«»({\[•*·]*[-–—]?[\s\p{Z}]+(?=\S)|^[\s\p{Z}\"'“”«»({\[•*·]+"
#: What carries no content: white space; marks that are not part of a number, a range or a unit; other punctuation.
_NOISE = (
    r"[\s\p{Z}]+"
    r"|(?<![0-9])[.,:]|[.,:](?![0-9])"
    r"|[-–—‐‑](?![\s\p{Z}]{0,3}[0-9])|(?<=\p{L})[-–—‐‑]|(?<=[^0-9\s\p{Z}][\s\p{Z}]{1,3})[-–—‐‑](?=[\s\p{Z}])"
    r"|[\p{P}&&[^%/.,:\-–—‐‑‰]]|[|`´¨]"
)
_SEPARATOR = r"[;|]|\n[\s\p{Z}]*[•*·\-–][\s\p{Z}]|\"[\s\p{Z}]*,[\s\p{Z}]*\""
_FIELD = r"^[^:]{1,80}:"
_BRACKETED = r"^[\s\p{Z}\"'•*·\-–]*\[([^\]:]{1,80})\]"
_ABSENT = "\x00"


def canonical_prose(text: Column) -> Column:
    """Lower case without white space and without punctuation; comparison signs and the signs of numbers and units stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), _LEAD, ""), _NOISE, "")


def canonical_text(text: Column) -> Column:
    """:func:`canonical_prose`; of a list of named fields the sorted canonical fields, each with its own value.

    A text is a list of named fields if it falls into two or more parts at ``;``, ``|``, bullets on new lines or the
    commas of an object, and every part begins with a name and a
    colon or with a name in square brackets. Null stays null; an empty text and one of punctuation only agree.
    """
    parts = F.filter(F.split(text, _SEPARATOR), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, _BRACKETED, "$1:"))
    fields = F.array_sort(F.transform(parts, lambda p: F.concat(canonical_prose(F.substring_index(p, ":", 1)), F.lit("\x01"), canonical_prose(F.regexp_replace(p, _FIELD, "")))))
    listed = text.rlike(r"[:\]]") & text.rlike(_SEPARATOR) & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_FIELD))
    return F.when(listed, F.concat(F.lit("\x02"), F.array_join(fields, "\x02"))).otherwise(canonical_prose(text))


def record_hashes(df: DataFrame, id_column: str, texts: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """(id, h, x): the 128-bit hash of each record's canonical form and 64 bits of another hash of it.

    ``texts`` are compared by canonical form, ``ignored`` columns not at all, all other columns exactly; null equals null only.
    """
    rest = sorted(set(df.columns) - {id_column, *texts, *ignored})
    kinds = dict(df.dtypes)
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if kinds[c].startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string") for c in rest]
    whole = F.concat_ws("\x1f", *(F.coalesce(canonical_text(F.col(f"`{c}`")), F.lit(_ABSENT)) for c in texts), *(F.coalesce(p, F.lit(_ABSENT)) for p in plain))
    return df.select(F.col(id_column).alias("id"), whole.alias("whole")).select("id", F.unhex(F.md5(F.col("whole").cast("binary"))).alias("h"), F.xxhash64("whole").alias("x"))


def copy_groups(hashes: DataFrame) -> DataFrame:
    """(h, x, keep_id, copies): each distinct record once, kept under its smallest id, with the number of its rows.

    Records that agree in the 128 bits but not in the check are different records and stay apart.
    """
    return hashes.groupBy("h", "x").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def copy_pairs(hashes: DataFrame) -> DataFrame:
    """(keep_id, copy_id): every row that is not the one kept of its group, with the one kept.

    The hashes are written once (40 bytes a row), as they are read twice. The groups' side has one row per group, so a
    group that holds a third of all rows is split on the other side by adaptive execution, never gathered.
    """
    hashes = checkpointed(hashes)
    groups = copy_groups(hashes).where("copies > 1").select("h", "x", "keep_id")
    return hashes.join(groups, ["h", "x"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


THRESHOLD_TEXTS = ("source_text", "label")
THRESHOLD_IGNORED = ("threshold_id", "extracted_at")


def threshold_hashes(thresholds: DataFrame) -> DataFrame:
    return record_hashes(thresholds, "row_id", THRESHOLD_TEXTS, THRESHOLD_IGNORED)
