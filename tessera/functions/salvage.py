"""JSON objects inside running text: balanced extraction, repair and flattening."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 50_000


def balanced_object(text: str, start: int, longest: int = LONGEST) -> str | None:
    """The object that begins at ``start``; braces inside strings don't count. None where it isn't closed within ``longest``."""
    depth, quoted, escaped = 0, False, False
    for place in range(start, min(len(text), start + longest)):
        char = text[place]
        if quoted:
            if escaped:
                escaped = False
            elif char == "\\":
                escaped = True
            elif char == '"':
                quoted = False
        elif char == '"':
            quoted = True
        elif char == "{":
            depth += 1
        elif char == "}":
            depth -= 1
            if not depth:
                return text[start : place + 1]
    return None


_TRAILING = re.compile(r",(\s*[}\]])")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def repaired(text: str) -> str:
    """Byte order mark, control characters and trailing commas out."""
    return _TRAILING.sub(r"\1", _CONTROL.sub("", text.removeprefix("﻿")))


def repaired_column(text: Column) -> Column:
    """:func:`repaired` as an expression."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), r",(\s*[}\]])", "$1")


def closed_objects(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost brackets that are closed, in one pass over the text.

    A brace that is never closed doesn't hide the objects after it: what it holds counts as outermost then. Braces inside of
    strings don't count; strings are told apart only inside of braces and end with their line at the latest, as in JSON.
    """
    spans, opened = [], []
    quoted = escaped = False
    for place, char in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif char == "\\":
                escaped = True
            elif char in '"\n':
                quoted = False
        elif char == '"' and opened:
            quoted = True
        elif char == "{":
            opened.append(place)
        elif char == "}" and opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, place + 1))
    return spans


def objects(text: str | None) -> list[str]:
    """The outermost objects that parse, as they stand in the text or after repair."""
    out: list[str] = []
    for start, end in closed_objects(text) if text else []:
        for candidate in (text[start:end], repaired(text[start:end])):
            try:
                json.loads(candidate)
            except ValueError:
                continue
            out.append(candidate)
            break
    return out


_MARKER = re.compile(r"Data\s+metadata\s*:", re.I)


def marked_blocks(text: str | None, longest: int = LONGEST) -> list[tuple[str | None, str]]:
    """(object, snippet) after each marker: the object that begins first after it, or None and 500 characters of what is there.

    An object may have up to ``longest`` characters, the operator's own limit.
    """
    out: list[tuple[str | None, str]] = []
    for m in _MARKER.finditer(text or ""):
        start = text.find("{", m.end())
        found = balanced_object(text, start, longest) if start >= 0 else None
        if found is not None:
            for candidate in (found, repaired(found)):
                try:
                    json.loads(candidate)
                except ValueError:
                    continue
                out.append((candidate, ""))
                break
            else:
                out.append((None, found[:500]))
        else:
            out.append((None, text[m.end() : m.end() + 500]))
    return out


def marked_objects(df: DataFrame) -> DataFrame:
    """(id, pos, object, error) of (id, text): the object after each marker; ``error`` has the first 500 characters of one that doesn't parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, o, e or None) for i, t in zip(batch["id"], batch["text"]) for n, (o, e) in enumerate(marked_blocks(t))]
            yield pd.DataFrame(rows, columns=["id", "pos", "object", "error"])

    return df.select("id", "text").where("text is not null").mapInPandas(run, f"id {dict(df.dtypes)['id']}, pos int, object string, error string")


def flattened(value: object, prefix: str = "") -> list[str]:
    """``path: value`` facts of a parsed object, with dotted and indexed paths, in order; nulls are left out."""
    if isinstance(value, dict):
        return [f for k, v in value.items() for f in flattened(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [f for i, v in enumerate(value) for f in flattened(v, f"{prefix}[{i}]")]
    if value is None:
        return []
    return [f"{prefix}: {str(value).lower() if isinstance(value, bool) else value}"]


def extract_objects(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, object, facts) of every JSON object in the texts; texts without a brace never reach Python."""
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, o, " | ".join(flattened(json.loads(o)))) for i, t in zip(batch["id"], batch["text"]) for n, o in enumerate(objects(t))]
            yield pd.DataFrame(rows, columns=["id", "pos", "object", "facts"])

    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.contains("text", F.lit("{")))
    return texts.mapInPandas(run, f"id {kind}, pos int, object string, facts string")
