"""Quantities in different units to the common unit of their quantity (problem 7).

Units are chosen by identities: the product of some columns, each to a power and in its unit, is a constant (mass = density x
volume). Of all combinations of the units that the columns may have the one with the smallest log residual is chosen, and
the choice is marked where another one is as good. The identities in use:

* every number of a text against the record's own numbers: the unit behind the one that leaves no residual is the record's;
* value, lower and upper bound of a record share their unit and lie at the usual magnitude of their quantity;
* a formula's result is the product of its variables, dimensions included.

A unit that is written restricts the combinations to itself. Its spelling is reduced to a key and, failing that, to its scale
and dimensions; both are compared with the units the conversion table has for the quantity. A unit that is written but
unknown stays unknown.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.formula import UnsafeExpression, parse
from tessera.functions.plain import compatible
from tessera.operators.names import resolve_names
from tessera.session import checkpointed

#: Largest conversion table that is sent to every task, in rows.
MAX_CONVERSIONS = 100_000
#: Residuals closer than this (a factor of 2) leave the choice open.
OPEN = math.log(2)
#: A formula whose constant is further off than this (a factor of 3) says nothing about units.
FAR = math.log(3)
#: Other spellings of units, of their parts and of the marks between them.
WHOLE = {"phần trăm": "%", "pct": "%", "percent": "%", "mm": "mmol/l", "um": "umol/l", "nm": "nmol/l", "pm": "pmol/l", "ratio": "tỷ số", "tỉ số": "tỷ số", "tỷ lệ": "tỷ số", "tỉ lệ": "tỷ số"}
PARTS = (
    ("micromol", "umol"), ("mcmol", "umol"), ("microgam", "ug"), ("microgram", "ug"), ("mcg", "ug"), ("μ", "u"), ("kilogam", "kg"), ("kilogram", "kg"), ("miligam", "mg"), ("milligram", "mg"),
    ("gam", "g"), ("gram", "g"), ("pounds", "lb"), ("pound", "lb"), ("lbs", "lb"), ("lít", "l"), ("litre", "l"), ("liter", "l"), ("mét vuông", "m2"), ("metvuong", "m2"),
    ("phút", "ph"), ("minute", "ph"), ("min", "ph"), ("giây", "s"), ("second", "s"), ("sec", "s"), ("24 giờ", "24h"), ("24giờ", "24h"), ("24 hours", "24h"), ("24 hour", "24h"), ("ngày", "24h"), ("day", "24h"),
    (" per ", "/"), ("/100 ml", "/dl"), ("/100ml", "/dl"), ("kg h2o", "kg"), ("kgh2o", "kg"),
)
PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "": 1.0, "k": 1e3}
#: Base units with (dimension, scale).
BASES = {"g": ("mass", 1.0), "l": ("volume", 1.0), "mol": ("amount", 1.0), "eq": ("charge", 1.0), "osm": ("osmoles", 1.0), "pa": ("pressure", 1.0), "h": ("time", 3600.0), "s": ("time", 1.0), "ph": ("time", 60.0), "lb": ("pounds", 1.0), "mhg": ("mercury", 1.0), "%": ("percent", 1.0)}
_NUMBER = re.compile(r"(?<![\w.,])\d+(?:[.,]\d+)*(?!\d)")
#: Characters in the longest spelling of a unit.
LONGEST = 64
_BEFORE_LIMIT = re.compile(r"(?:[<>=≤≥]|đến|to|-|–|và|and|từ)\s*$")
#: A remark in brackets, or lines that are no part of a sentence (headers and page numbers).
_BETWEEN = re.compile(r"\s*\([^()\n]*\)|[^\S\n]*\n(?:[^\n.,;:!?]{0,80}\n)+")
_UNIT_IS = re.compile(r"(?:đơn vị(?: đo| tính| đầu ra)?(?: là|:)?|units?(?: is|:| of)?)\s+", re.I)
_STATED = re.compile(r"(?:tính bằng|đơn vị(?: đầu ra)?(?: là|:)?|expressed in|units? (?:is|of|are)|in units of|bằng|là|in)\s+", re.I)


@lru_cache(maxsize=100_000)
def unit_key(text: str) -> str:
    """Comparable form of a unit's spelling; empty for an empty one."""
    key = " ".join(compatible(text).lower().split())
    key = WHOLE.get(key, key)
    for spelling, standard in PARTS:
        if spelling in key:
            key = key.replace(spelling, standard)
    key = key.replace(" ", "") if key not in WHOLE.values() else key
    if key.endswith("%") and len(key) > 1:
        key = key[:-1] + "/dl"
    return key.replace(",", ".")


@lru_cache(maxsize=100_000)
def dimensions(key: str) -> tuple[float, tuple[str, ...]] | None:
    """(scale, dimensions) of a unit key such as ``mg/dl`` or ``ml/ph/1.73m2``; None where a part is unknown."""
    scale, dims = 1.0, []
    for place, part in enumerate(key.split("/")):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)?([a-z%]*?)(2?)", part)
        if not m or not (m[2] or m[1]):
            return None
        number, name = float(m[1] or 1), m[2]
        if name in ("m", "cm", "dm") and m[3]:
            size, dim = {"m": 1.0, "dm": 1e-2, "cm": 1e-4}[name], "area"
        else:
            found = next(((PREFIXES[name[: len(name) - len(b)]] * s, d) for b, (d, s) in BASES.items() if name.endswith(b) and name[: len(name) - len(b)] in PREFIXES), None)
            if found is None:
                return None
            size, dim = found
        size *= number
        scale = scale * size if place == 0 else scale / size
        dims.append(dim if place == 0 else "/" + dim)
    return scale, (dims[0], *sorted(dims[1:]))


def readings(number: str) -> list[float]:
    """What a printed number may mean: a mark before the last digits is a decimal one or, between groups of three, none."""
    parts = re.split("[.,]", number)
    grouped = 0 < len(parts[0]) <= 3 and parts[0][0] != "0"
    found = []
    marks = [c for c in number if c in ".,"]
    if len(parts) <= 2 or (grouped and all(len(p) == 3 for p in parts[1:-1]) and marks[-1] not in marks[:-1]):
        found.append(float("".join(parts[:-1]) + "." + parts[-1]) if len(parts) > 1 else float(number))
    if len(parts) > 1 and grouped and all(len(p) == 3 for p in parts[1:]):
        found.append(float("".join(parts)))
    return found


@dataclass(frozen=True)
class Identity:
    """The product of columns to their ``powers`` is ``exp(log_constant)`` in base units."""

    powers: Mapping[str, float]
    log_constant: float = 0.0


def choose_units(numbers: Mapping[str, float], units: Mapping[str, Sequence[tuple[str, float]]], identities: Sequence[Identity], shared: Sequence[Sequence[str]] = ()) -> tuple[dict[str, str] | None, float, bool]:
    """(unit of each column, mean log residual, unique) of the combination of units that fulfils the identities best.

    ``numbers`` are positive; ``units`` has the (unit, factor to the base unit) that each column may have, the preferred one
    first; columns of one group of ``shared`` have the same unit. Identities with a column that has no number count for
    nothing; without any there is no choice. ``unique`` is false where another combination is within a factor of two.
    """
    usable = [i for i in identities if all(c in numbers and units.get(c) for c in i.powers)]
    columns = sorted({c for i in usable for c in i.powers})
    if not usable:
        return None, math.nan, False
    groups = [[c for c in g if c in columns] for g in shared]
    groups = [g for g in groups if g] + [[c] for c in columns if not any(c in g for g in groups)]
    rated = []
    for order, picks in enumerate(product(*(range(len(units[g[0]])) for g in groups))):
        chosen = {c: units[c][k] for g, k in zip(groups, picks) for c in g}
        residual = sum(abs(sum(p * math.log(numbers[c] * chosen[c][1]) for c, p in i.powers.items()) - i.log_constant) for i in usable) / len(usable)
        rated.append((residual, order, {c: u for c, (u, _) in chosen.items()}))
    rated.sort(key=lambda x: x[:2])
    return rated[0][2], rated[0][0], len(rated) == 1 or rated[1][0] - rated[0][0] > OPEN


def monomial(expression: str) -> tuple[float, dict[str, float]] | None:
    """(log of the constant, powers of the variables) of an expression that is a product of powers, else None."""

    def walk(node: ast.expr) -> tuple[float, dict[str, float]] | None:
        if isinstance(node, ast.Constant):
            return (math.log(node.value), {}) if node.value > 0 else None
        if isinstance(node, ast.Name):
            return 0.0, {node.id: 1.0}
        if not isinstance(node, ast.BinOp) or not isinstance(node.op, (ast.Mult, ast.Div, ast.Pow)):
            return None
        left, right = walk(node.left), walk(node.right)
        if left is None or right is None:
            return None
        if isinstance(node.op, ast.Pow):
            if right[1]:
                return None
            power = math.exp(right[0])
            return left[0] * power, {n: p * power for n, p in left[1].items()}
        sign = 1 if isinstance(node.op, ast.Mult) else -1
        powers = dict(left[1])
        for name, p in right[1].items():
            powers[name] = powers.get(name, 0.0) + sign * p
        return left[0] + sign * right[0], powers

    try:
        return walk(parse(expression))
    except UnsafeExpression:
        return None


class Converter:
    """Looks units up among those of a quantity. ``rows``: (quantity, from_unit, common_unit, factor)."""

    def __init__(self, rows: list[tuple[str, str, str, float]]):
        self.keys: dict[str, dict[str, str]] = {}
        self.sizes: dict[str, dict[tuple, str]] = {}
        self.factor: dict[tuple[str, str], float] = {}
        self.common: dict[str, str] = {}
        for quantity, unit, common, factor in rows:
            key = unit_key(unit)
            self.keys.setdefault(quantity, {}).setdefault(key, unit)
            size = dimensions(key)
            if size:
                self.sizes.setdefault(quantity, {}).setdefault((f"{size[0]:.9g}", size[1]), unit)
            self.factor[quantity, unit] = factor
            self.common[quantity] = common
        self.memo: dict[tuple[str, str], str | None] = {}

    def unit(self, quantity: str, spelling: str) -> str | None:
        """The table's spelling of a unit of this quantity."""
        known = self.memo.get((quantity, spelling), False)
        if known is not False:
            return known
        key = unit_key(spelling)
        unit = self.keys.get(quantity, {}).get(key)
        if unit is None and (size := dimensions(key)):
            unit = self.sizes.get(quantity, {}).get((f"{size[0]:.9g}", size[1]))
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[quantity, spelling] = unit
        return unit

    def unit_here(self, quantity: str, text: str, start: int) -> str | None:
        """The unit that is spelled at ``start``; the longest spelling counts."""
        while start < len(text) and text[start] in " \t\r\xa0":
            start += 1
        for end in range(min(len(text), start + LONGEST), start, -1):
            if end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                continue
            if text[end - 1].isspace() or text[end - 1] in ".,;:)":
                continue
            unit = self.keys.get(quantity, {}).get(unit_key(text[start:end]))
            if unit is not None:
                return unit
        return None

    def unit_at(self, quantity: str, text: str, start: int) -> str | None:
        """The unit at ``start`` or after remarks and page matter that stand there, however long they are."""
        unit = self.unit_here(quantity, text, start)
        while unit is None and (between := _BETWEEN.match(text, start)):
            start = between.end()
            unit = self.unit_here(quantity, text, start)
        return unit

    def unit_in_text(self, quantity: str, text: str, values: tuple[float | None, ...]) -> str | None:
        """The unit of the record in its text, whole texts.

        Every number of the text is a reading of the record's numbers; the identity of both leaves a log residual of zero for
        the record's own ones. Of those with a unit, numbers after a comparison sign or a range come first; where none has a
        unit, the one that the text states counts. In a text that has none of the record's numbers (it was copied without
        their marks or is about a sister quantity) the limit with the smallest residual takes their place.
        """
        text = compatible(text).lower()
        wanted = [v for v in values if v is not None and v == v]
        places, limits = [], []
        for m in _NUMBER.finditer(text):
            read = readings(m[0])
            rank = next((i for i, v in enumerate(wanted) if any(math.isclose(v, r, rel_tol=1e-9) for r in read)), None)
            limit = _BEFORE_LIMIT.search(text[max(0, m.start() - 8) : m.start()])
            if rank is not None:
                places.append((not limit, rank, m.end()))
            elif limit:
                residual = min((abs(math.log(r / v)) for r in read for v in wanted if r > 0 and v > 0), default=math.inf)
                limits.append((residual, m.end(), m.end()))
        for _, _, end in sorted(places or limits):
            unit = self.unit_at(quantity, text, end)
            if unit is not None:
                return unit
        for m in _UNIT_IS.finditer(text):
            unit = self.unit_here(quantity, text, m.end())
            if unit is not None:
                return unit
        return None

    def unit_stated(self, quantity: str, text: str) -> str | None:
        """The unit that a sentence states for a result."""
        text = compatible(text).lower()
        for m in reversed(list(_STATED.finditer(text))):
            unit = self.unit_at(quantity, text, m.end())
            if unit is not None:
                return unit
        return None

    def infer(self, quantity: str, numbers: Sequence[float | None], usual: Sequence[float]) -> tuple[str | None, float, bool]:
        """(unit, mean log residual, unique) of the unit that brings a record's ``numbers`` together closest to their usual log magnitudes.

        A column without a usual magnitude of its own is compared with the mean of the quantity's others.
        """
        there = [u for u in usual if u == u]
        positive = {str(i): n for i, n in enumerate(numbers) if n is not None and n > 0}
        if not there or not positive:
            return None, math.nan, False
        other = sum(there) / len(there)
        common = self.common.get(quantity)
        units = sorted(((u, self.factor[quantity, u]) for u in self.keys.get(quantity, {}).values()), key=lambda x: (x[0] != common, x[0]))
        identities = [Identity({c: 1.0}, usual[int(c)] if usual[int(c)] == usual[int(c)] else other) for c in positive]
        chosen, residual, unique = choose_units(positive, {c: units for c in positive}, identities, [list(positive)])
        return (next(iter(chosen.values())) if chosen else None), residual, unique

    def result_unit(self, quantity: str, expression: str | None, variables: Mapping[str, str]) -> tuple[str | None, float, bool]:
        """(unit, log residual, unique) of a formula's result from the units of its variables.

        The expression must be a product of powers of variables with known dimensions; units of other dimensions than the
        product's are no choice, nor is one that the formula's constant is further than :data:`FAR` from.
        """
        form = monomial(expression) if expression else None
        known = {n: dimensions(unit_key(u)) for n, u in variables.items() if u}
        if form is None or not form[1] or any(known.get(n) is None for n in form[1]):
            return None, math.nan, False
        dims = exponents((known[n][1], p) for n, p in form[1].items())
        units = []
        for unit in sorted(self.keys.get(quantity, {}).values(), key=lambda u: (u != self.common[quantity], u)):
            size = dimensions(unit_key(unit))
            if size and exponents([(size[1], 1.0)]) == dims:
                units.append((unit, size[0]))
        if not units:
            return None, math.nan, False
        numbers = dict.fromkeys([*form[1], ""], 1.0) | {"": math.exp(form[0])}
        candidates = {n: [(variables[n], known[n][0])] for n in form[1]} | {"": units}
        chosen, residual, unique = choose_units(numbers, candidates, [Identity(form[1] | {"": -1.0})])
        return (chosen[""], residual, unique) if chosen and residual <= FAR else (None, residual, False)


def exponents(parts: Iterable[tuple[Sequence[str], float]]) -> dict[str, float]:
    """Dimension exponents of a product of units to powers."""
    total: dict[str, float] = {}
    for dims, power in parts:
        for dim in dims:
            name, sign = dim.lstrip("/"), -1.0 if dim.startswith("/") else 1.0
            total[name] = total.get(name, 0.0) + sign * power
    return {n: round(p, 9) for n, p in total.items() if abs(p) > 1e-9}


def conversion_rows(conversions: DataFrame) -> list[tuple[str, str, str, float]]:
    rows = conversions.select("quantity", "from_unit", "common_unit", "factor").limit(MAX_CONVERSIONS + 1).collect()
    if len(rows) > MAX_CONVERSIONS:
        raise ValueError(f"the conversion table has more than {MAX_CONVERSIONS} rows")
    return [tuple(r) for r in rows]


Resolver = Callable[[DataFrame, DataFrame], DataFrame]


def with_units(records: DataFrame, conversions: DataFrame, stated: bool = False) -> DataFrame:
    """(record_id, quantity, from_unit, unit_source, written): the unit of each record whose quantity the table has.

    records: (record_id, quantity, unit, text, value, low, high). ``unit_source`` is ``column`` or ``text``; a unit that the
    quantity doesn't have and a missing one give null. With ``stated`` the text states the unit of a result instead of
    giving it after the record's number. Texts are read only where the column is null or blank. ``written`` is true where the column
    has a unit, known or not.
    """
    rows = conversion_rows(conversions)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Converter(rows)
        for batch in batches:
            units, sources = [], []
            for quantity, unit, text, value, low, high in zip(batch["quantity"], batch["unit"], batch["text"], batch["value"], batch["low"], batch["high"]):
                source = "column"
                if unit is not None:
                    found = table.unit(quantity, unit)
                elif not text:
                    found = None
                else:
                    source = "text"
                    found = table.unit_stated(quantity, text) if stated else table.unit_in_text(quantity, text, (high, value, low))
                units.append(found)
                sources.append(source if found is not None else None)
            yield pd.DataFrame({"record_id": batch["record_id"], "quantity": batch["quantity"], "from_unit": units, "unit_source": sources, "value": batch["value"], "low": batch["low"], "high": batch["high"], "written": batch["unit"].notna()})

    records = records.withColumn("unit", F.when(F.trim("unit") != "", F.col("unit")))
    needed = records.select("record_id", "quantity", "unit", F.when(F.col("unit").isNull(), F.col("text")).alias("text"), "value", "low", "high")
    known = needed.join(F.broadcast(conversions.select("quantity").distinct()), "quantity", "left_semi")
    schema = "record_id string, quantity string, from_unit string, unit_source string, value double, low double, high double, written boolean"
    return known.select("record_id", "quantity", "unit", "text", "value", "low", "high").mapInPandas(find, schema)


def threshold_records(thresholds: DataFrame, reference: DataFrame, resolve: Resolver = resolve_names) -> DataFrame:
    """Records of :func:`with_units` of thresholds; the quantity is the entry of the typed name, once per distinct name."""
    names = resolve(thresholds.select(F.col("biomarker").alias("name")), reference).withColumnRenamed("biomarker", "quantity")
    rows = thresholds.select(
        F.col("row_id").cast("string").alias("record_id"), F.col("biomarker").alias("name"), F.col("threshold_unit").alias("unit"),
        F.when(F.col("threshold_unit").isNull() | (F.trim("threshold_unit") == ""), F.col("source_text")).alias("text"), F.col("threshold_value").alias("value"),
        F.col("threshold_value_min").alias("low"), F.col("threshold_value_max").alias("high"),
    )
    return rows.join(names, "name").drop("name")


def formula_records(formulas: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return formulas.select(
        F.col("formula_id").alias("record_id"), F.col("output_name").alias("quantity"), F.col("output_unit").alias("unit"), F.col("source_text").alias("text"),
        nothing.alias("value"), nothing.alias("low"), nothing.alias("high"),
    ).distinct()


def other_units(thresholds: DataFrame, formulas: DataFrame, reference: DataFrame, conversions: DataFrame, resolve: Resolver = resolve_names) -> DataFrame:
    """(source_table, record_id, from_unit) of the records whose unit is written and isn't the common one."""
    found = with_units(threshold_records(thresholds, reference, resolve), conversions).withColumn("source_table", F.lit("thresholds_extra"))
    found = found.unionByName(with_units(formula_records(formulas), conversions, stated=True).withColumn("source_table", F.lit("formulas")))
    common = F.broadcast(conversions.select("quantity", "common_unit").distinct())
    return found.join(common, "quantity").where("from_unit is not null and from_unit <> common_unit").select("source_table", "record_id", "from_unit")


#: Columns of a record that share its unit.
NUMBERS = ("value", "low", "high")


def converted(thresholds: DataFrame, reference: DataFrame, conversions: DataFrame, resolve: Resolver = resolve_names) -> DataFrame:
    """(row_id, quantity, common_unit, from_unit, unit_source, value, low, high, residual, unique_unit) of every threshold of a known quantity.

    Values are in the common unit. Where neither the column nor the text has a unit it is inferred (``unit_source`` is
    ``inferred``) from value, low and high together: the usual magnitude of each of these columns is the median log of the
    quantity's numbers with written units, an approximation of all of them; where there are none, or no number is positive,
    unit and values stay null, as they do where a unit is written that the quantity doesn't have. ``residual`` is the mean
    over the record's numbers; ``unique_unit`` is false where another unit explains them nearly as well.
    """
    rows = conversion_rows(conversions)
    found = checkpointed(with_units(threshold_records(thresholds, reference, resolve), conversions))
    factors = conversions.select("quantity", "from_unit", "common_unit", "factor")
    known = found.join(F.broadcast(factors), ["quantity", "from_unit"])
    medians = [F.percentile_approx(F.when(F.col(c) > 0, F.log(F.col(c) * F.col("factor"))), 0.5, 10_000).alias(c) for c in NUMBERS]
    usual = {r[0]: [math.nan if m is None else m for m in r[1:]] for r in known.groupBy("quantity").agg(*medians).collect()}
    nothing = [math.nan] * len(NUMBERS)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Converter(rows)
        for batch in batches:
            picks = [
                (u, 0.0, True) if u is not None else (None, math.nan, False) if written else table.infer(q, numbers, usual.get(q, nothing))
                for q, u, written, *numbers in zip(batch["quantity"], batch["from_unit"], batch["written"], *(batch[c] for c in NUMBERS))
            ]
            batch["from_unit"] = [p[0] for p in picks]
            batch["residual"] = [p[1] if p[1] == p[1] else None for p in picks]
            batch["unique_unit"] = [p[2] for p in picks]
            batch["unit_source"] = [s if s is not None else ("inferred" if p[0] is not None else None) for s, p in zip(batch["unit_source"], picks)]
            yield batch.drop(columns="written")

    schema = "record_id string, quantity string, from_unit string, unit_source string, value double, low double, high double, residual double, unique_unit boolean"
    chosen = found.mapInPandas(choose, schema).join(F.broadcast(factors), ["quantity", "from_unit"], "left")
    scaled = [(F.col(c) * F.col("factor")).alias(c) for c in NUMBERS]
    return chosen.select(F.col("record_id").cast("long").alias("row_id"), "quantity", "common_unit", "from_unit", "unit_source", *scaled, "residual", "unique_unit")


def formula_units(formulas: DataFrame, conversions: DataFrame) -> DataFrame:
    """(formula_id, quantity, common_unit, from_unit, unit_source, factor, residual, unique_unit) of every formula whose result the table has.

    A result times ``factor`` is in the common unit. Where neither the column nor the text has a unit it is inferred
    (``unit_source`` is ``inferred``) from the expression and the units of its variables; where they don't tell, and where
    a unit is written that the quantity doesn't have, unit and factor are null. Null variables and null names are left out.
    """
    rows = conversion_rows(conversions)
    found = with_units(formula_records(formulas), conversions, stated=True)
    named = F.filter("variables", lambda v: v["name"].isNotNull() & v["unit"].isNotNull())
    bodies = formulas.select(F.col("formula_id").alias("record_id"), "expression", F.transform(named, lambda v: F.struct(v["name"].alias("name"), v["unit"].alias("unit"))).alias("variables"))
    bodies = bodies.groupBy("record_id").agg(F.max(F.struct("expression", "variables")).alias("body")).select("record_id", "body.*")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Converter(rows)
        for batch in batches:
            picks = []
            for unit, written, quantity, expression, variables in zip(batch["from_unit"], batch["written"], batch["quantity"], batch["expression"], batch["variables"]):
                if unit is not None or written:
                    picks.append((unit, 0.0 if unit is not None else math.nan, unit is not None))
                else:
                    picks.append(table.result_unit(quantity, expression, {v["name"]: v["unit"] for v in (() if variables is None else variables)}))
            batch["unit_source"] = [s if s is not None else ("inferred" if p[0] is not None else None) for s, p in zip(batch["unit_source"], picks)]
            batch["from_unit"] = [p[0] for p in picks]
            batch["residual"] = [p[1] if p[1] == p[1] else None for p in picks]
            batch["unique_unit"] = [p[2] for p in picks]
            yield batch[["record_id", "quantity", "from_unit", "unit_source", "residual", "unique_unit"]]

    chosen = found.join(bodies, "record_id", "left").select("record_id", "quantity", "from_unit", "unit_source", "written", "expression", "variables")
    chosen = chosen.mapInPandas(choose, "record_id string, quantity string, from_unit string, unit_source string, residual double, unique_unit boolean")
    common = F.broadcast(conversions.select("quantity", "common_unit").distinct())
    factors = F.broadcast(conversions.select("quantity", "from_unit", "factor"))
    named = chosen.join(common, "quantity").join(factors, ["quantity", "from_unit"], "left")
    return named.select(F.col("record_id").alias("formula_id"), "quantity", "common_unit", "from_unit", "unit_source", "factor", "residual", "unique_unit")


def all_converted(thresholds: DataFrame, formulas: DataFrame, reference: DataFrame, conversions: DataFrame, resolve: Resolver = resolve_names) -> DataFrame:
    """(source_table, record_id, quantity, common_unit, from_unit, unit_source, value, low, high, factor, residual, unique_unit): thresholds
    of :func:`converted` with their numbers, formulas of :func:`formula_units` with the factor for their results."""
    factors = F.broadcast(conversions.select("quantity", "from_unit", "factor"))
    first = converted(thresholds, reference, conversions, resolve).join(factors, ["quantity", "from_unit"], "left").withColumn("source_table", F.lit("thresholds_extra")).withColumn("record_id", F.col("row_id").cast("string"))
    nothing = F.lit(None).cast("double")
    second = formula_units(formulas, conversions).withColumns({"source_table": F.lit("formulas"), "record_id": F.col("formula_id"), "value": nothing, "low": nothing, "high": nothing})
    columns = ["source_table", "record_id", "quantity", "common_unit", "from_unit", "unit_source", "value", "low", "high", "factor", "residual", "unique_unit"]
    return first.select(columns).unionByName(second.select(columns))
