"""Arithmetic expressions as data: compiled to Columns, or evaluated per row when every row brings its own expression."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXPONENT = 200


class UnsafeExpression(ValueError):
    """The expression has something else than arithmetic."""


@lru_cache(maxsize=10_000)
def parse(expression: str) -> ast.expr:
    """The checked tree: numbers, names, ``+ - * / **``, signs, and ``min``/``max`` of two."""
    try:
        tree = ast.parse(expression, mode="eval").body
    except (SyntaxError, ValueError) as error:
        raise UnsafeExpression(str(error)) from None
    for node in ast.walk(tree):
        fine = (
            isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Name, ast.Load, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.UAdd, ast.USub))
            or (isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool))
            or (isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("min", "max") and len(node.args) == 2 and not node.keywords)
        )
        if not fine:
            raise UnsafeExpression(f"{type(node).__name__} is not allowed")
    return tree


@lru_cache(maxsize=10_000)
def names(expression: str) -> tuple[str, ...]:
    """Variable names in order of appearance."""
    tree = parse(expression)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = [(n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    return tuple(dict.fromkeys(x for _, _, x in sorted(found)))


def _fold(node: ast.expr, leaf: Callable[[ast.expr], object], binary: Callable[[type, object, object], object], call: Callable[[str, object, object], object], negate: Callable[[object], object]) -> object:
    go = lambda n: _fold(n, leaf, binary, call, negate)
    if isinstance(node, ast.BinOp):
        return binary(type(node.op), go(node.left), go(node.right))
    if isinstance(node, ast.UnaryOp):
        inner = go(node.operand)
        return negate(inner) if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.Call):
        return call(node.func.id, go(node.args[0]), go(node.args[1]))
    return leaf(node)


def compile_expression(expression: str, variables: Mapping[str, Column]) -> Column:
    """The expression over columns, inside code generation. Null where a variable is null, a divisor is zero, an exponent
    exceeds :data:`MAX_EXPONENT` in magnitude or the result is not finite."""

    def leaf(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        if node.id not in variables:
            raise KeyError(node.id)
        return variables[node.id].cast("double")

    def binary(op: type, a: Column, b: Column) -> Column:
        if op is ast.Add:
            return a + b
        if op is ast.Sub:
            return a - b
        if op is ast.Mult:
            return a * b
        if op is ast.Div:
            return F.when(b != 0, a / b)
        return F.when(F.abs(b) <= MAX_EXPONENT, F.pow(a, b))

    def call(name: str, a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, F.least(a, b) if name == "min" else F.greatest(a, b))

    value = _fold(parse(expression), leaf, binary, call, lambda x: -x)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def evaluate(expression: str, values: Mapping[str, float]) -> float | None:
    """The same on single values."""

    def binary(op: type, a: float | None, b: float | None) -> float | None:
        if a is None or b is None:
            return None
        try:
            if op is ast.Add:
                return a + b
            if op is ast.Sub:
                return a - b
            if op is ast.Mult:
                return a * b
            if op is ast.Div:
                return a / b if b else None
            result = a**b if abs(b) <= MAX_EXPONENT else None
            return result if not isinstance(result, complex) else None
        except (OverflowError, ZeroDivisionError):
            return None

    def leaf(node: ast.expr) -> float | None:
        return float(node.value) if isinstance(node, ast.Constant) else values.get(node.id)

    def call(name: str, a: float | None, b: float | None) -> float | None:
        return None if a is None or b is None else min(a, b) if name == "min" else max(a, b)

    value = _fold(parse(expression), leaf, binary, call, lambda x: None if x is None else -x)
    return value if value is not None and math.isfinite(value) else None


def evaluate_rows(df: DataFrame, id_column: str, expression_column: str, values_column: str) -> DataFrame:
    """(id, value, status, missing): each row's own expression over its own MAP of values.

    ``status`` is ``computed``, ``missing_inputs`` (``missing`` names them in order), ``error`` (no finite result) or
    ``invalid`` (no allowed expression, also a null one). Parsed trees are remembered per worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for expression, values in zip(batch["e"], batch["v"]):
                known = {k: v for k, v in (dict(values) if values is not None else {}).items() if v is not None}
                try:
                    wanted = names(expression or "")
                except UnsafeExpression:
                    out.append((None, "invalid", []))
                    continue
                missing = [n for n in wanted if n not in known]
                if missing:
                    out.append((None, "missing_inputs", missing))
                    continue
                value = evaluate(expression, known)
                out.append((value, "computed" if value is not None else "error", []))
            yield pd.DataFrame({"id": batch["id"], "value": [o[0] for o in out], "status": [o[1] for o in out], "missing": [o[2] for o in out]})

    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), F.col(expression_column).alias("e"), F.col(values_column).alias("v"))
    return rows.mapInPandas(run, f"id {kind}, value double, status string, missing array<string>")
