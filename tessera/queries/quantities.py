"""Problem 7: quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import units
from tessera.session import table


def p7_found(spark: SparkSession, folder: str, resolve: units.Resolver = units.resolve_names) -> DataFrame:
    tables = (table(spark, folder, t) for t in ("thresholds_extra", "formulas", "biomarker_reference", "unit_conversions"))
    return units.other_units(*tables, resolve)


def p7_converted(spark: SparkSession, folder: str, resolve: units.Resolver = units.resolve_names) -> DataFrame:
    """Threshold values in the common unit of their quantity, and the factors of formula results."""
    return units.all_converted(*(table(spark, folder, t) for t in ("thresholds_extra", "formulas", "biomarker_reference", "unit_conversions")), resolve)


def p7_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """The factor that brings each formula's result to the common unit of its quantity."""
    return units.formula_units(table(spark, folder, "formulas"), table(spark, folder, "unit_conversions"))


QUERIES = {f.__name__: f for f in (p7_found, p7_converted, p7_formulas)}
SQL: dict[str, str] = {}
