"""Measurements against threshold rules: units, scopes, comparisons and classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import formula
from tessera.functions.vocab import BLACK_FACTOR, CKD_EPI, FORMULAS, SEX_FACTORS, UNIT_ALIASES
from tessera.session import broadcast_if_small

RULE_SCHEMA = "biomarker string, op string, value double, low double, high double, rule_unit string, label string, disease string"
#: Rules up to this number are sent to the measurements; beyond that they are joined by shuffling on the biomarker.
BROADCAST_RULES = 10_000


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def unit_alias(unit: Column) -> Column:
    """Usual spelling of a unit; unknown ones are trimmed, empty ones null."""
    aliases = F.create_map(*(F.lit(x) for pair in UNIT_ALIASES.items() for x in pair))
    trimmed = F.trim(unit)
    return F.when(trimmed != "", F.coalesce(aliases[trimmed], aliases[F.replace(trimmed, F.lit(" "), F.lit(""))], trimmed))


def in_rule_unit(value: Column, unit: Column, rule_unit: Column) -> Column:
    """The value in the rule's unit; a missing unit is taken as the rule's, incompatible units give null."""
    return (
        F.when(unit.isNull() | rule_unit.isNull() | (unit == rule_unit), value)
        .when((unit == "g/dL") & (rule_unit == "g/L"), value * 10)
        .when((unit == "g/L") & (rule_unit == "g/dL"), value / 10)
    )


def meets(value: Column, op: Column, target: Column, low: Column, high: Column, inclusive: Column | None = None) -> Column:
    """Whether a value meets a rule; upper bounds of ranges are exclusive unless ``inclusive``. Never null."""
    below = (value < high) if inclusive is None else F.when(inclusive, value <= high).otherwise(value < high)
    test = (
        F.when(op == ">", value > target).when(op == ">=", value >= target).when(op == "<", value < target).when(op == "<=", value <= target)
        .when(op == "between", (F.coalesce(low, target) <= value) & below)
    )
    return F.coalesce(test, F.lit(False))


def evaluate_rules(measurements: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, biomarker, value, op, rule_value, low, high, rule_unit, label, disease, matched), each once.

    measurements: (request_id, biomarker, value, unit, disease). Where rules exist for the request's disease, those and the
    rules without a disease count, else all rules of the biomarker. Pairs with incompatible units are left out, pairs
    that don't match are kept with ``matched`` false. The number of pairs is that of the measurements times the rules of
    one biomarker. Rules are broadcast up to a checked number.
    """
    scoped = broadcast_if_small(rules.where("disease is not null").select("biomarker", F.col("disease").alias("scope")).distinct().withColumn("known", F.lit(True)), BROADCAST_RULES)
    table = broadcast_if_small(rules.withColumn("rule_value", F.col("value")).drop("value"), BROADCAST_RULES)
    m = measurements.select("request_id", "biomarker", "value", unit_alias(F.col("unit")).alias("unit"), F.col("disease").alias("asked"))
    m = m.join(scoped, (m.biomarker == scoped.biomarker) & (m.asked == scoped.scope), "left").select(m["*"], F.coalesce("known", F.lit(False)).alias("scoped"))
    pairs = m.join(table, "biomarker")
    pairs = pairs.where(~F.col("scoped") | F.col("disease").isNull() | (F.col("disease") == F.col("asked")))
    converted = pairs.withColumn("converted", in_rule_unit(F.col("value"), F.col("unit"), F.col("rule_unit"))).where("converted is not null")
    matched = meets(F.col("converted"), F.col("op"), F.col("rule_value"), F.col("low"), F.col("high"))
    return converted.select("request_id", "biomarker", "value", "op", "rule_value", "low", "high", "rule_unit", "label", "disease", matched.alias("matched")).distinct()


def formula_columns(creatinine: Column, age: Column, female: Column, black: Column, weight: Column, height: Column) -> Mapping[str, Column]:
    """The published renal formulas, compiled to expressions and rounded to four digits."""
    pick = lambda name: F.when(female, CKD_EPI["female"][name]).otherwise(CKD_EPI["male"][name])
    base = {"creatinine_mg_dl": creatinine, "age": age, "weight_kg": weight, "height_cm": height, "race_factor": F.when(black, BLACK_FACTOR).otherwise(1.0)}
    variables = {
        "ckd_epi_2021_creatinine": base | {"kappa": pick("kappa"), "alpha": pick("alpha"), "female_factor": pick("female_factor")},
        "mdrd_gfr": base | {"sex_factor": F.when(female, SEX_FACTORS["mdrd_gfr"]).otherwise(1.0)},
        "cockcroft_gault": base | {"sex_factor": F.when(female, SEX_FACTORS["cockcroft_gault"]).otherwise(1.0)},
        "body_surface_area": base,
    }
    return {name: F.round(formula.compile_expression(FORMULAS[name], known), 4) for name, known in variables.items()}
