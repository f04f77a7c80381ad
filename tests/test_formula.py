import pytest
from pyspark.sql import functions as F

from tessera.functions import formula
from tessera.functions.vocab import CKD_EPI, FORMULAS, SEX_FACTORS

CASES = [
    ("ckd_epi_2021_creatinine", {"creatinine_mg_dl": 1.4, "age": 60, **CKD_EPI["female"]}, 43.0698),
    ("mdrd_gfr", {"creatinine_mg_dl": 1.4, "age": 60, "sex_factor": SEX_FACTORS["mdrd_gfr"], "race_factor": 1.0}, 40.7681),
    ("cockcroft_gault", {"age": 65, "weight_kg": 70, "creatinine_mg_dl": 1.6, "sex_factor": 1.0}, 45.5729),
    ("body_surface_area", {"weight_kg": 55, "height_cm": 160}, 1.5635),
    ("fena_formula", {"urine_na": 20, "plasma_na": 140, "urine_creatinine": 100, "plasma_creatinine": 1}, 0.1429),
]


@pytest.mark.parametrize("name, values, expected", CASES)
def test_published_values(spark, name, values, expected):
    assert round(formula.evaluate(FORMULAS[name], {k: float(v) for k, v in values.items()}), 4) == expected
    column = formula.compile_expression(FORMULAS[name], {k: F.lit(float(v)) for k, v in values.items()})
    assert spark.range(1).select(F.round(column, 4)).first()[0] == expected


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "a if b else c", "min(1, 2, 3)", "'x'", "a @ b", "", "1 +"])
def test_unsafe_expressions_are_refused(bad):
    with pytest.raises(formula.UnsafeExpression):
        formula.parse(bad)


def test_no_finite_result_is_null(spark):
    one = spark.range(1).select(F.lit(0.0).alias("z"), F.lit(-8.0).alias("n"), F.lit(None).cast("double").alias("u"))
    for text in ("1 / z", "n ** 0.5", "10 ** 300", "u + 1", "min(u, 1)"):
        column = formula.compile_expression(text, {c: F.col(c) for c in ("z", "n", "u")})
        assert one.select(column).first()[0] is None, text
        assert formula.evaluate(text, {"z": 0.0, "n": -8.0}) is None, text


def test_each_row_its_own_expression(spark):
    df = spark.createDataFrame([(1, "a + b", {"a": 1.0, "b": 2.0}), (2, "a / b", {"a": 1.0, "b": 0.0}), (3, "a + c", {"a": 1.0}), (4, None, None), (5, "os.x", {})], "id int, e string, v map<string,double>")
    out = {r.id: (r.value, r.status, r.missing) for r in formula.evaluate_rows(df, "id", "e", "v").collect()}
    assert out == {1: (3.0, "computed", []), 2: (None, "error", []), 3: (None, "missing_inputs", ["c"]), 4: (None, "invalid", []), 5: (None, "invalid", [])}


def test_names_in_order():
    assert formula.names("b * a + min(c, b)") == ("b", "a", "c")
