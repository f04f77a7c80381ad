import pytest

from conftest import rows
from tessera.operators import lab
from tessera.operators.rules import rule_table

NAMES = {"creatinine": ["creatinin", "creatinin máu", "serum creatinine"], "potassium": ["kali máu", "K+"], "cholesterol": ["cholesterol"], "LDL_cholesterol": ["LDL cholesterol"], "GFR": ["GFR", "eGFR"], "age": ["tuổi", "age"], "weight_kg": ["cân nặng", "weight"]}


@pytest.mark.parametrize("text, found", [
    ("Creatinin máu 1,8 mg/dL và kali máu: 6.7", {"creatinine": (1.8, "mg/dL"), "potassium": (6.7, None)}),
    ("serum creatinine level of 88 umol/L", {"creatinine": (88.0, "μmol/L")}), ("55 tuổi, cân nặng 60 kg", {"age": (55.0, None), "weight_kg": (60.0, "kg")}),
    ("LDL cholesterol 3.2 mmol/L", {"LDL_cholesterol": (3.2, "mmol/L")}), ("LDL cholesterol 3.2 mmol/L, cholesterol toàn phần; cholesterol 5 mmol/L", {"LDL_cholesterol": (3.2, "mmol/L")}),
    ("Huyết áp 150 / 95 mmHg", {"systolic_bp": (150.0, "mmHg"), "diastolic_bp": (95.0, "mmHg")}), ("tỷ lệ 150/95", {}), ("creatinin tăng", {}), ("eGFR = 45 ml/phút/1.73m2", {"GFR": (45.0, "ml/ph/1.73m2")}), ("", {}), (None, {}), ("creatinins 5", {}),
])
def test_values_in_texts(text, found):
    assert lab.Reader(NAMES)(text)[0] == found


def test_sex_and_race():
    read = lambda t: lab.Reader({})(t)[1:]
    assert read("Bệnh nhân nữ, da đen") == ("female", "black") and read("male, non-black") == ("male", "other") and read("không rõ") == (None, None) and read("Việt Nam") == ("male", None)


FORMULAS = "formula_id string, expression string, output_name string, output_unit string"
REQUESTS = "request_id string, formula_ids array<string>, values map<string,double>, sex string, race string"


def test_formulas(spark):
    formulas = spark.createDataFrame([("mdrd_gfr", "186 * creatinine_mg_dl ** -1.154 * age ** -0.203 * sex_factor * race_factor", "gfr", "ml"), ("bsa", "(weight_kg * height_cm / 3600) ** 0.5", "bsa", "m2"), ("div", "1 / age", "x", None), ("bad", "import os", "x", None)], FORMULAS)
    known = {"creatinine_mg_dl": 1.2, "age": 60.0}
    requests = [("a", ["mdrd_gfr", "mdrd_gfr", "unknown"], known, "female", None), ("b", ["mdrd_gfr", "bsa"], known, None, "black"), ("c", ["div", "bad"], {"age": 0.0}, None, None), ("d", None, None, None, None), ("e", ["bsa"], None, None, None)]
    got = {(r.request_id, r.formula_id): (r.status, r.value, r.missing, r.assumptions) for r in lab.evaluate_formulas(spark.createDataFrame(requests, REQUESTS), formulas).collect()}
    assert got == {
        ("a", "mdrd_gfr"): ("computed", round(186 * 1.2**-1.154 * 60**-0.203 * 0.742, 4), [], ["race=other"]), ("b", "mdrd_gfr"): ("missing_inputs", None, ["sex"], []), ("b", "bsa"): ("missing_inputs", None, ["height_cm", "weight_kg"], []),
        ("c", "div"): ("error", None, [], []), ("c", "bad"): ("invalid", None, [], []), ("e", "bsa"): ("missing_inputs", None, ["height_cm", "weight_kg"], []),
    }


def test_whole_evaluation(spark):
    formulas = spark.createDataFrame([("g", "100 - age", "gfr", "ml/ph/1.73m2")], FORMULAS)
    rules = rule_table(spark, [("GFR", "<", 60.0, None, None, None, "low", None), ("potassium", ">=", 6.5, None, None, "mmol/L", "high", None)])
    schema = "request_id string, text string, measurements array<struct<name string, value double, unit string>>, formula_ids array<string>, disease string"
    data = [("a", "55 tuổi, kali máu 7 mmol/L", None, ["g"], None), ("b", "kali máu 7 mmol/L", [("potassium", 4.0, "mmol/L"), None, ("GFR", 90.0, None)], ["g"], "d"), ("c", None, None, None, None), ("d", "", [], [], None)]
    got = {r.request_id: r for r in lab.evaluate_requests(spark.createDataFrame(data, schema), NAMES, formulas, rules, {"gfr": ("GFR", "ml/ph/1.73m2")}).collect()}
    assert [(m.name, m.value) for m in got["a"].measurements] == [("age", 55.0), ("potassium", 7.0), ("GFR", 45.0)] and got["a"].classes == ["GFR=low", "potassium=high"]
    assert {m.name: m.value for m in got["b"].measurements} == {"potassium": 4.0, "GFR": 90.0} and got["b"].classes == [] and got["b"].formula_results[0].status == "missing_inputs"
    assert got["c"].status == got["d"].status == "no_input" and got["a"].status == "evaluated"
    assert lab.evaluate_requests(spark.createDataFrame([], schema), NAMES, formulas, rules, {}).count() == 0
