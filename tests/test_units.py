import math

import pytest

from conftest import rows
from tessera.operators.units import Converter, Identity, all_converted, choose_units, converted, dimensions, formula_units, other_units, readings, unit_key

CONVERSIONS = [
    ("creatinine", "μmol/L", "μmol/L", 1.0), ("creatinine", "mg/dL", "μmol/L", 88.4), ("GFR", "ml/ph/1.73m2", "ml/ph/1.73m2", 1.0), ("GFR", "ml/s/1.73m2", "ml/ph/1.73m2", 60.0),
    ("protein_niệu_24h", "g/24h", "g/24h", 1.0), ("protein_niệu_24h", "mg/24h", "g/24h", 0.001), ("fena_percent", "%", "%", 1.0), ("fena_percent", "tỷ số", "%", 100.0),
]
THRESHOLDS = "row_id long, biomarker string, threshold_unit string, source_text string, threshold_value double, threshold_value_min double, threshold_value_max double, quantity string, factor int"
FORMULAS = "formula_id string, output_name string, output_unit string, source_text string, expression string, variables array<struct<name string, unit string>>"
REFERENCE = "biomarker_id int, biomarker string, name_vi string, name_en string, aliases array<string>"


@pytest.mark.parametrize("quantity, spelling, unit", [
    ("creatinine", "µmol/l", "μmol/L"), ("creatinine", "mcmol / L", "μmol/L"), ("creatinine", "mg%", "mg/dL"), ("creatinine", "mg/100 ml", "mg/dL"), ("creatinine", "mg per dL", "mg/dL"),
    ("GFR", "mL/min/1.73 m2", "ml/ph/1.73m2"), ("GFR", "ml/giây/1,73m2", "ml/s/1.73m2"), ("protein_niệu_24h", "mg/ngày", "mg/24h"), ("protein_niệu_24h", "g/24 giờ", "g/24h"),
    ("fena_percent", "ratio", "tỷ số"), ("fena_percent", "phần trăm", "%"), ("creatinine", "g/24h", None), ("unknown", "mg/dL", None), ("creatinine", "", None),
])
def test_spellings(quantity, spelling, unit):
    assert Converter(CONVERSIONS).unit(quantity, spelling) == unit


def test_dimensions_agree_across_spellings():
    assert dimensions(unit_key("mg/dL")) == dimensions(unit_key("mg / 100ml")) and dimensions(unit_key("mg/dL"))[1] == ("mass", "/volume")
    assert math.isclose(dimensions("mg/dl")[0], 1e-2) and dimensions("no unit") is None


@pytest.mark.parametrize("text, values, unit", [
    ("creatinin máu < 1,33 mg/dl, sau 40 tháng 12.5%", (1.33,), "mg/dL"),
    ("trong 105 ngày. Ngưỡng: 105 - 175 mcmol/L; Bệnh", (175.0, 105.0), "μmol/L"),
    ("≥ 336\nTrang 464\nμmol/L", (336.0,), "μmol/L"),
    ("ｃｒｅａｔｉｎｉｎ ＜ ４．６７ ｍｇ ／ ｄＬ", (4.67,), "mg/dL"),
    ("creatinin máu <1.33. Khảo sát", (1.33,), None),
    ("creatinin < 412 mg / l là ngưỡng", (4.12,), None), ("creatinin < 412 mg / dl là ngưỡng", (4.12,), "mg/dL"), ("creatinin < 90 umol/l, sau khi < 4 mg/dl", (5.0,), "mg/dL"), ("creatinin < 4.12, sau khi < 5 mg/dl", (4.12,), None),
    ("nothing", (2.0,), None), ("creatinin > 1,234.5 µmol/L", (1234.5,), "μmol/L"), ("creatinin > 1.234,5 µmol/L", (1234.5,), "μmol/L"), ("trên 120 (đo bằng máy, hai lần trong cùng một buổi sáng) µmol/L", (120.0,), "μmol/L"),
    ("Đơn vị là µmol/L. Creatinin tăng khi > 120", (120.0,), "μmol/L"), ("≥ 336\nTrang 464\nSỔ TAY\n- 3 -\nPHẦN II\nμmol/L", (336.0,), "μmol/L"), ("ure đơn vị là g/L, creatinin > 120", (120.0,), None),
])
def test_units_in_texts(text, values, unit):
    assert Converter(CONVERSIONS).unit_in_text("creatinine", text, values) == unit


def frames(spark, thresholds, formulas):
    reference = spark.createDataFrame([(1, "creatinine", "creatinin máu", "serum creatinine", ["SCr"]), (2, "GFR", None, None, None)], REFERENCE)
    conversions = spark.createDataFrame(CONVERSIONS, "quantity string, from_unit string, common_unit string, factor double")
    return spark.createDataFrame(thresholds, THRESHOLDS), spark.createDataFrame([(*f, None, None)[:6] for f in formulas], FORMULAS), reference, conversions


def test_records_in_other_units(spark):
    thresholds = [
        (1, "Creatinin  máu", "mg/dl", None, 1.2, None, None, "x", 1), (2, "creatinine", "umol/L", "x", 90.0, None, None, "x", 1), (3, "SCr", None, "SCr > 2,5 mg%", 2.5, None, None, "x", 1),
        (4, None, "mg/dL", "", 1.0, None, None, "x", 1), (5, "creatinine", None, None, None, None, None, None, None), (6, "troponin", "mg/dL", "t", 1.0, None, None, None, 1), (7, "GFR", "kPa", "t", 1.0, None, None, None, 1),
    ]
    formulas = [("f1", "fena_percent", None, "FENa = a / b, kết quả tính bằng tỷ số."), ("f1", "fena_percent", None, "FENa = a / b, kết quả tính bằng tỷ số."), ("f2", "fena_percent", "pct", None), ("f3", None, "%", None), ("f4", "fena_percent", None, None)]
    t, f, r, c = frames(spark, thresholds, formulas)
    assert rows(other_units(t, f, r, c)) == [("formulas", "f1", "tỷ số"), ("thresholds_extra", "1", "mg/dL"), ("thresholds_extra", "3", "mg/dL")]


def test_values_in_the_common_unit_and_inferred_units(spark):
    thresholds = [(i, "creatinine", "μmol/L", "", 80.0 + i, None, None, None, None) for i in range(9)] + [(20, "creatinine", None, "no unit", 1.0, None, None, None, None), (21, "creatinine", "mg/dL", "", 2.0, 1.0, 2.0, None, None)]
    t, _, r, c = frames(spark, thresholds, [])
    out = {x.row_id: x for x in converted(t, r, c).collect()}
    assert out[21].value == pytest.approx(176.8) and out[21].low == pytest.approx(88.4) and out[21].unit_source == "column"
    assert out[20].from_unit == "mg/dL" and out[20].unit_source == "inferred" and out[20].unique_unit and out[20].value == pytest.approx(88.4)


def test_empty_tables(spark):
    t, f, r, c = frames(spark, [], [])
    assert other_units(t, f, r, c).count() == 0 and converted(t, r, c).count() == 0


def test_inference_uses_all_numbers_and_only_where_nothing_is_written(spark):
    known = [(i, "creatinine", "μmol/L", "", 80.0 + i, 60.0 + i, 110.0 + i, None, None) for i in range(9)]
    # By its value alone row 20 would be in μmol/L (or open), its bounds are in mg/dL; row 21 has bounds only; row 22 has a written unit of another quantity.
    asked = [(20, "creatinine", None, "no unit", 12.0, 0.7, 1.3, None, None), (21, "creatinine", None, None, None, 0.7, 1.3, None, None), (22, "creatinine", "kPa", "", 1.0, None, None, None, None), (23, "creatinine", None, None, 0.0, -1.0, None, None, None), (24, "creatinine", " ", "SCr > 2,5 mg%", 2.5, None, None, None, None)]
    t, _, r, c = frames(spark, known + asked, [])
    out = {x.row_id: x for x in converted(t, r, c).collect()}
    assert Converter(CONVERSIONS).infer("creatinine", (12.0,), (4.43,))[0] == "μmol/L"
    assert out[20].from_unit == "mg/dL" and out[20].unit_source == "inferred" and out[20].high == pytest.approx(1.3 * 88.4)
    assert out[21].from_unit == "mg/dL" and out[21].unique_unit and out[21].value is None and out[21].low == pytest.approx(0.7 * 88.4)
    assert (out[22].from_unit, out[22].unit_source, out[22].value, out[22].residual, out[22].unique_unit) == (None, None, None, None, False)
    assert out[23].from_unit is None and out[23].value is None
    assert (out[24].from_unit, out[24].unit_source) == ("mg/dL", "text")


def test_formulas_get_common_unit_and_factor(spark):
    formulas = [("f1", "fena_percent", None, "FENa = a / b, kết quả tính bằng tỷ số."), ("f2", "fena_percent", "pct", None), ("f3", "fena_percent", "kPa", None), ("f4", "other", "%", None)]
    _, f, _, c = frames(spark, [], formulas)
    got = rows(formula_units(f, c).drop("residual"))
    assert got == [("f1", "fena_percent", "%", "tỷ số", "text", 100.0, True), ("f2", "fena_percent", "%", "%", "column", 1.0, True), ("f3", "fena_percent", "%", None, None, None, False)]


def test_units_of_results_by_the_identity_of_the_formula(spark):
    flow = [("p", "mg/L"), ("v", "ml/24h"), None, (None, "g/L"), ("x", None)]
    formulas = [
        ("mg", "protein_niệu_24h", None, None, "p * v / 1000", flow), ("g", "protein_niệu_24h", None, None, "p * v / 1000000", flow), ("g2", "protein_niệu_24h", None, "", "p * v * 0.001", [("p", "g/L"), ("v", "ml/24h")]),
        ("far", "protein_niệu_24h", None, None, "p * v / 31000", flow), ("sum", "protein_niệu_24h", None, None, "p + v", flow), ("dim", "protein_niệu_24h", None, None, "p * 2", flow), ("odd", "protein_niệu_24h", None, None, "p * (", flow),
        ("none", "protein_niệu_24h", None, None, None, None), ("kept", "protein_niệu_24h", "g/24 giờ", None, "p * v / 1000", flow), ("no", "protein_niệu_24h", "kPa", None, "p * v / 1000", flow),
    ]
    _, f, _, c = frames(spark, [], formulas)
    got = {r.formula_id: (r.from_unit, r.unit_source, r.unique_unit) for r in formula_units(f, c).collect()}
    assert got == {
        "mg": ("mg/24h", "inferred", True), "g": ("g/24h", "inferred", True), "g2": ("g/24h", "inferred", True), "far": (None, None, False), "sum": (None, None, False), "dim": (None, None, False), "odd": (None, None, False),
        "none": (None, None, False), "kept": ("g/24h", "column", True), "no": (None, None, False),
    }


def test_identity_of_mass_density_and_volume():
    units = {"mass": [("g", 1.0), ("kg", 1000.0)], "density": [("g/ml", 1.0), ("mg/ml", 0.001)], "volume": [("ml", 1.0), ("l", 1000.0)]}
    law = [Identity({"mass": 1.0, "density": -1.0, "volume": -1.0})]
    assert choose_units({"mass": 3.0, "density": 1.5, "volume": 2.0}, {k: v[:1] for k, v in units.items()}, law) == ({"mass": "g", "density": "g/ml", "volume": "ml"}, pytest.approx(0), True)
    chosen, residual, unique = choose_units({"mass": 3.0, "density": 1.5, "volume": 2.0}, units, law)
    assert residual == pytest.approx(0) and not unique and chosen["mass"] == "g"  # kg with l fulfils it too
    assert choose_units({"mass": 3.0, "density": 1500.0, "volume": 2.0}, {**units, "mass": units["mass"][:1]}, law)[0] == {"mass": "g", "density": "mg/ml", "volume": "ml"}
    assert choose_units({"mass": 3.0}, units, law)[0] is None and choose_units({}, {}, []) == (None, pytest.approx(float("nan"), nan_ok=True), False)


@pytest.mark.parametrize("number, found", [("1,234.5", [1234.5]), ("12.345", [12.345, 12345.0]), ("0.123", [0.123]), ("7", [7.0]), ("1.2.3", []), ("1,234,567", [1234567.0])])
def test_printed_numbers(number, found):
    assert readings(number) == found


def test_everything_converted(spark):
    t, f, r, c = frames(spark, [(21, "Creatinin mau", "mg/dL", "", 2.0, 1.0, None, None, None)], [("f2", "fena_percent", "ratio", None)])
    got = rows(all_converted(t, f, r, c).select("source_table", "record_id", "from_unit", "value", "factor"))
    assert got == [("formulas", "f2", "tỷ số", None, 100.0), ("thresholds_extra", "21", "mg/dL", pytest.approx(176.8), 88.4)]
