import itertools
import re

from conftest import rows
from tessera.llm.hidden_copies import canonical_text, copy_groups, copy_pairs, record_hashes
from pyspark.sql import functions as F

SAME = [
    "Giữ kali máu < 5,5 mmol/L, sau 40 tháng.",
    "  giữ  kali máu\n< 5,5 mmol / L; sau 40 tháng!",
    "- GIỮ KALI MÁU <5,5 MMOL/L - sau 40 tháng",
]
FIELDS = [
    "Chỉ số: kali; Ngưỡng: < 5.5 mmol/L; Bệnh: thận",
    '{"Bệnh": "thận", "NGƯỠNG": "< 5.5 mmol/L", "Chỉ số": "kali"}',
    "• Ngưỡng: <5.5 mmol/L\n• Chỉ số: Kali\n• Bệnh: thận",
    "[Bệnh] thận ; [Chỉ số] kali ; [Ngưỡng] < 5.5 mmol/L.",
    "Bệnh: thận | Chỉ số: kali | Ngưỡng: < 5.5 mmol/L",
]
DIFFERENT = [
    "Giữ kali máu > 5,5 mmol/L, sau 40 tháng.", "Giữ kali máu < 55 mmol/L, sau 40 tháng.", "Giữ kali mau < 5,5 mmol/L, sau 40 tháng.", "Giữ máu kali < 5,5 mmol/L, sau 40 tháng.", "Giữ kali máu < 5.5 mmol/L, sau 40 tháng.",
    "Giữ kali máu 5 - 5,5 mmol/L", "Giữ kali máu 5 5,5 mmol/L", "Chỉ số: thận; Ngưỡng: < 5.5 mmol/L; Bệnh: kali", "", None,
]


def keys(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.k for r in df.select("i", canonical_text(F.col("t")).alias("k")).orderBy("i").collect()]


def test_formatting_is_no_difference(spark):
    assert len(set(keys(spark, SAME))) == 1
    assert len(set(keys(spark, FIELDS))) == 1


def test_content_is_a_difference(spark):
    found = keys(spark, [SAME[0], FIELDS[0], *DIFFERENT])
    assert len(set(found)) == len(found)
    assert found[-1] is None and found[-2] == ""


SCHEMA = "row_id long, label string, source_text string, extra double, threshold_id string, h string, x long"


def test_pairs_against_brute_force(spark):
    texts = SAME + FIELDS + DIFFERENT
    data = [(n, label, t, extra, f"t{n}", "clash", 1) for n, (t, label, extra) in enumerate(itertools.product(texts, ["A_1", "a 1", None], [1.0, None]))]
    data += [(10_000 + n, "hot", "same text", 0.0, None, None, None) for n in range(300)]  # one group with most rows
    key = {t: k for t, k in zip(texts, keys(spark, texts))}
    plain = lambda x: None if x is None else re.sub(r"[\W_]+", "", x).lower()
    groups = {}
    for r in data:
        groups.setdefault((key.get(r[2], r[2]), plain(r[1]), r[3], r[5], r[6]), []).append(r[0])
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    hashes = record_hashes(spark.createDataFrame(data, SCHEMA), "row_id", ("source_text", "label"), ("threshold_id",))
    assert sorted(map(tuple, copy_pairs(hashes).collect())) == want
    counts = {r.keep_id: r.copies for r in copy_groups(hashes).collect()}
    assert counts == {min(g): len(g) for g in groups.values()}


def test_empty_table(spark):
    assert rows(copy_pairs(record_hashes(spark.createDataFrame([], SCHEMA), "row_id", ("source_text", "label")))) == []
