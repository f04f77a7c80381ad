import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from tessera.operators.automaton import Trie
from tessera.llm.canonical_names import UNMATCHED, NameMatcher, canonical_names, closest_entries

WORDS = st.text("abcd", min_size=0, max_size=7)


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS.filter(bool), min_size=1, max_size=8, unique=True), WORDS, st.integers(0, 3))
def test_automaton_against_edit_distance(entries, name, limit):
    trie = Trie((e, i) for i, e in enumerate(entries))
    want = sorted((distance(name, e), e, i) for i, e in enumerate(entries) if distance(name, e) <= limit)
    assert sorted(trie.search(name, limit)) == want


REFERENCE = [(1, "creatinine", "creatinin máu", "serum creatinine", ["SCr"]), (2, "potassium", "kali máu", "serum potassium", ["K+"]), (3, "albumin_máu", "albumin huyết thanh", "serum albumin", ["Alb"]), (4, "ACR", "tỷ lệ albumin creatinin niệu", None, None)]


def test_typed_names():
    matcher = NameMatcher([(i, c, [x for x in (v, e, *(a or [])) if x]) for i, c, v, e, a in REFERENCE])
    for typed, want in {
        "Creatinin  máu": "creatinine", "creatinin máu (SCr)": "creatinine", "сrеаtіnіnе": "creatinine", "ｃｒｅａｔｉｎｉｎｅ": "creatinine", "XN kali mau lần 1": "potassium", "(K+)": "potassium", "Seum Potasssium": "potassium",
        "albumin, serum": "albumin_máu", "ALBUMIN-MÁU:": "albumin_máu", "ty le albumin creatinin nieu": "ACR", "k": "unmatched", "troponin T": "unmatched", "": "unmatched", "???": "unmatched", "x" * 5000: "unmatched", "cr​eatinine": "creatinine",
    }.items():
        assert matcher.match(typed) == want, typed


def test_names_of_both_tables(spark):
    reference = spark.createDataFrame(REFERENCE, "biomarker_id int, biomarker string, name_vi string, name_en string, aliases array<string>")
    thresholds = spark.createDataFrame([(1, "Kali máu", "x"), (2, None, "x"), (3, "potassium", "x"), (4, "gene panel", "x"), (5, "Kali máu", "x")], "row_id long, biomarker string, name string")
    audit = [(9, ([("scr", 1.0), None, (None, 2.0), ("creatinine", 1.0)],)), (9, ([("scr", 1.0), None, (None, 2.0), ("creatinine", 1.0)],)), (10, (None,)), (11, None), (12, ([],))]
    audits = spark.createDataFrame(audit, "result_id long, output_summary struct<detected_measurements array<struct<name string, value double>>>")
    got = rows(canonical_names(thresholds, audits, reference))
    assert got == [("medical_tools_audit_report", "9", 0, "creatinine"), ("thresholds_extra", "1", 0, "potassium"), ("thresholds_extra", "4", 0, "unmatched"), ("thresholds_extra", "5", 0, "potassium")]
    assert canonical_names(thresholds.limit(0), audits.limit(0), reference).count() == 0


@pytest.mark.parametrize("typed, entry", [("albmn", "albumin"), ("phosphlpd", "phospholipid"), ("phosphlipd", "phospholipid"), ("ferrtn", "ferritin")])
def test_deletions_are_counted_by_the_length_of_the_entry(typed, entry):
    assert NameMatcher([(1, entry, [])]).match(typed) == entry


@pytest.mark.parametrize("typed, entry", [("albm", "albumin"), ("phosphlp", "phospholipid"), ("na", "natri"), ("ur", "urea")])
def test_too_many_deletions_stay_unmatched(typed, entry):
    assert NameMatcher([(1, entry, [])]).match(typed) == UNMATCHED


def test_all_entries_within_the_distance(spark):
    reference = spark.createDataFrame([(1, "albumin", None, None, None), (2, "albumins", None, None, ["albmin"]), (3, "ferritin", None, None, None)], "biomarker_id int, biomarker string, name_vi string, name_en string, aliases array<string>")
    names = spark.createDataFrame([("albumn",), ("albumn",), ("ferritin",), ("xyz",), ("",), (None,)], "name string")
    got = rows(closest_entries(names, reference))
    assert got == [("", "unmatched", None, True), ("albumn", "albumin", 1, True), ("albumn", "albumins", 2, False), ("ferritin", "ferritin", 0, True), ("xyz", "unmatched", None, True)]
