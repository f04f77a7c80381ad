import math

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tessera.llm.scan_noise import CONFUSIONS, Model, Repair, candidate_line, channel, paragraphs, repaired, scan_damage, signature, signature_column, title_of

WORDS = {w: 500 for w in "thuốc bệnh thận người trong được kali máu theo dõi patients serum follow up low dose drug interstitium and carbonat natri blood acid".split()} | {"bicarbonat": 300, "in": 900, "inpatients": 40, "interstitium": 300, "clo": 90, "do": 600, "bi": 2, "ương": 1, "th": 2, "thương": 400, "tổn": 400}


@pytest.fixture(scope="module")
def repair():
    return Repair(Model(dict(WORDS), sum(WORDS.values()), {("clo", "máu"): 80, ("do", "thuốc"): 300}))


FILE = "Sổ tay lọc máu tập 6 - 2000-122.pdf"


@pytest.mark.parametrize("text, page, noise, want", [
    ("Tổn th-\nương trong thận", 5, {"hyphenation"}, "Tổn thương trong thận"),
    ("Tổn th¬ ương trong thận", 5, {"hyphenation"}, "Tổn thương trong thận"),
    ("natri bi-  carbonat máu", 5, {"hyphenation"}, "natri bicarbonat máu"),
    ("natri bi-\nTrang 464\nCHAPTER 3 - SỔ  TAY LỌC MÁU\ncarbonat máu", 464, {"hyphenation", "page_number", "running_header"}, "natri bicarbonat máu"),
    ("theo in-\npatients người", 5, {"hyphenation"}, None),
    ("low-\ndose drug and follow-up", 5, set(), None),
    ("người bệnli tr0ng thiiốc được", 5, {"misread"}, "người bệnh trong thuốc được"),
    ("clo máu trong thận", 5, set(), "clo máu trong thận"),
    ("B12 và CO2, G3b, 24h; kali máu!", 5, set(), None),
    ("thận\n~ SỔ TAY LỌC MÁU ~ Lưu hành nội bộ\t16\nmáu", 16, {"running_header", "page_number"}, None),
    ("người bệnh 203 / 243 theo dõi", 203, {"page_number"}, "người bệnh theo dõi"),
    ("Xem thêm trang 356.", 356, set(), None), ("theo dõi 356 người", 356, set(), None), ("thận\n356\nmáu", 356, {"page_number"}, None), ("thận\n355\nmáu", 356, set(), None),
    ("", 1, set(), ""), ("x", None, set(), "x"),
])
def test_damage_and_repair(repair, text, page, noise, want):
    out, found = repair(text, FILE, page, ())
    assert found == noise
    if want is not None:
        assert out == want


def test_unknown_source_and_learned_header(repair):
    assert repair("kali máu\nPhần II - Bệnh học\ntheo dõi", "x.pdf", 3, ["phan ii - benh hoc"])[1] == {"running_header"}
    text = "Tổn th-\nPhần II - Bệnh học (tiếp)\n416 / 459\nương trong thận"
    assert repair(text, "x.pdf", 416, ["phan ii - benh hoc", "phan ii - benh hoc (tiep)", "phan ii - benh hoc #"]) == ("Tổn thương trong thận", {"running_header", "page_number", "hyphenation"})
    assert repair("kali máu\n[48]\ntheo dõi", None, None, ())[1] == {"page_number"}


def test_titles_and_lines():
    assert title_of(FILE) == "Sổ tay lọc máu" and title_of("Cẩm nang tổng hợp (bản quét).pdf") == "Cẩm nang tổng hợp"
    assert candidate_line("Phần II - Bệnh học thận") and not candidate_line("thường.") and not candidate_line("a: b")


def test_paragraphs_keep_bullets():
    text = "Kali máu cao trong bệnh thận và cần được theo dõi\nở người bệnh.\n- creatinin: 7\n- ure: 8\n\nĐoạn hai được viết"
    assert paragraphs(text) == "Kali máu cao trong bệnh thận và cần được theo dõi ở người bệnh.\n- creatinin: 7\n- ure: 8\nĐoạn hai được viết"


def test_corpus(spark):
    clean = "người bệnh thận trong được theo dõi kali máu"
    data = [("t", str(i), FILE, 9, clean) for i in range(60)] + [("t", "bad", FILE, 9, "người bệnli thận\nTrang 9\nđược theo dõi"), ("t", "bad", FILE, 9, "người bệnli thận\nTrang 9\nđược theo dõi"), ("m", "nul", None, None, ""), ("m", "long", None, None, clean * 2000)]
    df = spark.createDataFrame(data, "source_table string, record_id string, source string, page int, text string").selectExpr("*", "'clash' as noise")
    assert rows(scan_damage(df)) == [("t", "bad", "misread"), ("t", "bad", "page_number")]
    assert {r.record_id: r.paragraphs for r in repaired(df).collect()}["bad"] == "người bệnh thận được theo dõi"
    assert scan_damage(df.limit(0)).count() == 0
    with_joins = repaired(df, max_shared=0)
    assert rows(with_joins.select("source_table", "record_id", "paragraphs", F.array_join("noise", ","))) == rows(repaired(df).select("source_table", "record_id", "paragraphs", F.array_join("noise", ",")))


def test_rare_words_count_in_a_corpus_of_any_size(spark):
    """A word that occurs four times among a million others is still what its misread form is read as."""
    page = "người bệnh thận trong được theo dõi kali máu " * 500
    data = [("t", str(i), None, None, page) for i in range(250)]
    data += [("t", f"rare{i}", None, None, f"dùng {w} mỗi ngày") for i, w in enumerate(["eplerenon"] * 4 + ["ep1erenon"])] + [("t", "hy", None, None, "dùng epler-\nenon mỗi ngày"), ("t", "co", None, None, "bơm na-\nkali sang")]
    data += [("t", f"co{i}", None, None, "bơm na-kali sang") for i in range(3)]
    df = spark.createDataFrame(data, "source_table string, record_id string, source string, page int, text string")
    assert rows(scan_damage(df)) == [("t", "hy", "hyphenation"), ("t", "rare4", "misread")]


def test_neighbours_decide_at_every_step():
    words = {"đo": 50, "clay": 40, "day": 4000, "soil": 60, "good": 900, "the": 5000}
    engine = Repair(Model(words, 20_000, {("the", "clay"): 30, ("clay", "soil"): 30, ("good", "day"): 700, ("good", "clay"): 1}))
    assert engine("the clay soil", None, None, ()) == ("the clay soil", set())
    assert engine("good clay", None, None, ()) == ("good day", {"misread"})


def test_signatures_and_the_channel(spark):
    for read, stands, p in CONFUSIONS:
        assert signature(f"x{read}y") == signature(f"x{stands}y")
        assert channel(f"x{read}y", f"x{stands}y") == pytest.approx(max(math.log(q) for r, s, q in CONFUSIONS if (r, s) == (read, stands)))
    assert channel("b0nli", "bonh") == pytest.approx(math.log(0.3 * 0.05)) and channel("1i", "h") == pytest.approx(math.log(0.3 * 0.05)) and channel("bonh", "b0nli") is None and channel("", "") == 0
    assert channel("m" * 400, "rn" * 400) == pytest.approx(400 * math.log(0.02))
    words = ["hmudw", "b0nli", "", "¢9!|15868$@€£", "thận"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", signature_column(F.col("w")).alias("s"))
    assert all(r.s == signature(r.w) for r in df.collect())
