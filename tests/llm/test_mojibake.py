import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from tessera.llm import mojibake
from tessera.llm.mojibake import byte_table, garbled_documents, is_garbled, repair, suspect

CLEAN = [
    "Người bệnh đã xuất viện. MÃ HỒ SƠ 70064, NGƯỜI BỆNH ĐÃ XUẤT VIỆN", "SUIVI DE LA TÂCHE: À l’hôpital, la fièvre « régresse »", "Größere Mengen Süßstoff; Äpfel nur geschält", "Łódzki żur i świeży ogórek: sól",
    "При отёках назначают диету, чем раньше", "НАБЛЮДЕНИЕ. ДИАГНОЗ: ХБП, УЗИ", "Ґрунтовна перевірка їжі: є зміни", "Њега бубрега: љекар, џеп и ђак", "Σ liều ≈ √(cân nặng) × ∞? ∂V/∂t ≤ ∫ dòng, Ω = 0", "║ ca 1 ║ ca 2 ║\n╠══════╬══════╣\n┌──┐", "腎臓の記録：水分は少なめに。", "⚠️ 👍🏽 ✅ 🙏",
    "Giá: £12, ¥900, ¢50, ƒ3", "Điều khoản § 4, ¶ 2 ®", "Það er ðæ, þörf", "", "   ", "ascii only",
]
VIETNAMESE = "Người bệnh cần được theo dõi huyết áp, đường huyết và chức năng thận ở nhà"
RUSSIAN = "Пациентам на гемодиализе рекомендуют вести дневник"


def garble(text, encoding):
    back = {b: c for c, b in byte_table(encoding).items()}
    return "".join(back.get(b, chr(b)) if b > 127 else chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert repair(text) == (text, False) and not is_garbled(text)


@pytest.mark.parametrize("encoding", ["cp1252", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [VIETNAMESE, "café-style", "It isn’t clear", "Costs rose to €12"])
def test_round_trip(encoding, text):
    assert repair(garble(text, encoding)) == (text, True)
    assert repair("clean part. " + garble(text, encoding) + " Thêm phần sạch.") == ("clean part. " + text + " Thêm phần sạch.", True)


def test_twice_garbled_and_single_byte_encodings():
    assert repair(garble(garble(VIETNAMESE, "cp1252"), "cp1252")) == (VIETNAMESE, True)
    assert repair(RUSSIAN.encode("cp1251").decode("cp1252")) == (RUSSIAN, True)
    assert repair("Врач объясняет. " + "Высокий уровень калия".encode("koi8_r").decode("cp1251")) == ("Врач объясняет. Высокий уровень калия", True)
    assert repair("trong tyÒ lệ") == ("trong tỷ lệ", True)
    assert repair("измеряют âåñ и пульс") == ("измеряют вес и пульс", True)
    assert repair("giai ðoaòn, tuÒy thâòn xõ hóa") == ("giai đoạn, tủy thận xơ hóa", True)


def test_lost_characters_are_found():
    assert repair("th��n") == ("th��n", True)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ađ ÃÂ»áº¡é ПрČ║─┐√·∫0'"), max_size=30))
def test_flag_agrees_with_repair_and_prefilter(text):
    flag = repair(text)[1]
    assert is_garbled(text) == flag
    assert suspect(text) or not flag


def test_documents(spark):
    data = [(1, garble(VIETNAMESE, "cp1252")), (2, VIETNAMESE), (3, None), (4, ""), (5, "x�"), (6, "a " * 50_000 + garble("é", "cp1252")), (1, garble(VIETNAMESE, "cp1252"))]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as id", "'z' as restored")
    got = rows(garbled_documents(df).select("id", "restorable"))
    assert got == [(1, True), (1, True), (5, False), (6, True)]
    assert rows(garbled_documents(df, restore=False).distinct()) == [(1,), (5,), (6,)]
    assert garbled_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["foo â€ bar", "xß║ t", "xß╗ t", "x├t", "x├║t", "dбє t", "dб» t", "foo вЂ bar", "xƒë t", "xÄ° t"])
def test_prefilter_keeps_texts_whose_only_damage_is_a_broken_unit(text):
    assert is_garbled(text) and suspect(text)


@pytest.mark.parametrize("text", ["Права: обвинение, любви, «клуб», клуб» и пункт «б»", "├─foo\n├── bar", "їбє обвал"])
def test_letters_of_broken_units_in_clean_texts(text):
    assert not is_garbled(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ax â€ß║╗├бєв»ЂїƒëÄÆ°‘ï¿½"), max_size=12))
def test_prefilter_over_broken_units(text):
    assert suspect(text) or not is_garbled(text)


def test_every_level_is_undone():
    text = "thận và “máu”"
    garbled = text
    for _ in range(6):
        garbled = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in garbled.encode("utf-8"))
    assert mojibake.repair(garbled) == (text, True)
