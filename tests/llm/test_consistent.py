import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import rows
from tessera.functions.characters import IGNORABLE
from tessera.llm.consistent import Consistent, LookalikeTrie, consistent_texts, shows

CLEAN = [
    "Kali máu ≥ 5,5 mmol/L ở 4 °C ±2, TNF-α, β-blockers, 12 μmol/L, €280", "Через 212 часов после процедуры измеряют вес и пульс, с утра", "plain ascii\ttext\n", "",
    "Đạm niệu – “ghi chú” • ‘x’", "α", "β", "ASCII (serum sodium) и натрий",
]


@pytest.mark.parametrize("text", CLEAN)
def test_consistent_texts_stay(text):
    assert Consistent({False: {"sodium": 3}})(text) == text


@pytest.mark.parametrize("text, want", [
    ("ｃｒｅａｔｉｎｉｎ　ｍáｕ ＜ ３２．４％", "creatinin máu < 32.4%"), ("сrеаtіnіnе", "creatinine"), ("phosph﻿o​ máu­", "phospho máu"), ("a b c", "a b c"), ("ﬁltration µ", "filtration μ"),
    ("𝗅𝗒𝗂𝗇𝗀 flat", "lying flat"), (unicodedata.normalize("NFD", "thận cấp"), "thận cấp"), ("thận сấр", "thận cấp"), ("Τһὸ̛і gian", "Thời gian"), ("ΗDL и натрий ВЕС", "HDL и натрий ВЕС"), ("РТН", "PTH"), ("кaлия ждёт", "калия ждёт"),
])
def test_consistent_form(text, want):
    assert Consistent()(text) == want
    assert Consistent()(want) == want


WORDS = {False: {"creatinine": 50, "β": 99, "poc": 4, "hb": 80, "pth": 9, "to": 70, "co": 5}, True: {"рост": 7, "тест": 5, "то": 40, "калия": 9, "pth": 6, "ртн": 1, "to": 2}}


@pytest.mark.parametrize("text, want", [
    ("рост", "рост"), ("Ηb тест", "Hb тест"), ("сrеаtіnіnе", "creatinine"), ("Рос", "Poc"), ("СО", "CO"), ("то", "to"), ("то ждёт", "то ждёт"), ("РТН ждёт", "PTH ждёт"), ("кaлия", "калия"),
    ("unкnown", "unknown"), ("а", "a"), ("РТН", "PTH"), ("х​ждёт", "хждёт"), ("crea​tіnine", "creatinine"),
])
def test_vocabulary_comes_before_the_table(text, want):
    assert Consistent(WORDS)(text) == want


def test_an_empty_vocabulary_changes_the_result():
    assert Consistent()("рост") == "poct" and Consistent()("Ηb тест") == "Hb tect"


def test_automaton_costs():
    trie = LookalikeTrie({"creatinine": 3, "thận": 2, "than": 9})
    deco = lambda t: unicodedata.normalize("NFKD", t)
    assert [(c, n) for c, _, n in trie.search(deco("сrеа​tіnіnе"))] == [(0.0, 3)]
    assert trie.search(deco("creatinin")) == [] and [(c, n) for c, _, n in trie.search(deco("creatinin"), 1)] == [(1.0, 3)]
    assert [(c, n) for c, _, n in trie.search(deco("tհận"), 2)] == [(0.0, 2), (2.0, 9)] and trie.search(deco("thаn")) == [(0.0, "than", 9)]
    assert trie.search("", 0.5) == []


@given(st.lists(st.text("abcо", min_size=1, max_size=5), min_size=1, max_size=6, unique=True), st.text("abcосе​", min_size=1, max_size=6), st.integers(0, 2))
def test_automaton_against_edit_distance(words, token, limit):
    def cost(a, b):
        row = [0]
        for c in a:
            row.append(row[-1] + (c not in IGNORABLE))
        for char in b:
            new = [row[0] + 1]
            for i, c in enumerate(a):
                new.append(min(row[i] + (char not in shows(c)), row[i + 1] + 1, new[i] + (c not in IGNORABLE)))
            row = new
        return row[-1]

    assert sorted((c, w) for c, w, _ in LookalikeTrie(dict.fromkeys(words, 1)).search(token, limit)) == sorted((cost(token, w), w) for w in words if cost(token, w) <= limit)


def test_words_of_the_corpus_decide(spark):
    texts = ["рост и вес ждёт", "рост", "poc co", "Рос", "creatinine", "сrеаtіnіnе", None, "", "Ηb тест", "тест и рост ждёт"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = [(3, "Poc"), (5, "creatinine"), (8, "Hb тест")]
    assert rows(consistent_texts(df, "id", ["t"]).select("id", "consistent")) == want
    assert rows(consistent_texts(df, "id", ["t"], max_shared=0).select("id", "consistent")) == want
    assert rows(consistent_texts(df.where("id in (1, 8)"), "id", ["t"]).select("id", "consistent")) == [(1, "poct"), (8, "Hb tect")]


def test_rows_and_fields(spark):
    df = spark.createDataFrame([(1, "ok", "ｘ"), (1, "ok", "ｘ"), (2, None, None), (3, "a​b", ""), (4, "x" * 100_000 + "­", "y")], "id long, t string, field string")
    got = rows(consistent_texts(df, "id", ["t", "field"]).select("id", "field", "consistent"))
    assert got == [(1, "field", "x"), (1, "field", "x"), (3, "t", "ab"), (4, "t", "x" * 100_000)]
    assert consistent_texts(df.limit(0), "id", ["t"]).count() == 0
