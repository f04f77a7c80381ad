import math

import pytest

from conftest import rows
from tessera.operators import models as M


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "kali máu cao"), (2, "KALI mau cao"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in M.embedded(df).collect()}
    assert got[1] == got[2] and math.isclose(sum(x * x for x in got[1]), 1, rel_tol=1e-5) and got[3] == got[4] == [0.0] * 64


def test_reranking(spark):
    hits = [(1, "kali mau", f"d{i}", t, i) for i, t in enumerate(["x", "kali", "kali mau", "kali mau y", None] + ["z"] * 10, 1)]
    df = spark.createDataFrame(hits, "query_id int, query string, id string, text string, rank int")
    assert [r[:2] for r in rows(M.reranked(df, top=5).select("rank", "id", "query_id"))] == [(1, "d3"), (2, "d4"), (3, "d2")]  # the others fall below the floor
    assert rows(M.reranked(df, None, top=2)) == [(1, "d1", None, 1), (1, "d2", None, 2)]
    assert M.reranked(df.limit(0)).count() == 0


def test_judge_and_classifier(spark):
    df = spark.createDataFrame([(1, "a b c kali", "kali mau"), (2, None, "kali"), (3, "kali", None)], "id int, answer string, reference string")
    assert rows(M.judged(df)) == [(1, pytest.approx(0.5), ), (2, pytest.approx(0, abs=1e-4)), (3, pytest.approx(0, abs=1e-4))]
    texts = spark.createDataFrame([(1, "Kidney and renal disease, nephron"), (2, "adrenal kidney renal"), (3, "heart"), (4, None)], "id int, text string")
    make = lambda: M.KeywordClassifier(["kidney", "renal", "neph"], ["adrenal"])
    assert rows(M.classified(texts, make)) == [(1, True, 0.9375, "kidney,renal,neph")]
    assert [r.related for r in M.classified(texts, make, None).orderBy("id").collect()] == [True, False, False, False]
