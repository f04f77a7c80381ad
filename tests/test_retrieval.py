import math
import random
from collections import Counter

import pytest

from conftest import rows
from tessera.operators import retrieval as R


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "x1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(40)] + [(98, None), (99, "")]
    queries = [(1, "alpha beta beta"), (2, "unknownword"), (3, ""), (4, None)]
    index = R.postings(spark.createDataFrame(docs, "id long, text string"))
    got = R.bm25(spark.createDataFrame(queries, "query_id long, query string"), index, 5).collect()
    lists = {i: t.split() for i, t in docs if t}
    df = Counter(w for ws in lists.values() for w in set(ws))
    average = sum(map(len, lists.values())) / len(lists)
    raw = {w: math.log((len(lists) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    score = {i: round(sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / average)) for w in "alpha beta beta".split()), 6) for i, ws in lists.items()}
    want = sorted((-s, i) for i, s in score.items() if s >= R.FLOOR)[:5]
    assert [(r.query_id, r.id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(1, i, k + 1) for k, (_, i) in enumerate(want)]


def test_nearest_is_exact_and_breaks_ties_by_id(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(30)] + [(100, [1.0, 0.0, 0.0, 0.0]), (101, [2.0, 0.0, 0.0, 0.0]), (102, [0.0] * 4), (103, None)]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.id, r.rank) for r in R.nearest(q, v, 3, block=5).orderBy("rank").collect()]
    assert got[:2] == [(100, 1), (101, 2)] and len(got) == 3
    assert R.nearest(q.limit(0), v, 3).count() == 0 and R.nearest(q, v.limit(0), 3).count() == 0


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    one = rows(R.fuse({"vector": a, "keyword": b}).select("id", "rrf_score", "rank"))
    two = rows(R.fuse({"keyword": b, "vector": a}).select("id", "rrf_score", "rank"))
    assert one == two and one[1][0] == "y" and one[1][2] == 1
    assert one[1][1] == pytest.approx(0.85 / 62 + 1 / 61, abs=1e-9)


def test_conjunctive_needs_all_terms(spark):
    index = R.postings(spark.createDataFrame([(1, "kali cao"), (2, "kali"), (3, "cao kali kali")], "id long, text string"))
    got = R.conjunctive(spark.createDataFrame([(1, "kali cao")], "query_id int, query string"), index)
    assert rows(got.select("id", "score", "rank")) == [(1, 2, 2), (3, 3, 1)]


def test_neighbors_stay_within_file_and_page(spark):
    chunks = [("a", "f", 1, 0, "t0"), ("b", "f", 1, 1, "t1"), ("c", "f", 1, 9, "t9"), ("d", "f", 2, 1, "other"), ("e", None, None, 1, "n1"), ("f", None, None, 2, None)]
    c = spark.createDataFrame(chunks, "id string, source_file string, page int, chunk_index int, text string")
    hits = c.where("id in ('b', 'e')").select("id", "source_file", "page", "chunk_index")
    assert rows(R.neighbors(c, hits, ["source_file", "page"], "chunk_index").select("id", "expanded")) == [("b", "t0\nt1"), ("e", "n1")]


def test_gold_metrics(spark):
    have = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (3, None)], "query_id int, id string")
    want = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y"), (4, "z")], "query_id int, id string")
    assert rows(R.gold_metrics(have, want)) == [(1, 0.5, 0.5), (2, 0.0, 0.0), (4, 0.0, 0.0)]
