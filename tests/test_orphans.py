import datetime as dt
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from conftest import rows
from tessera.operators.orphans import ARRAY_LIMIT, BLOCK_BITS, Container, orphan_report

REFS = "ref_table string, ref_id string, space string, key string, at timestamp, extra int"
PARENTS = "space string, key string, born timestamp, ended timestamp, at int"


def brute(refs, parents):
    out = set()
    for t, i, s, k, at, _ in refs:
        if k is None:
            continue
        known = [p for p in parents if p[0] == s and p[1] == k]
        alive = any(at is None or ((p[2] is None or p[2] <= at) and (p[3] is None or p[3] > at)) for p in known)
        if alive:
            continue
        gone = any(p[3] is not None and at is not None and p[3] <= at for p in known)
        out.add((t, i, k, "missing" if not known else "deleted" if gone else "late", at.strftime("%Y-%m") if at else None))
    return sorted(out, key=lambda t: [(x is None, str(x)) for x in t])


def test_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(120), hours=rng.randrange(24))
    keys = [f"k{i}" for i in range(60)]
    parents = []
    for k in keys[:40]:
        born = rng.choice([None, day()])
        ended = rng.choice([None, None, (born or dt.datetime(2024, 1, 1)) + dt.timedelta(days=rng.randrange(1, 60))])
        parents += [("s", k, born, ended, 0)] * rng.choice([1, 1, 2])
    refs = [("t", f"r{i}", rng.choice(["s", "s", "other"]), rng.choice([*keys, "k0", "k0", None]), rng.choice([day(), day(), None]), 1) for i in range(400)]
    refs += refs[:20] + [("t", f"hot{i}", "s", "gone", day(), 1) for i in range(200)]  # repeated rows and a hot key
    got = orphan_report(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert rows(got) == brute(refs, parents)


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    assert rows(orphan_report(refs, parents)) == []
    one = spark.createDataFrame([("t", "r", "s", "k", dt.datetime(2024, 2, 3), 0)], REFS)
    assert rows(orphan_report(one, parents)) == [("t", "r", "k", "missing", "2024-02")]


CODES = st.one_of(st.sets(st.integers(0, 60)), st.integers(0, 3).map(lambda k: set(range(k, BLOCK_BITS, 7))))


@given(CODES, CODES)
def test_containers_are_sets(a, b):
    one, two = (Container(np.array(sorted(x), dtype=np.int64)) for x in (a, b))
    assert (one.array is None) == (len(a) > ARRAY_LIMIT)
    assert set((one | two).codes().tolist()) == a | b and set(one.andnot(two).codes().tolist()) == a - b


def test_versions_of_one_key_are_merged(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    parents = [("s", "k", at(1), at(5), 0), ("s", "k", at(3), at(9), 0), ("s", "k", at(12), None, 0), ("s", "n", None, at(4), 0)] + [("s", "k", at(3), at(4), 0)] * 50
    refs = [("t", str(d), "s", k, at(d), 0) for d in (1, 4, 5, 9, 11, 12, 30) for k in ("k", "n")]
    got = orphan_report(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert rows(got) == brute(refs, parents)
