import itertools
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import batches, optimal_boundaries, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_minimise_padding(counts, buckets):
    found = optimal_boundaries(counts, buckets)
    sizes = [i + 1 for i, c in enumerate(counts) if c]
    cost = lambda ends: sum(c * (min(e for e in ends if e >= i + 1) - i - 1) for i, c in enumerate(counts) if c)
    if not sizes:
        assert found == []
        return
    best = min(cost([*some, sizes[-1]]) for k in range(min(buckets, len(sizes))) for some in itertools.combinations(sizes[:-1], k))
    assert len(found) <= buckets and cost(found) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=20), st.integers(1, 5))
def test_plan_uses_every_item_once(counts, buckets):
    capacity = len(counts)
    plan, containers = batches(counts, optimal_boundaries(counts, buckets), capacity)
    used = defaultdict(int)
    for p in plan:
        assert (p.end - p.start) % p.each == 0
        for r in range(p.start, p.end):
            used[p.base + (r - p.start) // p.each] += p.size
    for size, count in enumerate(counts, 1):
        assert sorted(r for p in plan if p.size == size for r in range(p.start, p.end)) == list(range(count))
    assert not used or max(used.values()) <= capacity
    assert set(used) == set(range(containers))


def test_a_batch_takes_its_own_bucket_first():
    counts = [0] * 100
    counts[39], counts[37], counts[19], counts[21] = 2, 2, 2, 4  # sizes 40, 38, 20, 22
    plan, _ = batches(counts, [22, 40], 100)
    first = {p.size: p.each for p in plan if p.base == 0}
    assert first == {40: 2, 20: 1}  # no third one of its own bucket fits
    plan, _ = batches([0] * 29 + [10] + [0] * 3 + [1] + [0] * 66, [30, 100], 100)
    assert {p.size: p.each for p in plan if p.base == 0} == {34: 1, 30: 2}


def test_little_room_is_left():
    rng = random.Random(5)
    counts = [0] * 2048
    for _ in range(20_000):
        counts[min(2047, int(rng.lognormvariate(5.5, 1)))] += 1
    _, containers = batches(counts, optimal_boundaries(counts, 64), 2048)
    assert sum((i + 1) * c for i, c in enumerate(counts)) / (containers * 2048) > 0.995


def test_containers(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 0, 1, 5, 50, 64, 64, 64, 65, 100, 130, 200])) for i in range(500)] + [(7, 5)]
    out = pack(spark.createDataFrame(data, "doc_id long, tokens int"), capacity=64, buckets=8).collect()
    assert len(out) == sum(max(1, -(-(t or 0) // 64)) for _, t in data)
    load, pieces = defaultdict(int), defaultdict(int)
    for r in out:
        pieces[r.doc_id] += r.piece_tokens
        if r.container is None:
            assert r.piece_tokens == 0
        else:
            load[r.container] += r.piece_tokens
    want = defaultdict(int)
    for i, t in data:
        want[i] += t or 0
    assert pieces == want and max(load.values()) <= 64 and set(load) == set(range(len(load)))
    split = {r.doc_id for r in out if r.piece > 0}
    assert all(t > 64 for i, t in data if i in split and i != 7)


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens int")
    assert pack(empty).count() == 0
    assert [r.container for r in pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, tokens int")).collect()] == [None, None]
