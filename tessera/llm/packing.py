"""Texts into containers of fixed capacity (problem 9).

The driver sees only the histogram of sizes. Dynamic programming over it places the bucket boundaries where padding is least;
token-budget batches are formed inside each bucket, and a second stage gives what a batch leaves free to the largest sizes
of other buckets that fit. The resulting plan is a list of intervals of ranks per size; every executor looks its items up in it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

CAPACITY = 2048
BUCKETS = 64
#: Items that one ranked group should hold; a hot size is spread over as many groups as that takes.
GROUP = 500_000


def optimal_boundaries(counts: Sequence[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets over sizes 1..len(counts) that minimise total padding.

    ``counts[i]`` items have size i+1; an item is padded to its bucket's boundary. Exact, by dynamic programming.
    """
    counts = np.asarray(counts, dtype=np.float64)
    sizes = np.arange(1, len(counts) + 1)
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    values, weights = sizes[used], counts[used]
    n, items, mass = len(used), np.concatenate([[0], np.cumsum(weights)]), np.concatenate([[0], np.cumsum(weights * values)])
    if n <= buckets:
        return [int(v) for v in values]
    # cost[i, j]: padding of used sizes i..j-1 in one bucket that ends at size j-1
    i, j = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
    cost = np.where(j > i, values[j - 1] * (items[j] - items[i]) - (mass[j] - mass[i]), np.inf)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    came = np.zeros((buckets, n + 1), dtype=np.int32)
    for k in range(buckets):
        through = best[:n, None] + cost
        came[k, 1:] = np.argmin(through, axis=0)
        best = np.concatenate([[np.inf], through[came[k, 1:], np.arange(n)]])
    ends, j = [], n
    for k in range(buckets - 1, -1, -1):
        ends.append(int(values[j - 1]))
        j = int(came[k, j])
        if j == 0:
            break
    return sorted(ends)


@dataclass(frozen=True)
class Interval:
    """Items ``start`` up to ``end`` of a size, ``each`` of them to a container, from container ``base`` on."""

    size: int
    start: int
    end: int
    base: int
    each: int


def batches(counts: Sequence[int], boundaries: Sequence[int], capacity: int) -> tuple[list[Interval], int]:
    """(intervals, number of containers) for ``counts[i]`` items of size i+1 in buckets up to ``boundaries``.

    The largest size left opens a run of containers that are made alike. A container takes sizes of the same bucket as long
    as they fit, largest first (the batch), then sizes of all other buckets (the filling). The run ends when one of its sizes
    has too few items for another container, so the plan has a few intervals per size.
    """
    left, done, base, plan = {i + 1: int(c) for i, c in enumerate(counts) if c}, dict.fromkeys(range(1, len(counts) + 1), 0), 0, []
    below = {end: start + 1 for start, end in zip([0, *boundaries], boundaries)}
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        floor = below[boundaries[bisect_left(boundaries, top)]]
        room, pattern = capacity, {}
        for own in (True, False):
            at = 0
            while room and at < len(order):
                if order[at] > room:  # the first size that fits; sizes descend
                    at = bisect_left(order, -room, lo=at, key=lambda x: -x)
                    continue
                size = order[at]
                if own and size < floor:
                    break
                each = min(room // size, left[size] - pattern.get(size, 0))
                if each:
                    pattern[size] = pattern.get(size, 0) + each
                    room -= each * size
                at += 1
        times = min(left[size] // each for size, each in pattern.items())
        for size, each in pattern.items():
            plan.append(Interval(size, done[size], done[size] + each * times, base, each))
            done[size] += each * times
            left[size] -= each * times
        base += times
        order = [size for size in order if left[size]]
    return plan, base


def pack(sizes: DataFrame, id_column: str = "doc_id", size_column: str = "tokens", capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(id, piece, piece_tokens, container): every item once, in pieces only if it exceeds the capacity.

    Pieces of a too large item are full but for the last. Containers are numbered from 0; no container exceeds the
    capacity. Items without tokens (null and empty texts) take no room: their container is null. Repeated rows are items
    of their own. The sizes are written once, being read three times; beyond the histograms (one row per size and per
    :data:`GROUP` items of a size) nothing is collected, and a hot size is ranked in groups of bounded size.
    """
    spark = sizes.sparkSession
    size = F.coalesce(F.col(f"`{size_column}`").cast("long"), F.lit(0))
    items = sizes.select(F.col(f"`{id_column}`").alias("id"), size.alias("size"))
    full = F.floor((F.col("size") - 1) / capacity)
    items = items.select("id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(full, F.lit(0).cast("long")))).alias("piece"))
    items = items.select("id", F.col("piece").cast("int").alias("piece"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    items = checkpointed(items)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in items.groupBy("size").count().collect():
        histogram[row[0]] = row[1]
    plan, _ = batches(histogram[1:], optimal_boundaries(histogram[1:], buckets), capacity)
    # Groups of each size, as a lookup of ``capacity`` entries.
    groups = np.maximum(1, -(-histogram[1:] // GROUP))
    some = items.where("size > 0")
    some = some.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.element_at(F.lit([int(g) for g in groups]), F.col("size"))).cast("int"))
    offsets, before = [], dict.fromkeys(range(1, capacity + 1), 0)
    for k, g, n in sorted(tuple(r) for r in some.groupBy("size", "part").count().collect()):
        offsets.append((k, g, before[k]))
        before[k] += n
    rank = F.row_number().over(Window.partitionBy("size", "part").orderBy("id", "piece")) - 1
    ranked = some.withColumn("r", rank)
    # Bounded: one row per group, and a few intervals per size.
    ranked = ranked.join(F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "size int, part int, before long")), ["size", "part"]).withColumn("r", F.col("r") + F.col("before"))
    intervals = spark.createDataFrame([(p.size, p.start, p.end, p.base, p.each) for p in plan] or [(0, 0, 0, 0, 1)], "b int, s long, e long, base long, each long")
    placed = ranked.join(F.broadcast(intervals), (F.col("size") == F.col("b")) & (F.col("r") >= F.col("s")) & (F.col("r") < F.col("e")))
    placed = placed.select("id", "piece", "size", (F.col("base") + F.floor((F.col("r") - F.col("s")) / F.col("each"))).alias("container"))
    empty = items.where("size = 0").select("id", "piece", "size", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(empty).select(F.col("id").alias(id_column), "piece", F.col("size").alias("piece_tokens"), "container")
