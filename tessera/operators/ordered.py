"""Operators that depend on an order: keep-first, carried state, neighbours in a sequence, majority and tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each distinct combination of ``keys``; nulls are equal to each other.

    An aggregation with map-side combining rather than a ranked window, so that a key with a third of all rows is no
    hot task. ``order`` must be unique for a defined result. An empty table stays empty.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    columns = df.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    grouped = df.select(*named, row.alias("_row"), F.struct(*(F.col(f"`{o}`") for o in order)).alias("_order"))
    first = grouped.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*(F.col("_row").getField(c).alias(c) for c in columns))


def carry_forward(df: DataFrame, partition: Sequence[str], order: Sequence[str], reset: Column, value: Column, name: str) -> DataFrame:
    """df plus ``name``: the last non-null ``value`` since the last row for which ``reset`` held, the row itself included."""
    within = Window.partitionBy(*partition).orderBy(*order)
    runs = df.withColumn("_reset", F.sum(F.when(F.coalesce(reset, F.lit(False)), 1).otherwise(0)).over(within)).withColumn("_value", value)
    inside = Window.partitionBy(*partition, "_reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).drop("_reset", "_value")


def look_back(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, rows: int, name: str) -> DataFrame:
    """df plus ``name``: the most recent non-null ``value`` among the ``rows`` rows before, the row itself excluded."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def majority_around(df: DataFrame, keys: Sequence[str], position: str, value: str, reach: int, name: str) -> DataFrame:
    """df plus ``name``: its own ``value``, or the strict majority value within ``reach`` positions; null on a tie.

    ``keys`` and ``position`` identify a row. A range join on the keys; nothing is collected.
    """
    others = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(position).alias("_p"), F.col(value).alias("_v"))
    condition = F.col("_p").between(F.col(position) - reach, F.col(position) + reach) & (F.col("_p") != F.col(position))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    empty = df.where(F.col(value).isNull()).select(*keys, position)
    votes = empty.join(others, condition).groupBy(*keys, position, "_v").agg(F.count(F.lit(1)).alias("_n"))
    tops = votes.groupBy(*keys, position).agg(F.max("_n").alias("_top"))
    winners = votes.join(tops, [*keys, position]).where("_n = _top").groupBy(*keys, position).agg(F.when(F.count(F.lit(1)) == 1, F.min("_v")).alias("_won"))
    renamed = winners.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(position).alias("_p"), "_won")
    on = F.col(position) == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(renamed, on, "left").select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.col(value), F.col("_won")).alias(name))


def pick_or_null(df: DataFrame, key: str, value: str, score: str, name: str) -> DataFrame:
    """(key, name): the value with the highest score of each key; null where two values share it."""
    best = df.groupBy(key).agg(F.max(score).alias("_top"))
    tops = df.join(best, key).where(F.col(score) == F.col("_top"))
    return tops.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(name))
