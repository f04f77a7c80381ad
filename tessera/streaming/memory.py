"""Streaming forms: rolling memory per conversation, look-back of the last messages, incremental upsert, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEMORY_CHARACTERS = 600


def summarize(previous: str, question: str, answer: str, size: int = MEMORY_CHARACTERS) -> str:
    """The deterministic rolling summary: the last ``size`` characters of the notes so far."""
    note = f"Q: {question.strip()} A: {answer.strip()}".strip()
    return (f"{previous} | {note}" if previous else note)[-size:]


def rolling_memory(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, summary) of a stream (conv_id, turn, question, answer): the memory after each turn.

    The state of a conversation is one text of bounded length, whatever its number of turns.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (summary,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values("turn")  # the new turns of one conversation in one micro-batch
        out = []
        for turn, question, answer in zip(rows["turn"], rows["question"], rows["answer"]):
            summary = summarize(summary, question or "", answer or "")
            out.append((key[0], turn, summary))
        state.update((summary,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "summary"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turn long, summary string", "summary string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, end, key, n) per tumbling window; events later than ``late`` are dropped by the watermark."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def incremental_upsert(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """A started query that adds each micro-batch to the Parquet log at ``path``: of each key its last change by ``order``.

    A batch writes what it has and nothing else, into a folder of its own, so that its cost doesn't grow with the table and a
    batch that is run again after a failure replaces itself. :func:`current_table` merges when it reads, :func:`compact` once
    in a while. Rows with a null key are kept as they are.
    """

    def add(batch: DataFrame, number: int) -> None:
        last_changes(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row by ``order``, combined on the map side; all rows without a key."""
    row = F.struct(*(F.col(f"`{c}`") for c in changes.columns))
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")
    return last.unionByName(changes.where(F.col(key).isNull()))


def current_table(spark, path: str, key: str, order: str) -> DataFrame:
    """The table that :func:`incremental_upsert` has merged so far."""
    return last_changes(spark.read.parquet(path).drop("batch"), key, order)


def compact(spark, path: str, target: str, key: str, order: str) -> DataFrame:
    """The merged table written as the first batch of a new log at ``target``; gives it back."""
    current_table(spark, path, key, order).write.mode("overwrite").parquet(f"{target}/batch=0")
    return spark.read.parquet(target).drop("batch")
