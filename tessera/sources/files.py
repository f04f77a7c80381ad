"""Readers and sinks of the artifact formats: JSON lines, JSON arrays, case files, XML, upserts, run logs and postings.

Readers take explicit schemas where the data is strict. Sinks write the partitions Spark has; nothing is coalesced to one
file unless asked for.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """JSON lines. Strict: a bad line fails; else bad lines are left out. Blank lines are skipped. With ``missing_ok`` a
    missing path gives an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files that hold one JSON array (or object) each; a row per element."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_cases(spark: SparkSession, path: str, schema: str | StructType, category: str | None = None) -> DataFrame:
    """Case files ``{category, cases: [...]}``, a row per case with its category; ``category`` selects one."""
    cases = read_json_array(spark, path, schema)
    if category is not None:
        cases = cases.where(F.col("category") == category)
    return cases.select("category", F.posexplode("cases").alias("pos", "case")).select("category", "pos", "case.*")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt records) of XML files; a corrupt record has its text and what could be read of it."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.format("xml").option("rowTag", row_tag).option("columnNameOfCorruptRecord", CORRUPT).schema(StructType(full.fields).add(CORRUPT, "string")).load(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("text"), F.struct(*full.names).alias("partial"))


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """UTF-8 JSON lines; null fields are left out."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the session names for checkpoints, else in a temporary one on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        from tessera.session import checkpointed

        checkpointed(spark.range(1))  # sets the folder as documented there
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the rows of ``changes`` in place of those with the same key; of several changes the last by ``order``.

    An anti-join and a union: unchanged rows are neither sorted nor aggregated. Null keys in ``changes`` are appended.
    """
    struct = F.struct(*(F.col(f"`{c}`") for c in changes.columns))
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(struct, F.col(order)).alias("_row")).select("_row.*")
    kept = target.join(last.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(last, allowMissingColumns=True).unionByName(changes.where(F.col(key).isNull()), allowMissingColumns=True)


def sync_plan(existing: DataFrame, incoming: DataFrame, key: str, policy: str = "update") -> DataFrame:
    """(key, action): what a dataset synchronisation does with each incoming id; policy ``update``, ``skip`` or ``fail``."""
    if policy not in ("update", "skip", "fail"):
        raise ValueError(f"unknown policy {policy}")
    new = incoming.join(existing.select(key), key, "left_anti").select(key, F.lit("create").alias("action"))
    old = incoming.join(existing.select(key), key, "left_semi").select(key, F.lit(policy).alias("action"))
    return new.unionByName(old).distinct()


def save_postings(index: DataFrame, path: str) -> None:
    """An inverted index as Parquet, clustered by term, so that a reader prunes row groups by term."""
    index.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def append_run(spark: SparkSession, path: str, run: DataFrame) -> DataFrame:
    """Appends (recorded_at, metric, value) rows to a run log and gives the whole log back."""
    run.write.mode("append").parquet(path)
    return spark.read.parquet(path)
