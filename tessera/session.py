"""Session construction and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera", driver_memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own session; no operator builds one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _own_folder() -> str:
    """A temporary folder for a single machine, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder the session names in ``spark.checkpoint.dir`` and cut its lineage.

    The folder is shared by all executors, so a lost executor costs nothing. Only where the session names
    no folder (single-machine tests) a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        context.setCheckpointDir(named or _own_folder())
    return df.checkpoint(eager=True)


#: Rows up to which a table that may grow is sent to every task.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is, so that the planner shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_folder() -> str:
    """Folder of the public tokenizer files; the environment variable overrides the default."""
    return os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
