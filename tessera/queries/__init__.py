"""The catalog: every runnable query by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    """(queries, SQL) of all modules of this package."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        loaded = importlib.import_module(f"{__name__}.{module}")
        for name, query in loaded.QUERIES.items():
            if name in queries:
                raise ValueError(f"query {name} is defined twice")
            queries[name] = query
        sql |= loaded.SQL
    return queries, sql
