"""Freely typed names to the entries of a reference list (problem 5).

The search itself (a trie of entries and aliases walked by a Levenshtein automaton) is that of
:mod:`tessera.operators.names`; here are the names of the tables and what is reported of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import UNMATCHED, NameMatcher, closest_entries, resolve_names

__all__ = ["UNMATCHED", "NameMatcher", "canonical_names", "closest_entries", "resolve_names", "typed_names"]


def typed_names(thresholds: DataFrame, audits: DataFrame) -> DataFrame:
    """(source_table, record_id, pos, name) of all names typed, null ones and null elements left out."""
    first = thresholds.select(F.lit("thresholds_extra").alias("source_table"), F.col("row_id").cast("string").alias("record_id"), F.lit(0).alias("pos"), F.col("biomarker").alias("name"))
    measured = audits.select("result_id", F.transform("output_summary.detected_measurements", lambda m: m["name"]).alias("names")).distinct()
    second = measured.select(F.lit("medical_tools_audit_report").alias("source_table"), F.col("result_id").cast("string").alias("record_id"), F.posexplode("names").alias("pos", "name"))
    return first.unionByName(second).where(F.col("name").isNotNull())


def canonical_names(thresholds: DataFrame, audits: DataFrame, reference: DataFrame) -> DataFrame:
    """(source_table, record_id, pos, biomarker) of every name that is not written exactly as its entry.

    Audit rows delivered twice count once. A name typed in a third of all rows is one row of the searched vocabulary;
    the join that brings the entries back has that vocabulary on one side, once per name, so that adaptive execution
    may broadcast it or split the hot name's rows.
    """
    typed = typed_names(thresholds, audits)
    typed = typed.join(F.broadcast(reference.select(F.col("biomarker").alias("name"))), "name", "left_anti")
    return typed.join(resolve_names(typed, reference), "name").select("source_table", "record_id", "pos", "biomarker")
