"""Queries of the text-corpus operators over the tables of a data folder. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical_names, consistent, encoding, hidden_copies, mojibake, packing, scan_noise
from tessera.session import table


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.scanned_records(table(spark, folder, "thresholds_extra"), table(spark, folder, "medical_documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.scan_damage(_scanned(spark, folder))


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's text as continuous paragraphs, with the damage that was undone."""
    return scan_noise.repaired(_scanned(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_copies.copy_pairs(hidden_copies.threshold_hashes(table(spark, folder, "thresholds_extra")))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct threshold record once, with the number of its copies."""
    groups = hidden_copies.copy_groups(hidden_copies.threshold_hashes(table(spark, folder, "thresholds_extra")))
    return groups.select("keep_id", "copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_names.canonical_names(*(table(spark, folder, t) for t in ("thresholds_extra", "medical_tools_audit_report", "biomarker_reference")))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Names without a counterpart and how often they were typed."""
    typed = canonical_names.typed_names(table(spark, folder, "thresholds_extra"), table(spark, folder, "medical_tools_audit_report"))
    counts = typed.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    resolved = canonical_names.resolve_names(counts, table(spark, folder, "biomarker_reference"))
    return counts.join(resolved.where(F.col("biomarker") == canonical_names.UNMATCHED).select("name"), "name", "left_semi")


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry within the distance allowed of each distinct typed name, with the distance; one is picked."""
    typed = canonical_names.typed_names(table(spark, folder, "thresholds_extra"), table(spark, folder, "medical_tools_audit_report"))
    return canonical_names.closest_entries(typed, table(spark, folder, "biomarker_reference"))


def _consistent(spark: SparkSession, folder: str) -> DataFrame:
    words = consistent.reference_words(table(spark, folder, "biomarker_reference"))
    return consistent.consistent_texts(table(spark, folder, "thresholds_extra"), "row_id", ["source_text", "biomarker"], words)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consistent(spark, folder).select(F.col("id").alias("row_id"), "field")


def p6_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every value that lacked it."""
    return _consistent(spark, folder).select(F.col("id").alias("row_id"), "field", "consistent")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(encoding.token_counts(table(spark, folder, "documents")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, folder, "documents"), restore=False).select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with their wording restored as far as it can be."""
    return mojibake.garbled_documents(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "restored", "restorable")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_paragraphs, p4_found, p4_counts, p5_found, p5_unmatched, p5_entries, p6_found, p6_consistent, p8_ids, p9_containers, p10_found, p10_restored)
}
SQL: dict[str, str] = {}
