"""Problems 1 and 3: nested records and references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import nested, orphans
from tessera.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    audits, formulas = table(spark, folder, "medical_tools_audit_report"), table(spark, folder, "formulas")
    return nested.flatten_positions([(audits, "result_id", [nested.CHECKS, nested.MEASUREMENTS]), (formulas, "formula_id", [nested.VARIABLES])])


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_children(table(spark, folder, "medical_tools_audit_report"), "result_id", nested.CHECKS)


def p1_detected_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_children(table(spark, folder, "medical_tools_audit_report"), "result_id", nested.MEASUREMENTS)


def p1_variables(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_children(table(spark, folder, "formulas"), "formula_id", nested.VARIABLES)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.knowledge_orphans(*(table(spark, folder, t) for t in ("threshold_qa", "medical_documents", "thresholds_extra", "formulas")))


QUERIES = {f.__name__: f for f in (p1_found, p1_checks, p1_detected_measurements, p1_variables, p3_found)}


def _children(table_name: str, key: str, array: str, columns: str) -> str:
    return f"""
        SELECT DISTINCT {key} AS parent_id, CAST(i - 1 AS INTEGER) AS pos, {columns}
        FROM (SELECT {key}, {array} AS a, UNNEST(RANGE(1, CAST(LEN({array}) AS BIGINT) + 1)) AS i FROM {table_name})
        WHERE a[i] IS NOT NULL
    """


def _struct(names: str) -> str:
    return ", ".join(f"a[i].{n} AS {n}" for n in names.split())


SQL = {
    "p1_checks": _children("medical_tools_audit_report", "result_id", "checks", _struct("name passed detail")),
    "p1_detected_measurements": _children("medical_tools_audit_report", "result_id", "output_summary.detected_measurements", _struct("name value unit source")),
    "p1_variables": _children("formulas", "formula_id", "variables", _struct("name description unit required")),
    "p1_found": " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS child_table, CAST({key} AS VARCHAR) AS parent_id, CAST(i - 1 AS INTEGER) AS pos "
        f"FROM (SELECT {key}, {array} AS a, UNNEST(RANGE(1, CAST(LEN({array}) AS BIGINT) + 1)) AS i FROM {source}) WHERE a[i] IS NOT NULL"
        for name, source, key, array in (
            ("checks", "medical_tools_audit_report", "result_id", "checks"),
            ("detected_measurements", "medical_tools_audit_report", "result_id", "output_summary.detected_measurements"),
            ("variables", "formulas", "formula_id", "variables"),
        )
    ),
    "p3_found": """
        WITH refs AS (
            SELECT DISTINCT id, asked_at, target FROM (SELECT id, asked_at, UNNEST(relevant_document_ids) AS target FROM threshold_qa) WHERE target IS NOT NULL
        ), judged AS (
            SELECT r.id, r.asked_at, r.target, BOOL_OR(m.document_id IS NOT NULL) AS known,
                   BOOL_OR(COALESCE(m.created_at <= r.asked_at AND (m.deleted_at IS NULL OR m.deleted_at > r.asked_at), FALSE)) AS alive,
                   BOOL_OR(COALESCE(m.deleted_at <= r.asked_at, FALSE)) AS gone
            FROM refs r LEFT JOIN medical_documents m ON m.document_id = r.target GROUP BY ALL
        )
        SELECT DISTINCT 'threshold_qa' AS ref_table, id AS ref_id, target AS target_id,
               CASE WHEN NOT known THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS reason, STRFTIME(asked_at, '%Y-%m') AS period
        FROM judged WHERE NOT alive
        UNION ALL
        SELECT DISTINCT 'medical_documents', document_id, source_id, 'missing', STRFTIME(created_at, '%Y-%m') FROM medical_documents
        WHERE source_id IS NOT NULL AND (
            (source_type = 'threshold' AND source_id NOT IN (SELECT threshold_id FROM thresholds_extra WHERE threshold_id IS NOT NULL))
            OR (source_type = 'formula' AND source_id NOT IN (SELECT formula_id FROM formulas WHERE formula_id IS NOT NULL)))
    """,
}
