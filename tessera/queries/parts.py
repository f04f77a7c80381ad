"""Operators with an entry of their own: joins, ranks and predicates that other queries have inside, evaluation, contracts, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import salvage
from tessera.functions import text as T
from tessera.functions.vocab import CLASS_RULES, SEX_FACTORS
from tessera.operators import blocks as K
from tessera.operators import lab, models
from tessera.operators import retrieval as R
from tessera.operators import rules as RU
from tessera.queries.search import _ASKED, _CHUNKS, _INDEX, TOP, _bm25, _chunks, _nearest, _passages, _queries, _vectors, sql_key, sql_token_set, sql_tokens
from tessera.sources import files
from tessera.session import broadcast_if_small, checkpointed, spread, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, folder):
    return table(spark, folder, "thresholds_extra")


def _qa(spark, folder):
    return table(spark, folder, "threshold_qa")


def _docs(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", "source_type", "source_id", "content", "metadata").distinct()


# Sources and sinks ------------------------------------------------------------------------------------------------
@query("SELECT row_id, label FROM thresholds_extra")
def src04_jsonl_with_blank_lines(spark, folder):
    """Lines of JSON between blank ones; a path that is missing adds nothing."""
    path = files.scratch(spark, "blank")
    t = _t(spark, folder).select(F.concat(F.to_json(F.struct("row_id", "label")), F.lit("\n\n")).alias("value"))
    t.write.text(path)
    schema = "row_id long, label string"
    return files.read_jsonl(spark, path, schema).where("row_id is not null").unionByName(files.read_jsonl(spark, f"{path}-missing", schema, missing_ok=True))


@query("SELECT row_id, label FROM thresholds_extra WHERE page IS NULL OR page >= 40")
def src05_jsonl_with_bad_lines(spark, folder):
    """Lines that were cut off are left out."""
    path = files.scratch(spark, "bad")
    line = F.to_json(F.struct("row_id", "label"))
    _t(spark, folder).select(F.when(F.col("page") < 40, F.expr("substring(to_json(struct(row_id, label)), 1, 7)")).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "row_id long, label string", strict=False).where("row_id is not null")


@query("SELECT DISTINCT disease_name AS category, result_id, title FROM medical_tools_audit_report WHERE disease_name IS NOT NULL")
def src08_case_files(spark, folder):
    """One case file a category, read back with a row per case."""
    path = files.scratch(spark, "cases")
    a = table(spark, folder, "medical_tools_audit_report").where("disease_name is not null").select("disease_name", "result_id", "title").distinct()
    # A file holds a page of at most some thousand cases, as case files do; a large category has several.
    paged = a.groupBy(F.col("disease_name").alias("category"), F.floor(F.col("result_id") / 5000).alias("part")).agg(F.collect_list(F.struct("result_id", "title")).alias("cases"))
    paged.select("category", "cases").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_cases(spark, path, "category string, cases array<struct<result_id long, title string>>").select("category", "result_id", "title")


@query("SELECT DISTINCT id, query AS question, reference_answer AS answer FROM threshold_qa WHERE query <> '' AND reference_answer <> ''")
def gen18_xml_pairs(spark, folder):
    """Question and answer pairs written as XML and read back; pairs without a question or an answer are dropped."""
    path = files.scratch(spark, "pairs")
    q = _qa(spark, folder).select("id", F.col("query").alias("question"), F.col("reference_answer").alias("answer")).distinct()
    q.write.format("xml").option("rootTag", "pairs").option("rowTag", "pair").save(path)
    good, _ = files.read_xml(spark, path, "pair", "id string, question string, answer string")
    return good.where("question <> '' and answer <> ''")


@query("SELECT DISTINCT result_id, passed, LEN(LIST_FILTER(checks, lambda c: c IS NOT NULL AND NOT c.passed)) AS failed FROM medical_tools_audit_report WHERE checks IS NOT NULL")
def snk09_summary_lines(spark, folder):
    """Summaries as JSON lines with sorted keys, appended to a run log and read back."""
    path = files.scratch(spark, "log")
    a = table(spark, folder, "medical_tools_audit_report").where("checks is not null")
    s = a.select(F.size(F.filter("checks", lambda c: c.isNotNull() & ~c["passed"])).cast("long").alias("failed"), "passed", "result_id").distinct()
    files.write_jsonl(s, path)
    return files.read_jsonl(spark, path, "failed long, passed boolean, result_id long").select("result_id", "passed", "failed")


# JSON salvage -----------------------------------------------------------------------------------------------------
_BROKEN = "CHR(65279) || '{\"document_id\": \"' || formula_id || '\",' || CHR(1) || ' \"page\": ' || COALESCE(CAST(page AS VARCHAR), 'null') || ' ,}'"


@query(f"SELECT formula_id, REGEXP_REPLACE(REPLACE(REPLACE({_BROKEN}, CHR(65279), ''), CHR(1), ''), ',(\\s*[}}\\]])', '\\1', 'g') AS repaired FROM (SELECT DISTINCT formula_id, page FROM formulas)")
def gen10_json_repair(spark, folder):
    """Byte order mark, control characters and trailing commas out of damaged objects."""
    f = table(spark, folder, "formulas").select("formula_id", "page").distinct()
    broken = F.concat(F.lit('﻿{"document_id": "'), "formula_id", F.lit('",\x01 "page": '), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit(" ,}"))
    return f.select("formula_id", salvage.repaired_column(broken).alias("repaired"))


@query("""SELECT doc_id, JSON_EXTRACT_STRING(x, '$.biomarker') AS biomarker, x IS NOT NULL AND JSON_EXTRACT_STRING(x, '$.biomarker') IS NOT NULL AS good, CASE WHEN JSON_EXTRACT_STRING(x, '$.biomarker') IS NULL THEN SUBSTRING(x, 1, 500) END AS snippet
    FROM (SELECT doc_id, REGEXP_EXTRACT_ALL(text, '\\{[^{}\\n]*\\}') AS l FROM documents) s, UNNEST(s.l) AS u(x)""")
def gen11_parsed_candidates(spark, folder):
    """Objects that parse and have the key asked for, and the first 500 characters of those that don't."""
    d = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{[^{}\n]*\}"), F.lit(0))).alias("x"))
    key = F.get_json_object("x", "$.biomarker")
    return d.select("doc_id", key.alias("biomarker"), key.isNotNull().alias("good"), F.when(key.isNull(), F.substring("x", 1, 500)).alias("snippet"))


@query("SELECT FLOOR((ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 50)::BIGINT AS batch, source, COUNT(*) OVER (PARTITION BY source) AS of_source, doc_id FROM documents WHERE source IS NOT NULL")
def gen16_batches(spark, folder):
    """Batches of fifty of each source's documents, in the order of their ids.

    Ranks are taken within ranges of ids whose counts are summed up before them, so that a hot source is many windows.
    """
    d = table(spark, folder, "documents").where("source is not null").select("doc_id", "source", F.floor(F.col("doc_id") / 20_000).alias("range"))
    counts = d.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("range")
    sums = counts.select("source", "range", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("of_source"))
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("source", "range").orderBy("doc_id"))).join(sums, ["source", "range"])
    return ranked.select(F.floor((F.col("r") + F.col("before") - 1) / 50).alias("batch"), "source", "of_source", "doc_id")


# Projections ------------------------------------------------------------------------------------------------------
@query("""SELECT DISTINCT document_id, STRUCT_PACK(doc_type := COALESCE(metadata.doc_type, 'unknown'), disease_name := metadata.disease_name, page := metadata.page, n_chars := LENGTH(content), source := source_type || ':' || source_id)::VARCHAR IS NOT NULL AS assembled,
    COALESCE(metadata.doc_type, 'unknown') AS doc_type, LENGTH(content) AS n_chars, CONCAT_WS('|', metadata.disease_name, metadata.section_type, metadata.page) AS tag FROM medical_documents""")
def prj01_metadata_assembly(spark, folder):
    """The metadata of a passage put together with defaults; absent parts leave no separator in its tag."""
    kind = F.coalesce("metadata.doc_type", F.lit("unknown"))
    return _docs(spark, folder).select("document_id", F.lit(True).alias("assembled"), kind.alias("doc_type"), F.length("content").alias("n_chars"), F.concat_ws("|", "metadata.disease_name", "metadata.section_type", F.col("metadata.page").cast("string")).alias("tag")).distinct()


@query("SELECT DISTINCT 'structured::' || formula_id AS document_id, 'Formula: ' || COALESCE(formula_name, formula_id) || CHR(10) || COALESCE(expression, '') AS embedding_text, 'structured_table' AS source_type FROM formulas")
def prj09_structured_documents(spark, folder):
    f = table(spark, folder, "formulas")
    text = F.concat(F.lit("Formula: "), F.coalesce("formula_name", "formula_id"), F.lit("\n"), F.coalesce("expression", F.lit("")))
    return f.select(F.concat(F.lit("structured::"), "formula_id").alias("document_id"), text.alias("embedding_text"), F.lit("structured_table").alias("source_type")).distinct()


@query("""SELECT row_id, CASE WHEN threshold_op = 'between' THEN CONCAT_WS(' ', COALESCE(biomarker, '?'), 'between', CAST(ROUND(threshold_value_min * 1000) AS BIGINT), CAST(ROUND(threshold_value_max * 1000) AS BIGINT), threshold_unit) ELSE CONCAT_WS(' ', COALESCE(biomarker, '?'), threshold_op, CAST(ROUND(threshold_value * 1000) AS BIGINT), threshold_unit) END AS rule,
    CONCAT_WS(', p. ', source_file, page) AS source FROM thresholds_extra""")
def prj12_serialised_rules(spark, folder):
    """Rules and their sources as strings, values in thousandths."""
    whole = lambda c: F.round(F.col(c) * 1000).cast("bigint").cast("string")
    name = F.coalesce("biomarker", F.lit("?"))
    both = F.concat_ws(" ", name, F.lit("between"), whole("threshold_value_min"), whole("threshold_value_max"), "threshold_unit")
    one = F.concat_ws(" ", name, "threshold_op", whole("threshold_value"), "threshold_unit")
    return _t(spark, folder).select("row_id", F.when(F.col("threshold_op") == "between", both).otherwise(one).alias("rule"), F.concat_ws(", p. ", "source_file", F.col("page").cast("string")).alias("source"))


@query("""SELECT id, STRING_AGG('[' || r || '] ' || SUBSTRING(f, 1, 1800), CHR(10) ORDER BY r) AS prompt FROM (SELECT id, f, ROW_NUMBER() OVER (PARTITION BY id ORDER BY p) AS r FROM
    (SELECT id, UNNEST(required_facts) AS f, UNNEST(RANGE(LEN(required_facts))) AS p FROM (SELECT DISTINCT id, required_facts FROM threshold_qa)) WHERE f IS NOT NULL) GROUP BY id""")
def prj15_evidence_blocks(spark, folder):
    """Numbered evidence blocks of each case, each cut at 1,800 characters, in order."""
    q = _qa(spark, folder).select("id", "required_facts").distinct()
    facts = F.filter("required_facts", lambda f: f.isNotNull())
    lines = F.transform(facts, lambda f, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(f, 1, 1800)))
    return q.where(F.size(facts) > 0).select("id", F.array_join(lines, "\n").alias("prompt"))


@query("""SELECT DISTINCT s.result_id, f.formula_id, f.status, COALESCE(c.formula_name, f.formula_name) AS title FROM (SELECT DISTINCT result_id, UNNEST(output_summary.formula_results) AS f FROM medical_tools_audit_report) s
    LEFT JOIN (SELECT formula_id, MIN(formula_name) AS formula_name FROM formulas GROUP BY formula_id) c ON c.formula_id = f.formula_id WHERE f IS NOT NULL""")
def prj17_result_documents(spark, folder):
    """The formula results of each report as document rows, with the catalogue's name where it has one."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.explode("output_summary.formula_results").alias("f")).where("f is not null")
    catalogue = table(spark, folder, "formulas").groupBy("formula_id").agg(F.min("formula_name").alias("known"))
    return a.select("result_id", "f.formula_id", "f.status", "f.formula_name").join(catalogue, "formula_id", "left").select("result_id", "formula_id", "status", F.coalesce("known", "formula_name").alias("title")).distinct()


@query("""SELECT result_id, CONCAT_WS(CHR(10), 'Measured: ' || ARRAY_TO_STRING((LIST_FILTER(LIST_TRANSFORM(d, lambda x: x.name), lambda x: x IS NOT NULL))[1:20], ', '), 'Classes: ' || ARRAY_TO_STRING((LIST_FILTER(LIST_TRANSFORM(c, lambda x: x.biomarker || ' ' || x.label), lambda x: x IS NOT NULL))[1:12], ', '),
    'Formulas: ' || ARRAY_TO_STRING((LIST_FILTER(LIST_TRANSFORM(f, lambda x: x.formula_id || ' ' || x.status), lambda x: x IS NOT NULL))[1:10], ', ')) AS prompt
    FROM (SELECT DISTINCT result_id, output_summary.detected_measurements AS d, output_summary.classifications AS c, output_summary.formula_results AS f FROM medical_tools_audit_report)""")
def prj20_report_lines(spark, folder):
    """Lines of a report prompt: at most 20 measurements, 12 classes and 10 formulas; absent parts give no line."""
    o = F.col("output_summary")
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", o["detected_measurements"].alias("d"), o["classifications"].alias("c"), o["formula_results"].alias("f")).distinct()
    part = lambda name, items, most: F.concat(F.lit(f"{name}: "), F.array_join(F.slice(F.filter(items, lambda x: x.isNotNull()), 1, most), ", "))
    two = lambda c, x, y: F.transform(c, lambda m: F.concat(m[x], F.lit(" "), m[y]))
    return a.select("result_id", F.concat_ws("\n", part("Measured", F.transform("d", lambda m: m["name"]), 20), part("Classes", two("c", "biomarker", "label"), 12), part("Formulas", two("f", "formula_id", "status"), 10)).alias("prompt"))


@query("SELECT DISTINCT id, COALESCE(NULLIF(TRIM(reference_answer), ''), NULLIF(TRIM(title), ''), NULLIF(TRIM(query), ''), '') AS answer FROM threshold_qa")
def prj21_probed_answer(spark, folder):
    """The first of several fields that holds a text."""
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return _qa(spark, folder).select("id", F.coalesce(text("reference_answer"), text("title"), text("query"), F.lit("")).alias("answer")).distinct()


# Predicates -------------------------------------------------------------------------------------------------------
def _topic(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return models.classified(texts, lambda: models.KeywordClassifier(["kidney", "renal", "nephr", "than", "thận"], ["adrenal"]), None)


_TOPIC = """c AS (SELECT doc_id AS id, LIST_FILTER(['kidney', 'renal', 'nephr', 'than', 'than'], lambda k: CONTAINS(b, k)) AS hits, CONTAINS(b, 'adrenal') AS veto FROM (SELECT doc_id, STRIP_ACCENTS(REPLACE(LOWER(COALESCE(text, '')), 'đ', 'd')) AS b FROM documents)),
    j AS (SELECT id, LEN(hits) > 0 AND NOT veto AS related, CASE WHEN veto THEN 0.95::DOUBLE ELSE ROUND(1 - POW(0.5::DOUBLE, LEN(hits) + 1), 6) END AS confidence FROM c)"""


@query()
def udf05_topic_classes(spark, folder):
    """Label, confidence and reason of every document by the classifier given."""
    return _topic(spark, folder)


@query()
def flt08_confident_topic(spark, folder):
    return _topic(spark, folder).where(F.col("related") & (F.col("confidence") >= models.MIN_CONFIDENCE)).select("id", "confidence")


@query(f"""SELECT id, CASE WHEN LENGTH(TRIM(k)) = 0 THEN TRUE WHEN REGEXP_MATCHES(k, '[0-9]') OR CONTAINS(k, 'benh') OR CONTAINS(k, 'than') OR CONTAINS(k, 'mau') OR CONTAINS(k, 'kidney') THEN FALSE ELSE k IN ('xin chao', 'chao', 'hello', 'hi', 'cam on', 'thanks') END AS direct FROM (SELECT DISTINCT id, {sql_key("COALESCE(query, '')")} AS k FROM threshold_qa)""")
def flt15_direct_route(spark, folder):
    """Whether a question is small talk: topic words and numbers veto, else an exact greeting decides."""
    k = T.ascii_key_trimmed(F.coalesce("query", F.lit("")))
    topic = k.rlike("[0-9]|benh|than|mau|kidney")
    return _qa(spark, folder).select("id", F.when(F.length(k) == 0, True).when(topic, False).otherwise(k.isin("xin chao", "chao", "hello", "hi", "cam on", "thanks")).alias("direct")).distinct()


@query("""SELECT DISTINCT id, COALESCE(expected.require_route = 'retrieve', FALSE) AND NOT COALESCE(expected.require_tool_called, FALSE) AND (relevant_document_ids IS NULL OR LEN(relevant_document_ids) < 2) AS retry,
    (relevant_document_ids IS NULL OR LEN(relevant_document_ids) = 0) AND (required_facts IS NULL OR LEN(required_facts) = 0) AND NOT COALESCE(expected.require_tool_success, FALSE) AS no_context FROM threshold_qa""")
def flt17_retry_and_no_context(spark, folder):
    """Whether a case would be searched again, and whether it has nothing to answer from."""
    e = F.col("expected")
    few = lambda c, n: F.coalesce(F.size(c) < n, F.lit(True))
    retry = F.coalesce(e["require_route"] == "retrieve", F.lit(False)) & ~F.coalesce(e["require_tool_called"], F.lit(False)) & (F.col("relevant_document_ids").isNull() | few("relevant_document_ids", 2))
    empty = few("relevant_document_ids", 1) & few("required_facts", 1) & ~F.coalesce(e["require_tool_success"], F.lit(False))
    return _qa(spark, folder).select("id", retry.alias("retry"), empty.alias("no_context")).distinct()


@query("""SELECT result_id, f.formula_id AS formula_id, COALESCE(CONTAINS(LOWER(q), LOWER(f.formula_name)) OR CONTAINS(LOWER(q), LOWER(REPLACE(f.output_name, '_', ' '))), FALSE) AS relevant
    FROM (SELECT DISTINCT result_id, query AS q, UNNEST(output_summary.formula_results) AS f FROM medical_tools_audit_report) WHERE f IS NOT NULL""")
def flt19_formula_relevance(spark, folder):
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.lower("query").alias("q"), "output_summary.formula_results").distinct()
    a = a.select("result_id", "q", F.explode("formula_results").alias("f")).where("f is not null")
    named = F.contains("q", F.lower("f.formula_name")) | F.contains("q", F.lower(F.replace("f.output_name", F.lit("_"), F.lit(" "))))
    return a.select("result_id", "f.formula_id", F.coalesce(named, F.lit(False)).alias("relevant"))


@query("""SELECT result_id, x.name AS name, MIN(x.value) AS value FROM (SELECT DISTINCT result_id, UNNEST(output_summary.detected_measurements) AS x FROM medical_tools_audit_report) WHERE x.value IS NOT NULL AND x.name IN (SELECT biomarker FROM biomarker_reference) GROUP BY ALL""")
def flt20_sanitised_payload(spark, folder):
    """Measurements with a value and an allowed name, one for each name."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.explode("output_summary.detected_measurements").alias("x")).where("x.value is not null")
    allowed = broadcast_if_small(table(spark, folder, "biomarker_reference").select(F.col("biomarker").alias("name")))
    return a.select("result_id", "x.name", "x.value").join(allowed, "name", "left_semi").groupBy("result_id", "name").agg(F.min("value").alias("value"))


@query("SELECT result_id, pos, REGEXP_MATCHES(LOWER(d), '429|rate limit|quota|too many requests|chờ') AS limited FROM (SELECT DISTINCT result_id, UNNEST(checks).detail AS d, UNNEST(RANGE(LEN(checks))) AS pos FROM medical_tools_audit_report) WHERE d IS NOT NULL")
def flt21_rate_limited(spark, folder):
    """Details that tell of a rate limit or of waiting."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.posexplode("checks").alias("pos", "c")).distinct()
    return a.where("c.detail is not null").select("result_id", F.col("pos").cast("long").alias("pos"), F.lower("c.detail").rlike("429|rate limit|quota|too many requests|chờ").alias("limited"))


# Joins and ranks --------------------------------------------------------------------------------------------------
@query(f"""WITH {_CHUNKS} SELECT a.id, b.id AS neighbour, b.chunk_index - a.chunk_index AS distance FROM chunks a JOIN chunks b ON a.source_file = b.source_file AND a.page = b.page AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 4 WHERE a.id <> b.id""")
def joi04_neighbour_join(spark, folder):
    """Chunks of the same page around each chunk, by an equi-join on buckets of positions."""
    c = _chunks(spark, folder).where("source_file is not null and page is not null and chunk_index is not null").select("id", "source_file", "page", "chunk_index")
    hits = c.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("chunk_index") - 1) / 6), F.floor((F.col("chunk_index") + 4) / 6))))
    near = c.select("source_file", "page", F.floor(F.col("chunk_index") / 6).alias("bucket"), F.col("id").alias("neighbour"), F.col("chunk_index").alias("at"))
    both = hits.join(near, ["source_file", "page", "bucket"]).where(F.col("at").between(F.col("chunk_index") - 1, F.col("chunk_index") + 4) & (F.col("id") != F.col("neighbour")))
    return both.select("id", "neighbour", (F.col("at") - F.col("chunk_index")).alias("distance"))


@query("""SELECT COALESCE(c.source_id, t.threshold_id) AS source_id, c.n AS documents, t.n AS rules FROM (SELECT source_id, COUNT(DISTINCT document_id) AS n FROM medical_documents WHERE source_type = 'threshold' GROUP BY ALL) c
    FULL JOIN (SELECT threshold_id, COUNT(*) AS n FROM thresholds_extra WHERE threshold_id IS NOT NULL GROUP BY ALL) t ON c.source_id = t.threshold_id""")
def joi05_full_outer(spark, folder):
    """Documents and rules of each source id, those of one side only included."""
    c = table(spark, folder, "medical_documents").where("source_type = 'threshold'").groupBy("source_id").agg(F.countDistinct("document_id").alias("documents"))
    t = _t(spark, folder).where("threshold_id is not null").groupBy(F.col("threshold_id").alias("source_id")).agg(F.count(F.lit(1)).alias("rules"))
    return c.join(t, "source_id", "full").select("source_id", "documents", "rules")


@query("SELECT DISTINCT document_id FROM medical_documents WHERE source_type = 'threshold' AND source_id IS NOT NULL AND source_id NOT IN (SELECT threshold_id FROM thresholds_extra WHERE threshold_id IS NOT NULL)")
def joi11_new_by_anti_join(spark, folder):
    m = table(spark, folder, "medical_documents").where("source_type = 'threshold' and source_id is not null").select("document_id", "source_id")
    return m.join(_t(spark, folder).select(F.col("threshold_id").alias("source_id")).where("source_id is not null"), "source_id", "left_anti").select("document_id").distinct()


@query("SELECT q.id, q.d AS document_id FROM (SELECT DISTINCT id, UNNEST(relevant_document_ids) AS d FROM threshold_qa) q WHERE d IN (SELECT document_id FROM medical_documents WHERE deleted_at IS NULL)")
def joi16_gold_intersection(spark, folder):
    """Gold ids of each case that name a living document."""
    gold = _qa(spark, folder).select("id", F.explode("relevant_document_ids").alias("document_id")).distinct()
    return gold.join(table(spark, folder, "medical_documents").where("deleted_at is null").select("document_id"), "document_id", "left_semi").select("id", "document_id")


def _near(spark, folder, top):
    v = _vectors(spark, folder)
    return R.nearest(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), v, top).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_nearest('', 12)} SELECT query_id, MAX(ROUND(similarity, 6)) AS score, COUNT(*) AS hits FROM near GROUP BY query_id")
def agg08_best_score(spark, folder):
    """Best similarity of each query's twelve nearest vectors."""
    return _near(spark, folder, 12).groupBy("query_id").agg(F.max("similarity").alias("score"), F.count(F.lit(1)).alias("hits"))


@query(f"WITH {_nearest('', 12)} SELECT id, ROUND(SUM(0.85::DOUBLE / (60 + rank)), 6) AS rrf FROM near GROUP BY id")
def agg10_rrf_sum(spark, folder):
    """Reciprocal ranks that each vector has in all queries together."""
    return _near(spark, folder, 12).groupBy("id").agg(F.round(F.sum(F.lit(0.85) / (60 + F.col("rank"))), 6).alias("rrf"))


@query(f"WITH {_nearest('', 12)} SELECT query_id, id, rank FROM near")
def top01_nearest(spark, folder):
    """Twice six nearest vectors of each query, ranked; equal similarities by id."""
    return _near(spark, folder, 12).select("query_id", "id", "rank")


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 15)} SELECT query_id, COUNT(*) AS hits, MIN(rank) AS first_rank, MAX(rank) AS last_rank, MIN(score) >= 0.01::DOUBLE AS above_floor FROM hits GROUP BY query_id""")
def top07_bm25_ranks(spark, folder):
    """Ranks of the fifteen best passages of each query, none below the floor of 0.01."""
    hits = K.bm25_search(_queries(spark, folder), _passages(spark, folder), 15)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), (F.min("score") >= R.FLOOR).alias("above_floor"))


flt12_score_floor_sql = f"""WITH {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 15)} SELECT query_id, COUNT(*) FILTER (score >= 0.01) AS kept, COUNT(*) FILTER (score < 0.01) AS below FROM hits_scores GROUP BY query_id"""


@query(flt12_score_floor_sql)
def flt12_score_floor(spark, folder):
    """Passages of each query at or above the score floor, and below it."""
    return K.floor_counts(_queries(spark, folder), _passages(spark, folder), R.FLOOR)


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 10)}, t AS (SELECT query_id, {sql_tokens('query')} AS q FROM queries), d AS (SELECT doc_id AS id, {sql_token_set('text')} AS w FROM documents WHERE text IS NOT NULL)
    SELECT query_id, COUNT(*) AS evidence, MAX(LEN(LIST_INTERSECT(q, w))) AS most_tokens, MAX(score) AS top_score FROM hits JOIN t USING (query_id) JOIN d USING (id) GROUP BY query_id""")
def agg12_evidence_summary(spark, folder):
    """Most shared tokens and best score over each query's evidence."""
    queries = _queries(spark, folder).select("query_id", R.content_tokens(F.col("query")).alias("q"))
    hits = K.with_passages(K.bm25_search(_queries(spark, folder), _passages(spark, folder), 10), _passages(spark, folder))
    hits = hits.join(broadcast_if_small(queries, K.SLICE), "query_id").withColumn("w", R.content_tokens(F.col("text"), 100000))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence"), F.max(F.size(F.array_intersect("q", "w"))).alias("most_tokens"), F.max("score").alias("top_score"))


@query("""SELECT biomarker, label, threshold_op, MIN(row_id) AS first_row, COUNT(*) AS copies FROM thresholds_extra GROUP BY biomarker, threshold_op, threshold_value, threshold_value_min, threshold_value_max, threshold_unit, label, disease_name, severity""")
def ded04_nine_part_key(spark, folder):
    """One row for each combination of nine columns; nulls are equal."""
    key = ["biomarker", "threshold_op", "threshold_value", "threshold_value_min", "threshold_value_max", "threshold_unit", "label", "disease_name", "severity"]
    return _t(spark, folder).groupBy(*key).agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("copies")).select("biomarker", "label", "threshold_op", "first_row", "copies")


@query("SELECT id, document_id, rank FROM (SELECT id, document_id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY score DESC, document_id) AS rank FROM (SELECT id, document_id, MAX(score) AS score FROM (SELECT DISTINCT id, UNNEST(relevant_document_ids) AS document_id, 2 AS score FROM threshold_qa UNION ALL SELECT DISTINCT id, 'source::' || UNNEST(relevant_source_ids), 1 FROM threshold_qa) WHERE document_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 8")
def ded12_merged_lists(spark, folder):
    """Two lists of each case merged by the better score of a document, the best eight."""
    q = _qa(spark, folder)
    a = q.select("id", F.explode("relevant_document_ids").alias("document_id"), F.lit(2).alias("score"))
    b = q.select("id", F.explode("relevant_source_ids").alias("s")).select("id", F.concat(F.lit("source::"), "s").alias("document_id"), F.lit(1).alias("score"))
    merged = a.unionByName(b).where("document_id is not null").groupBy("id", "document_id").agg(F.max("score").alias("score"))
    return R.best(merged, "id", [F.desc("score"), F.col("document_id")], 8).select("id", "document_id", "rank")


@query("SELECT host, MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM (SELECT doc_id, LOWER(REGEXP_REPLACE(COALESCE(source, ''), '[?#].*$|/+$', '')) AS host FROM documents) GROUP BY host")
def ded13_addresses(spark, folder):
    """Results with the same address, apart from case, query and closing slashes, once each."""
    host = F.lower(F.regexp_replace(F.coalesce("source", F.lit("")), "[?#].*$|/+$", ""))
    return table(spark, folder, "documents").groupBy(host.alias("host")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"WITH {_nearest('', 6)}, {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 6)} SELECT query_id, id, branch, rank FROM (SELECT query_id, id, 'vector' AS branch, rank FROM near UNION ALL SELECT query_id, id, 'keyword', rank FROM hits)")
def win05_branch_ranks(spark, folder):
    """Rank of each passage within its branch, from one."""
    keyword = K.bm25_search(_queries(spark, folder), _passages(spark, folder), 6)
    return _near(spark, folder, 6).select("query_id", "id", F.lit("vector").alias("branch"), "rank").unionByName(keyword.select("query_id", "id", F.lit("keyword").alias("branch"), "rank"))


@query("""WITH c AS (SELECT DISTINCT id, 'required' AS source, UNNEST(required_facts) AS f FROM threshold_qa UNION ALL SELECT DISTINCT id, 'tag', UNNEST(eval_tags) FROM threshold_qa UNION ALL SELECT DISTINCT id, 'reference', reference_answer FROM threshold_qa)
    SELECT id, LENGTH(f) AS n, STRING_AGG(DISTINCT source, '+' ORDER BY source) AS sources FROM c WHERE f IS NOT NULL GROUP BY id, f""")
def set03_candidate_union(spark, folder):
    """Candidates of three lists, each once with the lists that have it."""
    q = _qa(spark, folder)
    lists = q.select("id", F.lit("required").alias("source"), F.explode("required_facts").alias("f")).unionByName(q.select("id", F.lit("tag").alias("source"), F.explode("eval_tags").alias("f")))
    every = lists.unionByName(q.select("id", F.lit("reference").alias("source"), F.col("reference_answer").alias("f"))).where("f is not null")
    return every.groupBy("id", "f").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources")).select("id", F.length("f").alias("n"), "sources")


@query("SELECT kind, document_id FROM (SELECT 'table' AS kind, formula_id AS document_id FROM formulas UNION SELECT 'graph', threshold_id FROM thresholds_extra WHERE threshold_op = 'between' AND threshold_id IS NOT NULL)")
def set06_table_and_graph_hits(spark, folder):
    a = table(spark, folder, "formulas").select(F.lit("table").alias("kind"), F.col("formula_id").alias("document_id"))
    b = _t(spark, folder).where("threshold_op = 'between' and threshold_id is not null").select(F.lit("graph").alias("kind"), F.col("threshold_id").alias("document_id"))
    return a.unionByName(b).distinct()


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 10)} SELECT query_id, id, rank, GREATEST(0, ROUND(1 - (rank - 1) * 0.1::DOUBLE, 6)) AS kept_by_rank FROM hits""")
def win09_rank_before_grade(spark, folder):
    """The rank that a passage had before it is graded stays with it."""
    hits = K.bm25_search(_queries(spark, folder), _passages(spark, folder), 10)
    return hits.select("query_id", "id", "rank", F.greatest(F.lit(0.0), F.round(1 - (F.col("rank") - 1) * 0.1, 6)).alias("kept_by_rank"))


# Evaluation -------------------------------------------------------------------------------------------------------
def _names(spark, folder):
    rows = table(spark, folder, "biomarker_reference").select("biomarker", F.concat(F.array("biomarker", "name_vi", "name_en"), F.coalesce("aliases", F.array()))).collect()
    return {r[0]: [x for x in r[1] if x] for r in rows}


@query()
def txt17_measurements(spark, folder):
    """Values of all reference quantities in every question, blood pressure, sex and race."""
    q = _qa(spark, folder).select(F.col("id").alias("request_id"), F.col("query").alias("text")).distinct()
    read = lab.read_texts(broadcast_if_small(q), _names(spark, folder))
    return read.select("request_id", F.explode_outer("measurements").alias("m"), "sex", "race").select("request_id", "m.name", "m.value", "m.unit", "sex", "race")


def _requests(spark, folder):
    a = table(spark, folder, "medical_tools_audit_report")
    measured = F.transform("output_summary.detected_measurements", lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"), m["unit"].alias("unit")))
    return a.select(F.col("result_id").cast("string").alias("request_id"), F.col("query").alias("text"), measured.alias("measurements"), "formula_ids", F.col("disease_name").alias("disease")).dropDuplicates(["request_id"])


@query()
def num02_formula_evaluation(spark, folder):
    """Every formula that a report asked for, over its measurements: status, value, missing inputs and assumptions."""
    r = _requests(spark, folder).withColumn("measurements", lab.layered(F.col("measurements")))
    values = F.map_from_entries(F.transform("measurements", lambda m: F.struct(m["name"], m["value"])))
    asked = r.select("request_id", "formula_ids", values.alias("values"), F.lit(None).cast("string").alias("sex"), F.lit(None).cast("string").alias("race"))
    out = lab.evaluate_formulas(asked, table(spark, folder, "formulas"))
    return out.select("request_id", "formula_id", "status", "value", F.array_join("missing", ",").alias("missing"), F.array_join("assumptions", ",").alias("assumptions"))


@query()
def num05_evaluation(spark, folder):
    """The whole evaluation of every report: text and given measurements, formulas, derived values, classes."""
    out = lab.evaluate_requests(_requests(spark, folder), _names(spark, folder), table(spark, folder, "formulas"), RU.rule_table(spark, CLASS_RULES), {"gfr_ml_min_1_73m2": ("GFR", "ml/ph/1.73m2")})
    return out.select("request_id", F.size("measurements").alias("measurements"), F.size("formula_results").alias("formulas"), F.array_join("classes", ",").alias("classes"), "status")


@query("SELECT event_id, ROUND(CASE WHEN user_id % 2 = 0 THEN 0.85::DOUBLE ELSE 1 END, 3) AS cockcroft, ROUND(CASE WHEN user_id % 2 = 0 THEN 0.742::DOUBLE ELSE 1 END, 3) AS mdrd, CASE WHEN user_id % 7 = 0 THEN 1.21::DOUBLE ELSE 1 END AS race FROM events")
def num03_factors(spark, folder):
    """Sex and race factors of the formulas."""
    female, black = F.col("user_id") % 2 == 0, F.col("user_id") % 7 == 0
    factor = lambda name: F.when(female, SEX_FACTORS[name]).otherwise(1.0)
    return table(spark, folder, "events").select("event_id", factor("cockcroft_gault").alias("cockcroft"), factor("mdrd_gfr").alias("mdrd"), F.when(black, 1.21).otherwise(1.0).alias("race"))


@query("SELECT r.biomarker, r.threshold_op AS op, r.threshold_value AS rule_value, COUNT(*) AS met FROM (SELECT DISTINCT biomarker, threshold_op, threshold_value FROM thresholds_extra WHERE threshold_op IN ('<', '<=', '>', '>=') AND biomarker IS NOT NULL) r JOIN (SELECT biomarker, threshold_value AS v FROM thresholds_extra WHERE threshold_op = 'between') m ON m.biomarker = r.biomarker WHERE CASE r.threshold_op WHEN '<' THEN v < r.threshold_value WHEN '<=' THEN v <= r.threshold_value WHEN '>' THEN v > r.threshold_value ELSE v >= r.threshold_value END GROUP BY ALL")
def udf02_rules_as_data(spark, folder):
    """Rules taken from the table itself: how many of the ranges' values meet each."""
    t = _t(spark, folder)
    rules = t.where("threshold_op in ('<', '<=', '>', '>=') and biomarker is not null").select("biomarker", F.col("threshold_op").alias("op"), F.col("threshold_value").alias("rule_value")).distinct()
    values = t.where("threshold_op = 'between'").select("biomarker", F.col("threshold_value").alias("v"))
    met = rules.join(values, "biomarker").where(RU.meets(F.col("v"), F.col("op"), F.col("rule_value"), F.lit(None), F.lit(None)))
    return met.groupBy("biomarker", "op", "rule_value").agg(F.count(F.lit(1)).alias("met"))


# Contracts --------------------------------------------------------------------------------------------------------
_ANSWER = f"{sql_key('reference_answer')}"
_CONTRACT = [
    ("min_answer_chars", "e.min_answer_chars IS NOT NULL", "LENGTH(TRIM(COALESCE(reference_answer, ''))) >= e.min_answer_chars"),
    ("require_route", "COALESCE(e.require_route, '') <> ''", "route = e.require_route"),
    ("require_sources_min", "e.require_sources_min IS NOT NULL", "sources >= e.require_sources_min"),
    ("require_tool_called", "COALESCE(e.require_tool_called, FALSE)", "called"),
    ("require_tool_success", "COALESCE(e.require_tool_success, FALSE)", "called AND sources > 0"),
    ("require_no_null_tool_parameters", "COALESCE(e.require_no_null_tool_parameters, FALSE)", "NOT nulls"),
    ("require_extracted_measurements_min", "e.require_extracted_measurements_min IS NOT NULL", "facts >= e.require_extracted_measurements_min"),
    ("require_formula_result_min", "e.require_formula_result_min IS NOT NULL", "formulas >= e.require_formula_result_min"),
    ("require_formula_ids_any", "LEN(e.require_formula_ids_any) > 0", "LEN(LIST_INTERSECT(e.require_formula_ids_any, COALESCE(relevant_source_ids, []))) > 0"),
    ("require_threshold_match_min", "e.require_threshold_match_min IS NOT NULL", "thresholds >= e.require_threshold_match_min"),
    ("require_classification_min", "e.require_classification_min IS NOT NULL", "tags >= e.require_classification_min"),
    ("must_include_any", "LEN(e.must_include_any) > 0", f"LEN(LIST_FILTER(e.must_include_any, lambda w: CONTAINS(answer, {sql_key('w')}))) > 0"),
    ("must_include_all", "LEN(e.must_include_all) > 0", f"LEN(LIST_FILTER(e.must_include_all, lambda w: NOT CONTAINS(answer, {sql_key('w')}))) = 0"),
    ("must_not_include_any", "LEN(e.must_not_include_any) > 0", f"LEN(LIST_FILTER(e.must_not_include_any, lambda w: CONTAINS(answer, {sql_key('w')}))) = 0"),
]
_RESPONSES = f"""r AS (SELECT DISTINCT id, expected AS e, reference_answer, relevant_source_ids, COALESCE({_ANSWER}, '') AS answer, CASE WHEN LIST_CONTAINS(COALESCE(eval_tags, []), 'threshold') THEN 'tool' ELSE 'retrieve' END AS route,
    COALESCE(LEN(relevant_document_ids), 0) AS sources, LIST_CONTAINS(COALESCE(eval_tags, []), 'threshold') AS called, LEN(LIST_FILTER(COALESCE(relevant_document_ids, []), lambda x: x IS NULL)) > 0 AS nulls, COALESCE(LEN(required_facts), 0) AS facts,
    LEN(LIST_FILTER(COALESCE(relevant_document_ids, []), lambda x: COALESCE(STARTS_WITH(x, 'formula::'), FALSE))) AS formulas, LEN(LIST_FILTER(COALESCE(relevant_document_ids, []), lambda x: COALESCE(STARTS_WITH(x, 'threshold::'), FALSE))) AS thresholds, COALESCE(LEN(eval_tags), 0) AS tags FROM threshold_qa)"""


@query(f"WITH {_RESPONSES} " + " UNION ALL ".join(f"SELECT id, '{name}' AS name, COALESCE({test}, FALSE) AS passed FROM r WHERE {when}" for name, when, test in _CONTRACT))
def udf07_all_contract_keys(spark, folder):
    """All fourteen keys of a case's contract against a response made of its own reference: a row for each key that it has."""
    none = F.array().cast("array<string>")
    ids, tags = F.coalesce("relevant_document_ids", none), F.coalesce("eval_tags", none)
    begins = lambda p: F.size(F.filter(ids, lambda x: F.coalesce(F.startswith(x, F.lit(p)), F.lit(False))))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    r = _qa(spark, folder).select(
        "id", F.col("expected").alias("e"), "reference_answer", F.coalesce("relevant_source_ids", none).alias("source_ids"), F.coalesce(T.ascii_key_trimmed("reference_answer"), F.lit("")).alias("answer"),
        F.array_contains(tags, "threshold").alias("called"), size("relevant_document_ids").alias("sources"), F.exists(ids, lambda x: x.isNull()).alias("nulls"), size("required_facts").alias("facts"),
        begins("formula::").alias("formulas"), begins("threshold::").alias("thresholds"), size("eval_tags").alias("tags"),
    ).distinct()
    return contract_checks(r)


def contract_checks(responses):
    """(id, name, passed) of each key that a case's contract ``e`` has; a test that can't be made isn't passed."""
    e, answer = F.col("e"), F.col("answer")
    has = lambda w: F.contains(answer, T.ascii_key_trimmed(w))
    flag = lambda k: F.coalesce(e[k], F.lit(False))
    some = lambda k: F.coalesce(F.size(e[k]) > 0, F.lit(False))
    least = lambda k, n: (k, e[k].isNotNull(), n >= e[k])
    tests = [
        least("min_answer_chars", F.length(F.trim(F.coalesce("reference_answer", F.lit(""))))),
        ("require_route", F.coalesce(e["require_route"], F.lit("")) != "", F.when(F.col("called"), "tool").otherwise("retrieve") == e["require_route"]),
        least("require_sources_min", F.col("sources")), ("require_tool_called", flag("require_tool_called"), F.col("called")), ("require_tool_success", flag("require_tool_success"), F.col("called") & (F.col("sources") > 0)),
        ("require_no_null_tool_parameters", flag("require_no_null_tool_parameters"), ~F.col("nulls")), least("require_extracted_measurements_min", F.col("facts")), least("require_formula_result_min", F.col("formulas")),
        ("require_formula_ids_any", some("require_formula_ids_any"), F.arrays_overlap(e["require_formula_ids_any"], "source_ids")), least("require_threshold_match_min", F.col("thresholds")), least("require_classification_min", F.col("tags")),
        ("must_include_any", some("must_include_any"), F.exists(e["must_include_any"], lambda w: F.coalesce(has(w), F.lit(False)))), ("must_include_all", some("must_include_all"), ~F.exists(e["must_include_all"], lambda w: F.coalesce(~has(w), F.lit(False)))),
        ("must_not_include_any", some("must_not_include_any"), ~F.exists(e["must_not_include_any"], lambda w: F.coalesce(has(w), F.lit(False)))),
    ]
    checks = F.array(*(F.when(when, F.struct(F.lit(name).alias("name"), F.coalesce(test, F.lit(False)).alias("passed"))) for name, when, test in tests))
    return responses.select("id", F.inline(F.array_compact(checks)))


@query("SELECT id, result_id, failed, COALESCE(passed, FALSE) AND failed = 0 AS ok FROM (SELECT DISTINCT id, result_id, passed, LEN(LIST_FILTER(COALESCE(checks, []), lambda c: c IS NOT NULL AND NOT COALESCE(c.passed, FALSE))) AS failed FROM medical_tools_audit_report)")
def udf06_composed_checks(spark, folder):
    """A report passes if it says so and all its checks do."""
    a = table(spark, folder, "medical_tools_audit_report")
    bad = F.size(F.filter(F.coalesce("checks", F.array().cast(dict(a.dtypes)["checks"])), lambda c: c.isNotNull() & ~F.coalesce(c["passed"], F.lit(False))))
    return a.select("id", "result_id", "passed", bad.alias("failed")).distinct().select("id", "result_id", "failed", (F.coalesce("passed", F.lit(False)) & (F.col("failed") == 0)).alias("ok"))


# Models and searches ----------------------------------------------------------------------------------------------
@query()
def ret22_embeddings(spark, folder):
    """Embeddings of all documents by the embedder given (hashed tokens)."""
    return models.embedded(spread(_passages(spark, folder)))


@query()
def top06_reranked(spark, folder):
    """The twelve best hits of each query ranked again by the reranker given; scores under -10 are dropped."""
    queries = _queries(spark, folder)
    hits = K.with_passages(K.bm25_search(queries, _passages(spark, folder), models.CANDIDATES), _passages(spark, folder)).join(broadcast_if_small(queries, K.SLICE), "query_id")
    return models.reranked(hits.select("query_id", "query", "id", "text", "rank"))


@query(f"WITH {_INDEX}, {_ASKED}, {_bm25('hits', 'queries', 5)} SELECT query_id, id, rank FROM hits")
def udf03_null_reranker(spark, folder):
    """Without a model the hits keep their order."""
    queries = _queries(spark, folder)
    hits = K.bm25_search(queries, _passages(spark, folder), models.CANDIDATES).withColumns({"query": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    return models.reranked(hits, None).select("query_id", "id", "rank")


@query()
def udf04_judged_answers(spark, folder):
    """A judge's score of the first fact of each case against its reference answer."""
    q = _qa(spark, folder).select("id", F.try_element_at("required_facts", F.lit(1)).alias("answer"), F.col("reference_answer").alias("reference")).distinct()
    return models.judged(q)


_LEXICAL = f"""pats AS (SELECT query_id, UNNEST({sql_tokens("query", 12)}) AS p FROM queries), counted AS (SELECT query_id, doc_id AS id, COUNT(*) AS score FROM pats JOIN documents ON CONTAINS(LOWER(CONCAT_WS(CHR(10), text, source, source_file, disease_name, section_type)), p) GROUP BY ALL),
    lex AS (SELECT query_id, id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM counted) WHERE rank <= 12)"""


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25("hits", "queries", 12)}, {_nearest("", 12)}, {_LEXICAL},
    every AS (SELECT query_id, id, 'v' AS b, rank, similarity AS s FROM near UNION ALL SELECT query_id, id, 'k', rank, score FROM hits UNION ALL SELECT query_id, id, 'l', rank, score FROM lex),
    fused AS (SELECT query_id, id, MIN(rank) FILTER (b = 'v') AS vector_rank, MIN(rank) FILTER (b = 'k') AS keyword_rank, MIN(rank) FILTER (b = 'l') AS lexical_rank, ROUND(MAX(s) FILTER (b = 'v'), 6) AS similarity, MAX(s) FILTER (b = 'k') AS keyword_score, MAX(s) FILTER (b = 'l')::BIGINT AS lexical_score FROM every GROUP BY ALL),
    scored AS (SELECT f.*, ROUND(COALESCE(0.85::DOUBLE / (60 + vector_rank), 0) + COALESCE(1.0::DOUBLE / (60 + keyword_rank), 0) + COALESCE(1.15::DOUBLE / (60 + lexical_rank), 0), 9) AS rrf_score, d.lang, d.source, d.source_file, d.page, d.disease_name, d.section_type, SUBSTRING(d.text, 1, 800) AS preview,
        ROUND(CASE WHEN d.disease_name = q.disease_name THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN d.section_type = q.section_type THEN 0.10::DOUBLE ELSE 0 END, 6) AS metadata_bonus, COALESCE(LEN(LIST_INTERSECT({sql_tokens("q.text")}, {sql_token_set("d.text")})), 0) AS shared, LEN({sql_tokens("q.text")}) AS asked
        FROM fused f JOIN documents d ON d.doc_id = f.id JOIN documents q ON q.doc_id = f.query_id),
    final AS (SELECT *, ROUND(CASE WHEN asked > 0 THEN LEAST(0.10::DOUBLE, shared::DOUBLE / asked * 0.10::DOUBLE) ELSE 0 END, 6) AS lexical_bonus FROM scored)
    SELECT query_id, id, vector_rank, keyword_rank, lexical_rank, similarity, keyword_score, lexical_score, rrf_score, metadata_bonus, lexical_bonus, fusion_score, lang, source, source_file, page, disease_name, section_type, preview, rank FROM (
        SELECT *, ROUND(rrf_score + metadata_bonus + lexical_bonus, 6) AS fusion_score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(rrf_score + metadata_bonus + lexical_bonus, 6) DESC, COALESCE(keyword_score, 0) DESC, COALESCE(similarity, 0) DESC, id) AS rank FROM final) WHERE rank <= 5""")
def ret01_hybrid_search(spark, folder):
    """End to end: three branches, their fusion, bonuses for what question and passage have in common, the best five with all columns.

    The vector of a question is that of the document with its id; its disease and section are the soft hints.
    """
    queries, docs = _queries(spark, folder), table(spark, folder, "documents")
    v = _vectors(spark, folder)
    vector = R.nearest(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), v, 12).select("query_id", "id", "rank", F.col("similarity").alias("s"), F.lit("v").alias("b"))
    keyword = K.bm25_search(queries, _passages(spark, folder), 12).select("query_id", "id", "rank", F.col("score").alias("s"), F.lit("k").alias("b"))
    patterns = queries.select("query_id", R.content_tokens(F.col("query"), 12).alias("patterns"))
    fields = ["text", "source", "source_file", "disease_name", "section_type"]
    lexical = K.pattern_search(patterns, docs.select(F.col("doc_id").alias("id"), F.concat_ws("\n", *fields).alias("text")), 12).select("query_id", "id", "rank", F.col("score").cast("double").alias("s"), F.lit("l").alias("b"))
    every = vector.unionByName(keyword).unionByName(lexical)
    of = lambda b, c: F.when(F.col("b") == b, F.col(c))
    fused = every.groupBy("query_id", "id").agg(
        F.min(of("v", "rank")).alias("vector_rank"), F.min(of("k", "rank")).alias("keyword_rank"), F.min(of("l", "rank")).alias("lexical_rank"),
        F.round(F.max(of("v", "s")), 6).alias("similarity"), F.max(of("k", "s")).alias("keyword_score"), F.max(of("l", "s")).cast("long").alias("lexical_score"),
    )
    part = lambda name: F.coalesce(F.lit(R.WEIGHTS[name]) / (R.RRF_K + F.col(f"{name}_rank")), F.lit(0.0))
    fused = fused.withColumn("rrf_score", F.round(part("vector") + part("keyword") + part("lexical"), 9))
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("disease_name").alias("asked_disease"), F.col("section_type").alias("asked_section"), R.content_tokens(F.col("text")).alias("asked"))
    found = docs.select(F.col("doc_id").alias("id"), "lang", "source", "source_file", "page", "disease_name", "section_type", "text")
    joined = K.with_passages(fused, found).join(broadcast_if_small(asked, K.SLICE), "query_id")
    same = lambda a, b, points: F.when(F.coalesce(F.col(a) == F.col(b), F.lit(False)), points).otherwise(0.0)
    shared = F.coalesce(F.size(F.array_intersect("asked", R.content_tokens(F.col("text"), 100000))), F.lit(0))
    full = joined.select(
        "query_id", "id", "vector_rank", "keyword_rank", "lexical_rank", "similarity", "keyword_score", "lexical_score", "rrf_score", F.round(same("disease_name", "asked_disease", 0.08) + same("section_type", "asked_section", 0.10), 6).alias("metadata_bonus"),
        F.round(F.when(F.size("asked") > 0, F.least(F.lit(0.10), shared / F.size("asked") * 0.10)).otherwise(0.0), 6).alias("lexical_bonus"),
    )
    full = full.withColumn("fusion_score", F.round(F.col("rrf_score") + F.col("metadata_bonus") + F.col("lexical_bonus"), 6))
    first = R.best(full, "query_id", [F.desc("fusion_score"), F.coalesce("keyword_score", F.lit(0.0)).desc(), F.coalesce("similarity", F.lit(0.0)).desc(), F.col("id")], 5)
    return K.with_passages(first, found.withColumn("preview", F.substring("text", 1, 800)).drop("text")).select(*full.columns, "lang", "source", "source_file", "page", "disease_name", "section_type", "preview", "rank")


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25("hits", "queries", 10)}, sections AS (SELECT doc_id, section_type FROM documents),
    strict AS (SELECT h.query_id, h.id, h.score FROM hits_scores h JOIN sections d ON d.doc_id = h.id JOIN sections q ON q.doc_id = h.query_id WHERE d.section_type = q.section_type AND h.score >= 0.01),
    first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM strict) WHERE rank <= 5), weak AS (SELECT q.query_id FROM queries q LEFT JOIN first f USING (query_id) GROUP BY q.query_id HAVING COUNT(f.id) < 3),
    every AS (SELECT query_id, id, score, FALSE AS relaxed FROM first UNION ALL SELECT query_id, id, score, TRUE FROM hits WHERE query_id IN (SELECT query_id FROM weak)),
    merged AS (SELECT query_id, id, MAX(score) AS score, BOOL_AND(relaxed) AS relaxed FROM every GROUP BY ALL) SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM merged) WHERE rank <= 5""")
def ret16_relaxed_retry(spark, folder):
    """Hits of the question's own section; questions with fewer than three are searched again without that filter and merged."""
    passages = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.col("section_type").alias("group"))
    queries = passages.where("id % 50 = 0 and text is not null").select(F.col("id").alias("query_id"), F.col("text").alias("query"), "group")
    hits = checkpointed(K.bm25_grouped(queries, passages, 10))
    order = [F.desc("score"), F.col("id")]
    first = R.best(hits.where("own").select("query_id", "id", "score"), "query_id", order, 5).drop("rank")
    weak = queries.select("query_id").join(first.groupBy("query_id").count().where("count >= 3"), "query_id", "left_anti")
    again = R.best(hits.where("not own").select("query_id", "id", "score").join(weak, "query_id", "left_semi"), "query_id", order, 10).drop("rank")
    every = first.withColumn("relaxed", F.lit(False)).unionByName(again.withColumn("relaxed", F.lit(True)))
    return R.best(every.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("relaxed").alias("relaxed")), "query_id", order, 5)


# Orchestration ----------------------------------------------------------------------------------------------------
@query("""SELECT formula_id, COALESCE(MIN(disease_name), CASE WHEN REGEXP_MATCHES(MIN(output_name), 'gfr|creatinine_clearance|bsa') THEN 'benh_than_man' WHEN CONTAINS(MIN(output_name), 'fena') THEN 'acute_kidney_injury' END) AS disease FROM formulas GROUP BY formula_id""")
def orc02_formula_disease(spark, folder):
    """The disease of a formula, else the one its result is used for."""
    f = table(spark, folder, "formulas").groupBy("formula_id").agg(F.min("disease_name").alias("d"), F.min("output_name").alias("o"))
    return f.select("formula_id", F.coalesce("d", F.when(F.col("o").rlike("gfr|creatinine_clearance|bsa"), "benh_than_man").when(F.contains("o", F.lit("fena")), "acute_kidney_injury")).alias("disease"))


@query("SELECT DISTINCT id, TRIM(REGEXP_REPLACE(COALESCE(query, ''), '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')) AS question, LEAST(20, GREATEST(1, COALESCE(top_k, 5))) AS top_k FROM threshold_qa")
def orc03_prepared_input(spark, folder):
    """White space collapsed, the number of results within its bounds."""
    return _qa(spark, folder).select("id", T.collapse_spaces(F.coalesce("query", F.lit(""))).alias("question"), F.least(F.lit(20), F.greatest(F.lit(1), F.coalesce("top_k", F.lit(5)))).alias("top_k")).distinct()


@query("SELECT result_id, CASE WHEN disease_name IN (SELECT DISTINCT disease_name FROM formulas) THEN disease_name END AS disease FROM (SELECT DISTINCT result_id, disease_name FROM medical_tools_audit_report)")
def orc09_validated_filters(spark, folder):
    """Filters of a request that are on the list of allowed values; others count as not given."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", "disease_name").distinct()
    allowed = broadcast_if_small(table(spark, folder, "formulas").select(F.col("disease_name").alias("known")).where("known is not null").distinct())
    return a.join(allowed, F.col("disease_name") == F.col("known"), "left").select("result_id", F.col("known").alias("disease"))


@query("SELECT result_id, LEN(n) > 0 AS supported, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(n)), ',') AS fields FROM (SELECT DISTINCT result_id, LIST_FILTER(LIST_TRANSFORM(COALESCE(output_summary.detected_measurements, []), lambda x: CASE WHEN x.value IS NOT NULL THEN x.name END), lambda x: x IS NOT NULL) AS n FROM medical_tools_audit_report)")
def orc12_supported_inputs(spark, folder):
    """Whether a request has measurements at all, and which."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.col("output_summary.detected_measurements").alias("d")).distinct()
    names = F.coalesce(F.filter(F.transform("d", lambda x: F.when(x["value"].isNotNull(), x["name"])), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return a.select("result_id", (F.size(names) > 0).alias("supported"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("fields"))


@query("""SELECT biomarker, threshold_op, threshold_value, threshold_unit, label, disease_name, k, MIN(row_id) AS row_id FROM (SELECT *, SUBSTRING(TRIM(REGEXP_REPLACE(LOWER(COALESCE(source_text, '')), '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')), 1, 120) AS k FROM thresholds_extra)
    GROUP BY biomarker, threshold_op, threshold_value, threshold_value_min, threshold_value_max, threshold_unit, label, disease_name, severity, k""")
def orc14_dedupe_key(spark, folder):
    """The ten-part key of a rule (its text counts with its first 120 characters, as the key is defined) and its first row."""
    key = ["biomarker", "threshold_op", "threshold_value", "threshold_value_min", "threshold_value_max", "threshold_unit", "label", "disease_name", "severity"]
    t = _t(spark, folder).withColumn("k", F.substring(T.collapse_spaces(F.lower(F.coalesce("source_text", F.lit("")))), 1, 120))
    return t.groupBy(*key, "k").agg(F.min("row_id").alias("row_id")).select("biomarker", "threshold_op", "threshold_value", "threshold_unit", "label", "disease_name", "k", "row_id")


@query("SELECT 'rag_' || LPAD(CAST(ROW_NUMBER() OVER (ORDER BY id) AS VARCHAR), 6, '0') AS example, id, f AS facts, CASE WHEN LEN(d) > 0 THEN d[1] END AS gold FROM (SELECT id, LEN(LIST_FILTER(MAX(COALESCE(required_facts, [])), lambda x: LENGTH(x) >= 18)) AS f, LIST_SORT(LIST_FILTER(MAX(COALESCE(relevant_document_ids, [])), lambda x: x IS NOT NULL)) AS d FROM (SELECT DISTINCT id, required_facts, relevant_document_ids FROM threshold_qa) GROUP BY id)")
def orc15_dataset_rows(spark, folder):
    """Rows of the evaluation dataset: a running name, the number of facts long enough, the primary gold id.

    The running number is that of ranges of ids, summed up before them.
    """
    none = F.array().cast("array<string>")
    q = _qa(spark, folder).select("id", F.coalesce("required_facts", none).alias("f"), F.coalesce("relevant_document_ids", none).alias("d")).distinct().groupBy("id").agg(F.max("f").alias("f"), F.max("d").alias("d"))
    order = Window.partitionBy("start").orderBy("id")
    q = q.withColumn("start", F.substring("id", 1, 12))
    counts = q.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    # One row per first characters of the ids: a list of bounded size.
    before = counts.select("start", F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = q.withColumn("r", F.row_number().over(order)).join(before, "start")
    gold = F.array_sort(F.filter("d", lambda x: x.isNotNull()))
    return numbered.select(F.concat(F.lit("rag_"), F.lpad((F.col("r") + F.col("before")).cast("string"), 6, "0")).alias("example"), "id", F.size(F.filter("f", lambda x: F.length(x) >= 18)).alias("facts"), F.try_element_at(gold, F.lit(1)).alias("gold"))


@query("SELECT result_id, pos, name, passed FROM (SELECT DISTINCT result_id, UNNEST(RANGE(GREATEST(1, COALESCE(LEN(checks), 0)))) AS pos, checks FROM medical_tools_audit_report), LATERAL (SELECT CASE WHEN checks IS NOT NULL AND LEN(checks) > 0 THEN checks[pos + 1].name END AS name, CASE WHEN checks IS NOT NULL AND LEN(checks) > 0 THEN checks[pos + 1].passed END AS passed)")
def orc17_metric_rows(spark, folder):
    """Checks of every report; a report without any has one row of nulls."""
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", "checks").distinct()
    rows = a.select("result_id", F.posexplode_outer("checks").alias("pos", "c"))
    return rows.select("result_id", F.coalesce(F.col("pos").cast("long"), F.lit(0).cast("long")).alias("pos"), F.col("c.name").alias("name"), F.col("c.passed").alias("passed"))


@query("SELECT (SELECT COUNT(*) FROM thresholds_extra) AS records, (SELECT COUNT(*) FROM thresholds_extra WHERE source_text IS NULL OR TRIM(source_text) = '') AS blank, (SELECT COUNT(DISTINCT source_file) FROM thresholds_extra) AS sources")
def orc23_preflight(spark, folder):
    """Counts that are looked at before a run."""
    blank = F.col("source_text").isNull() | (F.trim("source_text") == "")
    return _t(spark, folder).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(blank, 1)).alias("blank"), F.countDistinct("source_file").alias("sources"))
