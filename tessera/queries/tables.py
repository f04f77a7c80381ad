"""Relational operators: deduplication, aggregation, windows, top-k, set operations and joins over the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_key_trimmed, lower_key
from tessera.operators import ordered as O
from tessera.queries.search import sql_key
from tessera.session import broadcast_if_small, table

TEN = ("biomarker", "threshold_op", "threshold_value", "threshold_value_min", "threshold_value_max", "threshold_unit", "disease_name", "section_type", "page")
NINE = ("biomarker", "threshold_op", "threshold_value", "threshold_value_min", "threshold_value_max", "threshold_unit", "label", "disease_name", "sex")


def _t(spark: SparkSession, folder: str, name: str = "thresholds_extra") -> DataFrame:
    return table(spark, folder, name)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "medical_documents")
    return d.select("id", "document_id", "source_type", "source_id", "content", *(F.col(f"metadata.{c}").alias(c) for c in ("doc_type", "disease_name", "section_type", "content_type", "biomarker", "source_file", "page", "language", "chunk_index")), "created_at", "deleted_at").distinct()


_DOCS = """docs AS (SELECT DISTINCT id, document_id, source_type, source_id, content, metadata.doc_type AS doc_type, metadata.disease_name AS disease_name, metadata.section_type AS section_type,
    metadata.content_type AS content_type, metadata.biomarker AS biomarker, metadata.source_file AS source_file, metadata.page AS page, metadata.language AS language, metadata.chunk_index AS chunk_index, created_at, deleted_at FROM medical_documents)"""

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a query with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _first(keys: str, columns: str, order: str, source: str = "thresholds_extra") -> str:
    return f"SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"


# Deduplication ----------------------------------------------------------------------------------------------------
@query(_first("COALESCE(NULLIF(threshold_id, ''), CAST(row_id AS VARCHAR))", "row_id, threshold_id", "row_id"))
def ded01_by_id(spark, folder):
    key = F.coalesce(F.when(F.col("threshold_id") != "", F.col("threshold_id")), F.col("row_id").cast("string"))
    return O.keep_first(_t(spark, folder).select("row_id", "threshold_id"), [key], ["row_id"])


@query(_first(", ".join(TEN) + ", SUBSTRING(source_text, 1, 120)", "row_id, biomarker", "row_id"))
def ded03_threshold_rules(spark, folder):
    t = _t(spark, folder)
    return O.keep_first(t.select("row_id", *TEN, F.substring("source_text", 1, 120).alias("head")), [*(F.col(c) for c in TEN), F.col("head")], ["row_id"]).select("row_id", "biomarker")


@query(_first(", ".join(NINE), "row_id, label", "row_id"))
def ded05_rule_candidates(spark, folder):
    return O.keep_first(_t(spark, folder).select("row_id", *NINE), [F.col(c) for c in NINE], ["row_id"]).select("row_id", "label")


@query("SELECT id, title, MIN(asked_at) AS first_asked FROM threshold_qa GROUP BY id, title")
def ded06_by_id_and_title(spark, folder):
    qa = _t(spark, folder, "threshold_qa").select("id", "title", "asked_at")
    return O.keep_first(qa, [F.col("id"), F.col("title")], ["asked_at"]).select("id", "title", F.col("asked_at").alias("first_asked"))


@query(f"WITH {_DOCS} SELECT document_id, source_id, MIN(created_at) AS created_at FROM docs GROUP BY document_id, source_id")
def ded08_by_document_and_source(spark, folder):
    d = _docs(spark, folder).select("document_id", "source_id", "created_at", "id")
    return O.keep_first(d, [F.col("document_id"), F.col("source_id")], ["created_at", "id"]).select("document_id", "source_id", "created_at")


@query(f"SELECT {sql_key('label')} AS label_key, MIN(row_id) AS row_id FROM thresholds_extra WHERE label IS NOT NULL GROUP BY 1")
def ded09_texts_by_key(spark, folder):
    t = _t(spark, folder).where("label is not null").select("row_id", ascii_key_trimmed("label").alias("label_key"))
    return O.keep_first(t, [F.col("label_key")], ["row_id"]).select("label_key", "row_id")


@query("SELECT DISTINCT id, ARRAY_TO_STRING(LIST_FILTER(eval_tags, lambda x, i: x IS NOT NULL AND x <> '' AND LIST_POSITION(eval_tags, x) = i), '|') AS tags FROM threshold_qa")
def ded10_ordered_distinct(spark, folder):
    qa = _t(spark, folder, "threshold_qa")
    kept = F.array_distinct(F.filter("eval_tags", lambda x: x.isNotNull() & (x != "")))
    return qa.select("id", F.array_join(kept, "|").alias("tags")).distinct()


# Aggregation ------------------------------------------------------------------------------------------------------
@query("SELECT section_type, COUNT(*) AS thresholds, COUNT(DISTINCT disease_name) AS diseases, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT disease_name) FILTER (disease_name IS NOT NULL)), ',') AS names FROM thresholds_extra GROUP BY section_type")
def agg01_summary(spark, folder):
    return _t(spark, folder).groupBy("section_type").agg(F.count(F.lit(1)).alias("thresholds"), F.count_distinct("disease_name").alias("diseases"), F.array_join(F.array_sort(F.collect_set("disease_name")), ",").alias("names"))


@query(f"""WITH {_DOCS} SELECT source_type, doc_type, section_type, disease_name, COUNT(*) AS n, GROUPING(source_type) * 8 + GROUPING(doc_type) * 4 + GROUPING(section_type) * 2 + GROUPING(disease_name) AS grouping_id
    FROM docs GROUP BY GROUPING SETS ((source_type), (doc_type), (section_type), (disease_name))""")
def agg02_manifest(spark, folder):
    d = _docs(spark, folder)
    names = ("source_type", "doc_type", "section_type", "disease_name")
    return d.groupingSets([[d[n]] for n in names], *(d[n] for n in names)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("grouping_id"))


@query("""SELECT source, COUNT(*) AS n, ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS ratio FROM documents GROUP BY source""")
def agg04_source_histogram(spark, folder):
    d = _t(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


_CHECKS = "checks AS (SELECT result_id, c.name AS name, c.passed AS passed FROM (SELECT DISTINCT result_id, checks FROM medical_tools_audit_report) s, UNNEST(s.checks) AS u(c) WHERE c IS NOT NULL)"


def _checks(spark, folder):
    a = _t(spark, folder, "medical_tools_audit_report").select("result_id", "checks").distinct()
    return a.select("result_id", F.explode("checks").alias("c")).where("c is not null").select("result_id", "c.name", "c.passed")


@query(f"WITH {_CHECKS} SELECT name, ROUND(AVG(CAST(passed AS INTEGER)), 6) AS mean, COUNT(*) AS n FROM checks GROUP BY name")
def agg05_metric_means(spark, folder):
    return _checks(spark, folder).groupBy("name").agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, ROUND(SUM(m * n) / SUM(n), 6) AS weighted FROM (SELECT event_type, user_id, AVG(value) AS m, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def agg06_weighted_means(spark, folder):
    per = _t(spark, folder, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("event_type").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query(f"""WITH {_CHECKS}, cases AS (SELECT result_id, BOOL_AND(COALESCE(passed, FALSE)) AS ok, COUNT(*) AS n FROM checks GROUP BY result_id)
    SELECT COUNT(*) AS cases, COUNT(*) FILTER (ok) AS passed, COUNT(*) FILTER (NOT ok) AS failed, CAST(SUM(n) AS BIGINT) AS checks FROM cases""")
def agg07_pass_totals(spark, folder):
    cases = _checks(spark, folder).groupBy("result_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"))
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.sum("n").alias("checks"))


@query("""SELECT disease_name, ROUND(MAX(page / 1000.0::DOUBLE), 3) AS confidence, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT extraction_method)), '+') AS methods, COUNT(DISTINCT source_file) AS files
    FROM thresholds_extra WHERE disease_name IS NOT NULL GROUP BY disease_name""")
def agg09_candidate_merge(spark, folder):
    t = _t(spark, folder).where("disease_name is not null")
    return t.groupBy("disease_name").agg(F.round(F.max(F.col("page") / 1000.0), 3).alias("confidence"), F.array_join(F.array_sort(F.collect_set("extraction_method")), "+").alias("methods"), F.count_distinct("source_file").alias("files"))


@query("""SELECT lang, COUNT(*) AS seen, COUNT(*) FILTER (LENGTH(TRIM(text)) >= 200) AS kept, ROUND(COUNT(*) FILTER (LENGTH(TRIM(text)) >= 200)::DOUBLE / COUNT(*), 6) AS ratio, COUNT(*) FILTER (text IS NULL) AS errors
    FROM documents GROUP BY lang""")
def agg11_kept_ratio(spark, folder):
    kept = F.coalesce(F.length(F.trim("text")) >= 200, F.lit(False))
    return _t(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"), F.round(F.count_if(kept) / F.count(F.lit(1)), 6).alias("ratio"), F.count_if(F.col("text").isNull()).alias("errors"))


@query("""SELECT id, ROUND(AVG(CASE WHEN CONTAINS(LOWER(COALESCE(reference_answer, '')), LOWER(f)) THEN 1 ELSE 0 END), 6) AS fact_recall
    FROM (SELECT DISTINCT id, reference_answer, required_facts FROM threshold_qa) s, UNNEST(s.required_facts) AS u(f) WHERE f IS NOT NULL GROUP BY id""")
def agg14_fact_recall(spark, folder):
    qa = _t(spark, folder, "threshold_qa").select("id", "reference_answer", "required_facts").distinct()
    facts = qa.select("id", F.lower(F.coalesce("reference_answer", F.lit(""))).alias("a"), F.explode("required_facts").alias("f")).where("f is not null")
    return facts.groupBy("id").agg(F.round(F.avg(F.contains("a", F.lower("f")).cast("int")), 6).alias("fact_recall"))


@query("SELECT event_type, ROUND(AVG(CASE WHEN value / 500 >= 0.5 THEN 1 ELSE 0 END), 6) AS precision FROM events GROUP BY event_type")
def agg15_scores_above_half(spark, folder):
    return _t(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") / 500 >= 0.5).cast("int")), 6).alias("precision"))


_CHUNKS = f"""{_DOCS}, chunks AS (SELECT source_file, page, chunk_index, MIN(disease_name) AS disease_name, MIN(section_type) AS section_type, MIN(content) AS content
    FROM docs WHERE source_type = 'chunk' AND source_file IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL)"""


def _chunks(spark, folder):
    d = _docs(spark, folder).where("source_type = 'chunk' and source_file is not null and page is not null and chunk_index is not null")
    return d.groupBy("source_file", "page", "chunk_index").agg(F.min("disease_name").alias("disease_name"), F.min("section_type").alias("section_type"), F.min("content").alias("content"))


@query(f"""WITH {_CHUNKS}, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY page, chunk_index) AS pos FROM chunks),
    votes AS (SELECT a.source_file, a.pos, b.disease_name AS v, COUNT(*) AS n FROM numbered a JOIN numbered b ON a.source_file = b.source_file AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND b.pos <> a.pos
        WHERE a.disease_name IS NULL AND b.disease_name IS NOT NULL GROUP BY ALL),
    won AS (SELECT source_file, pos, CASE WHEN COUNT(*) = 1 THEN MIN(v) END AS w FROM (SELECT *, MAX(n) OVER (PARTITION BY source_file, pos) AS top FROM votes) WHERE n = top GROUP BY ALL)
    SELECT n.source_file, n.page, n.chunk_index, COALESCE(n.disease_name, w) AS inferred FROM numbered n LEFT JOIN won USING (source_file, pos)""")
def agg03_majority_of_neighbors(spark, folder):
    numbered = _chunks(spark, folder).withColumn("pos", F.row_number().over(Window.partitionBy("source_file").orderBy("page", "chunk_index")))
    return O.majority_around(numbered, ["source_file"], "pos", "disease_name", 5, "inferred").select("source_file", "page", "chunk_index", "inferred")


# Windows ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {_CHUNKS}, runs AS (SELECT *, SUM(CASE WHEN section_type = 'general' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY page, chunk_index) AS run FROM chunks)
    SELECT source_file, page, chunk_index, LAST_VALUE(disease_name IGNORE NULLS) OVER (PARTITION BY source_file, run ORDER BY page, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM runs""")
def win01_context_carry_forward(spark, folder):
    return O.carry_forward(_chunks(spark, folder), ["source_file"], ["page", "chunk_index"], F.col("section_type") == "general", F.col("disease_name"), "carried").select("source_file", "page", "chunk_index", "carried")


@query(f"""WITH {_CHUNKS}, pages AS (SELECT source_file, page, ARG_MIN(disease_name, chunk_index) FILTER (disease_name IS NOT NULL) AS d FROM chunks GROUP BY ALL)
    SELECT source_file, page, COALESCE(d, LAG(d) OVER (PARTITION BY source_file ORDER BY page)) AS disease_name, LEAD(d) OVER (PARTITION BY source_file ORDER BY page) AS next_disease FROM pages""")
def win02_page_disease(spark, folder):
    pages = _chunks(spark, folder).groupBy("source_file", "page").agg(F.min_by("disease_name", F.when(F.col("disease_name").isNotNull(), F.col("chunk_index"))).alias("d"))
    w = Window.partitionBy("source_file").orderBy("page")
    return pages.select("source_file", "page", F.coalesce("d", F.lag("d").over(w)).alias("disease_name"), F.lead("d").over(w).alias("next_disease"))


@query(f"""WITH {_CHUNKS}, pages AS (SELECT source_file, page, STRING_AGG(content, CHR(10) ORDER BY chunk_index) AS t FROM chunks GROUP BY ALL)
    SELECT source_file, page, COALESCE(RIGHT(LAG(t) OVER (PARTITION BY source_file ORDER BY page), 200), '') || t || COALESCE(LEFT(LEAD(t) OVER (PARTITION BY source_file ORDER BY page), 200), '') AS view FROM pages WHERE t IS NOT NULL""")
def win04_cross_page_text(spark, folder):
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("chunk_index", "content")))), lambda x: x["content"])
    pages = _chunks(spark, folder).groupBy("source_file", "page").agg(F.array_join(ordered, "\n").alias("t"), F.count("content").alias("n")).where("n > 0")
    w = Window.partitionBy("source_file").orderBy("page")
    before, after = F.coalesce(F.right(F.lag("t").over(w), F.lit(200)), F.lit("")), F.coalesce(F.left(F.lead("t").over(w), F.lit(200)), F.lit(""))
    return pages.select("source_file", "page", F.concat(before, "t", after).alias("view"))


@query(f"WITH {_CHUNKS} SELECT source_file, page, chunk_index, ROW_NUMBER() OVER (PARTITION BY source_file, page ORDER BY chunk_index) - 1 AS place FROM chunks")
def win06_place_in_page(spark, folder):
    w = Window.partitionBy("source_file", "page").orderBy("chunk_index")
    return _chunks(spark, folder).select("source_file", "page", "chunk_index", (F.row_number().over(w) - 1).alias("place"))


@query("""SELECT event_id, LAST_VALUE(CASE WHEN value > 100 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM events""")
def win07_history_look_back(spark, folder):
    e = _t(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return O.look_back(e, ["user_id"], ["ts", "event_id"], F.when(F.col("value") > 100, F.col("event_type")), 3, "recent").select("event_id", "recent")


@query("""SELECT user_id, value AS top_value, ROUND(value - COALESCE(next, 0), 6) AS margin FROM (SELECT user_id, value, LEAD(value) OVER w AS next, ROW_NUMBER() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE rn = 1""")
def win10_margin(spark, folder):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = _t(spark, folder, "events").select("user_id", "value", F.lead("value").over(w).alias("next"), F.row_number().over(w).alias("rn"))
    return e.where("rn = 1").select("user_id", F.col("value").alias("top_value"), F.round(F.col("value") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


@query("""SELECT row_id, SUBSTRING(source_text, GREATEST(1, STRPOS(source_text, '%') - 60), 120) AS around FROM thresholds_extra WHERE CONTAINS(source_text, '%')""")
def win12_text_around_match(spark, folder):
    t = _t(spark, folder).where(F.contains("source_text", F.lit("%")))
    return t.select("row_id", F.substring("source_text", F.greatest(F.lit(1), F.instr("source_text", "%") - 60), F.lit(120)).alias("around"))


@query("""SELECT id, ARG_MAX(passed, STRUCT_PACK(g := generated_at, r := result_id)) AS latest, ARG_MIN(passed, STRUCT_PACK(g := generated_at, r := result_id)) AS baseline, COUNT(*) AS runs
    FROM (SELECT DISTINCT result_id, id, passed, generated_at FROM medical_tools_audit_report WHERE id IS NOT NULL AND passed IS NOT NULL AND generated_at IS NOT NULL) GROUP BY id""")
def win13_latest_run(spark, folder):
    a = _t(spark, folder, "medical_tools_audit_report").select("result_id", "id", "passed", "generated_at").where("id is not null and passed is not null and generated_at is not null").distinct()
    order = F.struct("generated_at", "result_id")
    return a.groupBy("id").agg(F.max_by("passed", order).alias("latest"), F.min_by("passed", order).alias("baseline"), F.count(F.lit(1)).alias("runs"))


# Top-k ------------------------------------------------------------------------------------------------------------
@query("SELECT row_id, page, threshold_value FROM thresholds_extra ORDER BY COALESCE(page, 0) DESC, COALESCE(threshold_value, 0) DESC, row_id LIMIT 40")
def top04_multi_key(spark, folder):
    t = _t(spark, folder).select("row_id", "page", "threshold_value")
    return t.orderBy(F.desc(F.coalesce("page", F.lit(0))), F.desc(F.coalesce("threshold_value", F.lit(0.0))), "row_id").limit(40)


@query("""SELECT disease_name, row_id, threshold_value FROM (SELECT *, MAX(threshold_value) OVER (PARTITION BY disease_name) AS best, ROW_NUMBER() OVER (PARTITION BY disease_name ORDER BY threshold_value DESC, row_id) AS rn
    FROM thresholds_extra WHERE disease_name IS NOT NULL AND threshold_value IS NOT NULL) WHERE rn <= 5 AND (rn = 1 OR threshold_value >= 0.9::DOUBLE * best)""")
def top10_near_the_best(spark, folder):
    t = _t(spark, folder).where("disease_name is not null and threshold_value is not null").select("disease_name", "row_id", "threshold_value")
    w = Window.partitionBy("disease_name")
    first = t.withColumn("rn", F.row_number().over(w.orderBy(F.desc("threshold_value"), "row_id"))).where("rn <= 5")
    return first.withColumn("best", F.max("threshold_value").over(w)).where("rn = 1 or threshold_value >= 0.9D * best").select("disease_name", "row_id", "threshold_value")


@query("""WITH counted AS (SELECT source_file, disease_name, COUNT(*) AS n FROM thresholds_extra WHERE disease_name IS NOT NULL GROUP BY ALL), tops AS (SELECT *, MAX(n) OVER (PARTITION BY source_file) AS top FROM counted)
    SELECT source_file, CASE WHEN COUNT(DISTINCT disease_name) = 1 THEN MIN(disease_name) END AS disease FROM tops WHERE n = top GROUP BY source_file""")
def top12_priority_or_null(spark, folder):
    counted = _t(spark, folder).where("disease_name is not null").groupBy("source_file", "disease_name").agg(F.count(F.lit(1)).alias("n"))
    return O.pick_or_null(counted.where("source_file is not null"), "source_file", "disease_name", "n", "disease").unionByName(O.pick_or_null(counted.where("source_file is null").withColumn("source_file", F.lit("")), "source_file", "disease_name", "n", "disease").withColumn("source_file", F.lit(None).cast("string")))


@query("SELECT DISTINCT id, ARRAY_TO_STRING(relevant_document_ids[1:3], ',') AS first_three FROM threshold_qa")
def top14_first_of_array(spark, folder):
    return _t(spark, folder, "threshold_qa").select("id", F.array_join(F.slice("relevant_document_ids", 1, 3), ",").alias("first_three")).distinct()


# Set operations ---------------------------------------------------------------------------------------------------
@query("""SELECT kind, COUNT(*) AS n, MIN(document_id) AS first_id FROM (SELECT 'threshold' AS kind, 'threshold::' || threshold_id AS document_id FROM thresholds_extra UNION ALL SELECT 'formula', 'formula::' || formula_id FROM formulas
    UNION ALL SELECT 'chunk', document_id FROM medical_documents WHERE source_type = 'chunk') GROUP BY kind""")
def set01_union_of_builders(spark, folder):
    t = _t(spark, folder).select(F.lit("threshold").alias("kind"), F.concat(F.lit("threshold::"), "threshold_id").alias("document_id"))
    f = _t(spark, folder, "formulas").select(F.lit("formula").alias("kind"), F.concat(F.lit("formula::"), "formula_id").alias("document_id"))
    c = _t(spark, folder, "medical_documents").where("source_type = 'chunk'").select(F.lit("chunk").alias("kind"), "document_id")
    return t.unionByName(f).unionByName(c).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_id"))


@query("SELECT row_id, label, threshold_value_min FROM thresholds_extra WHERE threshold_op = 'between' UNION ALL SELECT row_id, label, NULL FROM thresholds_extra WHERE threshold_op = '>'")
def set02_optional_columns(spark, folder):
    t = _t(spark, folder)
    full = t.where("threshold_op = 'between'").select("row_id", "label", "threshold_value_min")
    return full.unionByName(t.where("threshold_op = '>'").select("row_id", "label"), allowMissingColumns=True)


@query("""SELECT DISTINCT id, LEN(LIST_INTERSECT(LIST_FILTER(relevant_source_ids, lambda x: x IS NOT NULL), LIST_TRANSFORM(LIST_FILTER(relevant_document_ids, lambda x: x IS NOT NULL), lambda x: STRING_SPLIT(x, '::')[2]))) AS shared
    FROM threshold_qa WHERE relevant_source_ids IS NOT NULL AND relevant_document_ids IS NOT NULL""")
def set04_shared_ids(spark, folder):
    qa = _t(spark, folder, "threshold_qa").where("relevant_source_ids is not null and relevant_document_ids is not null")
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    sources = F.transform(known("relevant_document_ids"), lambda x: F.split_part(x, F.lit("::"), F.lit(2)))
    return qa.select("id", F.size(F.array_intersect(known("relevant_source_ids"), sources)).cast("long").alias("shared")).distinct()


@query("""SELECT formula_id, EXISTS (SELECT 1 FROM medical_documents m WHERE m.source_type = 'formula' AND m.source_id = formula_id) AS indexed FROM (SELECT DISTINCT formula_id FROM formulas)""")
def set05_existing_and_new(spark, folder):
    f = _t(spark, folder, "formulas").select("formula_id").distinct()
    m = _t(spark, folder, "medical_documents").where("source_type = 'formula'").select(F.col("source_id").alias("formula_id"))
    return f.join(m, "formula_id", "left_semi").withColumn("indexed", F.lit(True)).unionByName(f.join(m, "formula_id", "left_anti").withColumn("indexed", F.lit(False)))


# Joins ------------------------------------------------------------------------------------------------------------
@query(f"""WITH names AS (SELECT biomarker_id, biomarker, {sql_key('a')} AS k FROM biomarker_reference, UNNEST(LIST_CONCAT([biomarker, name_vi, name_en], aliases)) AS u(a)), firsts AS (SELECT k, ARG_MIN(biomarker, biomarker_id) AS canonical FROM names GROUP BY k)
    SELECT row_id, canonical FROM thresholds_extra t JOIN firsts ON {sql_key('t.biomarker')} = k""")
def joi07_alias_lookup(spark, folder):
    ref = _t(spark, folder, "biomarker_reference").select("biomarker_id", "biomarker", F.explode(F.concat(F.array("biomarker", "name_vi", "name_en"), "aliases")).alias("a"))
    firsts = ref.groupBy(ascii_key_trimmed("a").alias("k")).agg(F.min_by("biomarker", "biomarker_id").alias("canonical"))
    t = _t(spark, folder).select("row_id", ascii_key_trimmed("biomarker").alias("k"))
    return t.join(firsts, "k").select("row_id", "canonical")


@query("""SELECT q.id, ARG_MIN(b.biomarker, b.biomarker_id) AS hint FROM (SELECT DISTINCT id, query FROM threshold_qa) q JOIN biomarker_reference b ON CONTAINS(LOWER(q.query), LOWER(b.name_vi)) OR CONTAINS(LOWER(q.query), LOWER(b.name_en)) GROUP BY q.id""")
def joi08_alias_containment(spark, folder):
    # The reference list is a fixed small table; its size is checked.
    ref = broadcast_if_small(_t(spark, folder, "biomarker_reference").select("biomarker_id", "biomarker", F.lower("name_vi").alias("vi"), F.lower("name_en").alias("en")))
    qa = _t(spark, folder, "threshold_qa").select("id", F.lower("query").alias("q")).distinct()
    return qa.join(ref, F.contains("q", F.col("vi")) | F.contains("q", F.col("en"))).groupBy("id").agg(F.min_by("biomarker", "biomarker_id").alias("hint"))


@query("""WITH a AS (SELECT DISTINCT result_id, disease_name FROM medical_tools_audit_report), f AS (SELECT DISTINCT formula_id, disease_name FROM formulas), n AS (SELECT disease_name, COUNT(*) AS formulas FROM f GROUP BY disease_name)
    SELECT result_id, n.formulas FROM a LEFT JOIN n ON a.disease_name = n.disease_name""")
def joi09_left_join_reference(spark, folder):
    a = _t(spark, folder, "medical_tools_audit_report").select("result_id", "disease_name").distinct()
    n = _t(spark, folder, "formulas").select("formula_id", "disease_name").distinct().groupBy("disease_name").agg(F.count(F.lit(1)).alias("formulas"))
    return a.join(n, "disease_name", "left").select("result_id", "formulas")


@query("""WITH base AS (SELECT * FROM thresholds_extra WHERE row_id % 2 = 0) SELECT t.row_id FROM thresholds_extra t WHERE t.row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.biomarker IS NOT DISTINCT FROM t.biomarker AND b.threshold_op IS NOT DISTINCT FROM t.threshold_op
    AND b.threshold_value IS NOT DISTINCT FROM t.threshold_value AND b.threshold_unit IS NOT DISTINCT FROM t.threshold_unit AND b.disease_name IS NOT DISTINCT FROM t.disease_name AND b.page IS NOT DISTINCT FROM t.page AND b.sex IS NOT DISTINCT FROM t.sex)""")
def joi12_null_safe_anti_join(spark, folder):
    """Odd rows are new rules, even rows the base: new ones that the base lacks, nulls being equal."""
    t, keys = _t(spark, folder), ("biomarker", "threshold_op", "threshold_value", "threshold_unit", "disease_name", "page", "sex")
    base = t.where("row_id % 2 = 0").select(*(F.col(k).alias(f"b_{k}") for k in keys)).distinct()
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return t.where("row_id % 2 = 1").join(base, condition, "left_anti").select("row_id")


@query("""SELECT DISTINCT a.result_id, i - 1 AS pos, f.formula_id, f.output_name FROM (SELECT DISTINCT result_id, formula_ids, UNNEST(RANGE(1, CAST(LEN(formula_ids) AS BIGINT) + 1)) AS i FROM medical_tools_audit_report) a JOIN (SELECT DISTINCT formula_id, output_name FROM formulas) f ON f.formula_id = a.formula_ids[i]""")
def joi13_formula_selection(spark, folder):
    a = _t(spark, folder, "medical_tools_audit_report").select("result_id", "formula_ids").distinct().select("result_id", F.posexplode("formula_ids").alias("pos", "formula_id"))
    f = _t(spark, folder, "formulas").select("formula_id", "output_name").distinct()
    return a.join(f, "formula_id").select("result_id", F.col("pos").cast("long").alias("pos"), "formula_id", "output_name").distinct()


@query("""WITH m AS (SELECT DISTINCT result_id, output_summary.detected_measurements AS d, output_summary.derived_measurements AS v FROM medical_tools_audit_report),
    ranked AS (SELECT result_id, x.name AS name, x.value AS value, 0 AS prio FROM m, UNNEST(m.d) AS u(x) WHERE x.name IS NOT NULL AND x.value IS NOT NULL UNION ALL SELECT result_id, x.name, x.value, 1 FROM m, UNNEST(m.v) AS u(x) WHERE x.name IS NOT NULL AND x.value IS NOT NULL)
    SELECT result_id, name, ARG_MIN(value, STRUCT_PACK(p := prio, v := value)) AS value FROM ranked GROUP BY result_id, name""")
def joi18_measured_over_derived(spark, folder):
    a = _t(spark, folder, "medical_tools_audit_report").select("result_id", F.col("output_summary.detected_measurements").alias("d"), F.col("output_summary.derived_measurements").alias("v")).distinct()
    part = lambda c, p: a.select("result_id", F.explode(c).alias("x")).select("result_id", "x.name", "x.value", F.lit(p).alias("prio")).where("name is not null and value is not null")
    return part("d", 0).unionByName(part("v", 1)).groupBy("result_id", "name").agg(F.min_by("value", F.struct("prio", "value")).alias("value"))


@query("""WITH left_ AS (SELECT DISTINCT id, query FROM threshold_qa), exact AS (SELECT query, MAX(reference_answer) AS answer FROM threshold_qa GROUP BY query),
    bare AS (SELECT REGEXP_REPLACE(query, '[ \\t\\n]+', '', 'g') AS k, MIN(reference_answer) AS answer FROM threshold_qa GROUP BY 1)
    SELECT l.id, COALESCE(e.answer, b.answer, '') AS answer FROM left_ l LEFT JOIN exact e ON TRIM(l.query) = e.query LEFT JOIN bare b ON REGEXP_REPLACE(l.query, '[ \\t\\n]+', '', 'g') = b.k""")
def joi10_two_stage_merge(spark, folder):
    qa = _t(spark, folder, "threshold_qa")
    bare = F.regexp_replace("query", r"[ \t\n]+", "")
    exact = qa.groupBy(F.col("query").alias("eq")).agg(F.max("reference_answer").alias("exact"))
    loose = qa.groupBy(bare.alias("bk")).agg(F.min("reference_answer").alias("loose"))
    left = qa.select("id", "query").distinct()
    joined = left.join(exact, F.trim("query") == F.col("eq"), "left").join(loose, bare == F.col("bk"), "left")
    return joined.select("id", F.coalesce("exact", "loose", F.lit("")).alias("answer"))


@query("SELECT LOWER(TRIM(REGEXP_REPLACE(content, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g'))) AS k, COUNT(DISTINCT document_id) AS n FROM medical_documents GROUP BY 1 HAVING COUNT(DISTINCT document_id) > 1")
def ded11_repeated_contexts(spark, folder):
    d = _t(spark, folder, "medical_documents").select(lower_key("content").alias("k"), "document_id")
    return d.groupBy("k").agg(F.count_distinct("document_id").alias("n")).where("n > 1")
