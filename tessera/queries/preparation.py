"""Corpus preparation and ranking leftovers: sub-splitting, companions, predicates, look-ups and re-ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import passages as P
from tessera.functions import text as T
from tessera.operators import blocks as K
from tessera.operators import ordered as O
from tessera.operators import retrieval as R
from tessera.queries.search import _ASKED, _INDEX, _bm25, _passages, _queries, sql_fold, sql_key, sql_token_set, sql_tokens
from tessera.queries.strings import _QA, _qa, _sql_hint
from tessera.queries.tables import _CHUNKS, _DOCS, _chunks, _docs
from tessera.session import broadcast_if_small, table

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


# Splitting --------------------------------------------------------------------------------------------------------
@query()
def gen03_packed_units(spark, folder):
    """Every passage taken as a block: large ones are split between bullet units, the others stay whole."""
    d = table(spark, folder, "medical_documents").where("content is not null").select("document_id", "content").distinct()
    return d.select("document_id", F.posexplode(P.packed_units(F.col("content"))).alias("pos", "piece"))


@query()
def gen04_unit_texts(spark, folder):
    """The bullet units of every passage; ``gen04_bullet_units`` has only the number of bullet lines."""
    d = table(spark, folder, "medical_documents").where("content is not null").select("document_id", "content").distinct()
    return d.select("document_id", F.posexplode(P.bullet_units(P.stripped_lines(F.col("content")))).alias("pos", "unit"))


@query("SELECT document_id, LEN(LIST_FILTER(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY(content, '\\r?\\n'), lambda x: TRIM(x)), lambda x: REGEXP_MATCHES(x, '^[–•-]'))) AS bullets FROM (SELECT DISTINCT document_id, content FROM medical_documents)")
def gen04_bullet_units(spark, folder):
    d = table(spark, folder, "medical_documents").select("document_id", "content").distinct()
    return d.select("document_id", F.size(F.filter(P.lines(F.col("content")), lambda x: x.rlike("^[–•-]"))).cast("long").alias("bullets"))


@query("SELECT row_id, LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(source_text, '\"[^\"]+\": \"([^\"]*)\"', 1), lambda x: x <> '')) AS n, REGEXP_EXTRACT_ALL(source_text, '\"[^\"]+\": \"([^\"]*)\"', 1)[1] AS first_value FROM thresholds_extra WHERE CONTAINS(source_text, '\": \"')")
def gen06_json_text_values(spark, folder):
    found = F.regexp_extract_all("source_text", F.lit('"[^"]+": "([^"]*)"'), F.lit(1))
    t = _t(spark, folder).where(F.contains("source_text", F.lit('": "')))
    return t.select("row_id", F.size(F.filter(found, lambda x: x != "")).cast("long").alias("n"), F.try_element_at(found, F.lit(1)).alias("first_value"))


@query("""SELECT row_id, REGEXP_EXTRACT_ALL(source_text, '(?i)(?:khi|nếu) ([^.;]+) thì ([^.;]+)', 1)[1] AS condition, REGEXP_EXTRACT_ALL(source_text, '(?i)(?:khi|nếu) ([^.;]+) thì ([^.;]+)', 2)[1] AS consequence FROM thresholds_extra WHERE REGEXP_MATCHES(source_text, '(?i)(?:khi|nếu) ([^.;]+) thì ([^.;]+)')""")
def gen07_if_then_rules(spark, folder):
    pattern = r"(?iu)(?:khi|nếu) ([^.;]+) thì ([^.;]+)"
    t = _t(spark, folder).where(F.col("source_text").rlike(pattern))
    return t.select("row_id", F.regexp_extract("source_text", pattern, 1).alias("condition"), F.regexp_extract("source_text", pattern, 2).alias("consequence"))


@query("""WITH s AS (SELECT id, TRIM(REGEXP_REPLACE(reference_answer, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')) AS t FROM """ + _QA + """ WHERE reference_answer IS NOT NULL), p AS (SELECT id, t, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(REGEXP_REPLACE(t, '([.!?。]) +', '\\1' || CHR(30), 'g'), '; +', CHR(30), 'g'), CHR(30)), lambda x: REGEXP_REPLACE(x, '^[ 0-9.()•-]+|[ 0-9.()•-]+$', '', 'g')), lambda x: LENGTH(x) >= 18) AS p FROM s)
    SELECT id, LEN(LIST_DISTINCT(LIST_CONCAT([t], p))) AS parts FROM p""")
def gen14_match_parts(spark, folder):
    t = T.collapse_spaces("reference_answer")
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?。])\s+|;\s+"), lambda x: F.regexp_replace(x, r"^[ 0-9.()•\-]+|[ 0-9.()•\-]+$", "")), lambda x: F.length(x) >= 18)
    return _qa(spark, folder).where("reference_answer is not null").select("id", F.size(F.array_distinct(F.concat(F.array(t), parts))).cast("long").alias("parts"))


# Projections ------------------------------------------------------------------------------------------------------
@query(f"""WITH {_DOCS} SELECT document_id, CASE WHEN source_type = 'formula' THEN 'formula' WHEN source_type = 'threshold' THEN 'threshold' WHEN CONTAINS({sql_key('content')}, 'thuoc') THEN 'medication' ELSE 'guideline' END AS kind FROM docs""")
def prj02_document_kind(spark, folder):
    key = T.ascii_key_trimmed("content")
    kind = F.when(F.col("source_type") == "formula", "formula").when(F.col("source_type") == "threshold", "threshold").when(F.coalesce(F.contains(key, F.lit("thuoc")), F.lit(False)), "medication").otherwise("guideline")
    return _docs(spark, folder).select("document_id", kind.alias("kind"))


@query(f"WITH {_DOCS} SELECT document_id, CONCAT_WS(CHR(10), 'Disease: ' || disease_name, 'Section: ' || COALESCE(section_type, 'general'), content) AS embedding_text FROM docs WHERE source_type = 'chunk'")
def prj05_chunk_document(spark, folder):
    d = _docs(spark, folder).where("source_type = 'chunk'")
    return d.select("document_id", F.concat_ws("\n", F.concat(F.lit("Disease: "), "disease_name"), F.concat(F.lit("Section: "), F.coalesce("section_type", F.lit("general"))), "content").alias("embedding_text"))


@query("SELECT row_id, CASE section_type WHEN 'treatment' THEN 'Điều trị' WHEN 'diagnosis' THEN 'Chẩn đoán' WHEN 'classification' THEN 'Phân loại' ELSE COALESCE(section_type, 'Khác') END AS label FROM thresholds_extra")
def prj08_labels_with_fallback(spark, folder):
    labels = F.create_map(*(F.lit(x) for x in ("treatment", "Điều trị", "diagnosis", "Chẩn đoán", "classification", "Phân loại")))
    return _t(spark, folder).select("row_id", F.coalesce(labels[F.col("section_type")], "section_type", F.lit("Khác")).alias("label"))


@query(f"WITH {_DOCS} SELECT document_id, SUBSTRING(content, 1, 800) AS preview, ROUND(page / 7.0::DOUBLE, 6) AS score FROM docs")
def prj10_result_rows(spark, folder):
    return _docs(spark, folder).select("document_id", F.substring("content", 1, 800).alias("preview"), F.round(F.col("page") / 7.0, 6).alias("score"))


@query("""SELECT result_id, ARRAY_TO_STRING(LIST_TRANSFORM((LIST_FILTER(d, lambda x: x IS NOT NULL AND x.name IS NOT NULL AND x.value IS NOT NULL))[1:8], lambda x: '- ' || x.name || ': ' || CAST(ROUND(x.value) AS BIGINT)), CHR(10)) AS context
    FROM (SELECT DISTINCT result_id, output_summary.detected_measurements AS d FROM medical_tools_audit_report WHERE output_summary.detected_measurements IS NOT NULL)""")
def prj13_tool_context(spark, folder):
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", F.col("output_summary.detected_measurements").alias("d")).where("d is not null").distinct()
    known = F.slice(F.filter("d", lambda x: x.isNotNull() & x["name"].isNotNull() & x["value"].isNotNull()), 1, 8)
    lines = F.transform(known, lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), F.round(x["value"]).cast("bigint").cast("string")))
    return a.select("result_id", F.array_join(lines, "\n").alias("context"))


@query(f"WITH {_DOCS} SELECT document_id, '[' || ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY document_id) || '] ' || SUBSTRING(COALESCE(content, ''), 1, 240) AS shown FROM docs WHERE source_file IS NOT NULL")
def prj16_user_sources(spark, folder):
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("document_id"))
    return _docs(spark, folder).where("source_file is not null").select("document_id", F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 240)).alias("shown"))


@query("SELECT DISTINCT id, ARRAY_TO_STRING(CASE WHEN required_facts IS NOT NULL AND LEN(required_facts) > 0 THEN LIST_FILTER(required_facts, lambda x: x IS NOT NULL) ELSE [COALESCE(reference_answer, '')] END, '|') AS contexts FROM threshold_qa")
def prj22_contexts_with_fallback(spark, folder):
    facts = F.when(F.size("required_facts") > 0, F.filter("required_facts", lambda x: x.isNotNull())).otherwise(F.array(F.coalesce("reference_answer", F.lit(""))))
    return table(spark, folder, "threshold_qa").select("id", F.array_join(facts, "|").alias("contexts")).distinct()


# Predicates -------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT document_id FROM medical_documents WHERE CONTAINS(LOWER(content), 'fena') OR CONTAINS(LOWER(content), 'natri') OR CONTAINS(LOWER(content), 'sodium')")
def flt04_keyword_evidence(spark, folder):
    words = F.array(*(F.lit(w) for w in ("fena", "natri", "sodium")))
    return table(spark, folder, "medical_documents").where(F.exists(words, lambda w: F.contains(F.lower("content"), w))).select("document_id").distinct()


@query("SELECT row_id FROM thresholds_extra WHERE threshold_value > 0 AND threshold_value < 10000 AND biomarker IS NOT NULL AND (threshold_unit IS NOT NULL OR REGEXP_MATCHES(source_text, '[0-9]'))")
def flt06_plausible_thresholds(spark, folder):
    return _t(spark, folder).where((F.col("threshold_value") > 0) & (F.col("threshold_value") < 10000) & F.col("biomarker").isNotNull() & (F.col("threshold_unit").isNotNull() | F.col("source_text").rlike("[0-9]"))).select("row_id")


@query(f"SELECT doc_id, COALESCE(NOT CONTAINS(k, 'adrenal') AND (CONTAINS(k, 'kidney') OR CONTAINS(k, 'renal') OR CONTAINS(k, 'neph')), FALSE) AS kidney FROM (SELECT doc_id, LOWER(text) AS k FROM documents)")
def flt07_topic_with_veto(spark, folder):
    k = F.lower("text")
    return table(spark, folder, "documents").select("doc_id", F.coalesce(~F.contains(k, F.lit("adrenal")) & P.any_contains(k, ["kidney", "renal", "neph"]), F.lit(False)).alias("kidney"))


@query("SELECT doc_id, COALESCE(CONTAINS(text, '\"graph_type\"') OR (CONTAINS(text, '\"nodes\"') AND CONTAINS(text, '\"edges\"')) OR CONTAINS(text, '\"root_node\"'), FALSE) AS graph FROM documents")
def flt14_graph_documents(spark, folder):
    has = lambda w: F.contains("text", F.lit(f'"{w}"'))
    return table(spark, folder, "documents").select("doc_id", F.coalesce(has("graph_type") | (has("nodes") & has("edges")) | has("root_node"), F.lit(False)).alias("graph"))


@query(f"SELECT id, (CASE WHEN CONTAINS(k, 'va') THEN 1 ELSE 0 END + CASE WHEN CONTAINS(k, 'hay') THEN 1 ELSE 0 END + CASE WHEN CONTAINS(k, '?') THEN 1 ELSE 0 END) >= 2 AS several FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})")
def flt16_several_intents(spark, folder):
    k = T.ascii_key_trimmed("query")
    hits = F.array(*(F.contains(k, F.lit(w)) for w in ("va", "hay", "?")))
    return _qa(spark, folder).select("id", (F.size(F.filter(hits, lambda x: x)) >= 2).alias("several"))


@query("SELECT DISTINCT id, expected.require_route IS NULL OR expected.top IS NULL AS has_null FROM (SELECT id, STRUCT_PACK(require_route := expected.require_route, top := expected.require_tool_called) AS expected FROM threshold_qa)")
def flt22_contains_null(spark, folder):
    return table(spark, folder, "threshold_qa").select("id", (F.col("expected.require_route").isNull() | F.col("expected.require_tool_called").isNull()).alias("has_null")).distinct()


@query(f"WITH {_DOCS} SELECT document_id, COALESCE(REGEXP_MATCHES({sql_key('content')}, '^(phan|chuong|bai) [0-9ivx]+'), FALSE) AS resets FROM docs")
def flt24_context_reset(spark, folder):
    return _docs(spark, folder).select("document_id", F.coalesce(T.ascii_key_trimmed("content").rlike("^(phan|chuong|bai) [0-9ivx]+"), F.lit(False)).alias("resets"))


# Deduplication, windows, ranking ----------------------------------------------------------------------------------
@query("SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY COALESCE(LOWER(TRIM(REGEXP_REPLACE(text, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g'))), CAST(doc_id AS VARCHAR)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def ded02_distinct_texts(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.coalesce(T.lower_key("text"), F.col("doc_id").cast("string")).alias("k"))
    return O.keep_first(d, [F.col("k")], ["doc_id"]).select("doc_id")


@query("SELECT formula_id, MIN(formula_name) AS formula_name FROM formulas GROUP BY formula_id")
def ded07_structured_by_id(spark, folder):
    return O.keep_first(table(spark, folder, "formulas").select("formula_id", "formula_name"), [F.col("formula_id")], ["formula_name"])


@query(f"""WITH {_CHUNKS}, pages AS (SELECT source_file, page, ARG_MIN(disease_name, chunk_index) FILTER (disease_name IS NOT NULL) AS d FROM chunks GROUP BY ALL)
    SELECT t.row_id, COALESCE(a.d, b.d, c.d) AS disease FROM thresholds_extra t LEFT JOIN pages a ON a.source_file = t.source_file AND a.page = t.page LEFT JOIN pages b ON b.source_file = t.source_file AND b.page = t.page - 1 LEFT JOIN pages c ON c.source_file = t.source_file AND c.page = t.page + 1""")
def win03_page_context(spark, folder):
    """Disease of the page a rule stands on, of the page before or of the page after."""
    pages = _chunks(spark, folder).groupBy("source_file", "page").agg(F.min_by("disease_name", F.when(F.col("disease_name").isNotNull(), F.col("chunk_index"))).alias("d"))
    out = _t(spark, folder).select("row_id", "source_file", "page")
    for name, shift in (("a", 0), ("b", 1), ("c", -1)):
        out = out.join(pages.select("source_file", (F.col("page") + shift).alias("page"), F.col("d").alias(name)), ["source_file", "page"], "left")
    return out.select("row_id", F.coalesce("a", "b", "c").alias("disease"))


@query("""SELECT event_id, ROUND(CASE WHEN value > 100 THEN value / 500 ELSE GREATEST(0.5::DOUBLE, COALESCE(MAX(value / 500) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) - 0.2::DOUBLE) END, 6) AS confidence FROM events""")
def win08_history_confidence(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    share = F.col("value") / 500
    past = F.greatest(F.lit(0.5), F.coalesce(F.max(share).over(w), F.lit(0.0)) - 0.2)
    return table(spark, folder, "events").select("event_id", F.round(F.when(F.col("value") > 100, share).otherwise(past), 6).alias("confidence"))


@query("""WITH u AS (SELECT 0 AS part, row_id AS id FROM thresholds_extra WHERE threshold_op = 'between' UNION ALL SELECT 1, row_id FROM thresholds_extra WHERE threshold_op = '>=' AND page < 50) SELECT part, id, ROW_NUMBER() OVER (ORDER BY part, id) AS label FROM u""")
def win11_labels_over_union(spark, folder):
    """Running labels over two lists, the second going on where the first ends.

    Ranks are taken within ranges of 10,000 ids; the ranges' counts, a row each, are summed up before them. No task sees
    more than a range.
    """
    t = _t(spark, folder)
    u = t.where("threshold_op = 'between'").select(F.lit(0).alias("part"), F.col("row_id").alias("id")).unionByName(t.where("threshold_op = '>=' and page < 50").select(F.lit(1).alias("part"), F.col("row_id").alias("id")))
    u = u.withColumn("b", F.floor(F.col("id") / 10_000))
    counts = u.groupBy("part", "b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", "b", F.coalesce(F.sum("n").over(Window.orderBy("part", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = u.withColumn("r", F.row_number().over(Window.partitionBy("part", "b").orderBy("id")))
    return ranked.join(before, ["part", "b"]).select("part", "id", (F.col("r") + F.col("before")).alias("label"))


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25("hits", "queries", 10)}, again AS (SELECT h.query_id, h.id, ROUND(GREATEST(h.score, 0) + LEN(LIST_INTERSECT({sql_tokens("q.query")}, {sql_token_set("d.text")})) * 0.05::DOUBLE, 6) AS score FROM hits h JOIN queries q USING (query_id) JOIN documents d ON d.doc_id = h.id)
    SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM again""")
def top05_heuristic_rerank(spark, folder):
    """The best hits of each query ranked again by score plus shared tokens."""
    queries, passages = _queries(spark, folder), _passages(spark, folder)
    hits = K.bm25_search(queries, passages, 10).drop("rank")
    both = K.with_passages(hits, passages).join(broadcast_if_small(queries, K.SLICE), "query_id")
    shared = F.size(F.array_intersect(R.content_tokens(F.col("query")), R.content_tokens(F.col("text"), 100000)))
    again = both.select("query_id", "id", F.round(F.greatest("score", F.lit(0.0)) + shared * 0.05, 6).alias("score"))
    return R.best(again, "query_id", [F.desc("score"), F.col("id")], 10)


@query(f"""WITH r AS (SELECT biomarker_id, biomarker, LOWER(name_vi) AS a FROM biomarker_reference), h AS (SELECT t.row_id, r.biomarker, STRPOS(LOWER(t.source_text), r.a) AS p, LENGTH(r.a) AS l FROM thresholds_extra t JOIN r ON CONTAINS(LOWER(t.source_text), r.a))
    SELECT row_id, ARG_MAX(biomarker, STRUCT_PACK(e := p + l, l := l)) AS biomarker FROM h GROUP BY row_id""")
def top13_rightmost_name(spark, folder):
    """The reference name that ends last in a rule's text, of several the longest."""
    ref = broadcast_if_small(table(spark, folder, "biomarker_reference").select("biomarker", F.lower("name_vi").alias("a")))
    t = _t(spark, folder).select("row_id", F.lower("source_text").alias("s"))
    hits = t.join(ref, F.contains("s", F.col("a"))).select("row_id", "biomarker", F.position(F.col("a"), F.col("s")).alias("p"), F.length("a").alias("l"))
    return hits.groupBy("row_id").agg(F.max_by("biomarker", F.struct((F.col("p") + F.col("l")).alias("e"), "l")).alias("biomarker"))


@query("SELECT id, COUNT(*) AS documents FROM (SELECT id, d FROM (SELECT DISTINCT id, relevant_document_ids FROM threshold_qa) q, UNNEST(q.relevant_document_ids) AS u(d) UNION SELECT id, 'source::' || s FROM (SELECT DISTINCT id, relevant_source_ids FROM threshold_qa) q, UNNEST(q.relevant_source_ids) AS u(s)) GROUP BY id")
def set07_union_of_documents(spark, folder):
    qa = table(spark, folder, "threshold_qa")
    a = qa.select("id", F.explode("relevant_document_ids").alias("d"))
    b = qa.select("id", F.explode("relevant_source_ids").alias("s")).select("id", F.concat(F.lit("source::"), "s").alias("d"))
    return a.unionByName(b).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("documents"))


# Functions --------------------------------------------------------------------------------------------------------
@query(f"SELECT id, query || ' site:health.org -site:' || REPLACE(id, '_', '') || '.com' AS controlled FROM {_QA} WHERE query IS NOT NULL AND id IS NOT NULL")
def txt24_domain_controls(spark, folder):
    return _qa(spark, folder).where("query is not null and id is not null").select("id", F.concat("query", F.lit(" site:health.org -site:"), F.replace("id", F.lit("_"), F.lit("")), F.lit(".com")).alias("controlled"))


@query(f"SELECT id, query AS unescaped FROM {_QA} WHERE query IS NOT NULL")
def txt28_json_unescape(spark, folder):
    """Texts escaped as JSON strings and back."""
    escaped = F.get_json_object(F.to_json(F.struct(F.col("query").alias("q"))), "$.q")
    return _qa(spark, folder).where("query is not null").select("id", escaped.alias("unescaped"))


@query(f"""SELECT id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN {_sql_hint('k', {'x': ['ckd-epi', 'ckd epi']})} IS NOT NULL THEN 'ckd_epi' END, CASE WHEN {_sql_hint('k', {'x': ['mdrd']})} IS NOT NULL THEN 'mdrd' END, CASE WHEN {_sql_hint('k', {'x': ['fena', 'phan suat thai natri']})} IS NOT NULL THEN 'fena' END,
    CASE WHEN {_sql_hint('k', {'x': ['do thanh thai', 'cockcroft']})} IS NOT NULL THEN 'clearance' END], lambda x: x IS NOT NULL), ',') AS formulas FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})""")
def txt31_formula_intent(spark, folder):
    k = T.ascii_key_trimmed("query")
    test = lambda *words: P.keyword_in(k, words[0]) if len(words) == 1 else P.keyword_in(k, words[0]) | P.keyword_in(k, words[1])
    found = F.array(F.when(test("ckd-epi", "ckd epi"), "ckd_epi"), F.when(test("mdrd"), "mdrd"), F.when(test("fena", "phan suat thai natri"), "fena"), F.when(test("do thanh thai", "cockcroft"), "clearance"))
    return _qa(spark, folder).select("id", F.array_join(F.array_compact(found), ",").alias("formulas"))


_RULE15 = [("hemoglobin", "(?:huyet sac to|haemoglobin level)"), ("potassium", "(?:kali mau|serum potassium)"), ("creatinine", "(?:creatinin mau|serum creatinine)")]


@query(" UNION ALL ".join(f"SELECT row_id, '{name}' AS biomarker, CAST(REPLACE(REGEXP_EXTRACT(k, '{p} *(?:is)? *[<>]=? *([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS value FROM (SELECT row_id, {sql_key('source_text')} AS k FROM thresholds_extra) WHERE REGEXP_MATCHES(k, '{p} *(?:is)? *[<>]=? *([0-9]+(?:[.,][0-9]+)?)')" for name, p in _RULE15))
def txt15_targeted_rules(spark, folder):
    """A table of patterns applied to every text in one pass."""
    k = T.ascii_key_trimmed("source_text")
    found = []
    for name, p in _RULE15:
        pattern = rf"{p} *(?:is)? *[<>]=? *([0-9]+(?:[.,][0-9]+)?)"
        found.append(F.struct(F.lit(name).alias("biomarker"), F.translate(F.regexp_extract("k", pattern, 1), ",", ".").try_cast("double").alias("value")))
    t = _t(spark, folder).select("row_id", k.alias("k")).where("k is not null")
    return t.select("row_id", F.inline(F.filter(F.array(*found), lambda x: x["value"].isNotNull())))


@query("SELECT event_id, CAST(CAST(FLOOR(value * 60) AS INTEGER) / 32768.0::DOUBLE AS FLOAT) AS sample FROM events")
def num09_pcm_to_float(spark, folder):
    pcm = F.floor(F.col("value") * 60).cast("int")
    return table(spark, folder, "events").select("event_id", (pcm / F.lit(32768.0)).cast("float").alias("sample"))


@query(f"""WITH q AS (SELECT id, {sql_fold('LOWER(query)')} AS k FROM {_QA}) SELECT id, CASE WHEN CONTAINS(k, 'kali') OR CONTAINS(k, 'potassium') THEN 'potassium' END AS biomarker, TRY_CAST(REPLACE(NULLIF(REGEXP_EXTRACT(k, '([0-9]+(?:[.,][0-9]+)?) *(?:mmol/l|mg/dl|g/l|mg/g|%)', 1), ''), ',', '.') AS DOUBLE) AS value FROM q""")
def txt17_question_parse(spark, folder):
    k = T.fold_accents(F.lower("query"))
    number = F.regexp_extract(k, r"([0-9]+(?:[.,][0-9]+)?) *(?:mmol/l|mg/dl|g/l|mg/g|%)", 1)
    return _qa(spark, folder).select("id", F.when(P.any_contains(k, ["kali", "potassium"]), "potassium").alias("biomarker"), T.to_double(F.when(number != "", number)).alias("value"))


