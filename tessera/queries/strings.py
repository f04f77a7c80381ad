"""Text, number, array and date functions, predicates and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import passages as P
from tessera.functions import text as T
from tessera.functions.text import _vietnamese_pairs
from tessera.functions.vocab import BIOMARKER_HINTS, DISEASE_HINTS, SECTION_HINTS, UNIT_ALIASES
from tessera.operators.retrieval import content_tokens, terms
from tessera.queries.search import sql_distinct, sql_fold, sql_key, sql_terms, sql_tokens
from tessera.session import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _qa(spark, folder):
    return table(spark, folder, "threshold_qa").select("id", "title", "query", "reference_answer").distinct()


_QA = "(SELECT DISTINCT id, title, query, reference_answer FROM threshold_qa)"


def _t(spark, folder):
    return table(spark, folder, "thresholds_extra")


_WS = "[ \\t\\n\\x0B\\f\\r]"
_WIDE = "[ \\t\\n\\x0B\\f\\r\\x{A0}]"


@query(f"SELECT row_id, {sql_key('label')} AS k FROM thresholds_extra")
def txt01_ascii_key(spark, folder):
    return _t(spark, folder).select("row_id", T.ascii_key_trimmed("label").alias("k"))


@query(f"SELECT id, TRANSLATE(LOWER(query), '{_vietnamese_pairs()[0]}', '{_vietnamese_pairs()[1]}') AS k FROM {_QA}")
def txt02_query_key(spark, folder):
    return _qa(spark, folder).select("id", T.query_key("query").alias("k"))


@query(f"SELECT id, TRIM(REGEXP_REPLACE({sql_fold('LOWER(title)')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM {_QA}")
def txt03_match_key(spark, folder):
    return _qa(spark, folder).select("id", T.match_key("title").alias("k"))


@query(f"SELECT id, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE({sql_fold('LOWER(query)')}, ',', '.'), '[^a-z0-9%/.<>=+\\-]+', ' ', 'g'), '{_WS}+', ' ', 'g')) AS k FROM {_QA}")
def txt03_eval_key(spark, folder):
    return _qa(spark, folder).select("id", T.eval_key("query").alias("k"))


@query(f"SELECT id, LOWER(TRIM(REGEXP_REPLACE(reference_answer, '{_WIDE}+', ' ', 'g'))) AS k FROM {_QA}")
def txt03_lower_key(spark, folder):
    return _qa(spark, folder).select("id", T.lower_key("reference_answer").alias("k"))


@query(f"""SELECT DISTINCT document_id, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE(content, CHR(13), CHR(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', CHR(10) || CHR(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS tidy FROM medical_documents""")
def txt03_tidy_lines(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", T.tidy_lines("content").alias("tidy")).distinct()


@query(f"SELECT row_id, REGEXP_REPLACE(REGEXP_REPLACE(LOWER({sql_fold('biomarker')}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM thresholds_extra")
def txt04_slug(spark, folder):
    return _t(spark, folder).select("row_id", T.slug("biomarker").alias("slug"))


@query(f"SELECT id, ARRAY_TO_STRING({sql_terms('query')}, ' ') AS words FROM {_QA}")
def txt05_search_terms(spark, folder):
    return _qa(spark, folder).select("id", F.array_join(terms(F.col("query")), " ").alias("words"))


@query(f"SELECT id, ARRAY_TO_STRING({sql_tokens('query')}, ' ') AS words FROM {_QA}")
def txt06_content_tokens(spark, folder):
    return _qa(spark, folder).select("id", F.array_join(content_tokens(F.col("query")), " ").alias("words"))


_TOKENS = f"REGEXP_EXTRACT_ALL({sql_key('query')}, '[a-z0-9_]{{2,}}')"


@query(f"SELECT id, LEN({sql_distinct(_TOKENS)}) AS n FROM {_QA}")
def txt07_token_set(spark, folder):
    found = F.regexp_extract_all(T.ascii_key_trimmed("query"), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return _qa(spark, folder).select("id", F.size(F.array_distinct(found)).cast("long").alias("n"))


@query(f"SELECT id, COALESCE(NULLIF(REGEXP_REPLACE(TRIM(q), '(?i)^{_WS}*(?:hi|hello|hey|xin{_WS}+chào|chào{_WS}+bạn|chào){_WS}*[,!.\\-:;]*{_WS}+', ''), ''), TRIM(q)) AS asked FROM (SELECT id, 'Xin chào, ' || query AS q FROM {_QA})")
def txt08_without_greeting(spark, folder):
    return _qa(spark, folder).select("id", P.without_greeting(F.concat(F.lit("Xin chào, "), "query")).alias("asked"))


@query("SELECT DISTINCT document_id, COALESCE(LIST_FILTER(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY(content, '\\r?\\n'), lambda x: TRIM(x)), lambda x: x <> '')[1], TRIM(content)) AS line FROM medical_documents")
def txt08_primary_line(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", P.primary_line(F.col("content")).alias("line")).distinct()


@query("SELECT row_id, len(LIST_FILTER(REGEXP_EXTRACT_ALL(source_text, '(?i)(<=|>=|≤|≥|<|>)[ \\t\\n\\x0B\\f\\r]*([0-9]+(?:[.,][0-9]+)?)[ \\t\\n\\x0B\\f\\r]*(g/24h|g/l|mmol/l|mg/g|mg/mmol|mg/dl|ml/ph/1[.,]73m2|ml/ph|mmhg|%)'), lambda x: TRUE)) AS n FROM thresholds_extra")
def txt09_inline_threshold_counts(spark, folder):
    return _t(spark, folder).select("row_id", F.size(P.inline_thresholds(F.col("source_text"))).cast("long").alias("n"))


@query("""SELECT row_id, REPLACE(REGEXP_EXTRACT(source_text, '(?i)(<=|>=|≤|≥|<|>)[ \\t\\n\\x0B\\f\\r]*([0-9]+(?:[.,][0-9]+)?)[ \\t\\n\\x0B\\f\\r]*(g/24h|g/l|mmol/l|mg/g|mg/mmol|mg/dl|ml/ph/1[.,]73m2|ml/ph|mmhg|%)', 2), ',', '.')::DOUBLE AS value,
    LOWER(REGEXP_EXTRACT(source_text, '(?i)(<=|>=|≤|≥|<|>)[ \\t\\n\\x0B\\f\\r]*([0-9]+(?:[.,][0-9]+)?)[ \\t\\n\\x0B\\f\\r]*(g/24h|g/l|mmol/l|mg/g|mg/mmol|mg/dl|ml/ph/1[.,]73m2|ml/ph|mmhg|%)', 3)) AS unit
    FROM thresholds_extra WHERE REGEXP_MATCHES(source_text, '(?i)(<=|>=|≤|≥|<|>)[ \\t\\n\\x0B\\f\\r]*([0-9]+(?:[.,][0-9]+)?)[ \\t\\n\\x0B\\f\\r]*(g/24h|g/l|mmol/l|mg/g|mg/mmol|mg/dl|ml/ph/1[.,]73m2|ml/ph|mmhg|%)')""")
def txt09_first_inline_threshold(spark, folder):
    first = F.try_element_at(P.inline_thresholds(F.col("source_text")), F.lit(1))
    return _t(spark, folder).select("row_id", first.alias("x")).where("x is not null").select("row_id", "x.value", "x.unit")


@query("SELECT row_id, CASE threshold_op WHEN '>' THEN '>' WHEN '<' THEN '<' ELSE threshold_op END AS sign FROM thresholds_extra")
def txt11_operator_words(spark, folder):
    words = F.when(F.col("threshold_op") == ">", F.lit("Cao trên")).when(F.col("threshold_op") == "<", F.lit("dưới")).otherwise(F.col("threshold_op"))
    return _t(spark, folder).select("row_id", P.operator_sign(words).alias("sign"))


_UNIT_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in UNIT_ALIASES.items())


@query(f"SELECT row_id, CASE TRIM(threshold_unit) {_UNIT_CASE} ELSE CASE REPLACE(TRIM(threshold_unit), ' ', '') {_UNIT_CASE} ELSE TRIM(threshold_unit) END END AS unit FROM thresholds_extra")
def txt12_unit_alias(spark, folder):
    aliases = F.create_map(*(F.lit(x) for pair in UNIT_ALIASES.items() for x in pair))
    unit = F.trim("threshold_unit")
    return _t(spark, folder).select("row_id", F.coalesce(aliases[unit], aliases[F.replace(unit, F.lit(" "), F.lit(""))], unit).alias("unit"))


@query("""SELECT row_id, CASE WHEN threshold_op = 'between' THEN threshold_value_min ELSE threshold_value END AS low, CASE WHEN threshold_op = 'between' THEN threshold_value_max END AS high, threshold_op AS op
    FROM thresholds_extra WHERE threshold_value < 1000000 AND threshold_value >= 0.001 AND COALESCE(threshold_value_max, 1) < 1000000""")
def txt13_rule_condition(spark, folder):
    """Conditions written from the rules' columns and read back."""
    t = _t(spark, folder).where("threshold_value < 1000000 and threshold_value >= 0.001 and coalesce(threshold_value_max, 1) < 1000000")
    written = F.when(F.col("threshold_op") == "between", F.concat(F.col("threshold_value_min").cast("string"), F.lit(" <= x < "), F.col("threshold_value_max").cast("string"))).otherwise(F.concat(F.lit("x "), "threshold_op", F.lit(" "), F.col("threshold_value").cast("string")))
    return t.select("row_id", P.rule_condition(written).alias("r")).select("row_id", "r.low", "r.high", "r.op")


@query("""SELECT row_id, COALESCE(REGEXP_MATCHES(source_text, '(<=|≤)[ ]*' || REPLACE(REGEXP_REPLACE(CAST(threshold_value_max AS VARCHAR), '\\.0$', ''), '.', '[.]') || '([^0-9]|$)'), FALSE) AS inclusive FROM thresholds_extra WHERE threshold_op = 'between' AND threshold_value_max BETWEEN 0.001 AND 999999""")
def txt14_upper_bound_inclusive(spark, folder):
    t = _t(spark, folder).where("threshold_op = 'between' and threshold_value_max between 0.001 and 999999")
    number = F.replace(F.regexp_replace(F.col("threshold_value_max").cast("string"), r"\.0$", ""), F.lit("."), F.lit("[.]"))
    pattern = F.concat(F.lit("(<=|≤)[ ]*"), number, F.lit("([^0-9]|$)"))
    return t.select("row_id", F.coalesce(F.regexp_like("source_text", pattern), F.lit(False)).alias("inclusive"))


@query(f"""SELECT id, CASE WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(nu|female|woman)([^a-z0-9]|$)') THEN 'female' WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(nam|male|man)([^a-z0-9]|$)') THEN 'male' END AS sex FROM (SELECT id, {sql_key("query")} AS k FROM {_QA})""")
def txt18_sex(spark, folder):
    k = T.ascii_key_trimmed("query")
    return _qa(spark, folder).select("id", F.when(k.rlike("(?<![a-z0-9])(nu|female|woman)(?![a-z0-9])"), "female").when(k.rlike("(?<![a-z0-9])(nam|male|man)(?![a-z0-9])"), "male").alias("sex"))


def _lines(n: int) -> str:
    return f"regexp_replace(regexp_replace(lower({sql_fold(f'ARRAY_TO_STRING(ls[1:{n}], chr(32))')}), '[^\\x00-\\x7F]', '', 'g'), '{_WS}+', ' ', 'g')"


_SECTION_CASE = " ".join(f"WHEN {' OR '.join(f'CONTAINS({p}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{k}'" for p in ("two", "six") for k, words in P.SECTIONS.items())


@query(f"""SELECT DISTINCT document_id, CASE WHEN content IS NOT NULL THEN CASE {_SECTION_CASE} ELSE 'general' END END AS section FROM (SELECT document_id, content, {_lines(2)} AS two, {_lines(6)} AS six
    FROM (SELECT document_id, content, LIST_FILTER(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY(content, '\\r?\\n'), lambda x: TRIM(x)), lambda x: x <> '') AS ls FROM medical_documents))""")
def txt19_section_type(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", P.section_type(F.col("content")).alias("section")).distinct()


@query(f"""SELECT DISTINCT document_id, NULLIF(REGEXP_EXTRACT(line, '^([0-9]+(?:\\.[0-9]+)*)\\.?{_WS}+', 1), '') AS number, LEN(STRING_SPLIT(NULLIF(REGEXP_EXTRACT(line, '^([0-9]+(?:\\.[0-9]+)*)\\.?{_WS}+', 1), ''), '.')) AS level
    FROM (SELECT document_id, COALESCE(LIST_FILTER(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY(content, '\\r?\\n'), lambda x: TRIM(x)), lambda x: x <> '')[1], '') AS line FROM medical_documents)""")
def txt20_heading(spark, folder):
    number = P.heading_number(F.col("content"))
    return table(spark, folder, "medical_documents").select("document_id", number.alias("number"), F.when(number.isNotNull(), F.size(F.split(number, r"\.")).cast("long")).alias("level")).distinct()


@query()
def txt21_redacted(spark, folder):
    """Page marks and source marks out of passages; word boundaries in accented text are not expressible in the twin."""
    return table(spark, folder, "medical_documents").select("document_id", P.redacted(F.col("content")).alias("answer")).distinct()


@query("SELECT id, REGEXP_REPLACE(LOWER(REGEXP_EXTRACT(u, '^[a-z]+://([^/:]+)', 1)), '^www\\.', '') AS host FROM (SELECT id, 'https://www.' || REPLACE(id, '_', '-') || '.Example.org/a?q=1' AS u FROM (SELECT DISTINCT id FROM threshold_qa WHERE id IS NOT NULL))")
def txt23_hostname(spark, folder):
    ids = table(spark, folder, "threshold_qa").where("id is not null").select("id").distinct()
    url = F.concat(F.lit("https://www."), F.replace("id", F.lit("_"), F.lit("-")), F.lit(".Example.org/a?q=1"))
    return ids.select("id", F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "").alias("host"))


@query(f"SELECT doc_id, ARRAY_TO_STRING(LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(TRANSLATE(text, CHR(13) || CHR(9) || '“”', CHR(10) || ' \"\"'), CHR(10)), lambda x: TRIM(x)), lambda x: x <> ''), CHR(10)) AS clean FROM documents")
def txt25_ocr_cleanup(spark, folder):
    lines = F.filter(F.transform(F.split(F.translate("text", "\r\t“”", '\n ""'), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, folder, "documents").select("doc_id", F.array_join(lines, "\n").alias("clean"))


@query()
def txt26_trimmed_at_word(spark, folder):
    return table(spark, folder, "documents").select("doc_id", P.trimmed_at_word(F.col("text"), 240).alias("summary"))


@query("SELECT formula_id, REGEXP_EXTRACT_ALL(expression, '[0-9]+(?:\\.[0-9]+)?')[1] AS first_number, REGEXP_EXTRACT_ALL(expression, '[0-9]+(?:\\.[0-9]+)?')[-1] AS last_number FROM (SELECT DISTINCT formula_id, expression FROM formulas)")
def txt27_first_and_last_value(spark, folder):
    found = F.regexp_extract_all("expression", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    f = table(spark, folder, "formulas").select("formula_id", "expression").distinct()
    return f.select("formula_id", F.try_element_at(found, F.lit(1)).alias("first_number"), F.try_element_at(found, F.lit(-1)).alias("last_number"))


@query(f"""SELECT id, ARRAY_TO_STRING(LIST_SORT(LIST_FILTER([CASE WHEN REGEXP_MATCHES(COALESCE(query, '') || COALESCE(reference_answer, ''), '[0-9]') THEN 'numeric' END, CASE WHEN CONTAINS(k, 'chan doan') THEN 'diagnosis' END, CASE WHEN CONTAINS(k, 'dieu tri') THEN 'treatment' END,
    CASE WHEN CONTAINS(k, 'tien trien') OR CONTAINS(k, 'tien luong') THEN 'prognosis' END, 'rag_qa'], lambda x: x IS NOT NULL)), ',') AS tags FROM (SELECT *, {sql_key("CONCAT(COALESCE(query, ''), ' ', COALESCE(reference_answer, ''))")} AS k FROM {_QA})""")
def txt30_tags(spark, folder):
    both = F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("reference_answer", F.lit("")))
    k = T.ascii_key_trimmed(both)
    tags = F.array(F.when(both.rlike("[0-9]"), "numeric"), F.when(F.contains(k, F.lit("chan doan")), "diagnosis"), F.when(F.contains(k, F.lit("dieu tri")), "treatment"), F.when(P.any_contains(k, ["tien trien", "tien luong"]), "prognosis"), F.lit("rag_qa"))
    return _qa(spark, folder).select("id", F.array_join(F.array_sort(F.array_compact(tags)), ",").alias("tags"))


def _sql_hint(x: str, hints: dict) -> str:
    def one(word: str) -> str:
        return f"CONTAINS({x}, '{word}')" if " " in word or len(word) > 4 else f"REGEXP_MATCHES({x}, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(one, words))} THEN '{k}'" for k, words in hints.items()) + " END"


@query(f"SELECT id, {_sql_hint('k', DISEASE_HINTS)} AS disease_hint, {_sql_hint('k', SECTION_HINTS)} AS section_hint, {_sql_hint('k', BIOMARKER_HINTS)} AS biomarker_hint FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})")
def ret19_query_hints(spark, folder):
    q = F.col("query")
    return _qa(spark, folder).select("id", P.hint(q, DISEASE_HINTS).alias("disease_hint"), P.hint(q, SECTION_HINTS).alias("section_hint"), P.hint(q, BIOMARKER_HINTS).alias("biomarker_hint"))


# Numbers, arrays, dates -------------------------------------------------------------------------------------------
@query("SELECT formula_id, i - 1 AS pos, TRY_CAST(x[i] AS DOUBLE) AS value FROM (SELECT formula_id, REGEXP_EXTRACT_ALL(REPLACE(source_text, ',', '.'), '[0-9]+[.][0-9]+') AS x, UNNEST(RANGE(1, CAST(LEN(REGEXP_EXTRACT_ALL(REPLACE(source_text, ',', '.'), '[0-9]+[.][0-9]+')) AS BIGINT) + 1)) AS i FROM (SELECT DISTINCT formula_id, source_text FROM formulas))")
def num06_decimal_comma(spark, folder):
    f = table(spark, folder, "formulas").select("formula_id", "source_text").distinct()
    found = F.regexp_extract_all("source_text", F.lit("[0-9]+[.,][0-9]+"), F.lit(0))
    return f.select("formula_id", F.posexplode(found).alias("pos", "x")).select("formula_id", F.col("pos").cast("long").alias("pos"), T.to_double("x").alias("value"))


@query("SELECT event_id, ROUND(GREATEST(0.0, LEAST(1.0, value / 250)), 6) AS score FROM events")
def num07_clamped_score(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 250)), 6).alias("score"))


@query("SELECT id, TRY_CAST(REGEXP_EXTRACT(query, '[0-9]+', 0) AS INTEGER) AS number FROM " + _QA)
def num08_safe_int(spark, folder):
    return _qa(spark, folder).select("id", F.regexp_extract("query", "[0-9]+", 0).try_cast("int").alias("number"))


@query("SELECT DISTINCT id, LEN(relevant_document_ids) AS n, LIST_CONTAINS(relevant_source_ids, STRING_SPLIT(relevant_document_ids[1], '::')[2]) AS first_is_source FROM threshold_qa WHERE relevant_document_ids[1] IS NOT NULL AND relevant_source_ids IS NOT NULL AND LEN(LIST_FILTER(relevant_source_ids, lambda x: x IS NULL)) = 0")
def arr01_membership(spark, folder):
    qa = table(spark, folder, "threshold_qa").where(F.try_element_at("relevant_document_ids", F.lit(1)).isNotNull() & F.col("relevant_source_ids").isNotNull() & ~F.exists("relevant_source_ids", lambda x: x.isNull()))
    source = F.split_part(F.try_element_at("relevant_document_ids", F.lit(1)), F.lit("::"), F.lit(2))
    return qa.select("id", F.size("relevant_document_ids").cast("long").alias("n"), F.array_contains("relevant_source_ids", source).alias("first_is_source")).distinct()


@query("SELECT event_id, JSON_EXTRACT_STRING(props, '$.k') AS k, JSON_EXTRACT_STRING(props, '$.absent') AS absent FROM events")
def arr02_json_field(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("SELECT DISTINCT id, COALESCE(NULLIF(TRIM(reference_answer), ''), LIST_FILTER(required_facts, lambda x: x IS NOT NULL AND TRIM(x) <> '')[1]) AS usable FROM threshold_qa")
def arr03_optional_string(spark, folder):
    first = F.try_element_at(F.filter("required_facts", lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(1))
    text = F.trim("reference_answer")
    return table(spark, folder, "threshold_qa").select("id", F.coalesce(F.when(text != "", text), first).alias("usable")).distinct()


@query("SELECT event_id, STRFTIME(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def dat01_iso_timestamp(spark, folder):
    return table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


# Predicates -------------------------------------------------------------------------------------------------------
@query("""SELECT DISTINCT document_id, content IS NULL OR LENGTH(TRIM(content)) < 30 OR LENGTH(REGEXP_REPLACE(content, '[^\\p{L}]', '', 'g')) < 18 OR (NOT CONTAINS(content, CHR(10)) AND LENGTH(TRIM(content)) < 45) AS noise FROM medical_documents""")
def flt02_noise_passages(spark, folder):
    text = F.trim("content")
    noise = F.col("content").isNull() | (F.length(text) < 30) | (F.length(F.regexp_replace("content", r"[^\p{L}]", "")) < 18) | (~F.contains("content", F.lit("\n")) & (F.length(text) < 45))
    return table(spark, folder, "medical_documents").select("document_id", noise.alias("noise")).distinct()


@query("SELECT doc_id, LENGTH(text) - LENGTH(TRANSLATE(text, '{}[]', '')) >= 6 AND LENGTH(text) < 800 AS noisy FROM documents")
def flt03_noisy_evidence(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ((F.length("text") - F.length(F.translate("text", "{}[]", "")) >= 6) & (F.length("text") < 800)).alias("noisy"))


@query("SELECT formula_id, REGEXP_MATCHES(expression, '[-+*/()]') AS formula FROM (SELECT DISTINCT formula_id, expression FROM formulas)")
def flt05_formula_like(spark, folder):
    return table(spark, folder, "formulas").select("formula_id", F.col("expression").rlike("[-+*/()]").alias("formula")).distinct()


@query("SELECT row_id FROM thresholds_extra WHERE sex IS NULL OR sex = 'female'")
def flt09_sex_applies(spark, folder):
    return _t(spark, folder).where("sex is null or sex = 'female'").select("row_id")


@query("""WITH h AS (SELECT DISTINCT source, LOWER(REGEXP_REPLACE(source, '[^a-zA-Z0-9]', '', 'g')) || '.health.org' AS host FROM documents) SELECT source, (host LIKE '%.health.org' OR host = 'health.org') AND NOT (host LIKE 'guideline%') AS allowed FROM h""")
def flt10_domain_policy(spark, folder):
    host = F.concat(F.lower(F.regexp_replace("source", "[^a-zA-Z0-9]", "")), F.lit(".health.org"))
    allow = F.exists(F.array(F.lit("health.org")), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return table(spark, folder, "documents").select("source", (allow & ~F.startswith(host, F.lit("guideline"))).alias("allowed")).distinct()


@query(f"SELECT id, {_sql_hint('k', {'kidney': ['than', 'acr', 'gfr', 'egfr', 'creatinin']})} IS NOT NULL AS kidney FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})")
def flt13_keyword_boundaries(spark, folder):
    folded = T.ascii_key_trimmed("query")
    tests = [P.keyword_in(folded, w) for w in ("than", "acr", "gfr", "egfr", "creatinin")]
    return _qa(spark, folder).select("id", F.coalesce(tests[0] | tests[1] | tests[2] | tests[3] | tests[4], F.lit(False)).alias("kidney"))


@query("""SELECT DISTINCT document_id, COALESCE(line <> '' AND LENGTH(line) <= 120 AND l > 0 AND u > 0.7::DOUBLE * l, FALSE) AS title FROM (SELECT document_id, line, LENGTH(REGEXP_REPLACE(line, '[^\\p{L}]', '', 'g')) AS l, LENGTH(REGEXP_REPLACE(line, '[^\\p{Lu}]', '', 'g')) AS u
    FROM (SELECT document_id, COALESCE(LIST_FILTER(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY(content, '\\r?\\n'), lambda x: TRIM(x)), lambda x: x <> '')[1], TRIM(content)) AS line FROM medical_documents))""")
def flt23_uppercase_title(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", F.coalesce(P.uppercase_title(P.primary_line(F.col("content"))), F.lit(False)).alias("title")).distinct()


# Generators -------------------------------------------------------------------------------------------------------
@query()
def gen02_heading_blocks(spark, folder):
    d = table(spark, folder, "medical_documents").select("document_id", "content").distinct()
    return d.select("document_id", F.posexplode(P.blocks(F.col("content"))).alias("pos", "block"))


@query("""WITH s AS (SELECT DISTINCT document_id, content FROM medical_documents), marked AS (SELECT document_id, REGEXP_REPLACE(content, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || CHR(30), 'g') AS m FROM s),
    parts AS (SELECT document_id, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(m, CHR(30)), lambda x: TRIM(REGEXP_REPLACE(x, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g'))), lambda x: LENGTH(x) >= 20) AS p FROM marked)
    SELECT document_id, LEN(p) AS n, p[1] AS first_sentence FROM parts""")
def gen05_sentences(spark, folder):
    s = P.sentences(F.col("content"))
    d = table(spark, folder, "medical_documents").select("document_id", "content").distinct()
    return d.select("document_id", F.size(s).cast("long").alias("n"), F.try_element_at(s, F.lit(1)).alias("first_sentence"))


@query("""WITH s AS (SELECT id, TRIM(REGEXP_REPLACE(reference_answer, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')) AS t FROM """ + _QA + """), m AS (SELECT id, REGEXP_REPLACE(REGEXP_REPLACE(t, '([.!?。]) +', '\\1' || CHR(30), 'g'), '; +', CHR(30), 'g') AS m FROM s)
    SELECT id, ARRAY_TO_STRING((LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(m, CHR(30)), lambda x: REGEXP_REPLACE(x, '^[ \\-•]+|[ \\-•]+$', '', 'g')), lambda x: LENGTH(x) >= 18))[1:8], '|') AS facts FROM m""")
def gen15_required_facts(spark, folder):
    return _qa(spark, folder).select("id", F.array_join(P.facts(F.col("reference_answer")), "|").alias("facts"))


@query("SELECT DISTINCT id, i - 1 AS pos, f[i] AS fact FROM (SELECT id, required_facts AS f, UNNEST(RANGE(1, CAST(LEN(required_facts) AS BIGINT) + 1)) AS i FROM threshold_qa)")
def gen17_case_explode(spark, folder):
    return table(spark, folder, "threshold_qa").select("id", F.posexplode("required_facts").alias("pos", "fact")).select("id", F.col("pos").cast("long").alias("pos"), "fact").distinct()


# Projections ------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT document_id, COALESCE(metadata.disease_name, 'unknown') || '_p' || metadata.page || '_' || LPAD(CAST(metadata.chunk_index AS VARCHAR), 3, '0') AS chunk_id FROM medical_documents WHERE metadata.page IS NOT NULL AND metadata.chunk_index IS NOT NULL")
def prj03_chunk_id(spark, folder):
    m = table(spark, folder, "medical_documents").where("metadata.page is not null and metadata.chunk_index is not null")
    return m.select("document_id", F.format_string("%s_p%d_%03d", F.coalesce("metadata.disease_name", F.lit("unknown")), "metadata.page", "metadata.chunk_index").alias("chunk_id")).distinct()


@query("SELECT row_id, COALESCE(disease_name, 'unknown') || '_' || REPLACE(REPLACE(REPLACE(threshold_op, '<', 'lt'), '>', 'gt'), '=', 'eq') || '_p' || COALESCE(CAST(page AS VARCHAR), '0') || '_' || LPAD(CAST(row_id % 1000 AS VARCHAR), 3, '0') AS made FROM thresholds_extra")
def prj04_threshold_id(spark, folder):
    sign = F.replace(F.replace(F.replace("threshold_op", F.lit("<"), F.lit("lt")), F.lit(">"), F.lit("gt")), F.lit("="), F.lit("eq"))
    return _t(spark, folder).select("row_id", F.concat(F.coalesce("disease_name", F.lit("unknown")), F.lit("_"), sign, F.lit("_p"), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit("_"), F.lpad((F.col("row_id") % 1000).cast("string"), 3, "0")).alias("made"))


@query("SELECT row_id, CONCAT_WS(CHR(10), 'Biomarker: ' || biomarker, 'Disease: ' || disease_name, 'Section: ' || section_type, source_text) AS embedding_text FROM thresholds_extra")
def prj06_threshold_document(spark, folder):
    part = lambda label, c: F.concat(F.lit(label), c)
    return _t(spark, folder).select("row_id", F.concat_ws("\n", part("Biomarker: ", "biomarker"), part("Disease: ", "disease_name"), part("Section: ", "section_type"), "source_text").alias("embedding_text"))


@query("SELECT DISTINCT formula_id, 'Formula ' || formula_name || ' = ' || expression || ' with ' || ARRAY_TO_STRING(LIST_FILTER(LIST_TRANSFORM(variables, lambda v: v.name), lambda x: x IS NOT NULL), ', ') AS sentence FROM formulas")
def prj07_formula_document(spark, folder):
    names = F.array_join(F.filter(F.transform("variables", lambda v: v["name"]), lambda x: x.isNotNull()), ", ")
    return table(spark, folder, "formulas").select("formula_id", F.concat(F.lit("Formula "), "formula_name", F.lit(" = "), "expression", F.lit(" with "), names).alias("sentence")).distinct()


@query("SELECT row_id, CASE WHEN threshold_value = FLOOR(threshold_value) THEN CAST(CAST(threshold_value AS BIGINT) AS VARCHAR) ELSE RTRIM(RTRIM(PRINTF('%.4f', threshold_value), '0'), '.') END AS shown FROM thresholds_extra WHERE threshold_value < 1000000000")
def prj14_number_format(spark, folder):
    v = F.col("threshold_value")
    short = F.rtrim(F.rtrim(F.format_string("%.4f", v), F.lit("0")), F.lit("."))
    return _t(spark, folder).where("threshold_value < 1000000000").select("row_id", F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(short).alias("shown"))


@query("SELECT row_id, CONCAT_WS('. ', biomarker, threshold_op, label, disease_name, source_text) AS content FROM thresholds_extra")
def prj18_corpus_content(spark, folder):
    return _t(spark, folder).select("row_id", F.concat_ws(". ", "biomarker", "threshold_op", "label", "disease_name", "source_text").alias("content"))


@query("SELECT ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT output_name)), ',') AS outputs, COUNT(DISTINCT formula_id) AS formulas FROM formulas")
def prj19_capabilities(spark, folder):
    return table(spark, folder, "formulas").agg(F.array_join(F.array_sort(F.collect_set("output_name")), ",").alias("outputs"), F.count_distinct("formula_id").alias("formulas"))
