"""Whole forms of operators of which other modules hold reduced ones: filters with optional arguments, keyword and domain lists,
recursive walks, many-pattern rules, candidates with rows instead of counts."""

from __future__ import annotations

from html.parser import HTMLParser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tessera.functions import passages as P
from tessera.functions import salvage
from tessera.functions import text as T
from tessera.operators import blocks as K
from tessera.operators import retrieval as R
from tessera.queries.search import _ASKED, _INDEX, _bm25, _nearest, _passages, _queries, _vectors, sql_key, sql_tokens
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


def _t(spark, folder):
    return table(spark, folder, "thresholds_extra")


def _qa(spark, folder):
    return table(spark, folder, "threshold_qa")


def _docs(spark, folder):
    return table(spark, folder, "medical_documents").select("document_id", "source_type", "source_id", "content", "metadata").distinct()


_SPACE = "[ \\t\\n\\x0B\\f\\r\\x{A0}]+"


# Filters ----------------------------------------------------------------------------------------------------------
def metadata_filter(**wanted: str | None) -> Column:
    """Conjunction of equalities; an argument that is None filters nothing. Catalyst pushes what is left into the scan."""
    condition = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            condition = condition & (F.col(column) == value)
    return condition


@query("SELECT 'both' AS request, row_id FROM thresholds_extra WHERE language = 'vi' AND section_type = 'diagnosis' UNION ALL SELECT 'one', row_id FROM thresholds_extra WHERE section_type = 'treatment' UNION ALL SELECT 'none', row_id FROM thresholds_extra")
def flt01_optional_filters(spark, folder):
    """Three requests with two, one and no argument given."""
    t = _t(spark, folder)
    requests = {"both": {"language": "vi", "section_type": "diagnosis"}, "one": {"language": None, "section_type": "treatment"}, "none": {"language": None, "section_type": None}}
    parts = [t.where(metadata_filter(**wanted)).select(F.lit(name).alias("request"), "row_id") for name, wanted in requests.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH q AS (SELECT DISTINCT id, LOWER(query) AS q FROM threshold_qa), k AS (SELECT id, CONTAINS(q, 'fena') AS must, LIST_FILTER(['natri', 'kali', 'creatinin', 'albumin', 'protein', 'hemoglobin', 'fena'], lambda w: CONTAINS(q, w)) AS ws FROM q),
    f AS (SELECT DISTINCT id, UNNEST(required_facts) AS f FROM threshold_qa) SELECT f.id, f.f AS fact, LEN(LIST_FILTER(ws, lambda w: CONTAINS(LOWER(f), w))) > 0 AND (NOT must OR CONTAINS(LOWER(f), 'fena')) AS kept FROM f JOIN k USING (id) WHERE f IS NOT NULL""")
def flt04_tool_evidence(spark, folder):
    """Facts kept as evidence of a question: any of its keywords, and FENa where the question has it."""
    q = F.lower("query")
    words = F.filter(F.array(*map(F.lit, ("natri", "kali", "creatinin", "albumin", "protein", "hemoglobin", "fena"))), lambda w: F.contains(q, w))
    k = _qa(spark, folder).select("id", F.explode("required_facts").alias("fact"), words.alias("ws"), F.contains(q, F.lit("fena")).alias("must")).where("fact is not null").distinct()
    low = F.lower("fact")
    return k.select("id", "fact", (F.exists("ws", lambda w: F.contains(low, w)) & (~F.col("must") | F.contains(low, F.lit("fena")))).alias("kept"))


_ALLOW, _BLOCK = ("leaflet", "guideline", "lecture", "org"), ("ward", "qa.org")


@query("""SELECT doc_id, h AS host, (h = 'leaflet' OR h LIKE '%.leaflet' OR h = 'guideline' OR h LIKE '%.guideline' OR h = 'lecture' OR h LIKE '%.lecture' OR h = 'org' OR h LIKE '%.org') AND NOT (h = 'ward' OR h LIKE '%.ward' OR h = 'qa.org' OR h LIKE '%.qa.org') AS allowed
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'www.' || SPLIT_PART(source, '_', 1) WHEN doc_id % 3 = 1 THEN SPLIT_PART(source, '_', 1) || '.org' ELSE SPLIT_PART(source, '_', 1) END AS h FROM documents WHERE source IS NOT NULL)""")
def flt10_domain_lists(spark, folder):
    """Hosts allowed by a list and not blocked by another; an entry stands for its subdomains, a block wins."""
    name = F.element_at(F.split("source", "_"), 1)
    host = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("www."), name)).when(F.col("doc_id") % 3 == 1, F.concat(name, F.lit(".org"))).otherwise(name)
    d = table(spark, folder, "documents").where("source is not null").select("doc_id", host.alias("host"))
    on = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: (F.col("host") == n) | F.endswith("host", F.concat(F.lit("."), n)))
    return d.select("doc_id", "host", (on(_ALLOW) & ~on(_BLOCK)).alias("allowed"))


_STRUCTURED, _GRAPH, _JOINERS = ("bang", "phan loai", "giai doan", "tieu chuan", "stage", "table"), ("so do", "luu do", "quy trinh", "flow", "graph"), (" va ", " hoac ", ";", " and ", " so sanh ")


def _any_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"CONTAINS(k, '{w}')" for w in words) + ")"


@query(f"""SELECT id, {_any_sql(_STRUCTURED)} AS structured, {_any_sql(_GRAPH)} AS graph, LEN(LIST_FILTER({list(_JOINERS)}, lambda w: CONTAINS(k, w))) >= 1 AND LENGTH(k) >= 40 AS several FROM (SELECT DISTINCT id, {sql_key("COALESCE(query, '')")} AS k FROM threshold_qa)""")
def flt16_query_kinds(spark, folder):
    """Whether a question asks for a table, for a graph, and for several things."""
    q = _qa(spark, folder).select("id", T.ascii_key_trimmed(F.coalesce("query", F.lit(""))).alias("k")).distinct()
    hits = F.size(F.filter(F.array(*map(F.lit, _JOINERS)), lambda w: F.contains("k", w)))
    return q.select("id", P.any_contains(F.col("k"), list(_STRUCTURED)).alias("structured"), P.any_contains(F.col("k"), list(_GRAPH)).alias("graph"), ((hits >= 1) & (F.length("k") >= 40)).alias("several"))


def holds_null(column: Column, kind: DataType) -> Column:
    """Whether a value of any type is null or holds a null at any depth; the walk is over the schema, so it is one expression."""
    test = column.isNull()
    if isinstance(kind, StructType):
        for field in kind.fields:
            test = test | holds_null(column[field.name], field.dataType)
    elif isinstance(kind, ArrayType):
        test = test | F.exists(column, lambda x: holds_null(x, kind.elementType))
    return F.coalesce(test, F.lit(True))


@query("""SELECT DISTINCT result_id, checks IS NULL OR LEN(LIST_FILTER(checks, lambda c: c IS NULL OR c.name IS NULL OR c.passed IS NULL OR c.detail IS NULL)) > 0 AS checks_null,
    output_summary IS NULL OR output_summary.classifications IS NULL OR LEN(LIST_FILTER(output_summary.classifications, lambda c: c IS NULL OR c.biomarker IS NULL OR c.label IS NULL)) > 0 AS classes_null FROM medical_tools_audit_report""")
def flt22_nulls_at_any_depth(spark, folder):
    a = table(spark, folder, "medical_tools_audit_report")
    classes = a.schema["output_summary"].dataType["classifications"].dataType
    return a.select("result_id", holds_null(F.col("checks"), a.schema["checks"].dataType).alias("checks_null"), holds_null(F.col("output_summary.classifications"), classes).alias("classes_null")).distinct()


@query(f"""SELECT row_id, l AS line, LENGTH(l) <= 220 AND REGEXP_MATCHES(l, '^([0-9]+([.][0-9]+)*[.)]?|[IVX]+[.)]|[A-Z][.)])[ ]+[^ ]') AS heading,
    LENGTH(l) <= 120 AND LENGTH(u) >= 3 AND LENGTH(REGEXP_REPLACE(l, '[^\\p{{Lu}}]', '', 'g'))::DOUBLE / GREATEST(1, LENGTH(u)) > 0.7::DOUBLE AS title FROM (SELECT row_id, l, REGEXP_REPLACE(l, '[^\\p{{L}}]', '', 'g') AS u FROM (SELECT row_id, TRIM(REGEXP_REPLACE(STRING_SPLIT(source_text, CHR(10))[1], '{_SPACE}', ' ', 'g')) AS l FROM thresholds_extra WHERE source_text IS NOT NULL))""")
def flt23_headings(spark, folder):
    """Whether the first line of a text is a numbered heading, and whether it is a title in capital letters."""
    line = T.collapse_spaces(F.element_at(F.split("source_text", "\n"), 1))
    t = _t(spark, folder).where("source_text is not null").select("row_id", line.alias("line"))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    heading = (F.length("line") <= 220) & F.col("line").rlike(r"^([0-9]+([.][0-9]+)*[.)]?|[IVX]+[.)]|[A-Z][.)])[ ]+[^ ]")
    return t.select("row_id", "line", heading.alias("heading"), ((F.length("line") <= 120) & (letters >= 3) & (upper / F.greatest(letters, F.lit(1)) > 0.7)).alias("title"))


_DISEASES = ("benh than man", "ton thuong than cap", "hoi chung than hu", "viem cau than", "benh than iga", "lupus")


@query(f"""SELECT DISTINCT document_id, COALESCE(REGEXP_MATCHES(k, '^(phan|chuong|bai|muc|chapter|part|section) [0-9ivx]+'), FALSE) AS resets, COALESCE(LENGTH(k) <= 200 AND {_any_sql(_DISEASES)} OR {" OR ".join(f"STARTS_WITH(k, '{d}')" for d in _DISEASES)}, FALSE) AS anchors
    FROM (SELECT document_id, {sql_key('content')} AS k FROM medical_documents)""")
def flt24_resets_and_anchors(spark, folder):
    """Passages that end the context of a disease, and short or leading mentions that begin one."""
    d = _docs(spark, folder).select("document_id", T.ascii_key_trimmed("content").alias("k"))
    leads = F.exists(F.array(*map(F.lit, _DISEASES)), lambda x: F.startswith("k", x))
    anchors = ((F.length("k") <= 200) & P.any_contains(F.col("k"), list(_DISEASES))) | leads
    return d.select("document_id", F.coalesce(F.col("k").rlike("^(phan|chuong|bai|muc|chapter|part|section) [0-9ivx]+"), F.lit(False)).alias("resets"), F.coalesce(anchors, F.lit(False)).alias("anchors")).distinct()


# Splitting and salvage ---------------------------------------------------------------------------------------------
@query("""SELECT doc_id, x AS value FROM (SELECT doc_id, REGEXP_EXTRACT_ALL(text, '"(?:text|biomarker)"[ ]*:[ ]*"([^"\\\\]*)"', 1) AS l FROM documents) s, UNNEST(s.l) AS u(x)""")
def gen06_text_values(spark, folder):
    """Values of the keys asked for, a row each."""
    found = F.regexp_extract_all("text", F.lit(r'"(?:text|biomarker)"[ ]*:[ ]*"([^"\\]*)"'), F.lit(1))
    return table(spark, folder, "documents").select("doc_id", F.explode(found).alias("value"))


@query()
def gen09_marked_blocks(spark, folder):
    """Objects after a marker, a row each; here the marker is put before the objects of the documents."""
    d = table(spark, folder, "documents").where(F.contains("text", F.lit("{"))).select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"\{", "Data  metadata:\n{").alias("text"))
    return salvage.marked_objects(d)


@query()
def gen12_flat_lines(spark, folder):
    """Objects in the documents as ``key: value`` parts joined by bars."""
    return salvage.extract_objects(table(spark, folder, "documents"), "doc_id", "text").select("id", "pos", F.array_join(F.transform(F.split("facts", r" \| "), lambda f: F.regexp_replace(f, r"^[^:]*\.", "")), " | ").alias("line"))


@query(f"""WITH s AS (SELECT DISTINCT id, TRIM(REGEXP_REPLACE(reference_answer, '{_SPACE}', ' ', 'g')) AS t FROM threshold_qa WHERE reference_answer IS NOT NULL),
    p AS (SELECT id, x, MIN(i) AS i FROM (SELECT id, UNNEST(l) AS x, UNNEST(RANGE(LEN(l))) AS i FROM (SELECT id, LIST_CONCAT([t], LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(REGEXP_REPLACE(t, '([.!?]) +', '\\1' || CHR(30), 'g'), '; *', CHR(30), 'g'), CHR(30)), lambda x: TRIM(x))) AS l FROM s)) WHERE LENGTH(x) >= 18 GROUP BY id, x)
    SELECT id, part FROM (SELECT id, x AS part, ROW_NUMBER() OVER (PARTITION BY id ORDER BY i) AS r FROM p) WHERE r <= 12""")
def gen14_parts(spark, folder):
    """The parts of each answer that evidence is matched with: the whole and its sentences of 18 characters or more, each once, the first twelve."""
    t = T.collapse_spaces("reference_answer")
    parts = F.filter(F.concat(F.array(t), F.transform(F.split(t, r"(?<=[.!?]) +|; *"), F.trim)), lambda x: F.length(x) >= 18)
    return _qa(spark, folder).where("reference_answer is not null").select("id", F.explode(F.slice(F.array_distinct(parts), 1, 12)).alias("part")).distinct()


class _Visible(HTMLParser):
    """Text outside of elements that are not shown."""

    HIDDEN = ("script", "style", "noscript", "svg")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str | None) -> str | None:
    """Shown text of a page, parts joined by one space, white space collapsed; null stays null."""
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


@query()
def txt22_visible_text(spark, folder):
    """Shown text of the documents that are HTML pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [visible_text(t) for t in batch["text"]]
            yield batch

    pages = table(spark, folder, "documents").where(F.col("text").rlike("<[a-z]+[ >]")).select("doc_id", "text")
    return pages.mapInPandas(run, "doc_id long, text string")


@query()
def txt29_object_of_answer(spark, folder):
    """The object in a model's answer: fences off, from the first brace to the last, repaired where it needs to be."""
    d = table(spark, folder, "documents").where(F.contains("text", F.lit("{"))).select("doc_id", F.concat(F.lit("Here it is:\n```json\n"), "text", F.lit("\n```")).alias("answer"))
    body = F.regexp_extract(F.regexp_replace("answer", "```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    fixed = salvage.repaired_column(body)
    known = F.coalesce(F.get_json_object(body, "$.biomarker"), F.get_json_object(fixed, "$.biomarker"))
    return d.select("doc_id", known.alias("biomarker"), F.get_json_object(fixed, "$.value").cast("double").alias("value"))


@query("SELECT DISTINCT id, REPLACE(REPLACE(REPLACE(query, '\\n', ' '), '\\\"', '\"'), '\\t', ' ') AS plain FROM threshold_qa WHERE query IS NOT NULL")
def txt28_unescape_with_fallback(spark, folder):
    """JSON strings unescaped; one that is no JSON string has its escapes replaced."""
    q = _qa(spark, folder).where("query is not null").select("id", "query").distinct()
    parsed = F.from_json(F.concat(F.lit('["'), F.replace("query", F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>")[0]
    fallback = F.replace(F.replace(F.replace("query", F.lit("\\n"), F.lit(" ")), F.lit('\\"'), F.lit('"')), F.lit("\\t"), F.lit(" "))
    return q.select("id", F.coalesce(parsed, fallback).alias("plain"))


# Text rules -------------------------------------------------------------------------------------------------------
#: Fixed values: (quantity, pattern before the value, with accents folded).
RULES = [
    ("hemoglobin", "(?:huyet sac to|haemoglobin|hemoglobin|hb)"), ("potassium", "(?:kali mau|serum potassium|k[+])"), ("creatinine", "(?:creatinin mau|serum creatinine)"), ("sodium", "(?:natri mau|serum sodium|na[+])"), ("calcium", "(?:canxi toan phan|canxi mau|total calcium|serum calcium)"),
    ("albumin", "(?:albumin huyet thanh|serum albumin|albumin mau)"), ("GFR", "(?:muc loc cau than|glomerular filtration rate|e?gfr)"), ("ACR", "(?:ty le albumin creatinin nieu|urine albumin to creatinine ratio|acr)"), ("uric_acid", "(?:acid uric mau|serum uric acid|serum urate)"),
    ("ferritin", "(?:ferritin huyet thanh|serum ferritin|ferritin)"), ("PTH", "(?:hormon tuyen can giap|parathyroid hormone|pth)"), ("urea", "(?:ure mau|blood urea|serum urea)"), ("glucose", "(?:duong huyet luc doi|fasting plasma glucose)"),
]


def _rule_sql(name: str, pattern: str) -> str:
    whole = f"(?:^|[^a-z0-9]){pattern} *(<=|>=|<|>) *([0-9]+(?:[.,][0-9]+)?)"
    return f"SELECT row_id, '{name}' AS biomarker, REGEXP_EXTRACT(k, '{whole}', 1) AS op, CAST(REPLACE(REGEXP_EXTRACT(k, '{whole}', 2), ',', '.') AS DOUBLE) AS value FROM k WHERE REGEXP_MATCHES(k, '{whole}')"


_FOLDED = f"k AS (SELECT row_id, REPLACE(REPLACE({sql_key('REPLACE(REPLACE(source_text, CHR(8804), CHR(60) || CHR(61)), CHR(8805), CHR(62) || CHR(61))')}, '< =', '<='), '> =', '>=') AS k FROM thresholds_extra WHERE source_text IS NOT NULL)"


def _folded(spark, folder):
    signs = F.replace(F.replace("source_text", F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    k = F.replace(F.replace(T.ascii_key_trimmed(signs), F.lit("< ="), F.lit("<=")), F.lit("> ="), F.lit(">="))
    return _t(spark, folder).where("source_text is not null").select("row_id", k.alias("k"))


@query(f"WITH {_FOLDED}, found AS (" + " UNION ALL ".join(_rule_sql(*r) for r in RULES) + ") SELECT row_id, biomarker, op, CASE WHEN biomarker = 'hemoglobin' AND value < 30 THEN ROUND(value * 10, 6) ELSE value END AS value FROM found")
def txt15_rule_table(spark, folder):
    """Thirteen rules of patterns applied in one pass over the texts; haemoglobin below 30 is meant in g/dL and times ten."""
    found = []
    for name, pattern in RULES:
        whole = rf"(?:^|[^a-z0-9]){pattern} *(<=|>=|<|>) *([0-9]+(?:[.,][0-9]+)?)"
        value = F.translate(F.regexp_extract("k", whole, 2), ",", ".").try_cast("double")
        found.append(F.struct(F.lit(name).alias("biomarker"), F.regexp_extract("k", whole, 1).alias("op"), (F.when(value < 30, F.round(value * 10, 6)).otherwise(value) if name == "hemoglobin" else value).alias("value")))
    return _folded(spark, folder).select("row_id", F.inline(F.filter(F.array(*found), lambda x: x["value"].isNotNull())))


@query(f"""WITH {_FOLDED}, n AS (SELECT biomarker, {sql_key('name_vi')} AS a FROM biomarker_reference UNION SELECT biomarker, {sql_key('name_en')} FROM biomarker_reference), hits AS (SELECT k.row_id, n.biomarker, STRPOS(k.k, n.a) AS p, LENGTH(n.a) AS l, STRPOS(REGEXP_REPLACE(k.k, '(<=|>=|<|>)', CHR(1)), CHR(1)) AS sg FROM k JOIN n ON LENGTH(n.a) >= 3 AND CONTAINS(k.k, n.a))
    SELECT row_id, ARG_MAX(biomarker, STRUCT_PACK(e := p + l, l := l, b := biomarker)) AS biomarker FROM hits WHERE sg > 0 AND p + l <= sg GROUP BY row_id""")
def txt10_biomarker_before_sign(spark, folder):
    """The reference quantity whose name ends last before the first comparison sign of a text, of several the longest name.

    Each text is read once in an Arrow batch with all names, which are the bounded reference list.
    """
    r = table(spark, folder, "biomarker_reference")
    names = r.select("biomarker", T.ascii_key_trimmed("name_vi").alias("a")).unionByName(r.select("biomarker", T.ascii_key_trimmed("name_en").alias("a"))).where("length(a) >= 3").distinct()
    known = [(x[1], x[0]) for x in names.collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["k"]:
                sign = min((p for p in (text.find("<"), text.find(">")) if p >= 0), default=-1)
                places = ((p + len(a), len(a), b) for a, b in known if (p := text.find(a)) >= 0 and p + len(a) <= sign)
                found.append(max(places, default=(0, 0, None))[2])
            yield pd.DataFrame({"row_id": batch["row_id"], "biomarker": found})

    return _folded(spark, folder).where(F.col("k").rlike("[<>]")).mapInPandas(run, "row_id long, biomarker string").where("biomarker is not null")


@query(f"""SELECT DISTINCT id, CASE WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(nu|female|woman)([^a-z0-9]|$)') THEN 'female' WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(nam|male|man)([^a-z0-9]|$)') THEN 'male' END AS sex,
    CASE WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(khong phai da den|non-black|white|asian)([^a-z0-9]|$)') THEN 'other' WHEN REGEXP_MATCHES(k, '(^|[^a-z0-9])(da den|black|african american)([^a-z0-9]|$)') THEN 'black' END AS race FROM (SELECT id, {sql_key('query')} AS k FROM threshold_qa)""")
def txt18_sex_and_race(spark, folder):
    k = T.ascii_key_trimmed("query")
    says = lambda words: F.coalesce(k.rlike(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"), F.lit(False))
    sex = F.when(says("nu|female|woman"), "female").when(says("nam|male|man"), "male")
    race = F.when(says("khong phai da den|non-black|white|asian"), "other").when(says("da den|black|african american"), "black")
    return _qa(spark, folder).select("id", sex.alias("sex"), race.alias("race")).distinct()


@query(f"""SELECT row_id, STRPOS(source_text, m) AS at, SUBSTRING(source_text, GREATEST(1, STRPOS(source_text, m) - 220), LEAST(220, STRPOS(source_text, m) - 1) + LENGTH(m) + 220) AS around FROM (SELECT row_id, source_text, REGEXP_EXTRACT(source_text, '(<=|>=|≤|≥|<|>)[ ]*[0-9]+', 0) AS m FROM thresholds_extra WHERE REGEXP_MATCHES(source_text, '(<=|>=|≤|≥|<|>)[ ]*[0-9]+'))""")
def win12_window_around_match(spark, folder):
    """220 characters before and after the first comparison of a text."""
    pattern = "(<=|>=|≤|≥|<|>)[ ]*[0-9]+"
    t = _t(spark, folder).where(F.col("source_text").rlike(pattern)).withColumn("m", F.regexp_extract("source_text", pattern, 0))
    at = F.position(F.col("m"), F.col("source_text"))
    return t.select("row_id", at.alias("at"), F.substring("source_text", F.greatest(F.lit(1), at - 220), F.least(F.lit(220), at - 1) + F.length("m") + 220).alias("around"))


@query(f"""WITH d AS (SELECT DISTINCT document_id, source_type, {sql_key('content')} AS k, metadata.content_type AS c FROM medical_documents) SELECT document_id, CASE WHEN source_type = 'formula' OR CONTAINS(k, 'cong thuc') OR CONTAINS(k, 'formula') THEN 'formula' WHEN source_type = 'threshold' OR REGEXP_MATCHES(k, '(<=|>=|<|>) *[0-9]') THEN 'threshold'
    WHEN CONTAINS(k, 'lieu') OR CONTAINS(k, 'thuoc') OR CONTAINS(k, 'mg/kg') OR CONTAINS(k, 'dose') THEN 'medication' ELSE 'disease_guideline' END AS doc_type FROM d""")
def prj02_cascade(spark, folder):
    """The kind of a passage by the first test that holds: formula, threshold, medication, guideline."""
    d = _docs(spark, folder).select("document_id", "source_type", F.coalesce(T.ascii_key_trimmed("content"), F.lit("")).alias("k"))
    kind = F.when((F.col("source_type") == "formula") | P.any_contains(F.col("k"), ["cong thuc", "formula"]), "formula").when((F.col("source_type") == "threshold") | F.col("k").rlike("(<=|>=|<|>) *[0-9]"), "threshold")
    return d.select("document_id", kind.when(P.any_contains(F.col("k"), ["lieu", "thuoc", "mg/kg", "dose"]), "medication").otherwise("disease_guideline").alias("doc_type")).distinct()


# Unions, joins, aggregates ----------------------------------------------------------------------------------------
@query("SELECT biomarker, threshold_op, threshold_value, MIN(row_id) AS row_id, COUNT(*) AS n FROM thresholds_extra GROUP BY biomarker, threshold_op, threshold_value")
def src07_all_files(spark, folder):
    """Rules of every operator written as files of their own, read as one table and each kept once."""
    from tessera.sources import files

    path, schema = files.scratch(spark, "rules"), "row_id long, biomarker string, threshold_op string, threshold_value double"
    _t(spark, folder).select("row_id", "biomarker", "threshold_op", "threshold_value").write.partitionBy("threshold_op").json(path)
    back = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return back.groupBy("biomarker", "threshold_op", "threshold_value").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT 'chunk' AS kind, document_id AS id, content AS text FROM medical_documents UNION ALL SELECT 'threshold', 'row::' || row_id, source_text FROM thresholds_extra UNION ALL SELECT DISTINCT 'formula', formula_id, source_text FROM formulas""")
def src10_corpus_rows(spark, folder):
    """Passages, rules and formulas as one corpus."""
    a = table(spark, folder, "medical_documents").select(F.lit("chunk").alias("kind"), F.col("document_id").alias("id"), F.col("content").alias("text")).distinct()
    b = _t(spark, folder).select(F.lit("threshold").alias("kind"), F.concat(F.lit("row::"), F.col("row_id").cast("string")).alias("id"), F.col("source_text").alias("text"))
    c = table(spark, folder, "formulas").select(F.lit("formula").alias("kind"), F.col("formula_id").alias("id"), F.col("source_text").alias("text")).distinct()
    return a.unionByName(b).unionByName(c)


@query("SELECT row_id, biomarker, threshold_value AS low, threshold_value_max AS high, sex FROM thresholds_extra WHERE threshold_op = 'between' UNION ALL SELECT row_id, biomarker, threshold_value, NULL, NULL FROM thresholds_extra WHERE threshold_op <> 'between'")
def set02_ranges_and_bounds(spark, folder):
    """Ranges and single bounds in one table; columns that one side lacks are null."""
    t = _t(spark, folder)
    ranges = t.where("threshold_op = 'between'").select("row_id", "biomarker", F.col("threshold_value").alias("low"), F.col("threshold_value_max").alias("high"), "sex")
    return ranges.unionByName(t.where("threshold_op <> 'between'").select("row_id", "biomarker", F.col("threshold_value").alias("low")), allowMissingColumns=True)


@query("""SELECT t.row_id FROM thresholds_extra t WHERE t.extraction_method IS DISTINCT FROM 'rule_block' AND NOT EXISTS (SELECT 1 FROM thresholds_extra b WHERE b.extraction_method = 'rule_block' AND b.biomarker IS NOT DISTINCT FROM t.biomarker AND b.threshold_op IS NOT DISTINCT FROM t.threshold_op AND b.threshold_value IS NOT DISTINCT FROM t.threshold_value
    AND b.threshold_value_min IS NOT DISTINCT FROM t.threshold_value_min AND b.threshold_value_max IS NOT DISTINCT FROM t.threshold_value_max AND b.threshold_unit IS NOT DISTINCT FROM t.threshold_unit AND b.label IS NOT DISTINCT FROM t.label AND b.disease_name IS NOT DISTINCT FROM t.disease_name AND b.severity IS NOT DISTINCT FROM t.severity AND SUBSTRING(LOWER(b.source_text), 1, 120) IS NOT DISTINCT FROM SUBSTRING(LOWER(t.source_text), 1, 120))""")
def joi12_ten_part_anti_join(spark, folder):
    """Rules of other methods that the base list lacks, by all ten parts of the key; nulls are equal. The part of the text is
    the key's own definition."""
    key = ["biomarker", "threshold_op", "threshold_value", "threshold_value_min", "threshold_value_max", "threshold_unit", "label", "disease_name", "severity", "head"]
    t = _t(spark, folder).withColumn("head", F.substring(F.lower("source_text"), 1, 120))
    regex = F.coalesce(F.col("extraction_method") == "rule_block", F.lit(False))
    base = t.where(regex).select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    extra = t.where(~regex).select("row_id", *key)
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return extra.join(base, condition, "left_anti").select("row_id")


@query("""SELECT section_type, STRING_AGG(document_id, ',' ORDER BY document_id) AS sample, MAX(n) AS n FROM (SELECT section_type, document_id, ROW_NUMBER() OVER (PARTITION BY section_type ORDER BY document_id) AS r, COUNT(*) OVER (PARTITION BY section_type) AS n FROM (SELECT DISTINCT metadata.section_type AS section_type, document_id FROM medical_documents)) WHERE r <= 5 GROUP BY section_type""")
def agg02_samples(spark, folder):
    """The first five document ids of each section and the number of all."""
    d = table(spark, folder, "medical_documents").select("metadata.section_type", "document_id").distinct()
    counts = d.groupBy("section_type").agg(F.count(F.lit(1)).alias("n"))
    first = R.best(d, "section_type", [F.col("document_id")], 5).groupBy("section_type").agg(F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("sample"))
    return counts.alias("c").join(first.alias("f"), F.expr("c.section_type <=> f.section_type")).select("c.section_type", "sample", "n")


@query("""WITH s AS (SELECT event_type, user_id, AVG(value) AS m, COUNT(value) AS n FROM events GROUP BY ALL), w AS (SELECT event_type, SUM(m * n) / NULLIF(SUM(n) FILTER (n >= 2), 0) AS x, SUM(m * n) FILTER (n >= 2) / NULLIF(SUM(n) FILTER (n >= 2), 0) AS weighted FROM s GROUP BY event_type), r AS (SELECT event_type, AVG(value) AS plain FROM events GROUP BY event_type)
    SELECT event_type, ROUND(COALESCE(weighted, plain), 6) AS mean, weighted IS NULL AS fallback FROM w JOIN r USING (event_type)""")
def agg06_weighted_or_plain(spark, folder):
    """Means weighted by the sizes of groups of two and more; without such a group the mean of the rows."""
    e = table(spark, folder, "events").select("event_type", "user_id", "value")
    s = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.sum("value").alias("total"))
    big = F.col("n") >= 2
    w = s.groupBy("event_type").agg((F.sum(F.when(big, F.col("m") * F.col("n"))) / F.sum(F.when(big, F.col("n")))).alias("weighted"), (F.sum("total") / F.sum("n")).alias("plain"))
    return w.select("event_type", F.round(F.coalesce("weighted", "plain"), 6).alias("mean"), F.col("weighted").isNull().alias("fallback"))


@query("""SELECT k, MIN(row_id) AS row_id FROM (SELECT row_id, CASE WHEN threshold_id IS NOT NULL AND threshold_id <> '' AND row_id % 2 = 0 THEN threshold_id ELSE CONCAT_WS('|', COALESCE(biomarker, '~'), COALESCE(threshold_op, '~'), COALESCE(label, '~'), COALESCE(source_text, '~')) END AS k FROM thresholds_extra) GROUP BY k""")
def ded01_id_or_payload(spark, folder):
    """Rules once by their id; those without one (here every other row counts as such) by their whole payload."""
    known = lambda c: F.coalesce(c, F.lit("~"))
    payload = F.concat_ws("|", *(known(c) for c in ("biomarker", "threshold_op", "label", "source_text")))
    key = F.when(F.col("threshold_id").isNotNull() & (F.col("threshold_id") != "") & (F.col("row_id") % 2 == 0), F.col("threshold_id")).otherwise(payload)
    return _t(spark, folder).groupBy(key.alias("k")).agg(F.min("row_id").alias("row_id"))


@query("""SELECT id, STRING_AGG(f, CHR(10) ORDER BY p) AS contexts, COUNT(*) AS n FROM (SELECT id, TRIM(REGEXP_REPLACE(f, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')) AS f, MIN(p) AS p FROM (SELECT id, UNNEST(l) AS f, UNNEST(RANGE(LEN(l))) AS p FROM (SELECT DISTINCT id, LIST_CONCAT(required_facts, required_facts, [reference_answer]) AS l FROM threshold_qa WHERE required_facts IS NOT NULL)) WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY id""")
def ded11_unique_contexts(spark, folder):
    """Contexts of each case (its facts twice and its answer) once each, apart from white space, in order."""
    every = F.transform(F.concat("required_facts", "required_facts", F.array("reference_answer")), T.collapse_spaces)
    kept = F.array_distinct(F.filter(every, lambda x: x.isNotNull()))
    return _qa(spark, folder).where("required_facts is not null").select("id", F.array_join(kept, "\n").alias("contexts"), F.size(kept).alias("n")).where("n > 0").distinct()


_CHUNKED = "c AS (SELECT DISTINCT document_id, metadata.source_file AS f, metadata.page AS p, metadata.content_type AS ct, metadata.chunk_index AS i FROM medical_documents WHERE source_type = 'chunk' AND metadata.source_file IS NOT NULL)"


@query(f"WITH {_CHUNKED} SELECT document_id, ROW_NUMBER() OVER (PARTITION BY f, p ORDER BY CASE WHEN ct = 'table' THEN 1 ELSE 0 END, i NULLS FIRST, document_id) - 1 AS position FROM c")
def win06_prose_before_tables(spark, folder):
    """Positions within a page: structured chunks continue after the prose."""
    m = table(spark, folder, "medical_documents").where("source_type = 'chunk' and metadata.source_file is not null").select("document_id", F.col("metadata.source_file").alias("f"), F.col("metadata.page").alias("p"), F.col("metadata.content_type").alias("ct"), F.col("metadata.chunk_index").alias("i")).distinct()
    w = Window.partitionBy("f", "p").orderBy(F.when(F.col("ct") == "table", 1).otherwise(0), F.col("i").asc_nulls_first(), "document_id")
    return m.select("document_id", (F.row_number().over(w) - 1).alias("position"))


@query("""WITH p AS (SELECT source_file, page, STRING_AGG(source_text, CHR(10) ORDER BY row_id) AS t FROM thresholds_extra WHERE source_file IS NOT NULL AND page IS NOT NULL AND source_text IS NOT NULL GROUP BY ALL)
    SELECT a.source_file, a.page, LENGTH(RIGHT(COALESCE(b.t, ''), 2000)) + LENGTH(a.t) + LENGTH(LEFT(COALESCE(n.t, ''), 2000)) AS characters, MD5(RIGHT(COALESCE(b.t, ''), 2000) || a.t || LEFT(COALESCE(n.t, ''), 2000)) AS digest FROM p a LEFT JOIN p b ON b.source_file = a.source_file AND b.page = a.page - 1 LEFT JOIN p n ON n.source_file = a.source_file AND n.page = a.page + 1""")
def win04_pages_with_neighbours(spark, folder):
    """Each page with the last 2,000 characters of the page before and the first of the next, as its length and digest.

    Pages meet their neighbours by equi-joins on (file, page), so that no file has to be in one task.
    """
    t = _t(spark, folder).where("source_file is not null and page is not null and source_text is not null")
    p = t.groupBy("source_file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "source_text"))), lambda x: x["source_text"]), "\n").alias("t"))
    tail = p.select("source_file", (F.col("page") + 1).alias("page"), F.expr("right(t, 2000)").alias("before"))
    head = p.select("source_file", (F.col("page") - 1).alias("page"), F.expr("left(t, 2000)").alias("after"))
    both = p.join(tail, ["source_file", "page"], "left").join(head, ["source_file", "page"], "left")
    text = F.concat(F.coalesce("before", F.lit("")), "t", F.coalesce("after", F.lit("")))
    return both.select("source_file", "page", F.length(text).alias("characters"), F.md5(text).alias("digest"))


_LEX = f"""pats AS (SELECT query_id, UNNEST({sql_tokens("query", 12)}) AS p FROM queries), counted AS (SELECT query_id, doc_id AS id, COUNT(*) AS score FROM pats JOIN documents ON CONTAINS(LOWER(CONCAT_WS(CHR(10), text, source, source_file)), p) GROUP BY ALL),
    lex AS (SELECT query_id, id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM counted) WHERE rank <= 12)"""


@query(f"""WITH {_INDEX}, {_ASKED}, {_bm25("hits", "queries", 12)}, {_nearest("", 12)}, {_LEX}, every AS (SELECT query_id, id, 'v' AS b, rank FROM near UNION ALL SELECT query_id, id, 'k', rank FROM hits UNION ALL SELECT query_id, id, 'l', rank FROM lex),
    fused AS (SELECT query_id, id, MIN(rank) FILTER (b = 'v') AS vector_rank, MIN(rank) FILTER (b = 'k') AS keyword_rank, MIN(rank) FILTER (b = 'l') AS lexical_rank FROM every GROUP BY ALL),
    scored AS (SELECT *, ROUND(COALESCE(0.85::DOUBLE / (60 + vector_rank), 0) + COALESCE(1.0::DOUBLE / (60 + keyword_rank), 0) + COALESCE(1.15::DOUBLE / (60 + lexical_rank), 0), 9) AS rrf_score FROM fused)
    SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM scored) WHERE rank <= 10""")
def ret07_three_branches(spark, folder):
    """All three branches fused; patterns are looked for in text, source and file name."""
    queries, docs, v = _queries(spark, folder), table(spark, folder, "documents"), _vectors(spark, folder)
    vector = R.nearest(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), v, 12)
    fields = ["text", "source", "source_file"]
    lexical = K.pattern_search(queries.select("query_id", R.content_tokens(F.col("query"), 12).alias("patterns")), docs.select(F.col("doc_id").alias("id"), F.concat_ws("\n", *fields).alias("text")), 12)
    return R.fuse({"vector": vector, "keyword": K.bm25_search(queries, _passages(spark, folder), 12), "lexical": lexical}, top=10)
