"""Lab evaluation: rules, units, formulas and classes; structured documents; contract checks; evidence matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formula
from tessera.functions import text as T
from tessera.functions.vocab import CLASS_RULES, UNIT_ALIASES
from tessera.operators import rules as RU
from tessera.operators.blocks import shared_words
from tessera.operators.retrieval import best, content_tokens
from tessera.queries.search import sql_key, sql_tokens
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


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"


_RULES = "rules(biomarker, op, rule_value, low, high, rule_unit, label, disease) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in CLASS_RULES) + ")"
_UNIT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in UNIT_ALIASES.items())
_M = f"""m AS (SELECT DISTINCT CAST(result_id AS VARCHAR) AS request_id, x.name AS biomarker, x.value AS value, NULLIF(CASE TRIM(x.unit) {_UNIT} ELSE CASE REPLACE(TRIM(x.unit), ' ', '') {_UNIT} ELSE TRIM(x.unit) END END, '') AS unit, disease_name AS asked
    FROM (SELECT DISTINCT result_id, disease_name, output_summary.detected_measurements AS d FROM medical_tools_audit_report) s, UNNEST(s.d) AS u(x) WHERE x.value IS NOT NULL)"""
_EVALUATED = f"""{_RULES}, {_M}, scoped AS (SELECT m.*, EXISTS (SELECT 1 FROM rules r WHERE r.biomarker = m.biomarker AND r.disease = m.asked) AS scoped FROM m),
    pairs AS (SELECT s.*, r.op, r.rule_value, r.low, r.high, r.rule_unit, r.label, r.disease, CASE WHEN s.unit IS NULL OR r.rule_unit IS NULL OR s.unit = r.rule_unit THEN s.value WHEN s.unit = 'g/dL' AND r.rule_unit = 'g/L' THEN s.value * 10 WHEN s.unit = 'g/L' AND r.rule_unit = 'g/dL' THEN s.value / 10 END AS c
        FROM scoped s JOIN rules r ON r.biomarker = s.biomarker WHERE NOT s.scoped OR r.disease IS NULL OR r.disease = s.asked),
    evaluated AS (SELECT DISTINCT request_id, biomarker, value, op, rule_value, low, high, rule_unit, label, disease,
        COALESCE(CASE op WHEN '>' THEN c > rule_value WHEN '>=' THEN c >= rule_value WHEN '<' THEN c < rule_value WHEN '<=' THEN c <= rule_value WHEN 'between' THEN COALESCE(low, rule_value) <= c AND c < high END, FALSE) AS matched FROM pairs WHERE c IS NOT NULL)"""


def _measurements(spark, folder):
    a = table(spark, folder, "medical_tools_audit_report").select("result_id", "disease_name", F.col("output_summary.detected_measurements").alias("d")).distinct()
    x = a.select(F.col("result_id").cast("string").alias("request_id"), F.col("disease_name").alias("disease"), F.explode("d").alias("x"))
    return x.where("x.value is not null").select("request_id", F.col("x.name").alias("biomarker"), "x.value", "x.unit", "disease")


@query(f"WITH {_EVALUATED} SELECT * FROM evaluated")
def joi01_threshold_join(spark, folder):
    return RU.evaluate_rules(_measurements(spark, folder), RU.rule_table(spark, CLASS_RULES))


@query(f"WITH {_EVALUATED} SELECT biomarker, label, matched, COUNT(*) AS n FROM evaluated GROUP BY ALL")
def joi02_scope_fallback_counts(spark, folder):
    return RU.evaluate_rules(_measurements(spark, folder), RU.rule_table(spark, CLASS_RULES)).groupBy("biomarker", "label", "matched").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EVALUATED} SELECT request_id, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT biomarker || '=' || label)), ',') AS classes FROM evaluated WHERE matched GROUP BY request_id")
def num05_classes(spark, folder):
    e = RU.evaluate_rules(_measurements(spark, folder), RU.rule_table(spark, CLASS_RULES)).where("matched")
    return e.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("biomarker", F.lit("="), "label"))), ",").alias("classes"))


@query(f"WITH {_M} SELECT request_id, biomarker, unit, CASE WHEN unit = 'g/dL' THEN value * 10 WHEN unit = 'g/L' OR unit IS NULL THEN value END AS in_g_l FROM m WHERE biomarker = 'albumin_máu'")
def joi03_unit_conversion(spark, folder):
    m = _measurements(spark, folder).where("biomarker = 'albumin_máu'").select("request_id", "biomarker", "value", RU.unit_alias(F.col("unit")).alias("unit")).distinct()
    return m.select("request_id", "biomarker", "unit", RU.in_rule_unit(F.col("value"), F.col("unit"), F.lit("g/L")).alias("in_g_l")).distinct()


_EVENT = "e AS (SELECT event_id, 0.3 + value / 100 AS cr, 20 + user_id % 60 AS age, user_id % 2 = 0 AS female, user_id % 7 = 0 AS black, 45 + user_id % 50 AS weight, 145 + user_id % 45 AS height FROM events WHERE value IS NOT NULL)"


def _patients(spark, folder):
    e = table(spark, folder, "events").where("value is not null")
    u = F.col("user_id")
    return e.select("event_id", (0.3 + F.col("value") / 100).alias("cr"), (20 + u % 60).alias("age"), (u % 2 == 0).alias("female"), (u % 7 == 0).alias("black"), (45 + u % 50).alias("weight"), (145 + u % 45).alias("height"))


def _formulas():
    return RU.formula_columns(F.col("cr"), F.col("age"), F.col("female"), F.col("black"), F.col("weight"), F.col("height"))


@query(f"""WITH {_EVENT}, k AS (SELECT *, CASE WHEN female THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS kappa, CASE WHEN female THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END AS alpha FROM e)
    SELECT event_id, ROUND(142 * POW(LEAST(cr / kappa, 1), alpha) * POW(GREATEST(cr / kappa, 1), -1.2::DOUBLE) * POW(0.9938::DOUBLE, age) * CASE WHEN female THEN 1.012::DOUBLE ELSE 1 END, 4) AS ckd_epi,
        ROUND(186 * POW(cr, -1.154::DOUBLE) * POW(age, -0.203::DOUBLE) * CASE WHEN female THEN 0.742::DOUBLE ELSE 1 END * CASE WHEN black THEN 1.21::DOUBLE ELSE 1 END, 4) AS mdrd,
        ROUND((140 - age) * weight / (72 * cr) * CASE WHEN female THEN 0.85::DOUBLE ELSE 1 END, 4) AS cockcroft, ROUND(POW(weight * height / 3600.0::DOUBLE, 0.5::DOUBLE), 4) AS bsa FROM k""")
def num01_renal_formulas(spark, folder):
    f = _formulas()
    return _patients(spark, folder).select("event_id", f["ckd_epi_2021_creatinine"].alias("ckd_epi"), f["mdrd_gfr"].alias("mdrd"), f["cockcroft_gault"].alias("cockcroft"), f["body_surface_area"].alias("bsa"))


@query(f"""WITH {_EVENT}, g AS (SELECT event_id, ROUND(186 * POW(cr, -1.154::DOUBLE) * POW(age, -0.203::DOUBLE) * CASE WHEN female THEN 0.742::DOUBLE ELSE 1 END * CASE WHEN black THEN 1.21::DOUBLE ELSE 1 END, 4) AS gfr FROM e), {_RULES}
    SELECT event_id, label FROM g JOIN rules ON biomarker = 'GFR' AND disease IS NULL AND CASE op WHEN '>=' THEN gfr >= rule_value WHEN '<' THEN gfr < rule_value WHEN 'between' THEN gfr >= low AND gfr < high END""")
def num04_derived_then_classified(spark, folder):
    gfr = _patients(spark, folder).select(F.col("event_id").cast("string").alias("request_id"), F.lit("GFR").alias("biomarker"), _formulas()["mdrd_gfr"].alias("value"), F.lit("ml/ph/1.73m2").alias("unit"), F.lit(None).cast("string").alias("disease"))
    rules = RU.rule_table(spark, [r for r in CLASS_RULES if r[0] == "GFR" and r[7] is None])
    return RU.evaluate_rules(gfr, rules).where("matched").select(F.col("request_id").cast("long").alias("event_id"), "label")


@query("SELECT DISTINCT formula_id, CASE WHEN LEN(LIST_FILTER(variables, lambda v: v IS NOT NULL AND v.name IS NOT NULL)) > 0 THEN 'has' ELSE 'none' END AS variables, REGEXP_MATCHES(expression, '[*]{2}') AS powers FROM formulas")
def num02_formula_shapes(spark, folder):
    known = F.filter("variables", lambda v: v.isNotNull() & v["name"].isNotNull())
    return table(spark, folder, "formulas").select("formula_id", F.when(F.size(known) > 0, "has").otherwise("none").alias("variables"), F.col("expression").rlike("[*]{2}").alias("powers")).distinct()


@query()
def udf01_formulas_as_data(spark, folder):
    """Every formula row evaluated from its own expression, its declared variables set to 2, 3, 4 ... in order."""
    f = table(spark, folder, "formulas").select("formula_id", "expression", "variables").distinct()
    names = F.array_distinct(F.filter(F.transform(F.coalesce("variables", F.array()), lambda v: v["name"]), lambda n: n.isNotNull()))
    values = F.map_from_arrays(names, F.transform(names, lambda n, i: (i + 2).cast("double")))
    return formula.evaluate_rows(f.withColumn("values", values), "formula_id", "expression", "values").select(F.col("id").alias("formula_id"), F.round("value", 4).alias("value"), "status", F.array_join("missing", ",").alias("missing"))


# Structured documents ---------------------------------------------------------------------------------------------
_ASKED = "kali mau creatinin huyet ap blood pressure serum potassium"


@query(f"""WITH d AS (SELECT DISTINCT document_id, content FROM medical_documents WHERE content IS NOT NULL), s AS (SELECT document_id, LEN(LIST_INTERSECT({sql_tokens(f"'{_ASKED}'")}, {sql_tokens('content', 100000)}))::DOUBLE / LEN({sql_tokens(f"'{_ASKED}'")}) AS overlap FROM d)
    SELECT document_id, ROUND(overlap, 6) AS score FROM s WHERE overlap > 0 ORDER BY score DESC, document_id LIMIT 30""")
def top08_structured_overlap(spark, folder):
    d = table(spark, folder, "medical_documents").where("content is not null").select("document_id", "content").distinct()
    asked = content_tokens(F.lit(_ASKED))
    scored = d.select("document_id", F.round(F.size(F.array_intersect(asked, content_tokens(F.col("content"), 100000))) / F.size(asked), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "document_id").limit(30)


@query("""WITH d AS (SELECT DISTINCT document_id, LOWER(content) AS t FROM medical_documents WHERE content IS NOT NULL) SELECT document_id, ROUND((CASE WHEN CONTAINS(t, 'kali máu') THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN CONTAINS(t, 'serum potassium') THEN 0.25::DOUBLE ELSE 0 END)
    + (CASE WHEN CONTAINS(t, 'gfr') THEN 0.12::DOUBLE ELSE 0 END) + (CASE WHEN CONTAINS(t, 'acr') THEN 0.12::DOUBLE ELSE 0 END), 6) AS boost FROM d""")
def ret12_phrase_boost(spark, folder):
    d = table(spark, folder, "medical_documents").where("content is not null").select("document_id", F.lower("content").alias("t")).distinct()
    part = lambda w, p: F.when(F.contains("t", F.lit(w)), p).otherwise(0.0)
    return d.select("document_id", F.round(part("kali máu", 0.25) + part("serum potassium", 0.25) + part("gfr", 0.12) + part("acr", 0.12), 6).alias("boost"))


@query("""WITH hits AS (SELECT 'threshold' AS kind, threshold_id AS document_id, page / 1000.0::DOUBLE AS score FROM thresholds_extra WHERE page IS NOT NULL UNION ALL SELECT 'formula', formula_id, page / 900.0::DOUBLE FROM formulas WHERE page IS NOT NULL)
    SELECT document_id, ROUND(MAX(score), 6) AS score FROM hits GROUP BY document_id""")
def joi14_union_by_max_score(spark, folder):
    t = table(spark, folder, "thresholds_extra").where("page is not null").select(F.col("threshold_id").alias("document_id"), (F.col("page") / 1000.0).alias("score"))
    f = table(spark, folder, "formulas").where("page is not null").select(F.col("formula_id").alias("document_id"), (F.col("page") / 900.0).alias("score"))
    return t.unionByName(f).groupBy("document_id").agg(F.round(F.max("score"), 6).alias("score"))


# Contract checks and evidence -------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT DISTINCT id, expected, LOWER(COALESCE(reference_answer, '')) AS a FROM threshold_qa) SELECT id, expected.min_answer_chars IS NULL OR LENGTH(a) >= expected.min_answer_chars AS long_enough,
    expected.must_include_any IS NULL OR LEN(expected.must_include_any) = 0 OR LEN(LIST_FILTER(expected.must_include_any, lambda x: CONTAINS(a, LOWER(x)))) > 0 AS includes_any,
    LEN(LIST_FILTER(COALESCE(expected.must_not_include_any, []), lambda x: CONTAINS(a, LOWER(x)))) = 0 AS excludes FROM q""")
def udf07_contract_checks(spark, folder):
    q = table(spark, folder, "threshold_qa").select("id", "expected", F.lower(F.coalesce("reference_answer", F.lit(""))).alias("a")).distinct()
    hit = lambda words: F.size(F.filter(words, lambda x: F.contains(F.col("a"), F.lower(x))))
    any_of, least = F.col("expected.must_include_any"), F.col("expected.min_answer_chars")
    return q.select(
        "id",
        (least.isNull() | (F.length("a") >= least)).alias("long_enough"),
        (any_of.isNull() | (F.size(any_of) == 0) | (hit(any_of) > 0)).alias("includes_any"),
        (hit(F.coalesce("expected.must_not_include_any", F.array())) == 0).alias("excludes"),
    )


@query(f"""WITH facts AS (SELECT DISTINCT q.id, f, {sql_tokens('f', 1000)} AS ts FROM (SELECT DISTINCT id, required_facts FROM threshold_qa) q, UNNEST(q.required_facts) AS u(f) WHERE f IS NOT NULL),
    words AS (SELECT DISTINCT document_id, UNNEST({sql_tokens('content', 100000)}) AS w FROM medical_documents WHERE source_type = 'formula'),
    shared AS (SELECT id, f, document_id, COUNT(*) AS n, MAX(LEN(ts)) AS total FROM (SELECT id, f, ts, UNNEST(ts) AS w FROM facts) JOIN words USING (w) GROUP BY ALL),
    scored AS (SELECT id, document_id, MAX(ROUND(n::DOUBLE / total, 6)) AS score FROM shared GROUP BY ALL)
    SELECT id, document_id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY score DESC, document_id) AS rank FROM scored WHERE score >= 0.12) WHERE rank <= 3""")
def joi15_evidence_match(spark, folder):
    """Facts of the cases against formula passages by shared tokens. Facts with the same tokens are looked for once; the best three
    passages of a case are among the best three of its facts."""
    qa = table(spark, folder, "threshold_qa").select("id", "required_facts").distinct().select("id", F.explode("required_facts").alias("f")).where("f is not null")
    facts = qa.select("id", "f", content_tokens(F.col("f"), 1000).alias("ts")).distinct()
    docs = table(spark, folder, "medical_documents").where("source_type = 'formula'")
    facts = facts.select("id", F.array_join("ts", " ").alias("query_id"), F.size("ts").alias("total")).distinct()
    passages = docs.select(F.col("document_id").alias("id"), content_tokens(F.col("content"), 100000).alias("words"))
    shared = shared_words(facts.select("query_id", F.split("query_id", " ").alias("words")).distinct(), passages, 3)
    shared = facts.join(shared.select("query_id", F.col("id").alias("document_id"), "score"), "query_id")
    scored = shared.groupBy("id", "document_id").agg(F.max(F.round(F.col("score") / F.col("total"), 6)).alias("score")).where("score >= 0.12")
    return best(scored, "id", [F.desc("score"), F.col("document_id")], 3)


@query(f"""WITH cases AS (SELECT DISTINCT id, query FROM threshold_qa), n AS (SELECT {sql_key('biomarker')} AS k, biomarker_id FROM biomarker_reference)
    SELECT c.id, COUNT(n.k) AS named FROM cases c LEFT JOIN n ON CONTAINS({sql_key('c.query')}, n.k) GROUP BY c.id""")
def joi17_enrichment(spark, folder):
    """Cases with the number of reference entries they name; cases without one stay, with zero."""
    cases = table(spark, folder, "threshold_qa").select("id", T.ascii_key_trimmed("query").alias("q")).distinct()
    names = broadcast_if_small(table(spark, folder, "biomarker_reference").select(T.ascii_key_trimmed("biomarker").alias("k")))
    return cases.join(names, F.contains("q", F.col("k")), "left").groupBy("id").agg(F.count("k").alias("named"))
