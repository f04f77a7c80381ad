"""Sources, sinks, JSON salvage, streaming forms and the remaining query-planning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import passages as P
from tessera.functions import salvage
from tessera.functions import text as T
from tessera.functions.vocab import DISEASE_HINTS
from tessera.operators import retrieval as R
from tessera.queries.search import _INDEX, sql_distinct, sql_key, sql_terms, sql_tokens
from tessera.queries.strings import _QA, _qa, _sql_hint
from tessera.sources import files
from tessera.session import table
from tessera.streaming import memory

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Sources and sinks ------------------------------------------------------------------------------------------------
_T = "row_id, threshold_id, biomarker, threshold_op, threshold_value, source_text"
_T_SCHEMA = "row_id long, threshold_id string, biomarker string, threshold_op string, threshold_value double, source_text string"


@query(f"SELECT {_T} FROM thresholds_extra")
def src03_jsonl_round_trip(spark, folder):
    path = files.scratch(spark, "thresholds")
    files.write_jsonl(table(spark, folder, "thresholds_extra").select(*_T.split(", ")), path)
    return files.read_jsonl(spark, path, _T_SCHEMA)


@query("SELECT DISTINCT formula_id, expression, LEN(variables) AS variables FROM formulas")
def src06_nested_json(spark, folder):
    path = files.scratch(spark, "formulas")
    f = table(spark, folder, "formulas").select("formula_id", "expression", "variables").distinct()
    files.write_jsonl(f, path)
    back = files.read_jsonl(spark, path, f.schema)
    return back.select("formula_id", "expression", F.when(F.col("variables").isNotNull(), F.size("variables").cast("long")).alias("variables"))


@query("SELECT biomarker, COUNT(*) AS n FROM thresholds_extra WHERE threshold_op IN ('<', '>=') GROUP BY biomarker")
def src07_multi_file_union(spark, folder):
    base, extra = files.scratch(spark, "base"), files.scratch(spark, "extra")
    t = table(spark, folder, "thresholds_extra").select(*_T.split(", "))
    files.write_jsonl(t.where("threshold_op = '<'"), base)
    files.write_jsonl(t.where("threshold_op = '>='").drop("source_text"), extra)
    union = files.read_jsonl(spark, base, _T_SCHEMA).unionByName(files.read_jsonl(spark, extra, _T_SCHEMA), allowMissingColumns=True)
    return union.groupBy("biomarker").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'threshold' AS kind, COUNT(*) AS n, CAST(SUM(LENGTH(source_text)) AS BIGINT) AS characters FROM thresholds_extra UNION ALL SELECT source_type, COUNT(*), CAST(SUM(LENGTH(content)) AS BIGINT) FROM (SELECT DISTINCT document_id, source_type, content FROM medical_documents) GROUP BY source_type")
def src10_source_corpus(spark, folder):
    t = table(spark, folder, "thresholds_extra").select(F.lit("threshold").alias("kind"), F.col("source_text").alias("text"))
    first = t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))
    m = table(spark, folder, "medical_documents").select("document_id", F.col("source_type").alias("kind"), F.col("content").alias("text")).distinct()
    return first.unionByName(m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters")))


@query("SELECT threshold_id, ARG_MAX(label, row_id) AS label FROM thresholds_extra WHERE threshold_id IS NOT NULL AND label IS NOT NULL GROUP BY threshold_id")
def src11_keyed_catalog(spark, folder):
    t = table(spark, folder, "thresholds_extra").where("threshold_id is not null and label is not null")
    return t.groupBy("threshold_id").agg(F.max_by("label", "row_id").alias("label"))


@query("""WITH old AS (SELECT row_id, threshold_id, label FROM thresholds_extra WHERE row_id % 3 <> 0 AND threshold_id IS NOT NULL), new AS (SELECT threshold_id, ARG_MAX(row_id, row_id) AS row_id, ARG_MAX(COALESCE(label, ''), row_id) AS label FROM thresholds_extra WHERE row_id % 3 = 0 AND threshold_id IS NOT NULL GROUP BY threshold_id)
    SELECT row_id, threshold_id, COALESCE(label, '') AS label FROM old WHERE threshold_id NOT IN (SELECT threshold_id FROM new) UNION ALL SELECT row_id, threshold_id, label FROM new""")
def snk04_upsert(spark, folder):
    t = table(spark, folder, "thresholds_extra").where("threshold_id is not null").select("row_id", "threshold_id", F.coalesce("label", F.lit("")).alias("label"))
    return files.upsert(t.where("row_id % 3 <> 0"), t.where("row_id % 3 = 0"), "threshold_id", "row_id").select("row_id", "threshold_id", "label")


@query(f"WITH {_INDEX} SELECT id, term, tf FROM idx")
def snk06_postings_round_trip(spark, folder):
    path = files.scratch(spark, "postings")
    files.save_postings(R.postings(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")), path)
    return spark.read.parquet(path).select("id", "term", "tf")


@query("SELECT source_id, CASE WHEN source_id IN (SELECT threshold_id FROM thresholds_extra WHERE threshold_id IS NOT NULL) THEN 'update' ELSE 'create' END AS action FROM (SELECT DISTINCT source_id FROM medical_documents WHERE source_type = 'threshold' AND source_id IS NOT NULL)")
def snk07_sync_plan(spark, folder):
    existing = table(spark, folder, "thresholds_extra").select(F.col("threshold_id").alias("source_id"))
    incoming = table(spark, folder, "medical_documents").where("source_type = 'threshold' and source_id is not null").select("source_id").distinct()
    return files.sync_plan(existing, incoming, "source_id")


@query("""SELECT 'report' AS name, STRING_AGG('- ' || section_type || ': ' || n, CHR(10) ORDER BY section_type) AS body FROM (SELECT section_type, COUNT(*) AS n FROM thresholds_extra WHERE section_type IS NOT NULL GROUP BY section_type)""")
def snk08_markdown_report(spark, folder):
    n = table(spark, folder, "thresholds_extra").where("section_type is not null").groupBy("section_type").agg(F.count(F.lit(1)).alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section_type", "n"))), lambda x: F.concat(F.lit("- "), x["section_type"], F.lit(": "), x["n"].cast("string")))
    return n.agg(F.array_join(lines, "\n").alias("body")).select(F.lit("report").alias("name"), "body")


# JSON salvage -----------------------------------------------------------------------------------------------------
_FLAT = "flat AS (SELECT doc_id, REGEXP_EXTRACT_ALL(text, '\\{\"biomarker\": \"[^\"{}]*\", \"value\": [0-9.]+\\}') AS o FROM documents WHERE CONTAINS(text, '{'))"


@query(f"WITH {_FLAT} SELECT doc_id AS id, JSON_EXTRACT_STRING(x, '$.biomarker') AS biomarker, CAST(JSON_EXTRACT_STRING(x, '$.value') AS DOUBLE) AS value FROM flat, UNNEST(flat.o) AS u(x)")
def gen08_json_objects(spark, folder):
    """Objects with a biomarker inside the documents' running text."""
    found = salvage.extract_objects(table(spark, folder, "documents"), "doc_id", "text")
    picked = found.select("id", F.get_json_object("object", "$.biomarker").alias("biomarker"), F.get_json_object("object", "$.value").cast("double").alias("value"))
    return picked.where("biomarker is not null and value is not null")


@query()
def gen13_flattened_facts(spark, folder):
    return salvage.extract_objects(table(spark, folder, "documents"), "doc_id", "text").select("id", "pos", "facts")


@query("SELECT doc_id, ARRAY_TO_STRING(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '\\n'), lambda x: NOT REGEXP_MATCHES(TRIM(x), '^([{\\[]|\"[^\"]+\"[ \\t]*:)')), CHR(10)) AS prose FROM documents WHERE text IS NOT NULL")
def gen01_without_json_lines(spark, folder):
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.trim(x).rlike(r'^([{\[]|"[^"]+"[ \t]*:)'))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.array_join(kept, "\n").alias("prose"))


@query("SELECT doc_id, REPLACE(REPLACE(REPLACE(REGEXP_REPLACE(x, '<[^>]*>', '', 'g'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS item FROM (SELECT doc_id, REGEXP_EXTRACT_ALL(text, '<li>[^<]*</li>') AS l FROM documents) s, UNNEST(s.l) AS u(x)")
def txt22_html_items(spark, folder):
    items = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("<li>[^<]*</li>"), F.lit(0))).alias("x"))
    text = F.regexp_replace("x", "<[^>]*>", "")
    for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return items.select("doc_id", text.alias("item"))


@query("SELECT doc_id, JSON_EXTRACT_STRING(REGEXP_EXTRACT(line, '\\{.*\\}'), '$.biomarker') AS biomarker FROM (SELECT doc_id, REGEXP_EXTRACT(text, '(\\{\"biomarker\"[^\\n]*\\})', 1) AS line FROM documents) WHERE line <> ''")
def txt29_object_from_text(spark, folder):
    line = F.regexp_extract("text", r'(\{"biomarker"[^\n]*\})', 1)
    d = table(spark, folder, "documents").select("doc_id", line.alias("line")).where("line <> ''")
    return d.select("doc_id", F.get_json_object(F.regexp_extract("line", r"\{.*\}", 0), "$.biomarker").alias("biomarker"))


# Streaming --------------------------------------------------------------------------------------------------------
@query("SELECT DATE_TRUNC('day', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def str01_windowed_counts(spark, folder):
    """Daily counts by a stream over the event files, run to their end; the late bound exceeds the data's disorder."""
    static = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source, sink, state = (files.scratch(spark, x) for x in ("events", "counts", "state"))
    static.write.parquet(source)
    stream = spark.readStream.schema(static.schema).parquet(source)
    counted = memory.windowed_counts(stream, "ts", "event_type", "1 day", "36500 days").select("start", "event_type", "n")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(sink)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT user_id, ARG_MAX(event_type, event_id) AS event_type, MAX(event_id) AS event_id FROM events GROUP BY user_id")
def str04_incremental_upsert(spark, folder):
    static = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    source, target, state = (files.scratch(spark, x) for x in ("events", "users", "state"))
    static.write.parquet(source)
    memory.incremental_upsert(spark.readStream.schema(static.schema).parquet(source), target, "user_id", "event_id", state).awaitTermination()
    return memory.current_table(spark, target, "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id AS conv_id, MAX(event_id) AS turn, RIGHT(STRING_AGG('Q: ' || event_type || ' A: ' || CAST(event_id AS VARCHAR), ' | ' ORDER BY event_id), 600) AS summary FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def str02_rolling_memory(spark, folder):
    """The rolling notes of each conversation after its last turn, kept as the stream's state."""
    turns = table(spark, folder, "events").where("user_id is not null").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("question"), F.col("event_id").cast("string").alias("answer"))
    source, sink, state = (files.scratch(spark, x) for x in ("turns", "notes", "state"))
    turns.write.parquet(source)
    notes = memory.rolling_memory(spark.readStream.schema(turns.schema).parquet(source))

    def keep(batch, number):
        batch.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("summary", "turn").alias("summary")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    notes.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("summary", "turn").alias("summary"))


# Planning ---------------------------------------------------------------------------------------------------------
@query(f"""SELECT id, ARRAY_TO_STRING(({sql_distinct("ps")})[1:16], '|') AS patterns FROM (SELECT id, LIST_FILTER(LIST_CONCAT([SUBSTRING({sql_key('query')}, 1, 140)], LIST_TRANSFORM(RANGE(1, GREATEST(1, LEN(ts[1:8]))), lambda i: ts[i] || ' ' || ts[i + 1])), lambda x: LENGTH(x) >= 3) AS ps
    FROM (SELECT id, query, {sql_tokens('query', 8)} AS ts FROM {_QA}))""")
def ret06_lexical_patterns(spark, folder):
    """The folded question and the bigrams of its first eight tokens, up to 16 patterns of three characters or more."""
    ts = R.content_tokens(F.col("query"), 8)
    pairs = F.zip_with(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))), F.slice(ts, 2, F.greatest(F.size(ts), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    every = F.filter(F.concat(F.array(F.substring(T.ascii_key_trimmed("query"), 1, 140)), F.filter(pairs, lambda x: x.isNotNull())), lambda x: F.length(x) >= 3)
    return _qa(spark, folder).select("id", F.array_join(F.slice(F.array_distinct(every), 1, 16), "|").alias("patterns"))


_CONFIDENCE = "ROUND(LEAST(0.95::DOUBLE, 0.68::DOUBLE + 0.06::DOUBLE * LEN(STRING_SPLIT(a, ' ')) + 0.006::DOUBLE * LEAST(LENGTH(a), 18)), 3)"
_ALIASES = "aliases(d, o, a) AS (VALUES " + ", ".join(f"('{d}', {o}, '{a}')" for o, (d, words) in enumerate(DISEASE_HINTS.items()) for a in words) + ")"


@query(f"""WITH {_ALIASES}, q AS (SELECT id, {sql_key('query')} AS k FROM {_QA}), hits AS (SELECT id, d, {_CONFIDENCE} AS c FROM q JOIN aliases ON CASE WHEN CONTAINS(a, ' ') OR LENGTH(a) > 4 THEN CONTAINS(k, a) ELSE REGEXP_MATCHES(k, '(^|[^a-z0-9])' || a || '([^a-z0-9]|$)') END)
    SELECT id, d AS disease, MAX(c) AS confidence FROM hits GROUP BY id, d""")
def ret20_alias_candidates(spark, folder):
    """Diseases a question may be about, with the confidence of the best alias."""
    aliases = spark.createDataFrame([(d, a) for d, words in DISEASE_HINTS.items() for a in words], "disease string, a string")
    q = _qa(spark, folder).select("id", T.ascii_key_trimmed("query").alias("k"))
    long = F.contains("a", F.lit(" ")) | (F.length("a") > 4)
    bounded = F.regexp_like("k", F.concat(F.lit("(^|[^a-z0-9])"), "a", F.lit("([^a-z0-9]|$)")))
    hits = q.join(F.broadcast(aliases), F.when(long, F.contains("k", F.col("a"))).otherwise(bounded))
    confidence = F.round(F.least(F.lit(0.95), 0.68 + 0.06 * F.size(F.split("a", " ")) + 0.006 * F.least(F.length("a"), F.lit(18))), 3)
    return hits.groupBy("id", "disease").agg(F.max(confidence).alias("confidence"))


@query(f"""WITH {_ALIASES}, q AS (SELECT id, {sql_key('query')} AS k FROM {_QA}), hits AS (SELECT id, d, MAX({_CONFIDENCE}) AS c FROM q JOIN aliases ON CASE WHEN CONTAINS(a, ' ') OR LENGTH(a) > 4 THEN CONTAINS(k, a) ELSE REGEXP_MATCHES(k, '(^|[^a-z0-9])' || a || '([^a-z0-9]|$)') END GROUP BY id, d),
    ranked AS (SELECT *, ROW_NUMBER() OVER w AS r, LEAD(c) OVER w AS n FROM hits WINDOW w AS (PARTITION BY id ORDER BY c DESC, d)) SELECT id, d AS disease, c >= 0.86::DOUBLE AND ROUND(c - COALESCE(n, 0), 3) >= 0.12::DOUBLE AS hard FROM ranked WHERE r = 1""")
def top11_hard_pick(spark, folder):
    """The top candidate of each question, hard if it is confident and well ahead of the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("confidence"), "disease")
    ranked = ret20_alias_candidates(spark, folder).select("id", "disease", "confidence", F.row_number().over(w).alias("r"), F.lead("confidence").over(w).alias("n"))
    hard = (F.col("confidence") >= 0.86) & (F.round(F.col("confidence") - F.coalesce("n", F.lit(0.0)), 3) >= 0.12)
    return ranked.where("r = 1").select("id", "disease", hard.alias("hard"))


@query(f"""SELECT id, CASE WHEN {_sql_hint('k', {'y': ['fena', 'phan suat', 'cockcroft', 'mdrd', 'bsa', 'cong thuc']})} IS NOT NULL THEN 'formula' WHEN REGEXP_MATCHES(k, '[0-9]') THEN 'threshold' ELSE 'structured' END AS route FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})""")
def ret23_route(spark, folder):
    k = T.ascii_key_trimmed("query")
    formula = [P.keyword_in(k, w) for w in ("fena", "phan suat", "cockcroft", "mdrd", "bsa", "cong thuc")]
    any_formula = formula[0] | formula[1] | formula[2] | formula[3] | formula[4] | formula[5]
    return _qa(spark, folder).select("id", F.when(any_formula, "formula").when(k.rlike("[0-9]"), "threshold").otherwise("structured").alias("route"))


@query(f"""SELECT id, CAST(NULLIF(REPLACE(REGEXP_EXTRACT(k, '(?:^|[^a-z0-9])(?:creatinin mau|serum creatinine|creatinin|creatinine)[ ]*(?:=|:|la|level of|of)?[ ]*([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.'), '') AS DOUBLE) AS creatinine FROM (SELECT id, {sql_key('query')} AS k FROM {_QA})""")
def txt16_measurement(spark, folder):
    """The creatinine value a question states after one of its names, the longest name first."""
    k = T.ascii_key_trimmed("query")
    found = F.regexp_extract(k, r"(?:^|[^a-z0-9])(?:creatinin mau|serum creatinine|creatinin|creatinine)[ ]*(?:=|:|la|level of|of)?[ ]*([0-9]+(?:[.,][0-9]+)?)", 1)
    return _qa(spark, folder).select("id", T.to_double(F.when(found != "", found)).alias("creatinine"))


@query(f"SELECT id, LEN({sql_terms('query')}) AS terms, LENGTH(query) AS characters, REGEXP_MATCHES(query, '[0-9]') AS numeric_ FROM {_QA}")
def ret01_query_profile(spark, folder):
    return _qa(spark, folder).select("id", F.size(R.terms(F.col("query"))).cast("long").alias("terms"), F.length("query").cast("long").alias("characters"), F.col("query").rlike("[0-9]").alias("numeric_"))
