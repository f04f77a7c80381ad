"""Search over passages: vectors, words, patterns, and the fusion of their rankings.

A search takes a set of queries and all passages. Lexical searches meet through an inverted index (an equi-join on terms),
vector searches block by block; each block keeps only its best hits before anything is shuffled. Ties break on ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_key_trimmed, fold_pairs
from tessera.functions.vocab import RETRIEVAL_STOPWORDS
from tessera.session import broadcast_if_small, checkpointed

K1, B, FLOOR = 1.5, 0.75, 0.01
RRF_K = 60
WEIGHTS = {"vector": 0.85, "keyword": 1.0, "lexical": 1.15}
QUERY_TOKENS = 32
#: Query terms up to which they are sent to every task of a search.
BROADCAST_TERMS = 200_000
BLOCK = 1024


def terms(text: Column) -> Column:
    """Search terms in order: folded runs of letters and digits, also joined by ``.``, ``/`` or ``-``, of two or more
    characters or digits only, without stop words."""
    found = F.regexp_extract_all(ascii_key_trimmed(text), F.lit(r"[a-z0-9]+(?:[./\-][a-z0-9]+)*"), F.lit(0))
    return F.filter(found, lambda t: ((F.length(t) >= 2) | t.rlike("^[0-9]+$")) & ~t.isin(RETRIEVAL_STOPWORDS))


def content_tokens(text: Column, limit: int = QUERY_TOKENS) -> Column:
    """Distinct tokens of three or more characters, without stop words, the first ``limit``."""
    found = F.regexp_extract_all(ascii_key_trimmed(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(RETRIEVAL_STOPWORDS))), 1, limit)


_TERM = re.compile(r"[a-z0-9]+(?:[./\-][a-z0-9]+)*")


def _folding() -> dict[int, str | None]:
    source, target = fold_pairs()
    return {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}


def postings(passages: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(term, id, tf, length, head): the inverted index; ``head`` marks one posting of each passage.

    The terms are those of :func:`terms`, counted text by text in Arrow batches, so that nothing is shuffled. Null texts and
    texts without terms have no postings. Passages are told apart by their rows: one that comes twice is indexed twice.
    """
    kind = dict(passages.dtypes)[id_column]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, stop = _folding(), frozenset(RETRIEVAL_STOPWORDS)
        for batch in batches:
            ids, lengths, found, counts = [], [], [], []
            for i, text in zip(batch["id"], batch["text"]):
                plain = text.lower() if text.isascii() else text.translate(fold).lower().encode("ascii", "ignore").decode("ascii")
                tf = Counter(t for t in _TERM.findall(plain) if (len(t) >= 2 or t.isdigit()) and t not in stop)
                if tf:
                    ids.append(i)
                    lengths.append(sum(tf.values()))
                    found.append(list(tf))
                    counts.append(list(tf.values()))
            yield pd.DataFrame({"id": ids, "length": lengths, "terms": found, "counts": counts})

    rows = passages.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    counted = rows.mapInPandas(count, f"id {kind}, length long, terms array<string>, counts array<long>")
    each = counted.select("id", "length", F.posexplode(F.arrays_zip("terms", "counts")).alias("place", "t"))
    return each.select(F.col("t.terms").alias("term"), "id", F.col("t.counts").alias("tf"), "length", (F.col("place") == 0).alias("head"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    """One row (documents, average_length) of an inverted index, by one partial aggregation."""
    return index.where("head").agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average_length"))


def term_weights(index: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): Okapi weights; negative ones become ``epsilon`` times the mean weight of all terms. The counts of the
    terms are written once, being read twice."""
    total = corpus_statistics(index)
    counted = checkpointed(index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).crossJoin(F.broadcast(total.select("documents")))
    raw = counted.select("term", "df", F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, score): Okapi BM25 of (query_id, query) over an inverted index, all passages with a term of the query.

    A term counts as often as the query has it among its first 32 terms. Queries without terms have no rows. The terms of the
    queries go to the index, which stays where it is, up to a checked number; beyond it both are sorted by term. The index is
    never the side that is sent, whatever its size is taken for.
    """
    wanted = queries.select("query_id", F.explode(F.slice(terms(F.col("query")), 1, QUERY_TOKENS)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    average = corpus_statistics(index).select("average_length")
    weighted = checkpointed(wanted.join(term_weights(index), "term"))
    few = weighted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = index.join(F.broadcast(weighted) if few else weighted.hint("merge"), "term").crossJoin(F.broadcast(average))
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average_length")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(queries: DataFrame, index: DataFrame, top: int = 15) -> DataFrame:
    """(query_id, id, score, rank): :func:`bm25_scores` without those below 0.01, the best ``top`` of each query."""
    return best(bm25_scores(queries, index).where(F.col("score") >= FLOOR), "query_id", [F.col("score").desc(), F.col("id")], top)


def best(df: DataFrame, key: str, order: Sequence[Column], top: int, rank: str = "rank") -> DataFrame:
    """The first ``top`` rows of each key; Spark keeps only those while shuffling (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= top)


def conjunctive(queries: DataFrame, index: DataFrame, top: int = 30) -> DataFrame:
    """(query_id, id, score, rank): passages with all terms of the query; the score is the sum of their frequencies."""
    wanted = queries.select("query_id", F.array_distinct(F.slice(terms(F.col("query")), 1, QUERY_TOKENS)).alias("terms")).where(F.size("terms") > 0)
    parts = wanted.select("query_id", F.size("terms").alias("needed"), F.explode("terms").alias("term"))
    hits = index.join(broadcast_if_small(parts, BROADCAST_TERMS), "term").groupBy("query_id", "needed", "id").agg(F.count(F.lit(1)).alias("met"), F.sum("tf").alias("score"))
    return best(hits.where("met = needed").select("query_id", "id", "score"), "query_id", [F.col("score").desc(), F.col("id")], top)


def pattern_hits(passages: DataFrame, patterns: DataFrame, fields: Sequence[str], top: int = 30) -> DataFrame:
    """(query_id, id, score, rank): number of a query's patterns that are found in any of the fields, case ignored.

    patterns: (query_id, patterns ARRAY), a stated set of queries. Up to a checked number they are sent to the passages;
    beyond it the planner pairs partitions of both. The passages are not shuffled before they are counted.
    """
    found = broadcast_if_small(patterns).select("query_id", F.transform("patterns", F.lower).alias("patterns"))
    text = F.lower(F.concat_ws("\n", *fields))
    counted = passages.withColumn("text_", text).crossJoin(found)
    counted = counted.select("query_id", "id", F.size(F.filter("patterns", lambda p: F.contains(F.col("text_"), p))).alias("score"))
    return best(counted.where("score > 0"), "query_id", [F.col("score").desc(), F.col("id")], top)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null where a length differs or a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    product = norm(a) * norm(b)
    return F.when(product > 0, dot / product)


def nearest(queries: DataFrame, vectors: DataFrame, top: int = 12, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): exact nearest neighbours by cosine.

    queries: (query_id, embedding); vectors: (id, embedding). Both are packed into blocks of bounded size; a pair of
    blocks is one matrix product that gives back only its best hits, and those are merged. Null and zero vectors have
    no neighbours; similarities are rounded to nine digits so that ties break on ids.
    """

    def packed(df: DataFrame, key: str, name: str, size: int) -> DataFrame:
        # Blocks form within partitions: a bounded number of rows each, whatever the ids' distribution.
        kind = dict(df.dtypes)[key]

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                good = batch[batch["embedding"].notna()]
                for i in range(0, len(good), size):
                    part = good.iloc[i : i + size]
                    yield pd.DataFrame({f"{name}_ids": [list(part[key])], f"{name}_vectors": [[list(map(float, v)) for v in part["embedding"]]]})

        return df.select(key, "embedding").mapInPandas(pack, f"{name}_ids array<{kind}>, {name}_vectors array<array<double>>")

    id_kind, query_kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qi, qv, vi, vv in zip(batch["q_ids"], batch["q_vectors"], batch["v_ids"], batch["v_vectors"]):
                q, v = np.array([list(x) for x in qv]), np.array([list(x) for x in vv])
                if not len(q) or not len(v) or q.shape[1] != v.shape[1]:
                    continue
                qn, vn = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(v, axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    similarity = np.round((q / qn) @ (v / vn).T, 9)
                ids = np.array(list(vi))
                for row, query_id in zip(similarity, qi):
                    fine = np.flatnonzero(np.isfinite(row))
                    order = fine[np.lexsort((ids[fine], -row[fine]))][:top]
                    yield pd.DataFrame({"query_id": query_id, "id": ids[order], "similarity": row[order]})

    pairs = packed(vectors, "id", "v", block).crossJoin(packed(queries, "query_id", "q", block))
    hits = pairs.mapInPandas(multiply, f"query_id {query_kind}, id {id_kind}, similarity double")
    return best(hits, "query_id", [F.col("similarity").desc(), F.col("id")], top)


def fuse(branches: Mapping[str, DataFrame], weights: Mapping[str, float] = WEIGHTS, top: int = 5, k: int = RRF_K) -> DataFrame:
    """(query_id, id, <branch>_rank ..., rrf_score, rank): weighted reciprocal rank fusion of ranked branches.

    Each branch has (query_id, id, rank). One union and one aggregation, instead of a chain of outer joins. A passage
    that a branch lacks has no part of it; equal scores are ordered by id.
    """
    union: DataFrame | None = None
    for name, branch in branches.items():
        rows = branch.select("query_id", "id", F.lit(name).alias("branch"), "rank")
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        raise ValueError("no branches")
    score = F.lit(0.0)
    ranks = []
    for name in branches:
        rank = F.min(F.when(F.col("branch") == name, F.col("rank")))
        ranks.append(rank.alias(f"{name}_rank"))
        score = score + F.coalesce(F.lit(float(weights[name])) / (k + rank), F.lit(0.0))
    fused = union.groupBy("query_id", "id").agg(*ranks, F.round(score, 9).alias("rrf_score"))
    return best(fused, "query_id", [F.col("rrf_score").desc(), F.col("id")], top)


def metadata_bonus(disease: Column, section: Column, biomarker: Column, disease_hint: Column, section_hint: Column, biomarker_hint: Column) -> Column:
    """0.08 for the disease, 0.10 for the section, 0.05 for the biomarker that the query hints at; a definition question
    also takes general passages, at 0.03."""
    part = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    return part(disease == disease_hint, 0.08) + part(section == section_hint, 0.10) + part((section_hint == "definition") & (section == "general"), 0.03) + part(biomarker == biomarker_hint, 0.05)


def lexical_bonus(tokens: Column, text_tokens: Column, numbers: Column, text: Column) -> Column:
    """Token overlap up to 0.10, numbers 0.02 each up to 0.06, together at most 0.22; six digits."""
    overlap = F.when(F.size(tokens) > 0, F.least(F.lit(0.10), F.size(F.array_intersect(tokens, text_tokens)) / F.size(tokens) * 0.10)).otherwise(0.0)
    shared = F.least(F.lit(0.06), F.size(F.filter(numbers, lambda n: F.contains(text, n))) * 0.02)
    return F.round(F.least(F.lit(0.22), overlap + shared), 6)


def neighbors(passages: DataFrame, hits: DataFrame, keys: Sequence[str], position: str, before: int = 1, after: int = 4, limit: int = 1800) -> DataFrame:
    """hits plus ``expanded``: texts of the passages around each hit, in order, joined by line feeds, cut at ``limit`` characters.

    Passages belong together by ``keys`` and lie at ``position``. The join is by equality of the keys and of a bucket of
    positions as wide as the window, so that a hot file is split among its buckets and a hit meets two of them; a passage
    that comes twice counts once. A hit always contains its own text; one without a position has no neighbours.
    """
    width = before + after + 1
    around = passages.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(position).alias("_position"), F.col("text").alias("_text")).where("_text is not null").distinct()
    around = around.withColumn("_bucket", F.floor(F.col("_position") / width))
    buckets = F.sequence(F.floor((F.col(position) - before) / width), F.floor((F.col(position) + after) / width))
    asked = hits.withColumn("_at", F.explode_outer(buckets))
    condition = (F.col("_at") == F.col("_bucket")) & F.col("_position").between(F.col(position) - before, F.col(position) + after)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = asked.join(around, condition, "left")
    texts = F.transform(F.array_sort(F.collect_set(F.when(F.col("_text").isNotNull(), F.struct("_position", "_text")))), lambda x: x["_text"])
    return joined.groupBy(*hits.columns).agg(F.substring(F.array_join(F.array_distinct(texts), "\n"), 1, limit).alias("expanded"))


def evidence_grade(token_hits: Column, term_hits: Column, meta_hits: Column, score: Column) -> Column:
    """min(.35, .055 tokens) + min(.30, .10 terms) + min(.15, .05 metadata) + min(.20, score), six digits."""
    parts = F.least(F.lit(0.35), token_hits * 0.055) + F.least(F.lit(0.30), term_hits * 0.10) + F.least(F.lit(0.15), meta_hits * 0.05) + F.least(F.lit(0.20), F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)))
    return F.round(parts, 6)


def sufficient(has_evidence: Column, tool: Column, coverage: Column, term_hits: Column, top_score: Column) -> Column:
    """Evidence and one of: a tool result, coverage of 0.34, two terms, a score of 0.12."""
    return has_evidence & (F.coalesce(tool, F.lit(False)) | (coverage >= 0.34) | (term_hits >= 2) | (F.coalesce(top_score, F.lit(0.0)) >= 0.12))


def merge_by_score(*lists: DataFrame, top: int) -> DataFrame:
    """(query_id, id, score, rank): union of scored lists, each passage with its best score, the best ``top`` per query."""
    union = lists[0].select("query_id", "id", "score")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "id", "score"))
    return best(union.groupBy("query_id", "id").agg(F.max("score").alias("score")), "query_id", [F.col("score").desc(), F.col("id")], top)


def gold_metrics(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, precision, recall) over id sets: (query_id, id) retrieved against (query_id, id) gold.

    Repeated and null ids count once and never; queries without gold have no recall, without retrieved ids a precision of 0.
    """
    have = retrieved.where("id is not null").select("query_id", "id").distinct().withColumn("r", F.lit(1))
    want = gold.where("id is not null").select("query_id", "id").distinct().withColumn("g", F.lit(1))
    counts = have.join(want, ["query_id", "id"], "full").groupBy("query_id").agg(F.sum("r").alias("r"), F.sum("g").alias("g"), F.count(F.when(F.col("r").isNotNull() & F.col("g").isNotNull(), 1)).alias("b"))
    return counts.select("query_id", F.round(F.when(F.col("r") > 0, F.col("b") / F.col("r")).otherwise(0.0), 6).alias("precision"), F.round(F.when(F.col("g") > 0, F.col("b") / F.col("g")), 6).alias("recall"))
