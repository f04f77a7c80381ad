"""Places for models: embedder, reranker, judge and classifier as batch functions.

A model is a factory that is called once per task, so that weights are loaded on the workers and never sent with the plan. The
models here are deterministic and need no service; a real one only has to have the same methods. Without a model
(``None``) the operators pass their rows on in the order they have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.plain import bare
from tessera.operators.retrieval import best

CANDIDATES, SCORE_FLOOR = 12, -10.0
MIN_CONFIDENCE = 0.85
_TOKEN = re.compile(r"[a-z0-9]{2,}")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(bare(text)) if text else []


class HashingEmbedder:
    """Tokens hashed to signed places of a unit vector; a text without tokens has the zero vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str | None]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str | None) -> list[float]:
        vector = [0.0] * self.size
        for token in tokens(text):
            code = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            vector[code % self.size] += 1.0 if code >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in vector))
        return [x / norm for x in vector] if norm else vector


class OverlapScorer:
    """Score of (query, text): log odds of the share of the query's tokens that the text has; nothing shared gives -12."""

    def score(self, pairs: Sequence[tuple[str | None, str | None]]) -> list[float]:
        out = []
        for query, text in pairs:
            wanted = set(tokens(query))
            share = len(wanted & set(tokens(text))) / len(wanted) if wanted else 0.0
            out.append(round(math.log((share + 1e-6) / (1 - share + 1e-6)), 6) if share else -12.0)
        return out


class KeywordClassifier:
    """(label, confidence, reason): whether a text is about the topic of the keywords; a veto word decides against it."""

    def __init__(self, keywords: Sequence[str], veto: Sequence[str] = ()):
        self.keywords, self.veto = [bare(k) for k in keywords], [bare(v) for v in veto]

    def classify(self, texts: Sequence[str | None]) -> list[tuple[bool, float, str]]:
        out = []
        for text in texts:
            folded = bare(text or "")
            against = [v for v in self.veto if v in folded]
            hits = [k for k in self.keywords if k in folded]
            confidence = 0.95 if against else round(1 - 0.5 ** (len(hits) + 1), 6)
            out.append((bool(hits) and not against, confidence, ",".join(against or hits)))
        return out


def embedded(texts: DataFrame, factory: Callable[[], HashingEmbedder] = HashingEmbedder) -> DataFrame:
    """(id, embedding) of (id, text), in Arrow batches of the session's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": model.embed(list(batch["text"]))})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, embedding array<float>")


def reranked(hits: DataFrame, factory: Callable[[], OverlapScorer] | None = OverlapScorer, top: int = 5, candidates: int = CANDIDATES, floor: float = SCORE_FLOOR) -> DataFrame:
    """(query_id, id, rerank_score, rank): the first ``candidates`` hits of each query scored by the model, those at or above
    ``floor`` in the order of their scores, the best ``top``; ties keep their order.

    hits: (query_id, query, id, text, rank). Without a model the hits keep their order and have no score.
    """
    first = hits.where(F.col("rank") <= candidates)
    if factory is None:
        return first.where(F.col("rank") <= top).select("query_id", "id", F.lit(None).cast("double").alias("rerank_score"), "rank")
    kinds = dict(hits.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            batch["rerank_score"] = model.score(list(zip(batch["query"], batch["text"])))
            yield batch[["query_id", "id", "before", "rerank_score"]]

    scored = first.select("query_id", "query", "id", "text", F.col("rank").alias("before")).mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, before int, rerank_score double")
    return best(scored.where(F.col("rerank_score") >= floor), "query_id", [F.desc("rerank_score"), F.col("before"), F.col("id")], top).select("query_id", "id", "rerank_score", "rank")


def judged(rows: DataFrame, factory: Callable[[], OverlapScorer] = OverlapScorer) -> DataFrame:
    """(id, score): a judge's score between 0 and 1 of each answer against its reference; rows: (id, answer, reference)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            scores = model.score(list(zip(batch["reference"], batch["answer"])))
            yield pd.DataFrame({"id": batch["id"], "score": [round(1 / (1 + math.exp(-min(50.0, max(-50.0, s)))), 6) for s in scores]})

    return rows.select("id", "answer", "reference").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double")


def classified(texts: DataFrame, factory: Callable[[], KeywordClassifier], least: float | None = MIN_CONFIDENCE) -> DataFrame:
    """(id, related, confidence, reason) of (id, text), whole texts; with ``least`` only related ones that are so certain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            found = model.classify(list(batch["text"]))
            yield pd.DataFrame({"id": batch["id"], "related": [f[0] for f in found], "confidence": [f[1] for f in found], "reason": [f[2] for f in found]})

    out = texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, related boolean, confidence double, reason string")
    return out if least is None else out.where(F.col("related") & (F.col("confidence") >= least))
