"""The facade: one call for a set of queries, from validation to grouped results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.models import reranker
from claimloom.functions.text import hashing_embedding
from claimloom.operators import lexical
from claimloom.operators.dense import dense_search
from claimloom.operators.filters import Filters
from claimloom.operators.fusion import fuse, group_hits
from claimloom.operators.quality import corpus_stats
from claimloom.operators.rerank import rerank
from claimloom.session import materialise

METHODS = ("bm25", "dense", "hybrid", "hybrid_reranked")
# Bounds of a request.
LIMITS = {"query": (1, 8000), "top_k": (1, 100), "candidates": (1, 200)}
FILTER_LENGTHS = {"classification_prefix": 16, "title_keyword": 200, "abstract_keyword": 200, "exact_title": 400, "exclude_patent": 32}
PREVIEW, SUPPORTING = 400, 5


class StageTimer:
    """Milliseconds of named stages. Plans are lazy, so a stage is timed only if it runs an action."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    def run(self, name: str, action: Callable):
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + (time.perf_counter() - began) * 1000

    def report(self) -> dict[str, float]:
        return {k: round(v, 2) for k, v in self.ms.items()} | {"total": round(sum(self.ms.values()), 2)}


def check_request(query: str, filters: Filters | None = None) -> None:
    """Raises ValueError for a query or a filter text that is too short or too long."""
    if not LIMITS["query"][0] <= len(query or "") <= LIMITS["query"][1]:
        raise ValueError(f"the query must have {LIMITS['query'][0]} to {LIMITS['query'][1]} characters")
    for name, most in FILTER_LENGTHS.items():
        if len(getattr(filters, name, None) or "") > most:
            raise ValueError(f"{name} must have at most {most} characters")


def check_requests(queries: DataFrame, filters: Filters | None = None) -> None:
    """check_request of every query of a set, in one pass over it."""
    check_request("x", filters)
    size = F.length(F.coalesce("text", F.lit("")))
    bad = queries.where(~size.between(*LIMITS["query"])).select("query_id", size.alias("n")).limit(1).collect()
    if bad:
        raise ValueError(f"query {bad[0].query_id!r} has {bad[0].n} characters, not {LIMITS['query'][0]} to {LIMITS['query'][1]}")


@dataclass
class Outcome:
    """A search's hits and patents, and the milliseconds of its stages."""

    method: str
    hits: DataFrame
    patents: DataFrame
    timings_ms: dict[str, float]


@dataclass
class SearchEngine:
    """Search over one record table.

    embed: a column expression from text to vector for queries (None: no dense search); scorer: the specification of a
    reranker, what the registry makes of it, or a column expression over hits joined with query, text and title (None: no
    reranking).
    """

    records: DataFrame
    index: lexical.LexicalIndex
    embed: Callable | None = None
    scorer: Callable | str | None = None
    synonyms: dict[str, str] = field(default_factory=dict)
    stem: bool = True

    @classmethod
    def over(cls, records: DataFrame, synonyms: dict[str, str] | None = None, stem: bool = True, **kw) -> SearchEngine:
        unique = records.dropDuplicates(["record_id"])
        return cls(unique, lexical.build_index(unique, None, synonyms, stem), synonyms=synonyms or {}, stem=stem, **kw)

    def capabilities(self) -> list[str]:
        return [m for m in METHODS if m == "bm25" or (self.embed and (m != "hybrid_reranked" or self.scorer))]

    def check(self, method: str, top_k: int, candidates: int) -> None:
        """All arguments are checked before any work is planned."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        if method != "bm25" and self.embed is None:
            raise ValueError(f"{method} needs an embedder")
        if method == "hybrid_reranked" and self.scorer is None:
            raise ValueError(f"{method} needs a reranker")
        for name, value in (("top_k", top_k), ("candidates", candidates)):
            if not LIMITS[name][0] <= value <= LIMITS[name][1]:
                raise ValueError(f"{name} must be in {LIMITS[name]}")
        if candidates < top_k:
            raise ValueError("candidates must be at least top_k")

    def _embedded(self, queries: DataFrame, method: str) -> DataFrame:
        return queries if method == "bm25" or "vector" in queries.columns else queries.withColumn("vector", self.embed(F.col("text")))

    def _retrieved(self, q: DataFrame, method: str, top_k: int, candidates: int, filters: Filters | None) -> DataFrame:
        """Hits with the fields of their records and the query's text, before reranking."""
        none = lambda kind: F.lit(None).cast(kind)
        if filters is not None:
            filters = replace(filters, synonyms=self.synonyms, stem=self.stem)  # keywords are analysed as the index is
        depth = top_k if method in ("bm25", "dense") else candidates
        words = lambda: lexical.bm25_search(self.index, q, depth, filters, synonyms=self.synonyms, stem=self.stem)
        vectors = lambda: dense_search(self.records, q.select("query_id", "vector"), depth, filters)
        if method == "bm25":
            found = words()
        elif method == "dense":
            found = vectors()
        else:
            found = fuse(words(), vectors(), candidates if method == "hybrid_reranked" else top_k)
        if "bm25_rank" not in found.columns:
            found = found.withColumns({"bm25_rank": none("int"), "vector_rank": none("int")})
        fields = ["record_id", "patent_id", "record_type", "title", "text", "classification_raw", "claim_number"]
        joined = found.join(self.records.select(*fields), "record_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
        return joined.withColumn("rerank_score", none("double"))

    def _reranked(self, hits: DataFrame, top_k: int) -> DataFrame:
        """scorer is a column expression, or a function from hits to hits with a rerank_score, as the registry gives."""
        if isinstance(self.scorer, str):
            return rerank(reranker(self.scorer)(hits), "rerank_score", top_k)
        scored = self.scorer(hits) if len(signature(self.scorer).parameters) == 1 else None
        return rerank(scored, "rerank_score", top_k) if isinstance(scored, DataFrame) else rerank(hits, self.scorer(), top_k)

    def hits(self, queries: DataFrame, method: str = "hybrid", top_k: int = 10, candidates: int = 50, filters: Filters | None = None) -> DataFrame:
        """(query_id, record_id, patent_id, record fields, query, score, bm25_rank, vector_rank, rerank_score, rank).

        queries: (query_id, text), optionally vector. Ranks of the two lists exist only after fusion. Texts that are empty
        or too long raise ValueError, as all arguments that don't fit do.
        """
        self.check(method, top_k, candidates)
        check_requests(queries, filters)
        found = self._retrieved(self._embedded(queries, method), method, top_k, candidates, filters)
        return self._reranked(found, top_k) if method == "hybrid_reranked" else found

    def search(self, queries: DataFrame, top_n: int = 10, **kw) -> tuple[DataFrame, DataFrame]:
        """(hits, patents)"""
        hits = self.hits(queries, **kw)
        return hits, group_hits(hits, top=top_n)

    def timed_search(self, queries: DataFrame, method: str = "hybrid", top_k: int = 10, candidates: int = 50, filters: Filters | None = None, top_n: int = 10) -> Outcome:
        """As search, with each stage run and written before the next, so that its milliseconds can be told."""
        timer = StageTimer()
        self.check(method, top_k, candidates)
        check_requests(queries, filters)
        q = timer.run("embed", lambda: materialise(self._embedded(queries, method))) if method != "bm25" else queries
        hits = timer.run("retrieve", lambda: materialise(self._retrieved(q, method, top_k, candidates, filters)))
        if method == "hybrid_reranked":
            found = hits
            hits = timer.run("rerank", lambda: materialise(self._reranked(found, top_k)))
        patents = timer.run("aggregate", lambda: materialise(group_hits(hits, top=top_n)))
        return Outcome(method, hits, patents, timer.report())

    def health(self) -> dict:
        """Whether the records can be read, how many they are, and what can be searched for."""
        try:
            row = corpus_stats(self.records).first()
            return {"status": "ok", "records": row.records, "patents": row.patents, "methods": self.capabilities()}
        except Exception as e:
            return {"status": "unavailable", "error": f"{type(e).__name__}: {e}"[:500], "methods": []}

    @staticmethod
    def served(hits: DataFrame) -> DataFrame:
        """Hits as they are given out: scores to four digits, texts cut to a preview."""
        return hits.withColumns({"score": F.round("score", 4), "rerank_score": F.round("rerank_score", 4), "text": F.substring("text", 1, PREVIEW)})

    @staticmethod
    def served_patents(patents: DataFrame) -> DataFrame:
        """Grouped patents as they are given out: the score to four digits, the first supporting hits and how many there are."""
        # rounded twice, so that the last bit of a sum doesn't decide between two results
        return patents.withColumns({"score": F.round(F.round("score", 9), 4), "supporting_count": F.size("supporting"), "supporting": F.slice("supporting", 1, SUPPORTING)})

    def patent(self, patents: DataFrame, patent_id: str) -> DataFrame:
        """One patent with its raw non-blank paragraphs; empty if there is none."""
        return patents.where(F.col("patent_id") == patent_id).withColumn("description_paragraphs", F.filter("description_paragraphs", lambda p: F.trim(p) != ""))


def hashing_engine(records: DataFrame, dimension: int = 32, **kw) -> SearchEngine:
    """An engine that needs no model: records and queries are embedded by hashing."""
    embedded = records.withColumn("embedding", hashing_embedding(F.col("text"), dimension))
    return SearchEngine.over(embedded, embed=lambda c: hashing_embedding(c, dimension), **kw)
