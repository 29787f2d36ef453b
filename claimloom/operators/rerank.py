"""Rerankers: they rescore a candidate set and never change it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import lexical_overlap

CROSS_CHARS, MODEL_CHARS, MODEL_GROUP, NEUTRAL = 2000, 1200, 10, 1.0


def rerank(hits: DataFrame, score: Column | str, top_k: int | None = None) -> DataFrame:
    """Replaces score by the reranker's, which is also kept as rerank_score; ties keep the incoming rank."""
    scored = hits.withColumn("rerank_score", F.col(score) if isinstance(score, str) else score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = scored.withColumn("_r", F.row_number().over(w)).drop("rank").withColumnRenamed("_r", "rank").withColumn("score", F.col("rerank_score"))
    return out.where(F.col("rank") <= top_k) if top_k else out


def identity_score() -> Column:
    """Keeps the order: the number of hits less those before."""
    return (F.count("*").over(Window.partitionBy("query_id")) - F.col("rank") + 1).cast("double")


def overlap_score(query: str = "query", text: str = "text") -> Column:
    """An offline stand-in for a pair model: the share of the query's tokens in the text's first characters."""
    return lexical_overlap(F.col(query), F.substring(text, 1, CROSS_CHARS))


def pair_model_score(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32):
    """A pandas UDF around a pair model, loaded once in each worker: score(query, text)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            pairs = list(zip(q.fillna(""), t.fillna("").str.slice(0, CROSS_CHARS)))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])])

    return run


def parse_grades(reply: str | None, size: int, default: float = NEUTRAL) -> list[float]:
    """Scores from a model's JSON reply [{"id": 0, "score": 2}, ...]; ids out of bounds are ignored, errors keep the defaults."""
    out = [default] * size
    try:
        for item in json.loads(reply or ""):
            i = int(item["id"])
            if 0 <= i < size:
                out[i] = float(item["score"])
    except (ValueError, KeyError, TypeError):
        pass
    return out


def model_grades(hits: DataFrame, load: Callable[[], Callable[[str, list[str]], str]], query: str = "query", text: str = "text") -> DataFrame:
    """Hits with rerank_score from a language model asked about MODEL_GROUP texts at a time; load() runs once in each task."""
    w = Window.partitionBy("query_id").orderBy("rank")
    grouped = hits.withColumn("_g", F.floor((F.row_number().over(w) - 1) / MODEL_GROUP)).groupBy("query_id", "_g").agg(F.first(query).alias("q"), F.sort_array(F.collect_list(F.struct("rank", F.substring(text, 1, MODEL_CHARS).alias("t"), "record_id"))).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for b in batches:
            rows = []
            for r in b.itertuples():
                items = list(r.items)
                for item, s in zip(items, parse_grades(ask(r.q, [i["t"] for i in items]), len(items))):
                    rows.append((r.query_id, item["record_id"], s))
            yield pd.DataFrame(rows, columns=["query_id", "record_id", "rerank_score"])

    kinds = [f"{c} {hits.schema[c].dataType.simpleString()}" for c in ("query_id", "record_id")]
    grades = grouped.select("query_id", "q", "items").mapInPandas(run, f"{', '.join(kinds)}, rerank_score double")
    return hits.drop("rerank_score").join(grades, ["query_id", "record_id"])
