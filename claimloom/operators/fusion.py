"""Reciprocal-rank fusion of two ranked lists, and grouping of hits by their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.lexical import top_k

RRF_K, ALPHA, GROUP_TOP = 60, 0.3, 10


def fuse(lexical: DataFrame, dense: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, record_id, bm25_rank, vector_rank, score, rank) from two lists of (query_id, record_id, rank).

    Ties keep the order of the first list, then of the second.
    """
    both = lexical.select("query_id", "record_id", F.col("rank").alias("bm25_rank")).join(dense.select("query_id", "record_id", F.col("rank").alias("vector_rank")), ["query_id", "record_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("bm25_rank") + part("vector_rank"))
    return top_k(scored, k, [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank")])


def group_hits(hits: DataFrame, parent: str = "patent_id", alpha: float = ALPHA, top: int = GROUP_TOP, supporting: int = 3) -> DataFrame:
    """(query_id, parent, score, best, supporting, rank): the best hit, plus alpha times the mean of the next three.

    hits: (query_id, parent, record_id, score, rank). Supporting ids are all but the best, in order; equal scores keep
    the order in which the parents were first hit.
    """
    w = Window.partitionBy("query_id", parent).orderBy(F.desc("score"), "rank")
    placed = hits.withColumn("_n", F.row_number().over(w))
    grouped = placed.groupBy("query_id", parent).agg(
        F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("_best"),
        F.avg(F.when(F.col("_n").between(2, supporting + 1), F.col("score"))).alias("_next"),
        F.max(F.when(F.col("_n") == 1, F.col("record_id"))).alias("best"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "record_id")))), lambda s: s["record_id"]).alias("supporting"),
        F.min("rank").alias("_first"),
    )
    scored = grouped.withColumn("score", F.col("_best") + alpha * F.coalesce("_next", F.lit(0.0)))
    return top_k(scored, top, [F.desc("score"), "_first"]).select("query_id", parent, "score", "best", "supporting", "rank")
