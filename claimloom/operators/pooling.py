"""Pools of candidates for judging, the judgement cache, and the merging of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH, JUDGE_GROUP, JUDGE_CHARS = 50, 10, 1100


def build_pool(run: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, record_id, found_by, best_rank): the union of the systems' first hits."""
    return run.where(F.col("rank") <= depth).groupBy("query_id", "record_id").agg(F.sort_array(F.collect_set("system")).alias("found_by"), F.min("rank").alias("best_rank"))


def pool_stats(pool: DataFrame) -> DataFrame:
    per = pool.groupBy("query_id").agg(F.count("*").alias("size"), F.count_if(F.size("found_by") > 1).alias("multi"))
    return per.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.round(F.avg("size"), 1), F.lit(0.0)).alias("mean_pool_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_pool_size"),
        F.coalesce(F.round(F.avg("multi"), 1), F.lit(0.0)).alias("mean_found_by_multiple_systems"),
    )


def unjudged(pool: DataFrame, judgements: DataFrame) -> DataFrame:
    return pool.join(judgements.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")


def first_judgements(cache: DataFrame, sequence: str = "seq") -> DataFrame:
    """(query_id, record_id, grade) of the cache, the first one written winning."""
    return cache.groupBy("query_id", "record_id").agg(F.min_by("grade", sequence).alias("grade"))


def judge_batches(pool: DataFrame, size: int = JUDGE_GROUP) -> DataFrame:
    """The pool with the batch that each candidate is judged in."""
    w = Window.partitionBy("query_id").orderBy("best_rank", "record_id")
    return pool.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def judge_pool(pool: DataFrame, judgements: DataFrame, assess) -> DataFrame:
    """(query_id, record_id, grade): cached judgements first, the rest from assess(column struct) clamped to 0..3."""
    new = unjudged(pool, judgements).select("query_id", "record_id", F.greatest(F.lit(0), F.least(F.lit(3), assess)).cast("int").alias("grade"))
    kept = pool.join(judgements, ["query_id", "record_id"]).select("query_id", "record_id", "grade")
    return kept.unionByName(new)


def merge_qrels(structural: DataFrame, judged: DataFrame, prefer_judged: bool = True) -> DataFrame:
    """(query_id, record_id, grade): both sources, one preferred where they meet; grades of 0 and below are dropped."""
    both = structural.select("query_id", "record_id", F.col("grade").alias("s")).join(judged.select("query_id", "record_id", F.col("grade").alias("j")), ["query_id", "record_id"], "full_outer")
    grade = F.coalesce("j", "s") if prefer_judged else F.coalesce("s", "j")
    return both.select("query_id", "record_id", grade.alias("grade")).where("grade > 0")


def apply_judgements(eval_queries: DataFrame, judged: DataFrame, keep_structural: bool = True) -> DataFrame:
    """eval_queries with merged qrels; queries left without any are dropped."""
    structural = eval_queries.select("query_id", F.explode("qrels").alias("record_id", "grade"))
    merged = merge_qrels(structural if keep_structural else structural.limit(0), judged)
    maps = merged.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("record_id", "grade"))).alias("_q"))
    return eval_queries.join(maps, "query_id").withColumn("qrels", F.col("_q")).drop("_q")
