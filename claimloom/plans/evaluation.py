"""Evaluation of several search methods on one query set, and the judging of their pooled candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import evalset, metrics, pooling, significance
from claimloom.plans.engine import SearchEngine
from claimloom.session import materialise

MEASURES = ["success@10", "recall@10", "recall@50", "ndcg@10", "mrr@10", "precision@5"]


def run_systems(engine: SearchEngine, queries: DataFrame, methods: list[str], depth: int = 50) -> tuple[DataFrame, dict[str, float]]:
    """(system, query_id, record_id, rank) of each method, and the milliseconds that a query of the set took in the mean."""
    runs, latency = [], {}
    number = max(queries.count(), 1)
    for m in methods:
        found = engine.timed_search(queries.select("query_id", "text"), m, depth, depth)
        latency[m] = found.timings_ms["total"] / number
        runs.append(found.hits.select(F.lit(m).alias("system"), "query_id", "record_id", "rank"))
    return reduce(DataFrame.unionByName, runs), latency


def evaluate_methods(engine: SearchEngine, eval_queries: DataFrame, methods: list[str], baseline: str | None = None, measures: tuple[str, ...] = ("ndcg@10", "recall@50"), test: str = "bootstrap", depth: int = 50) -> dict:
    """{per_query, systems, comparisons, latency, overlap}: metrics by query and in the mean, and each method against the baseline.

    baseline: the first method if None. overlap tells how many words the queries share with their first graded record.
    """
    run, latency = run_systems(engine, eval_queries, methods, depth)
    per_query = materialise(metrics.evaluate(run, metrics.explode_qrels(eval_queries), eval_queries))
    base = baseline or methods[0]
    compared = [r for m in measures for r in significance.compare_systems(per_query, m, base, test).orderBy("system_a").collect()] if len(methods) > 1 else []
    return {"per_query": per_query, "systems": metrics.macro_average(per_query), "comparisons": compared, "latency": latency, "overlap": evalset.overlap_report(eval_queries, engine.records).first()}


def printed(result: dict) -> str:
    """The tables of an evaluation."""
    rows = result["systems"].orderBy("system").collect()
    o = result["overlap"]
    parts = [significance.comparison_table(rows, MEASURES, result["latency"]), significance.significance_table(result["comparisons"])]
    return "\n\n".join([*parts, f"words of the queries in their first graded record: mean {o.mean_overlap}, median {o.median_overlap}, n={o.n}"])


def pooled_qrels(engine: SearchEngine, eval_queries: DataFrame, methods: list[str], assess: Column, judgements: DataFrame | None = None, depth: int = pooling.DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries with merged qrels, all judgements of the pool, its statistics).

    The methods' first hits are pooled; what the cache of judgements doesn't know is judged by assess, a column expression
    over the candidate and the query's and the record's texts.
    """
    run, _ = run_systems(engine, eval_queries, methods, depth)
    pool = materialise(pooling.build_pool(run, depth))
    texts = engine.records.select("record_id", F.substring("text", 1, pooling.JUDGE_CHARS).alias("text"))
    shown = pool.join(texts, "record_id").join(eval_queries.select("query_id", F.col("text").alias("query")), "query_id")
    known = judgements if judgements is not None else metrics.explode_qrels(eval_queries).limit(0)
    judged = materialise(pooling.judge_pool(shown, known, assess))
    return pooling.apply_judgements(eval_queries, judged), judged, pooling.pool_stats(pool)
