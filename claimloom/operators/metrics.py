"""Graded retrieval metrics: every metric is a group-by over run(system, query_id, record_id, rank) and qrels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20, 50)


def explode_qrels(eval_queries: DataFrame) -> DataFrame:
    """(query_id, record_id, grade) of the positive grades."""
    return eval_queries.select("query_id", F.explode("qrels").alias("record_id", "grade")).where("grade > 0")


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grades; records without one have grade 0."""
    return run.join(qrels, ["query_id", "record_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def ideal(qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, n_1, n_2, idcg_k...) of each query's qrels."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "record_id")
    placed = qrels.withColumn("_p", F.row_number().over(w))
    return placed.groupBy("query_id").agg(
        F.count("*").alias("n_1"),
        F.count_if(F.col("grade") >= 2).alias("n_2"),
        *[F.sum(F.when(F.col("_p") <= k, _gain(F.col("grade")) / F.log2(F.col("_p") + F.lit(1.0)))).alias(f"idcg_{k}") for k in ks],
    )


def evaluate(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """(system, query_id, metric columns): success, recall, recall_ceiling, precision, ndcg, mrr, map, and strict ones, at each k.

    run: (system, query_id, record_id, rank from 1 without gaps). queries: all (query_id), so that queries without hits
    have zeros for every system; without it only queries in the run are given. precision divides by k, map by the lesser
    of k and the relevant.
    """
    graded = judged_run(run.where(F.col("rank") <= max(ks)), qrels)  # no metric looks further
    w = Window.partitionBy("system", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("grade") >= 1
    graded = graded.withColumn("_hits", F.sum(rel.cast("int")).over(w))
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.count_if(inside & rel).alias(f"_r{k}"),
            F.count_if(inside & (F.col("grade") >= 2)).alias(f"_s{k}"),
            F.min(F.when(inside & rel, F.col("rank"))).alias(f"_f{k}"),
            F.sum(F.when(inside, _gain(F.col("grade")) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias(f"_d{k}"),
            F.sum(F.when(inside & rel, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias(f"_a{k}"),
        ]
    per = graded.groupBy("system", "query_id").agg(*aggs)
    if queries is not None:
        per = run.select("system").distinct().crossJoin(queries.select("query_id").distinct()).join(per, ["system", "query_id"], "left")  # systems are few: one row for each system and query is the result's size
    joined = per.join(ideal(qrels, ks), "query_id", "left").na.fill(0)
    out = []
    n = F.col("n_1")
    for k in ks:
        r, some = F.col(f"_r{k}"), n > 0
        out += [
            (r > 0).cast("double").alias(f"success@{k}"),
            F.when(some, r / n).otherwise(0.0).alias(f"recall@{k}"),
            F.when(some, F.least(F.lit(k), n) / n).otherwise(0.0).alias(f"recall_ceiling@{k}"),
            (r / F.lit(float(k))).alias(f"precision@{k}"),
            F.when(F.col(f"idcg_{k}") > 0, F.col(f"_d{k}") / F.col(f"idcg_{k}")).otherwise(0.0).alias(f"ndcg@{k}"),
            F.when(F.col(f"_f{k}") > 0, F.lit(1.0) / F.col(f"_f{k}")).otherwise(0.0).alias(f"mrr@{k}"),
            F.when(some, F.col(f"_a{k}") / F.least(F.lit(k), n)).otherwise(0.0).alias(f"map@{k}"),
            (F.col(f"_s{k}") > 0).cast("double").alias(f"success@{k}_strict"),
            (F.col(f"_s{k}") / F.lit(float(k))).alias(f"precision@{k}_strict"),
        ]
    return joined.select("system", "query_id", *out)


def macro_average(per_query: DataFrame, by: str = "system") -> DataFrame:
    """Means over all queries, a missing value counting as 0."""
    metrics = [c for c in per_query.columns if c not in (by, "query_id")]
    return per_query.groupBy(by).agg(*[(F.sum(F.coalesce(F.col(f"`{m}`"), F.lit(0.0))) / F.count("*")).alias(m) for m in metrics])


def percentile(values: Column, p: float) -> Column:
    """Nearest rank with half-to-even rounding over a collected array, as the published latency figures use."""
    at = F.bround(F.lit(p / 100.0) * (F.size(values) - 1).cast("double")).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.least(at, F.size(values)))))


def nearest_rank(df: DataFrame, group: str, value: str, ps: tuple[float, ...] = (50, 95), ranges: int = 64) -> DataFrame:
    """(group, p..., mean, n) without collecting or sorting a group in one task.

    Equal values are counted first. The distinct ones of a group are cut into ranges at approximate quantiles, and the
    counts of the ranges before are added to the running counts within.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    edges = values.groupBy("g").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("e"))
    same = F.col("x.g").eqNullSafe(F.col("y.g"))
    ranged = values.alias("x").join(edges.alias("y"), same).select("x.g", "v", "c", F.size(F.filter("e", lambda q: q < F.col("v"))).alias("r"))
    totals = ranged.groupBy("g", "r").agg(F.sum("c").alias("t"))  # at most `ranges` rows a group
    w = Window.partitionBy("g")
    offsets = totals.select("g", "r", F.coalesce(F.sum("t").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("t").over(w).alias("n"))
    run = F.sum("c").over(Window.partitionBy("x.g", "x.r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.alias("x").join(offsets.alias("y"), same & (F.col("x.r") == F.col("y.r"))).select("x.g", "v", "c", "n", (F.col("before") + run).alias("upto"))
    want = lambda p: F.bround(F.lit(p / 100.0) * (F.col("n") - 1).cast("double")).cast("long") + 1
    there = lambda p: (F.col("upto") - F.col("c") < want(p)) & (F.col("upto") >= want(p))
    found = placed.groupBy("g").agg(*[F.max(F.when(there(p), F.col("v"))).alias(f"p{p:g}") for p in ps], (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    return found.withColumnRenamed("g", group)
