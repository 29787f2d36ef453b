"""Paired significance tests between systems, and run export."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RESAMPLES, SEED, LEVEL = 10_000, 7, 0.05
PRIME = (1 << 31) - 1


def resample(block: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The rows drawn for the resamples of a block: n numbers below n for each, from integer arithmetic that SQL can repeat."""
    x = ((block[:, None] + 1) * 7919 + (np.arange(n, dtype=np.int64)[None, :] + 1) * 104_729 + seed) % PRIME
    for add in (12_345, 678_901, 2_345_678):
        x = (x * x + add) % PRIME * 48_271 % PRIME
    return x % n


def paired_bootstrap(a: list[float], b: list[float], resamples: int = RESAMPLES, seed: int = SEED) -> float:
    """Two-sided p of the mean difference under centred resampling; 1.0 without a difference or without data."""
    if len(a) != len(b):
        raise ValueError("the samples must be paired")
    d = np.asarray(a, float) - np.asarray(b, float)
    if not len(d) or abs(d.mean()) == 0.0:
        return 1.0
    centred, extreme, block = d - d.mean(), 0, max(1, 2_000_000 // len(d))
    for i in range(0, resamples, block):
        means = centred[resample(np.arange(i, min(i + block, resamples), dtype=np.int64), len(d), seed)].mean(axis=1)
        extreme += int((np.abs(means) >= abs(d.mean()) - 1e-12).sum())  # equal but for rounding counts
    return (extreme + 1) / (resamples + 1)


def normal_tail(t: float) -> float:
    return 2.0 * (1.0 - 0.5 * (1.0 + math.erf(abs(t) / math.sqrt(2.0))))


def paired_t(a: list[float], b: list[float]) -> float:
    """Paired t test by the normal approximation."""
    if len(a) != len(b):
        raise ValueError("the samples must be paired")
    d = np.asarray(a, float) - np.asarray(b, float)
    if len(d) < 2:
        return 1.0
    var = d.var(ddof=1)
    if var == 0:
        return 1.0 if d.mean() == 0 else 0.0
    return normal_tail(d.mean() / math.sqrt(var / len(d)))


def paired_differences(per_query: DataFrame, metric: str, baseline: str) -> DataFrame:
    """(system, query_id, a, b): each other system's value and the baseline's on the queries both have."""
    v = per_query.select("system", "query_id", F.col(f"`{metric}`").alias("v"))
    base = v.where(F.col("system") == baseline).select("query_id", F.col("v").alias("b"))
    return v.where(F.col("system") != baseline).join(base, "query_id").select("system", "query_id", F.col("v").alias("a"), "b")


def t_terms(per_query: DataFrame, metric: str, baseline: str) -> DataFrame:
    """(system, n, mean_a, mean_b, delta, t): what the t test needs, as plain aggregates over any number of queries."""
    d = paired_differences(per_query, metric, baseline).withColumn("d", F.col("a") - F.col("b"))
    g = d.groupBy("system").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("delta"), F.var_samp("d").alias("var"))
    return g.withColumn("t", F.when((F.col("n") >= 2) & (F.col("var") > 0), F.col("delta") / F.sqrt(F.col("var") / F.col("n"))))


def compare_systems(per_query: DataFrame, metric: str, baseline: str, test: str = "bootstrap", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(metric, system_a, system_b, mean_a, mean_b, delta, p_value, n, test, significant) against the baseline.

    A system's queries are an evaluation set (hundreds or thousands); each system's pairs are one group.
    """
    if per_query.where(F.col("system") == baseline).isEmpty():
        raise ValueError(f"unknown baseline {baseline!r}")
    run = {"bootstrap": lambda a, b: paired_bootstrap(a, b, resamples, seed), "t": paired_t}[test]

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        p = run(pdf.a.tolist(), pdf.b.tolist())
        row = (metric, key[0], baseline, pdf.a.mean(), pdf.b.mean(), pdf.a.mean() - pdf.b.mean(), p, len(pdf), test, bool(p < LEVEL))
        return pd.DataFrame([row], columns=["metric", "system_a", "system_b", "mean_a", "mean_b", "delta", "p_value", "n", "test", "significant"])

    schema = "metric string, system_a string, system_b string, mean_a double, mean_b double, delta double, p_value double, n bigint, test string, significant boolean"
    return paired_differences(per_query, metric, baseline).groupBy("system").applyInPandas(group, schema)


def summary(r) -> str:
    """One comparison as a line."""
    return f"{r.metric:<12} {r.system_a} {r.mean_a:.4f} vs {r.system_b} {r.mean_b:.4f}  delta={r.delta:+.4f}  p={r.p_value:.4f}{'*' if r.significant else ' '}"


def significance_table(rows: list) -> str:
    """What was tested, and a line for each comparison."""
    if not rows:
        return "(no comparisons)"
    return "\n".join([f"paired {rows[0].test} test, two-sided, n={rows[0].n} queries (* = p < {LEVEL})", "-" * 78, *map(summary, rows)])


def comparison_table(rows: list, metrics: list[str], latency: dict[str, float] | None = None) -> str:
    """Fixed-width table of macro-averages, a line a system, with the median latency where it is known.

    A last line gives the ceilings of recall, which few hits and many relevant records put below 1.
    """
    head = f"{'system':<20}" + "".join(f"{m:>18}" for m in metrics) + (f"{'P50 ms':>10}" if latency else "")
    lines = [head, "-" * len(head)]
    lines += [f"{r['system']:<20}" + "".join(f"{r[m]:>18.4f}" for m in metrics) + (f"{latency.get(r['system'], 0.0):>10.1f}" if latency else "") for r in rows]
    ceilings = [f"recall@{k} max {rows[0][f'recall_ceiling@{k}']:.3f}" for k in (10, 50) if rows and f"recall_ceiling@{k}" in rows[0].asDict()]
    return "\n".join([*lines, *(["", "recall ceilings: " + ", ".join(ceilings)] if ceilings else [])])


@F.arrow_udf(StringType())
def _inverse(rank: pa.Array) -> pa.Array:
    """1 / rank to six digits; the double decides where its decimal form is a tie, which no built-in format does."""
    return pa.array([None if r is None else f"{1 / r:.6f}" for r in rank.to_pylist()], pa.string())


def trec_run(run: DataFrame, name: str) -> DataFrame:
    """Lines `query Q0 record rank 1/rank name`, as evaluation tools read them."""
    return run.select("query_id", "rank", F.format_string("%s Q0 %s %d %s %s", "query_id", "record_id", F.col("rank").cast("long"), _inverse("rank"), F.lit(name)).alias("line"))
