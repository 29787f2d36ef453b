"""Latencies of single searches by method, unfiltered and filtered."""

from __future__ import annotations

import time

from claimloom.operators.filters import Filters
from claimloom.plans.engine import SearchEngine

# The queries and the filter that published latencies were measured with.
QUERIES = [
    "flexible fibre spoke connected between a hub and a wheel rim",
    "pneumatic tyre tread with circumferential grooves and sipes",
    "wheel bearing unit with inner toothing and axial retention",
    "run-flat tyre sidewall insert reinforcement",
    "carbon fibre composite wheel rim manufacturing method",
    "tyre pressure sensor mounted on the inner liner",
    "brake disc mounted to a wheel hub with plural fasteners",
    "rubber composition comprising silica and a coupling agent",
    "spoke tension adjustment mechanism for a bicycle wheel",
    "vehicle wheel with a decorative cover attached by clips",
]
FILTERED = Filters(classification_prefix="B60B", record_types=["claim"])


def nearest_rank(values: list[float], p: float) -> float:
    """The value at the rounded rank, as published latencies are given; 0 of none."""
    ordered = sorted(values)
    return ordered[min(round(p / 100 * (len(ordered) - 1)), len(ordered) - 1)] if ordered else 0.0


def benchmark(engine: SearchEngine, methods: list[str], repeats: int = 3, candidates: int = 50, queries: list[str] | None = None) -> list[dict]:
    """A row for each method and filter: searches, p50, p95 and mean milliseconds, mean hits, and the stages' p50."""
    spark = engine.records.sparkSession
    out = []
    for method in methods:
        for name, filters in (("unfiltered", None), ("filtered", FILTERED)):
            total, hits, stages = [], [], {}
            for _ in range(repeats):
                for q in queries or QUERIES:
                    began = time.perf_counter()
                    found = engine.timed_search(spark.createDataFrame([("q", q)], "query_id string, text string"), method, 10, candidates, filters)
                    hits.append(found.hits.count())
                    total.append((time.perf_counter() - began) * 1000)
                    for stage, ms in found.timings_ms.items():
                        stages.setdefault(stage, []).append(ms)
            out.append({
                "method": method, "filters": name, "n": len(total), "p50_ms": round(nearest_rank(total, 50), 1), "p95_ms": round(nearest_rank(total, 95), 1), "mean_ms": round(sum(total) / max(len(total), 1), 1),
                "mean_hits": round(sum(hits) / max(len(hits), 1), 1), "stages_p50_ms": {k: round(nearest_rank(v, 50), 1) for k, v in stages.items()},
            })
    return out
