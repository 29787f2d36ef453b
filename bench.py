"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Searches run on a warm index, as the published figures do, and as whole query sets: queries a second are in `per_second`.
Every other query is timed from its tables to its last row.
"""

import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import functions as F  # noqa: E402

from claimloom.operators import claims, dense, fusion, lexical, metrics, records, rerank  # noqa: E402
from claimloom.operators.filters import Filters  # noqa: E402
from claimloom.plans import queries as core  # noqa: E402
from claimloom.session import local_session  # noqa: E402

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
OTHERS = ["reconstruct_claims", "chunk_passages", "quality_report", "evaluate_systems", "t_test_terms", "pool_stats", "ltr_features", "group_runs", "latency_percentiles", "job_summary"]
TRAINING = [f"p{n}_found" for n in range(1, 10)]


def seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    spark = local_session(CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    took, per_second = {}, {}
    core.facet_record_type(spark, DIR).count()  # starts the workers

    patents = core._patents(spark, DIR).repartition(int(CPUS)).persist()
    n = patents.count()
    records.build_records(patents.limit(50), claims.reconstruct_claims(patents.limit(50))).count()
    took["record_build"] = seconds(records.build_records(patents, claims.reconstruct_claims(patents)))
    per_second["record_build_patents"] = n / took["record_build"]

    table = core._dense_records(spark, DIR).repartition(int(CPUS)).persist()  # the index's shards
    size = table.count()
    for df in (lexical.build_index(table.limit(2000), synonyms=core.SYNONYMS).docs, lexical.build_index(table.limit(2000), synonyms=core.SYNONYMS).terms):
        df.count()  # compiled before, as a running server has it
    began = time.perf_counter()
    index = lexical.build_index(table, synonyms=core.SYNONYMS).persist()
    took["index_build"] = round(time.perf_counter() - began, 3)
    per_second["index_build_records"] = size / took["index_build"]

    queries, vectors = core._eval(spark, DIR).persist(), core._vectors(spark, DIR).persist()
    asked, known = queries.count(), vectors.count()
    narrow = Filters(classification_prefix="B60", record_types=["claim"])
    words = lambda f=None: lexical.bm25_search(index, queries, 50, f, synonyms=core.SYNONYMS)
    near = lambda f=None: dense.dense_search(table, vectors, 50, f)
    words().count()
    both = fusion.fuse(words(), near(), 50).join(table.select("record_id", "patent_id", "text"), "record_id").join(queries.select("query_id", "text").withColumnRenamed("text", "query"), "query_id")
    searches = {
        "bm25": (lambda: words(), asked), "bm25_filtered": (lambda: words(narrow), asked), "dense": (lambda: near(), known), "dense_filtered": (lambda: near(narrow), known), "hybrid": (lambda: fusion.fuse(words(), near(), 50), asked),
        "hybrid_filtered": (lambda: fusion.fuse(words(narrow), near(narrow), 50), asked), "hybrid_grouped": (lambda: fusion.group_hits(both), asked), "hybrid_reranked": (lambda: rerank.rerank(both, rerank.overlap_score(), 10), asked),
    }
    for name, (search, count) in searches.items():
        began = time.perf_counter()
        search().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        per_second[name] = count / took[name]
    run = fusion.fuse(words(), near(), 50).withColumn("system", F.lit("hybrid"))
    took["evaluate_hybrid"] = seconds(metrics.evaluate(run, metrics.explode_qrels(queries), queries))
    for df in (patents, table, queries, vectors):
        df.unpersist()
    for name in OTHERS:
        took[name] = seconds(core.QUERIES[name](spark, DIR))
    try:
        from claimloom.llm.queries import QUERIES

        for name in TRAINING:
            began = time.perf_counter()
            QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    except ImportError:
        pass
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "per_second": {k: round(v, 1) for k, v in per_second.items()}, "sf": os.path.basename(DIR.rstrip("/")), "cpus": CPUS}))


if __name__ == "__main__":
    main()
