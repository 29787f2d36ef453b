"""Training a ranking model on a search engine's own hits, and its evaluation on held-out queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import ltr, metrics, significance
from claimloom.plans.engine import SearchEngine
from claimloom.session import materialise


def train_and_evaluate(engine: SearchEngine, eval_queries: DataFrame, depth: int = 50, test_fraction: float = 0.25, iterations: int = 300, measures: tuple[str, ...] = ("ndcg@10", "recall@10", "recall@50")) -> dict:
    """A model trained on hybrid hits, and how it does against them: {model, report, systems, comparisons, leaky_queries}.

    Patents are split; a query is held out if its own patent is in the test part, and candidates of test patents are
    never trained on. leaky_queries counts the held-out queries of which some row was trained on, as its candidate's
    patent is in the training part. Reranking only reorders, so recall@50 must come out equal.
    """
    qrels = metrics.explode_qrels(eval_queries)
    hits = materialise(engine.hits(eval_queries.select("query_id", "text"), "hybrid", depth, depth))
    rows = ltr.split_by_patent(ltr.label_rows(ltr.features(hits), qrels), test_fraction)
    model = ltr.train(rows, iterations)
    patents = rows.select("patent_id", "split").distinct()
    held = eval_queries.join(patents.where("split = 'test'"), eval_queries["source_patent_id"] == patents["patent_id"], "left_semi").select("query_id")
    before = hits.join(held, "query_id", "left_semi")
    after = ltr.rerank_with_model(model, before)
    run = before.select(F.lit("hybrid").alias("system"), "query_id", "record_id", "rank").unionByName(after.select(F.lit("hybrid+model").alias("system"), "query_id", "record_id", "rank"))
    per_query = materialise(metrics.evaluate(run, qrels, held))
    return {
        "model": model,
        "report": ltr.report(rows, model),
        "systems": metrics.macro_average(per_query),
        "comparisons": [r for m in measures for r in significance.compare_systems(per_query, m, "hybrid").collect()],
        "leaky_queries": rows.where("split = 'train'").join(held, "query_id", "left_semi").select("query_id").distinct().count(),
    }
