"""Command line: python -m claimloom {ingest,index,search,evaluate,qrels,train,benchmark} ...

Under spark-submit it runs on the session that spark-submit configures.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from claimloom.functions.analyzer import SYNONYM_GROUPS, canonical_synonyms
from claimloom.functions.models import embedder, reranker
from claimloom.functions.text import lexical_overlap
from claimloom.operators import evalset, lexical, ltr, significance
from claimloom.operators.filters import Filters
from claimloom.plans import benchmark, evaluation, training
from claimloom.plans.engine import METHODS, SearchEngine
from claimloom.plans.reports import write_reports
from claimloom.session import session
from claimloom.sources.corpus import load_corpus
from claimloom.sources.files import append_judgements, read_eval_set, read_judgements, read_synonyms, write_eval_set
from claimloom.streaming.ingest import JobTable, RecordTable, ingest_batch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="corpus files to record tables, new and changed patents only")
    a.add_argument("corpus"), a.add_argument("records"), a.add_argument("--jobs", required=True), a.add_argument("--parser-version", default="1"), a.add_argument("--reports", help="folder for the quality reports")
    models = argparse.ArgumentParser(add_help=False)
    models.add_argument("--synonyms", help="a synonym file instead of the built-in groups"), models.add_argument("--embedder", default="hashing:32"), models.add_argument("--reranker", default="overlap"), models.add_argument("--model", help="folder of a trained ranking model, for --reranker ltr")
    a = sub.add_parser("index", parents=[models], help="record table to a lexical index")
    a.add_argument("records"), a.add_argument("index"), a.add_argument("--keep", action="store_true", help="leave an index that is there as it is")
    a = sub.add_parser("search", parents=[models])
    a.add_argument("index"), a.add_argument("query"), a.add_argument("--method", choices=METHODS, default="bm25"), a.add_argument("--top-k", type=int, default=10), a.add_argument("--candidates", type=int, default=50)
    a.add_argument("--classification-prefix"), a.add_argument("--title-keyword"), a.add_argument("--abstract-keyword"), a.add_argument("--exact-title"), a.add_argument("--record-type", action="append", default=[]), a.add_argument("--independent-only", action="store_true"), a.add_argument("--exclude-patent")
    several = argparse.ArgumentParser(add_help=False)
    several.add_argument("index"), several.add_argument("eval_set"), several.add_argument("--method", action="append", dest="methods", choices=METHODS)
    a = sub.add_parser("evaluate", parents=[models, several], help="metrics of several methods, compared with the first")
    a.add_argument("--test", choices=["bootstrap", "t"], default="bootstrap"), a.add_argument("--trec", help="folder for the runs"), a.add_argument("--prefix", help="a phrase put before each query, as a paraphrase")
    a = sub.add_parser("qrels", parents=[models, several], help="pooled candidates judged by word overlap, merged into the evaluation set")
    a.add_argument("judgements"), a.add_argument("out")
    a = sub.add_parser("train", parents=[models], help="a ranking model from the hybrid hits of an evaluation set")
    a.add_argument("index"), a.add_argument("eval_set"), a.add_argument("out"), a.add_argument("--trees", type=int, default=300)
    a = sub.add_parser("benchmark", parents=[models], help="latencies of single searches")
    a.add_argument("index"), a.add_argument("--method", action="append", dest="methods", choices=METHODS), a.add_argument("--repeats", type=int, default=3)
    return p


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = session()
    if args.command == "ingest":
        patents, issues = load_corpus(spark, args.corpus)
        queued, skipped = ingest_batch(patents, JobTable(spark, args.jobs), RecordTable(spark, args.records).append, args.parser_version)
        print(f"queued {queued}, skipped {skipped}, issues {issues.count()}")
        if args.reports:
            write_reports(patents, issues, args.reports)
        return
    synonyms = canonical_synonyms(read_synonyms(args.synonyms) if args.synonyms else SYNONYM_GROUPS)
    if args.command == "index":
        if args.keep and lexical.LexicalIndex.exists(spark, args.index):
            print("kept")
            return
        records = RecordTable(spark, args.records).read().dropDuplicates(["record_id"]).withColumn("embedding", embedder(args.embedder)(F.col("text")))
        lexical.build_index(records, synonyms=synonyms).write(args.index)
        return
    index = lexical.LexicalIndex.read(spark, args.index)
    scorer = reranker(args.reranker, ltr.load(args.model) if args.model else None)
    engine = SearchEngine(index.docs, index, embed=embedder(args.embedder, queries=True), scorer=scorer, synonyms=synonyms)
    if args.command == "search":
        filters = Filters(classification_prefix=args.classification_prefix, title_keyword=args.title_keyword, abstract_keyword=args.abstract_keyword, exact_title=args.exact_title, record_types=args.record_type, independent_only=args.independent_only, exclude_patent=args.exclude_patent)
        found = engine.timed_search(spark.createDataFrame([("q", args.query)], "query_id string, text string"), args.method, args.top_k, args.candidates, filters)
        engine.served_patents(found.patents).orderBy("rank").show(args.top_k, False)
        print(json.dumps(found.timings_ms))
        return
    if args.command == "benchmark":
        print(json.dumps(benchmark.benchmark(engine, args.methods or ["bm25", "dense", "hybrid"], args.repeats), indent=1))
        return
    queries, notes = read_eval_set(spark, args.eval_set)
    if args.command == "evaluate":
        if args.prefix:
            queries = evalset.paraphrase(queries, lambda t: f"{args.prefix} {t}")
        result = evaluation.evaluate_methods(engine, queries, args.methods or ["bm25", "dense", "hybrid"], test=args.test)
        print(evaluation.printed(result))
        if args.trec:
            run, _ = evaluation.run_systems(engine, queries, args.methods or ["bm25", "dense", "hybrid"])
            for m in args.methods or ["bm25", "dense", "hybrid"]:
                significance.trec_run(run.where(F.col("system") == m), m).orderBy("query_id", "rank").select("line").write.mode("overwrite").text(f"{args.trec}/{m}")
    elif args.command == "qrels":
        cache = read_judgements(spark, args.judgements)
        assess = F.round(lexical_overlap(F.col("query"), F.col("text")) * 3).cast("int")
        merged, judged, stats = evaluation.pooled_qrels(engine, queries, args.methods or ["bm25", "dense", "hybrid"], assess, cache)
        append_judgements(judged, args.judgements)
        write_eval_set(merged.select(*queries.columns), {**notes, "pooled": True}, args.out)
        print(json.dumps(stats.first().asDict()))
    else:
        result = training.train_and_evaluate(engine, queries, iterations=args.trees)
        ltr.save(result["model"], args.out)
        print(json.dumps(result["report"]))
        print(significance.comparison_table(result["systems"].orderBy("system").collect(), ["ndcg@10", "recall@10", "recall@50"]))
        print(significance.significance_table(result["comparisons"]))


if __name__ == "__main__":
    main()
