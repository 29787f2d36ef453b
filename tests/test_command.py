import json

import pytest

from claimloom.__main__ import main
from claimloom.operators import evalset
from claimloom.plans.engine import check_request, hashing_engine
from claimloom.operators.filters import Filters
from claimloom.plans.training import train_and_evaluate
from claimloom.sources.files import read_eval_set, read_judgements, write_eval_set, write_report


def test_from_files_to_scores(spark, tmp_path, capsys):
    word = lambda i: f"part{i} element{i % 3}"
    records = [{"title": f"THING {word(i)}", "doc_number": f"P{i:02d}", "abstract": f"A {word(i)} is held.", "detailed_description": [f"The {word(i)} in detail."], "claims": [f"1 . A {word(i)}.", "2 . The thing of claim 1 ."], "classification": "B60B1"} for i in range(12)]
    (tmp_path / "patents_0.json").write_text(json.dumps(records))
    paths = {n: str(tmp_path / n) for n in ("records", "jobs", "index", "eval.jsonl")}
    for _ in range(2):
        main(["ingest", str(tmp_path), paths["records"], "--jobs", paths["jobs"], "--reports", str(tmp_path / "reports")])
    reports = {n: {r["key"]: r["value"] for r in json.loads((tmp_path / "reports" / f"{n}.json").read_text())} for n in ("data_quality", "extraction_quality")}
    assert reports["data_quality"]["patents_loaded"] == 12 and reports["extraction_quality"]["claims_total"] == 24 and reports["extraction_quality"]["numbers_given_twice"] == 0
    said = capsys.readouterr().out
    assert "queued 12, skipped 0" in said and "queued 0, skipped 12" in said
    main(["index", paths["records"], paths["index"]])
    main(["search", paths["index"], "part7", "--top-k", "3"])
    assert "P07" in capsys.readouterr().out
    table = spark.read.parquet(paths["records"])
    queries = evalset.build_eval_set(table, 12)
    write_eval_set(queries, {}, paths["eval.jsonl"])
    main(["index", paths["records"], paths["index"], "--keep"])
    assert "kept" in capsys.readouterr().out
    main(["evaluate", paths["index"], paths["eval.jsonl"], "--method", "bm25", "--method", "hybrid_reranked", "--trec", str(tmp_path / "trec"), "--prefix", "a"])
    said = capsys.readouterr().out
    assert all(x in said for x in ("hybrid_reranked", "recall ceilings", "paired bootstrap test", "delta=", "first graded record"))
    assert spark.read.text(str(tmp_path / "trec" / "bm25")).first().value.split()[1] == "Q0"
    for _ in range(2):  # the second time all judgements are in the cache
        main(["qrels", paths["index"], paths["eval.jsonl"], str(tmp_path / "judged"), str(tmp_path / "pooled.jsonl"), "--method", "bm25"])
        merged, notes = read_eval_set(spark, str(tmp_path / "pooled.jsonl"))
        assert notes["pooled"] and merged.count() > 0
    cache = read_judgements(spark, str(tmp_path / "judged"))
    assert cache.count() == cache.select("query_id", "record_id").distinct().count() > 0
    main(["train", paths["index"], paths["eval.jsonl"], str(tmp_path / "model"), "--trees", "2"])
    main(["search", paths["index"], "part7", "--method", "hybrid_reranked", "--reranker", "ltr", "--model", str(tmp_path / "model")])
    capsys.readouterr()
    main(["benchmark", paths["index"], "--method", "bm25", "--repeats", "1"])
    rows = json.loads(capsys.readouterr().out)
    assert [(r["method"], r["filters"], r["n"]) for r in rows] == [("bm25", "unfiltered", 10), ("bm25", "filtered", 10)] and rows[0]["stages_p50_ms"]["total"] > 0
    write_report(table.groupBy("record_type").count(), str(tmp_path / "report.json"))
    assert len(json.loads((tmp_path / "report.json").read_text())) == 4
    result = train_and_evaluate(hashing_engine(table), queries, depth=20, test_fraction=0.4, iterations=3)
    systems = {r.system: r for r in result["systems"].collect()}
    assert set(systems) == {"hybrid", "hybrid+model"} and systems["hybrid"]["recall@50"] == systems["hybrid+model"]["recall@50"]
    assert {c.metric for c in result["comparisons"]} == {"ndcg@10", "recall@10", "recall@50"}


def test_requests():
    check_request("x", Filters(classification_prefix="B60B"))
    for query, filters in (("", None), ("x" * 8001, None), ("x", Filters(classification_prefix="x" * 17)), ("x", Filters(exact_title="x" * 401))):
        with pytest.raises(ValueError):
            check_request(query, filters)
