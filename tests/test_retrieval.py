import math

import pytest
from pyspark.sql import functions as F

from claimloom.functions.text import hashing_embedding
from claimloom.operators import dense, fusion, lexical, rerank
from claimloom.operators.filters import Filters
from claimloom.plans.engine import SearchEngine, StageTimer

DOCS = [("P1:summary", "P1", "summary", "Tire with rim", "a rubber tire on a rim", "abs", "B60C1", None, None), ("P1:claim:1", "P1", "claim", "Tire with rim", "a rim and a hub", "abs", "B60C1", 1, True), ("P2:claim:1", "P2", "claim", "Hub", "hub hub hub", None, "C08L2", 1, False), ("P3:claim:1", None, "claim", None, None, None, None, None, None)]
SCHEMA = "record_id string, patent_id string, record_type string, title string, text string, abstract string, classification_raw string, claim_number int, is_independent boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumn("embedding", hashing_embedding(F.col("text"), 8)).cache()


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_bm25_by_hand(spark, docs):
    index = lexical.build_index(docs, stem=False)
    got = {r.record_id: r.score for r in lexical.bm25_search(index, queries(spark, "hub"), 5, stem=False).collect()}
    # stop words are out
    lengths = {"P1:summary": 3, "P1:claim:1": 2, "P2:claim:1": 3}
    avg = sum(lengths.values()) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    part = lambda tf, dl: idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    title = math.log(1 + (3 - 1 + 0.5) / 1.5) / (1 + 1.2 * (0.25 + 0.75 * 1 / ((2 + 2 + 1) / 3)))
    assert abs(got["P1:claim:1"] - part(1, 2)) < 1e-3
    assert abs(got["P2:claim:1"] - max(part(3, 3), 2 * title)) < 1e-3
    assert "P3:claim:1" not in got and "P1:summary" not in got


def test_adversarial_queries(spark, docs):
    index = lexical.build_index(docs)
    bad = ["", None, "   ", "???", "\U0001f600", "a" * 9000, "the of and", "' OR 1=1 --", "\u0000x", "hub " * 500]
    assert lexical.bm25_search(index, queries(spark, *bad), 5).where("query_id != 'q9'").count() == 0


def test_blocks_agree(spark, docs, monkeypatch):
    q = queries(spark, "rim hub", "tire", "rubber rim")
    index = lexical.build_index(docs)
    whole = sorted(map(tuple, lexical.bm25_search(index, q, 3).collect()))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, lexical.bm25_search(index, q, 3).collect())) == whole


def test_index_round_trip(spark, docs, tmp_path):
    index = lexical.build_index(docs)
    index.write(str(tmp_path))
    again = lexical.LexicalIndex.read(spark, str(tmp_path))
    q = queries(spark, "rim hub")
    assert sorted(map(tuple, lexical.bm25_search(again, q, 3).collect())) == sorted(map(tuple, lexical.bm25_search(index, q, 3).collect()))


@pytest.mark.parametrize("f,want", [
    (Filters(), 4), (Filters(classification_prefix="B60"), 2), (Filters(classification_prefix="b60"), 0), (Filters(title_keyword="hub tires"), 3), (Filters(exact_title="Hub"), 1), (Filters(record_types=["claim"]), 3),
    (Filters(independent_only=True), 1), (Filters(exclude_patent="P1"), 2), (Filters(classification_prefix="B60", record_types=["claim"], exclude_patent="P9"), 1),
])
def test_filters(docs, f, want):
    assert f.apply(docs).count() == want
    assert f.is_empty == (f == Filters())


def test_prefix_reaches_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "r"))
    df = Filters(classification_prefix="B60").apply(spark.read.parquet(str(tmp_path / "r"))).select("record_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(classification_raw,B60)" in plan and "embedding" not in plan


def test_dense(spark):
    r = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("l", [1.0]), ("x", [float("nan"), 1.0])], "record_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [5.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "query_id string, vector array<double>")
    got = [tuple(x) for x in dense.dense_search(r, q, 2).orderBy("rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "c", 0.70711, 2)]
    assert dense.dense_search(r, q.limit(0), 2).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame([("q", r, i + 1) for i, r in enumerate(rows)], "query_id string, record_id string, rank int")


def test_fusion(spark):
    top = fusion.fuse(ranked(spark, "xy"), ranked(spark, "xz"), 10).orderBy("rank").collect()
    assert [r.record_id for r in top] == ["x", "y", "z"]
    both = fusion.fuse(ranked(spark, "ab"), ranked(spark, "ba"), 10).orderBy("rank").collect()
    assert abs(both[0].score - (1 / 61 + 1 / 62)) < 1e-12 and both[0].record_id == "a"
    assert fusion.fuse(ranked(spark, "abcdefghijklmnopqrst"), ranked(spark, ""), 5).count() == 5


def test_grouping(spark):
    rows = [("q", "p1", "a", 5.0, 1), ("q", "p2", "c", 4.0, 2), ("q", "p1", "b", 3.0, 3)]
    hits = spark.createDataFrame(rows, "query_id string, patent_id string, record_id string, score double, rank int")
    got = fusion.group_hits(hits).orderBy("rank").collect()
    assert [(r.patent_id, r.best, r.supporting) for r in got] == [("p1", "a", ["b"]), ("p2", "c", [])]
    assert abs(got[0].score - 5.9) < 1e-9 and got[1].score == 4.0
    many = spark.createDataFrame([("q", "p", str(i), 10.0 if i == 0 else 1.0, i + 1) for i in range(11)], hits.schema)
    assert fusion.group_hits(many, alpha=1.0).first().score == 11.0 and fusion.group_hits(hits, alpha=0.0).orderBy("rank").first().score == 5.0


def test_rerank_keeps_candidates(spark):
    hits = spark.createDataFrame([("q", c, float(9 - i), i + 1, "rim hub", "rim" if c == "c" else "x") for i, c in enumerate("abcde")], "query_id string, record_id string, score double, rank int, query string, text string")
    same = rerank.rerank(hits, rerank.identity_score()).orderBy("rank").collect()
    assert [r.record_id for r in same] == list("abcde") and [r.rerank_score for r in same] == [5, 4, 3, 2, 1]
    assert [r.record_id for r in rerank.rerank(hits, rerank.overlap_score()).orderBy("rank").collect()] == list("cabde")
    graded = rerank.model_grades(hits, lambda: lambda q, texts: '[{"id": 1, "score": 3}, {"id": 77, "score": 9}]')
    assert {r.record_id: r.rerank_score for r in graded.collect()} == {"a": 1.0, "b": 3.0, "c": 1.0, "d": 1.0, "e": 1.0}
    assert rerank.parse_grades("no json", 2) == [1.0, 1.0]
    load = lambda: lambda pairs: [len(t) for _, t in pairs]
    assert rerank.rerank(hits, rerank.pair_model_score(load)("query", "text")).orderBy("rank").first().record_id == "c"


def test_engine(spark, docs):
    embed = lambda c: hashing_embedding(c, 8)
    bare, full = SearchEngine.over(docs), SearchEngine.over(docs, embed=embed, scorer=rerank.overlap_score)
    assert bare.capabilities() == ["bm25"] and len(full.capabilities()) == 4
    for kw in (dict(method="x"), dict(method="dense"), dict(method="bm25", top_k=0), dict(method="bm25", top_k=60, candidates=50), dict(method="bm25", candidates=500)):
        with pytest.raises(ValueError):
            bare.hits(queries(spark, "hub"), **kw)
    hits, patents = full.search(queries(spark, "hub rim", "nothing here at all"), method="hybrid_reranked", top_k=3)
    assert hits.where("query_id = 'q0'").count() == 3 and hits.where("rerank_score IS NULL").count() == 0
    assert patents.where("query_id = 'q0'").count() >= 1
    assert full.hits(queries(spark, "hub"), method="bm25").where("bm25_rank IS NOT NULL").count() == 0
    timer = StageTimer()
    assert timer.run("retrieve", lambda: 3) == 3 and set(timer.report()) == {"retrieve", "total"}


def engine_of(spark):
    from claimloom.plans.engine import hashing_engine

    rows = [(f"P{i}:claim:1", f"P{i}", "claim", f"a tyre with groove {i} and fibres", f"TIRE {i % 3}", f"abstract {i}", "B60C", "B60C", 1) for i in range(12)]
    schema = "record_id string, patent_id string, record_type string, text string, title string, abstract string, classification_raw string, classification_subclass string, claim_number int"
    return hashing_engine(spark.createDataFrame(rows, schema), synonyms={"tyre": "tire", "fibre": "fiber"}, scorer="overlap")


def test_engine_stages_and_requests(spark):
    engine = engine_of(spark)
    queries = spark.createDataFrame([("q1", "groove 7"), ("q2", "tire fiber")], "query_id string, text string")
    out = engine.timed_search(queries, "hybrid_reranked", 5, 10)
    assert set(out.timings_ms) == {"embed", "retrieve", "rerank", "aggregate", "total"} and abs(sum(v for k, v in out.timings_ms.items() if k != "total") - out.timings_ms["total"]) < 0.1
    assert sorted(map(tuple, out.hits.select("query_id", "record_id", "rank").collect())) == sorted(map(tuple, engine.hits(queries, "hybrid_reranked", 5, 10).select("query_id", "record_id", "rank").collect()))
    served = engine.served_patents(out.patents).first()
    assert served.supporting_count >= len(served.supporting)
    assert set(engine.timed_search(queries, "bm25").timings_ms) == {"retrieve", "aggregate", "total"}
    assert engine.health()["records"] == 12 and "hybrid_reranked" in engine.health()["methods"]
    for text in ("", "x" * 8001, None):
        with pytest.raises(ValueError):
            engine.hits(spark.createDataFrame([("q", text)], "query_id string, text string"), "bm25")
    engine.hits(spark.createDataFrame([("q", "x" * 8000)], "query_id string, text string"), "bm25")
    # the filter's keyword is analysed with the engine's synonyms, though none were given with it
    assert engine.hits(queries, "bm25", 20, filters=Filters(title_keyword="tyre")).count() > 0


def test_ties_are_cut_by_id():
    import numpy as np
    import pyarrow as pa

    from claimloom.operators.lexical import best_k

    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, (20, 50)).astype(float)
    ids = pa.array([f"r{i:02d}" for i in rng.permutation(50)])
    i, j = best_k(s, 7, ids, 0.0)
    names = ids.to_pylist()
    for q in range(20):
        want = sorted((-s[q, c], names[c]) for c in range(50) if s[q, c] > 0)[:7]
        assert sorted((-s[q, c], names[c]) for c in j[i == q]) == want


def test_registries(spark):
    from claimloom.functions import models

    assert models.parse_spec("hashing") == ("hashing", "32") and models.parse_spec("bge-small")[1] == "BAAI/bge-small-en-v1.5"
    for bad in ("what", "st", "nothing:x", "st:"):
        with pytest.raises(ValueError):
            models.parse_spec(bad)
    hits = spark.createDataFrame([("q", "a tire", f"r{i}", "tire " * i, i + 1) for i in range(13)], "query_id string, query string, record_id string, text string, rank int")
    assert [r.record_id for r in models.reranker("off")(hits).orderBy(F.desc("rerank_score")).limit(2).collect()] == ["r0", "r1"]
    models.register_pair_model("toy-pairs", lambda name: lambda pairs: [float(len(t)) for _, t in pairs])
    assert models.reranker("toy-pairs:x")(hits).orderBy(F.desc("rerank_score")).first().record_id == "r12"
    models.register_grader("toy-grades", lambda name: lambda q, texts: '[{"id": 2, "score": 3}]')
    assert sorted(r.record_id for r in models.reranker("toy-grades:x")(hits).where("rerank_score = 3").collect()) == ["r12", "r2"]
    for bad in ("what", "cross:x", "ltr"):
        with pytest.raises(ValueError):
            models.reranker(bad)
    seen = []
    models.register_loader("bge-toy", lambda name: lambda texts: [[float(len(t))] for t in texts])
    for queries in (False, True):
        seen.append(hits.limit(1).select(models.embedder("bge-toy:bge-x", queries=queries)(F.lit("abc")).alias("v")).first().v[0])
    assert seen == [3.0, 3.0 + len(models.QUERY_PREFIX)]


def test_postings_find_what_a_scan_finds(spark, tmp_path, monkeypatch):
    records = spark.createDataFrame(DOCS + [(f"N{i}", "P9", "claim", "Wheel", f"a wheel number {i % 4} with rim rim", "x", "B60C1", i, True) for i in range(30)], SCHEMA)
    index = lexical.build_index(records)
    queries = spark.createDataFrame([("q1", "rim of a wheel"), ("q2", "hub hub"), ("q3", ""), ("q4", "nothing here")], "query_id string, text string")
    lexical.write_postings(index, str(tmp_path / "postings"))
    table = spark.read.parquet(str(tmp_path / "postings"))
    for most in (5_000, 1):
        monkeypatch.setattr(lexical, "MOST_TERMS", most)
        for filters in (None, Filters(record_types=["claim"], classification_prefix="B60")):
            want = sorted(map(tuple, lexical.bm25_search(index, queries, 7, filters).select("query_id", "record_id", "score", "rank").collect()))
            got = sorted(map(tuple, lexical.postings_search(index, table, queries, 7, filters).select("query_id", "record_id", "score", "rank").collect()))
            assert want == got and len(want) > 7


def test_postings_of_many_queries_are_gathered_once(spark, tmp_path, monkeypatch):
    """no row for each query and record that meet; several blocks and passes of queries find what one does."""
    records = spark.createDataFrame([(f"N{i:03}", "P9", "claim", "Wheel", f"a wheel number {i % 4} with rim {'rim ' * (i % 3)}", "x", "B60C1", i, True) for i in range(200)], SCHEMA)
    index = lexical.build_index(records, counted=True)
    plain = lexical.build_index(records)
    for name in ("terms", "stats"):
        assert sorted(map(tuple, getattr(index, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
    queries = spark.createDataFrame([(f"q{i}", f"rim wheel {i % 5} rim") for i in range(12)] + [("q0", "number"), (None, "wheel 1")], "query_id string, text string")
    lexical.write_postings(index, str(tmp_path / "postings"))
    table = spark.read.parquet(str(tmp_path / "postings"))
    asked = queries.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))  # a query's rows count together
    for filters in (None, Filters(record_types=["claim"])):
        want = sorted(map(repr, lexical.bm25_search(index, asked, 3, filters).select("query_id", "record_id", "score", "rank").collect()))
        assert len(want) == 39
        for block, passes in ((2048, 16), (5, 1), (2, 3)):
            monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
            monkeypatch.setattr(lexical, "PASS_BLOCKS", passes)
            found = lexical.postings_search(index, table, queries, 3, filters)
            assert sorted(map(repr, found.select("query_id", "record_id", "score", "rank").collect())) == want
        monkeypatch.undo()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("query_id" in line for line in grouped)
