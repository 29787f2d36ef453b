import math

import pytest
from pyspark.sql import functions as F

from claimloom.operators import evalset, ltr, metrics, pooling, significance


def run_of(spark, **systems):
    rows = [(s, "q", r, i + 1) for s, ranked in systems.items() for i, r in enumerate(ranked)]
    return spark.createDataFrame(rows, "system string, query_id string, record_id string, rank int")


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1)], "query_id string, record_id string, grade int")


def test_metrics(spark, qrels):
    run = run_of(spark, perfect="abcxy", reverse="cbaxy", none="xyz", single="a", third="xya", gaps="axby")
    queries = spark.createDataFrame([("q",), ("empty",)], "query_id string")
    got = {(r.system, r.query_id): r for r in metrics.evaluate(run, qrels, queries, (2, 4, 5, 10)).collect()}
    v = lambda s, m: got[s, "q"][m]
    assert v("perfect", "recall@5") == 1 and abs(v("perfect", "recall@2") - 2 / 3) < 1e-12
    assert v("single", "precision@5") == 0.2 and v("perfect", "ndcg@5") == 1 and v("reverse", "ndcg@5") < 1
    assert abs(v("third", "mrr@10") - 1 / 3) < 1e-12 and v("third", "mrr@2") == 0
    assert abs(v("gaps", "map@4") - (1 + 2 / 3) / 3) < 1e-12
    dcg2 = 7 + 3 / math.log2(3)
    assert abs(v("gaps", "ndcg@2") - 7 / dcg2) < 1e-12
    assert v("none", "success@5") == 0 and v("none", "recall_ceiling@2") == pytest.approx(2 / 3)
    assert v("perfect", "precision@5_strict") == 0.4 and v("perfect", "success@5_strict") == 1
    assert all(x == 0 for m, x in got["perfect", "empty"].asDict().items() if "@" in m)


def test_macro_average(spark):
    per = spark.createDataFrame([("s", "q1", 1.0), ("s", "q2", None)], "system string, query_id string, a double")
    assert metrics.macro_average(per).first().a == 0.5


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 31)], "g string, v double")
    r = metrics.nearest_rank(df, "g", "v").first()
    want = lambda p: sorted(range(1, 31))[int(round(p / 100 * 29))]
    assert (r.p50, r.p95, r.n) == (want(50), want(95), 30)
    arr = df.agg(metrics.percentile(F.collect_list("v"), 50).alias("p")).first().p
    assert arr == want(50)


def test_pool(spark):
    run = run_of(spark, bm25=["r1", "r2"], dense=["r2", "r3"])
    pool = pooling.build_pool(run)
    got = {r.record_id: (r.found_by, r.best_rank) for r in pool.collect()}
    assert got == {"r1": (["bm25"], 1), "r2": (["bm25", "dense"], 1), "r3": (["dense"], 2)}
    assert pooling.build_pool(run_of(spark, a=[str(i) for i in range(50)]), 5).count() == 5
    s = pooling.pool_stats(pool).first()
    assert (s.queries, s.total_candidates, s.max_pool_size, s.mean_found_by_multiple_systems) == (1, 3, 3, 1.0)
    assert pooling.pool_stats(pool.limit(0)).first().total_candidates == 0
    cache = spark.createDataFrame([("q", "r1", 3, 2), ("q", "r1", 2, 1)], "query_id string, record_id string, grade int, seq int")
    judged = pooling.first_judgements(cache)
    assert judged.first().grade == 2
    all_judged = {r.record_id: r.grade for r in pooling.judge_pool(pool, judged, F.lit(9)).collect()}
    assert all_judged == {"r1": 2, "r2": 3, "r3": 3}
    assert {r.batch for r in pooling.judge_batches(pool, 2).collect()} == {0, 1}


def test_merge(spark):
    df = lambda rows: spark.createDataFrame(rows, "query_id string, record_id string, grade int")
    s, j = df([("q", "r1", 3), ("q", "r2", 2)]), df([("q", "r1", 1), ("q", "r2", 0)])
    got = lambda **kw: {r.record_id: r.grade for r in pooling.merge_qrels(s, j, **kw).collect()}
    assert got() == {"r1": 1} and got(prefer_judged=False) == {"r1": 3, "r2": 2}
    e = spark.createDataFrame([("q", {"r1": 3}), ("p", {"x": 0})], "query_id string, qrels map<string,int>")
    assert [r.query_id for r in pooling.apply_judgements(e, j).collect()] == ["q"]


def test_significance(spark):
    b, t = significance.paired_bootstrap, significance.paired_t
    assert b([0.5] * 20, [0.5] * 20) == 1.0 and b([0.9] * 30, [0.1] * 30) < 0.05
    noise = [0.1 if i % 2 else -0.1 for i in range(30)]
    assert b([0.5 + n for n in noise], [0.5 - n for n in noise]) > 0.05
    assert b([0.9, 0.1, 0.7], [0.1, 0.2, 0.3]) == b([0.9, 0.1, 0.7], [0.1, 0.2, 0.3])
    assert t([1.0], [0.0]) == 1.0 and t([1, 1], [0, 0]) == 0.0 and t([1, 1], [1, 1]) == 1.0
    with pytest.raises(ValueError):
        t([1], [])
    rows = [(s, f"q{i}", 0.9 if s == "x" else 0.1 + i / 1000) for s in "xy" for i in range(30)]
    per = spark.createDataFrame(rows, "system string, query_id string, m double")
    got = significance.compare_systems(per, "m", "y").collect()
    assert len(got) == 1 and got[0].significant and got[0].n == 30
    assert "x" in significance.significance_table(got)
    assert significance.t_terms(per, "m", "y").first().t > 10
    with pytest.raises(ValueError):
        significance.compare_systems(per, "m", "nobody")


def test_trec(spark):
    lines = [r.line for r in significance.trec_run(run_of(spark, s=["d1", "d2", "d3"]), "hybrid").orderBy("rank").collect()]
    assert lines == ["q Q0 d1 1 1.000000 hybrid", "q Q0 d2 2 0.500000 hybrid", "q Q0 d3 3 0.333333 hybrid"]
    many = spark.range(1, 3300).selectExpr("'q' query_id", "'d' record_id", "cast(id as int) rank")
    assert all(r.line.split()[4] == f"{1 / r['rank']:.6f}" for r in significance.trec_run(many, "h").collect())


def test_eval_set(spark):
    rows = [(f"P{p}:{s}", f"P{p}", kind, f"text {p} {s}", "an abstract", ind) for p in range(4) for s, kind, ind in (("summary", "summary", None), ("abstract", "abstract", None), ("claim:1", "claim", True), ("claim:2", "claim", False), ("description:0-1", "description", None))]
    r = spark.createDataFrame(rows, "record_id string, patent_id string, record_type string, text string, abstract string, is_independent boolean")
    got = {x.query_id: x for x in evalset.build_eval_set(r, 3).collect()}
    assert sorted(got) == ["q000a", "q000c", "q001a", "q001c", "q002a", "q002c"]
    p = got["q000a"].source_patent_id
    assert got["q000a"].qrels == {f"{p}:claim:1": 3, f"{p}:claim:2": 2, f"{p}:description:0-1": 1}
    assert got["q000c"].qrels == {f"{p}:summary": 2, f"{p}:abstract": 2, f"{p}:claim:2": 2, f"{p}:description:0-1": 1}
    q = spark.createDataFrame([("q", "text x", "P1", {"P1:claim:1": 3, "P2:claim:1": 1})], "query_id string, text string, source_patent_id string, qrels map<string,int>")
    assert evalset.cross_patent(q).first().asDict() == {"pairs": 2, "cross_patent": 1, "grade_1": 1, "grade_2": 0, "grade_3": 1}
    assert evalset.overlap_report(q, r).first().n == 1
    assert evalset.paraphrase(q, lambda t: 1 / 0).count() == 0
    assert evalset.paraphrase(q, lambda t: t.upper()).first().text == "TEXT X"


def test_ltr(spark, tmp_path):
    rows = [(f"q{p % 6}", f"P{p}:{r}", f"P{p}", [1.0 / (60 + r)] * 6 + [0.0] * 10, 3 if r < 2 else 1 if r < 5 else 0) for p in range(24) for r in range(10)]
    rows += [("q", "x", "P1", [0.0] * 15, 1), ("q", "x", "P1", [float("nan")] * 16, 1), (" Q0 ", "P0:0", "p0", [1.0] * 16, 3), ("q", "y", "P1", [0.0] * 16, -1), ("q", "y", "P1", [0.0] * 16, None)]
    raw = spark.createDataFrame(rows, "query_id string, record_id string, patent_id string, features array<double>, label int")
    usable = ltr.usable_rows(raw).cache()
    assert usable.count() == 240
    split = ltr.split_by_patent(usable).cache()
    sides = {s: {r.patent_id for r in split.where(f"split = '{s}'").collect()} for s in ("train", "test")}
    assert not sides["train"] & sides["test"] and len(sides["train"]) == 18
    model = ltr.train(split, iterations=5)
    out = model.transform(split).groupBy("label").agg(F.avg("rerank_score").alias("s")).collect()
    by = {r.label: r.s for r in out}
    assert by[3] > by[1] > by[0]
    ltr.save(model, str(tmp_path))
    assert ltr.load(str(tmp_path)).transform(split).count() == 240
    spark.createDataFrame([('["other"]',)], "names string").write.mode("overwrite").text(str(tmp_path / "features"))
    with pytest.raises(ValueError):
        ltr.load(str(tmp_path))
    with pytest.raises(ValueError):
        ltr.train(split.where("split = 'test'"))
    assert ltr.report(split, model)["rows"]["train"] == 180


def test_features(spark):
    h = spark.createDataFrame([("q", "r", "wide rims here", "wide rims of steel", "rims", 1, None, 0.5, "claim", 1), ("q", "s", "", None, None, None, None, None, "summary", None)], "query_id string, record_id string, query string, text string, title string, bm25_rank int, vector_rank int, score double, record_type string, claim_number int")
    a, b = (r.asDict() for r in ltr.features(h).orderBy("record_id").collect())
    assert a["bm25_rr"] == 1 / 61 and a["bm25_only"] == 1 and a["vec_rr"] == 0 and a["is_claim"] == 1 and a["is_independent"] == 1
    assert a["claim_number_norm"] == pytest.approx(1 / math.log2(3)) and a["term_overlap"] == pytest.approx(2 / 3) and a["title_overlap"] == pytest.approx(1 / 3)
    assert b["claim_number_norm"] == 1.0 and b["term_overlap"] == 0 and b["found_by_both"] == 0


def test_registered_reranker_is_fully_trained(spark, sf, monkeypatch):
    """The query trains with the operator's own number of trees, 300 as in the reference."""
    import inspect

    from claimloom.plans import queries

    used, real = [], ltr.train

    def few(rows, *args, **kw):
        used.append(inspect.signature(real).bind(rows, *args, **kw))
        used[-1].apply_defaults()
        return real(rows, iterations=2)

    monkeypatch.setattr(ltr, "train", few)
    assert queries.ltr_rerank(spark, sf).count() > 0
    assert [u.arguments["iterations"] for u in used] == [300]
