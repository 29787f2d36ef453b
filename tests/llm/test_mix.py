import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import mix

DOC, WEIGHT = "doc_id long, source string, text string, rate double, label string", "source string, weight double, max_repeats int"


def mixture(spark, docs, weights, **kw):
    d = spark.createDataFrame([(i, s, t, 0.5, "x") for i, (s, t) in enumerate(docs)], DOC)
    return mix.Mixture(d, "source", "text", "doc_id", spark.createDataFrame(weights, WEIGHT), **kw)


def documents():
    words = {"a": "tire rim hub spoke", "b": "polymer resin foam", "c": "court ruling appeal"}
    return [(s, f"{words[s]} {words[s]} number {i}") for s, n in (("a", 300), ("b", 60), ("c", 20)) for i in range(n)]


def test_targets_and_caps(spark):
    docs = [(" A " if i % 9 == 0 and s == "a" else s, t) for i, (s, t) in enumerate(documents())]
    m = mixture(spark, docs, [("a", 1.0, 1), ("B", 2.0, 3), ("c", 7.0, None), ("none", 1.0, 2), ("zero", 0.0, 1)])
    r = {x.source: x for x in m.report().collect()}
    size = {s: sum(len(t.split()) for k, t in documents() if k == s) for s in "abc"}
    assert {s: r[s].size for s in "abc"} == size and r["none"].size == 0
    total = sum(size.values())
    for s, w, cap in (("a", 1, 1), ("b", 2, 3), ("c", 7, 1)):
        target = total * w / 11
        assert r[s].target_size == pytest.approx(target) and r[s].short == (size[s] * cap < target)
        assert r[s].expected_size == pytest.approx(min(target, cap * size[s]), rel=1e-3)
    assert r["none"].short and not r["zero"].short and r["zero"].expected_size < 1e-3 and r["zero"].planned_size == 0
    assert sum(x.reached_share for x in r.values()) == pytest.approx(1)
    plan = m.plan("doc_id")
    got = {x.source: x.n for x in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    assert got["a"] == pytest.approx(r["a"].expected_size, rel=0.25) and got["c"] == size["c"]
    assert plan.where("source = 'b' AND copies > 3 OR source = 'a' AND copies > 1").count() == 0
    assert {s: n for s, n in got.items()} == {s: r[s].planned_size for s in "abc"}
    assert all(x.converged and x.moved < mix.TOLERANCE for x in r.values())


def test_unlabelled_documents_count_by_posterior(spark):
    docs = documents() + [(None, "court ruling appeal court ruling appeal number 5")] * 30 + [("", "tire rim hub spoke")] * 2
    m = mixture(spark, docs, [("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)])
    r = {x.source: x for x in m.report().collect()}
    own = sum(len(t.split()) for k, t in documents() if k == "c")
    assert r["c"].size == own and r["c"].expected_size > 1.5 * own  # they helped a scarce source
    assert m.plan("doc_id").where("source IS NULL").count() >= 25


def test_classifier_accuracy():
    docs = documents()
    train, held = docs[::2], docs[1::2]
    names = ["a", "b", "c"]
    c = mix.SourceClassifier([t for _, t in train], [names.index(s) for s, _ in train], 3)
    p = c.posteriors([t for _, t in held])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.mean(p.argmax(axis=1) == [names.index(s) for s, _ in held]) > 0.95


def test_dirty_and_empty(spark):
    docs = [("a", None), ("a", ""), ("x", "not listed"), ("a", "w " * 100_000), (None, None)]
    weights = [("a", 1.0, -1), (" A", float("nan"), 2), (None, 3.0, 1), ("b", -1.0, 1), ("c", None, 0)]
    r = {x.source: x for x in mixture(spark, docs, weights).report().collect()}
    assert r["a"].size == 100_000 and r["a"].max_repeats == 2 and r["b"].target_share == 0 and r["c"].max_repeats == 0
    assert mixture(spark, [], weights).report().count() == 3
    empty = mixture(spark, docs, [])
    assert empty.report().count() == 0 and empty.plan("doc_id").count() == 0
    assert mixture(spark, [], []).plan("doc_id").count() == 0


def test_tokenizer_sizes():
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    sizes = mix.tokenizer_sizes(path)
    assert sizes(["", "hello world", "<|endoftext|>"])[:2] == [0, 2]


def test_a_fit_that_is_cut_off_says_so(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_ROUNDS", 1)
    monkeypatch.setattr(mix, "TOLERANCE", 0.0)
    m = mixture(spark, documents(), [("a", 1.0, 1), ("b", 2.0, 3), ("c", 7.0, None)])
    r = m.report().collect()
    assert not any(x.converged for x in r) and {x.rounds for x in r} == {1} and min(x.moved for x in r) > 0
    got = {x.source: x.n for x in m.plan("doc_id").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    assert {x.source: x.planned_size for x in r} == pytest.approx(got)  # report and plan describe the same mix


def test_a_label_is_a_prior():
    sure = np.array([[0.98, 0.02], [1e-7, 1 - 1e-7], [0.3, 0.7]], np.float32)
    at, p = mix.membership(sure, np.array([0, 0, -1]))
    own = [{int(d): float(x) for d, x in zip(a, b)} for a, b in zip(at, p)]
    assert own[0][0] > 0.999 and own[1][1] > 0.99 and own[2][1] == pytest.approx(0.7)
    many = np.full((1, 40), 1 / 40, np.float32)
    at, p = mix.membership(many, np.array([7]))
    assert at.shape == (1, mix.MOST_DOMAINS) and p.sum() == pytest.approx(1) and p[0][list(at[0]).index(7)] > 0.99
