import random

import pytest

from claimloom.llm import splits

SCHEMA = "query_id string, patent_id string, component int, split string, m map<string,int>"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in pairs:
        find("r" + r)
        if e:
            a, b = find("r" + r), find("e" + e)
            parent[a] = b
    groups = {}
    for r, _ in pairs:
        groups.setdefault(find("r" + r), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


@pytest.mark.parametrize("n,entities", [(80, 60), (40, 200), (60, 3)])
def test_components(spark, n, entities):
    rng = random.Random(n)
    pairs = [(f"q{rng.randint(0, n)}", rng.choice([None, "", f"p{rng.randint(0, entities)}"])) for _ in range(n * 2)]
    pairs += [("hub", f"p{i}") for i in range(entities // 20)]
    messy = [(rng.choice(["", " "]) + (q.upper() if rng.random() < 0.3 else q), p and rng.choice(["", "  "]) + p) for q, p in pairs]
    df = spark.createDataFrame([(q, p, 1, "x", None) for q, p in messy], SCHEMA)
    got = {r.record: r.component for r in splits.record_components(df, "query_id", "patent_id").collect()}
    want = brute(pairs)
    assert got == want
    linked = {r.record for r in splits.record_components(df, "query_id", "patent_id").where("linked").collect()}
    assert linked == {r for r, c in want.items() if sum(x == c for x in want.values()) > 1}


def test_long_chain(spark):
    rows = [(f"q{i:03d}", f"p{j}", 1, "", None) for i in range(200) for j in (i, i + 1)]
    got = splits.record_components(spark.createDataFrame(rows, SCHEMA), "query_id", "patent_id")
    assert {r.component for r in got.collect()} == {"q000"} and got.count() == 200


def test_splits(spark):
    rng = random.Random(4)
    rows = [(f"q{rng.randint(0, 400)}", f"p{rng.randint(0, 3000)}", i, "old", {"a": 1}) for i in range(600)]
    rows += [(None, "p1", 1, "", None), (None, "zzz", 2, "", None), (None, None, 3, "", None), (" ", "", 4, "", None), ("q1", None, 5, "", None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    shares = {"train": 8, "validation": 1, "test": 1}
    got = splits.grouped_splits(df, "query_id", "patent_id", shares)
    assert got.columns == ["query_id", "patent_id", "m", "component", "split"] and got.count() == len(rows)
    for c in ("query_id", "patent_id"):
        tidy = splits.tidy(c)
        assert got.where(tidy.isNotNull()).groupBy(tidy).agg({"split": "count"}).count() == got.where(tidy.isNotNull()).select(tidy, "split").distinct().count()
    assert sorted(map(str, got.collect())) == sorted(map(str, splits.grouped_splits(df, "query_id", "patent_id", shares).collect()))
    assert sum(r.share for r in splits.reached_shares(got).collect()) == pytest.approx(1)
    assert splits.grouped_splits(df.limit(0), "query_id", "patent_id", shares).count() == 0
    for bad in ({"a": 0}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            splits.grouped_splits(df, "query_id", "patent_id", bad)


def test_proportions(spark):
    df = spark.range(20_000).selectExpr("concat('q', id) query_id", "cast(null as string) patent_id")
    got = {r.split: r.share for r in splits.reached_shares(splits.grouped_splits(df, "query_id", "patent_id", {"a": 0.7, "b": 0.3})).collect()}
    assert abs(got["a"] - 0.7) < 0.02
