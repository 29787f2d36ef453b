import math
import random

from claimloom.llm import rankfuse

SCHEMA = "run string, item string, s double, t double, b int, place int, fused string"


def brute(rows):
    items = {}
    for run, item, s, t, b, *_ in rows:
        if run is None or item is None:
            continue
        v = items.setdefault((run, item), [None] * 3)
        for i, x in enumerate((s, t, b)):
            if x is not None and not (isinstance(x, float) and math.isnan(x)) and not (i == 2 and x < 1):
                x = x if i == 2 else -x
                v[i] = x if v[i] is None else min(v[i], x)
    out = {}
    for (run, item), v in items.items():
        mates = [w for (r, _), w in items.items() if r == run]
        out[run, item] = [1 + sum(w[i] is not None and (v[i] is None or w[i] < v[i]) for w in mates) for i in range(3)]
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    value = lambda f: rng.choice([None, float("nan"), float("inf"), -1e300, 0.0, -0.0, *[f(rng) for _ in range(6)]])
    rows = [(f"r{rng.randint(0, 2)}", f"i{rng.randint(0, n // 3)}", value(lambda r: r.random()), value(lambda r: float(r.randint(0, 3))), rng.choice([None, 0, -4, 1, 2, 3, rng.randint(1, 50)]), 1, "x") for _ in range(n)]
    return [*rows, *rows[:9], (None, "i", 1.0, 1.0, 1, 1, ""), ("r1", None, 1.0, 1.0, 1, 1, "")]


def test_against_brute_force(spark):
    rows = rows_of(2, 120)
    want = brute(rows)
    for most in (200_000, 4):
        got = rankfuse.fused_ranking(spark.createDataFrame(rows, SCHEMA), "run", "item", ["s", "t"], ["b"], range_rows=most).collect()
        assert {(r.run, r.item): [r.place_s, r.place_t, r.place_b] for r in got} == want
        for r in got:
            assert r.place_sum == sum(want[r.run, r.item])
            assert r.sum_place == 1 + sum(sum(v) < r.place_sum for (run, _), v in want.items() if run == r.run)
            assert abs(r.fused - sum(1 / (60 + p) for p in want[r.run, r.item])) < 1e-12
        for run in {r.run for r in got}:
            own = sorted((r for r in got if r.run == run), key=lambda r: (-r.fused, r.item))
            assert [r.place for r in own] == list(range(1, len(own) + 1))


def test_all_missing_and_empty(spark):
    df = spark.createDataFrame([("r", "a", None, None, None, 1, ""), ("r", "b", None, None, 0, 1, "")], SCHEMA)
    got = rankfuse.fused_ranking(df, "run", "item", ["s", "t"], ["b"]).collect()
    assert sorted((r.item, r.place_sum, r.place) for r in got) == [("a", 3, 1), ("b", 3, 2)]
    assert rankfuse.fused_ranking(df.limit(0), "run", "item", ["s", "t"], ["b"]).count() == 0
