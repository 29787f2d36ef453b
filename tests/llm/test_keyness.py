import math
import re
from collections import Counter, defaultdict

from claimloom.llm import keyness

SCHEMA = "record_id string, patent_id string, title string, text string, z string, n string"


def brute(rows, min_count=1, prior=1000.0):
    tf, groups = {}, defaultdict(set)
    for rid, pid, title, text in {r[:4] for r in rows}:
        joined = " ".join(x for x in (title, text) if x is not None)
        tf[rid, pid, title, text] = Counter(t for t in re.findall(r"[^\W\d_]+", joined.lower()) if len(t) >= 3)
        for t in tf[rid, pid, title, text]:
            if pid is not None:
                groups[t].add(pid)
    c = Counter()
    for counts in tf.values():
        c.update(counts)
    total = c.total()
    out = set()
    for (rid, *_), counts in tf.items():
        for t, n in counts.items():
            if n >= min_count and rid is not None:
                a, size = prior * c[t] / total, counts.total()
                own, rest = size + prior - n - a, total - size + prior - (c[t] - n) - a
                z = None
                if own > 0 and rest > 0:
                    z = round((math.log((n + a) / own) - math.log((c[t] - n + a) / rest)) / math.sqrt(1 / (n + a) + 1 / (c[t] - n + a)), 8)
                out.add((rid, t, n, c[t], min(4, len(groups[t])), z))
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = [(f"r{i}", f"p{i % 7}", f"Title {i % 3}", " ".join(["common words"] * (i % 5) + [f"rare{chr(97 + i % 11)} Übung über ab 12x34yz"] * 2), "x", "y") for i in range(60)]
    rows += [rows[0], rows[1], ("r61", "p1", None, None, "", ""), ("r62", None, "lone lone lone", "", "", ""), (None, "p1", "common", "common", "", ""), ("r63", "p2", "", "single " * 5000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for flush, share in ((200_000, 1 / 20_000), (3, 0.05)):
        monkeypatch.setattr(keyness, "FLUSH", flush)
        monkeypatch.setattr(keyness, "HEAVY_SHARE", share)
        for least in (1, 2):
            got = {(r.record_id, r.term, r.n, r.collection_n, r.groups, None if r.z is None else round(r.z, 8)) for r in keyness.distinctive_terms(df, "record_id", "patent_id", ["title", "text"], min_count=least).collect()}
            assert got == brute(rows, least)


def test_common_terms_count_little(spark):
    rows = [(f"r{i}", f"p{i}", "", "the device has the wheel " * 3 + ("vulcaflex " * 3 if i < 2 else ""), "", "") for i in range(50)]
    got = {(r.record_id, r.term): r.z for r in keyness.distinctive_terms(spark.createDataFrame(rows, SCHEMA), "record_id", "patent_id", ["title", "text"]).collect()}
    assert got["r0", "vulcaflex"] > 1 > abs(got["r0", "the"])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keyness.distinctive_terms(df, "record_id", "patent_id", ["title", "text"]).count() == 0


def test_repeated_rows_are_dropped_however_many(spark, monkeypatch):
    rows = [("a", "g", "x y"), ("a", "g", "x y"), ("a", None, "x y"), (None, "g", "x"), (None, "g", "x"), ("b", "g", None), ("b", "g", None), ("c", "h", "z")]
    df = spark.createDataFrame(rows, "id string, group string, text string")
    for most in (1_000_000, 0):
        monkeypatch.setattr(keyness, "MOST_BROADCAST", most)
        got = sorted(map(tuple, keyness.unrepeated(df).collect()), key=repr)
        assert got == sorted(set(rows), key=repr)
    assert keyness.unrepeated(df.limit(0)).count() == 0
