import random

import numpy as np

from claimloom.llm import neardup

SCHEMA = "id string, text string, key_a string, class int"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 300, 900]))]
        docs.append((f"d{i}", " ".join(base)))
        for v in range(rng.choice([0, 0, 1, 3])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                half = len(words) // 2
                words = words[half:] + words[:half]
            docs.append((f"d{i}v{v}", " ".join(words)))
    return docs


def brute(docs, words, threshold):
    sets = {}
    for key, text in docs:
        w = (text or "").lower().split()
        s = set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else set()
        if s and key is not None:
            sets[key] = s
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in docs], SCHEMA)


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    for leaf, page, node in ((16, 1024, 32), (2, 7, 2)):
        for name, value in (("LEAF", leaf), ("PAGE", page), ("NODE", node)):
            monkeypatch.setattr(neardup, name, value)
        for words, threshold in ((3, 0.7), (5, 0.8), (2, 0.4)):
            got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, docs), "id", "text", words, threshold).collect()}
            assert got == brute(docs, words, threshold)


def test_planes_bound_the_minima():
    rng = np.random.default_rng(0)
    for n in (40, 700, 3000):
        sets = [np.unique(rng.integers(0, 1 << 62, n)) for _ in range(6)]
        sets.append(np.unique(np.r_[sets[0][: n // 2], sets[1][: n // 2]]))
        ns = np.array([len(s) for s in sets])
        points = np.stack([neardup.planes(s, neardup.dimensions(n)) for s in sets])
        for dims in (neardup.dimensions(n), 256, 64):
            p = neardup.fold(points, dims)
            counts = np.stack([np.bincount(s & (dims - 1), minlength=dims) for s in sets])
            assert (neardup.held(p) == np.stack([(counts >= 1).sum(axis=1), (counts >= 2).sum(axis=1)], axis=1)).all()
            rest = ns - neardup.held(p).sum(axis=1)
            for i in range(len(sets)):
                bound = neardup.held(p & p[i]).sum(axis=1) + np.minimum(rest, rest[i])
                common = np.array([len(np.intersect1d(s, sets[i])) for s in sets])
                assert (bound >= common).all() and (bound >= np.minimum(counts, counts[i]).sum(axis=1)).all()
        assert neardup.beyond(ns, points)[0] == (ns - neardup.held(points).sum(axis=1)).max()


def test_groups_and_edges(spark):
    text = " ".join(f"word{i}" for i in range(100))
    near = text.replace("word50", "other")
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    docs = [("a", text), ("b", text), ("c", near), ("e", "completely different words stand here now"), ("f", ""), ("g", None), (None, text), ("h", "too short"), ("a", text), ("l", long), ("m", long + " tail")]
    got = {r.id: (r.group, r.links) for r in neardup.near_duplicate_groups(frame(spark, docs), "id", "text").collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "e": ("e", 0), "l": ("l", 1), "m": ("l", 1)}
    pairs = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, docs), "id", "text").collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("b", "c"), ("l", "m")}
    empty = frame(spark, docs).limit(0)
    assert neardup.near_duplicate_pairs(empty, "id", "text").count() == 0 and neardup.near_duplicate_groups(empty, "id", "text").count() == 0


def test_patent_texts(spark):
    df = spark.createDataFrame([("p", "old", ["c"], ["d"], 1), ("p", "new", ["c1", None, "c2"], None, 2), ("p", "new", ["c1", None, "c2"], None, 2)], "patent_id string, abstract string, claims_raw array<string>, description_paragraphs array<string>, ingested_at int")
    assert [tuple(r) for r in neardup.patent_texts(df).collect()] == [("p", "new c1 c2")]
