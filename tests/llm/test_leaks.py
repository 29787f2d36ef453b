import random
import re

from claimloom.llm import leaks

DOC, ITEM = "doc_id long, text string, item_id string, doc int", "item_id long, text string, item int"


def brute(docs, items, width=12):
    """Equal windows: of 12 words, or of the whole of an item that has 5 to 11."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for i, s in items:
        own = words(s)
        if i is None or len(own) < 5:
            continue
        n = min(width, len(own))
        out |= {(d, i) for d, t in docs if d is not None and grams(words(t), n) & grams(own, n)}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOC), spark.createDataFrame([(i, t, 1) for i, t in items], ITEM)


def found(spark, docs, items, **kw):
    d, i = frames(spark, docs, items)
    return {(r.doc_id, r.item_id): r for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text", **kw).collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([5, 11, 12, 13, 40]))) for i in range(40)]
    docs = []
    for d in range(150):
        own = text(rng.choice([0, 3, 30, 100]))
        if rng.random() < 0.6:
            source = rng.choice(items)[1]
            n = rng.randint(5, len(source))
            at = rng.randint(0, len(source) - n)
            part, edit = list(source[at : at + n]), rng.random()
            if edit < 0.3:
                part[rng.randrange(len(part))] = "changed"
            elif edit < 0.5:
                part.insert(rng.randrange(len(part)), "added")
            cut = rng.randint(0, len(own))
            own = own[:cut] + part + own[cut:]
        docs.append((d, ", ".join(own).upper() if d % 3 else "; ".join(own)))
    return docs, [(i, " ".join(t)) for i, t in items]


def test_equal_windows_are_all_found(spark, monkeypatch):
    docs, items = corpus()
    docs += [(None, docs[1][1]), (900, None), (901, ""), (902, " ".join(t for _, t in items) * 50), (0, docs[0][1])]
    items += [(None, "x"), (99, ""), (98, None), items[0]]
    want = brute(docs, items)
    for block, chunk in ((200_000, 150_000), (30, 7)):
        monkeypatch.setattr(leaks, "ITEM_BLOCK", block)
        monkeypatch.setattr(leaks, "CHUNK", chunk)
        assert len(want) > 20 and set(found(spark, docs, items, most_edits=0)) == want
    near = found(spark, docs, items, most_edits=1)
    assert want <= set(near) and all(r.edits == 0 for k, r in near.items() if k in want)


def test_recall_of_edited_windows(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(30))) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split()
        for p in range(5, 30, 11):  # an edit in every window
            w[p] = "edit"
        docs.append((i, " ".join(w)))
    got = found(spark, docs, items, most_edits=1)
    assert not found(spark, docs, items, most_edits=0)
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items) and all(r.edits == 1 for r in got.values())


def test_the_screen_loses_nothing(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, [f"w{rng.randint(0, 300)}" for _ in range(30)]) for i in range(60)]
    docs = []
    for d in range(200):
        _, t = rng.choice(items)
        at = rng.randint(0, 18)
        part = t[at : at + 12]
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(part))
            part[p : p + rng.randint(0, 1)] = rng.choice([[], ["neu"]])
        docs.append((d, " ".join([f"w{rng.randint(0, 300)}" for _ in range(10)] + part + [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 9))])))
    given = [(i, " ".join(t)) for i, t in items]
    for long in (None, (24, 3)):
        screened = found(spark, docs, given, long=long)
        with monkeypatch.context() as m:
            m.setattr(leaks.ItemIndex, "may_be_near", lambda self, marked, at, edits: at == at)
            whole = found(spark, docs, given, long=long)
        near = {k for k, r in whole.items() if r.window == 12}
        assert len(near) > 100 and near <= set(screened) and len(screened) >= 0.97 * len(whole)


def test_planted_edits_in_the_given_items(spark):
    """Items of the given tables with one to three words changed, inserted or dropped, put into given documents."""
    import pathlib

    import pytest

    d = pathlib.Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no tables")
    rng = random.Random(9)
    items = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{d}/eval_passages.parquet").collect()]
    hosts = [r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()]
    docs = []
    for k, (i, t) in enumerate(items):
        for edits in (1, 2, 3):
            n = rng.randint(24, len(t)) if len(t) > 24 else len(t)
            at = rng.randint(0, len(t) - n)
            part = list(t[at : at + n])
            for _ in range(edits):
                p = rng.randrange(len(part))
                part[p : p + rng.randint(0, 1)] = rng.choice([["ersatz"], ["ersatz"], []])
            docs.append((10 * i + edits, f"{hosts[k % len(hosts)]} {' '.join(part)} {hosts[(k + 7) % len(hosts)]}"))
    got = found(spark, docs, [(i, " ".join(t)) for i, t in items], most_edits=1, long=(40, 8))
    for edits in (1, 2, 3):
        assert sum((10 * i + edits, i) in got for i, _ in items) >= 0.9 * len(items), edits


def test_coverage(spark):
    item = " ".join(f"w{i}" for i in range(40))
    r = found(spark, [(1, f"before {item} after"), (2, " ".join(f"w{i}" for i in range(10, 25)))], [(7, item)])
    assert r[1, 7].covered_words == 40 == r[1, 7].item_words and r[2, 7].covered_words >= 15


def test_empty(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0))):
        assert leaks.leaks(a, "doc_id", "text", b, "item_id", "text").count() == 0


def test_edit_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (500, 8)), rng.integers(0, 4, (500, 8))
    y[:200] = x[:200]
    y[:100, 3] = 9
    y[200:300, 1:] = x[200:300, :-1]
    full = leaks._full_distance(x, y)
    for most in range(3):
        got = leaks._edit_distance(x, y, most)
        assert (got[full <= most] == full[full <= most]).all() and (got[full > most] > most).all()


def edited(words, every, kind, rng):
    """Every so many words one is changed, dropped or has another inserted before it."""
    out = []
    for p, w in enumerate(words):
        if p % every != every - 1:
            out.append(w)
            continue
        what = kind if kind != "mixed" else rng.choice(["change", "insert", "drop"])
        out += {"change": [f"n{rng.random()}"[:9].replace(".", "")], "insert": ["neu", w], "drop": []}[what]
    return out


def test_recall_of_inserted_and_dropped_words(spark):
    rng = random.Random(4)
    items = [(i, [f"w{rng.randint(0, 5000)}" for _ in range(60)]) for i in range(100)]
    docs = []
    for k, kind in enumerate(["change", "insert", "drop", "mixed"]):
        docs += [(1000 * k + i, " ".join(["davor"] * 5 + edited(t, 5, kind, rng) + ["danach"] * 5)) for i, t in items]
    got = found(spark, docs, [(i, " ".join(t)) for i, t in items], most_edits=1, long=(40, 8))
    for k in range(4):
        assert sum((1000 * k + i, i) in got for i, _ in items) >= 95, k
    assert all(d % 1000 == i and 1 <= r.edits <= (1 if r.window == 12 else 8) for (d, i), r in got.items())


def test_registered_query_finds_edited_items(spark, tmp_path):
    from claimloom.llm import queries

    rng = random.Random(6)
    items = [(i, [f"w{rng.randint(0, 5000)}" for _ in range(60)]) for i in range(40)]
    d, i = frames(spark, [(i, " ".join(edited(t, 6, "insert", rng))) for i, t in items], [(i, " ".join(t)) for i, t in items])
    d.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    i.select("item_id", "text").write.parquet(f"{tmp_path}/eval_passages.parquet")
    assert queries.p7_leaks(spark, str(tmp_path)).count() == 40


def test_text_that_ends_early(spark):
    """A dropped word at the very end of a text, beside texts that could be read into."""
    words = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(words[:4] + words[5:])), (2, "w4 " + " ".join(words[:3])), (3, " ".join(words[6:])), (4, " ".join(words[:6])), (5, " ".join(words[6:]))]
    assert set(found(spark, docs, [(9, " ".join(words))])) <= {(1, 9)}
