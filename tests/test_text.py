import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import analyzer, models, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["a   b\n\nc\t d", "A-B-C  (I)", "Z=112⁢π⁢i", "Referring toFIG.1, the wheel", "as shown inFIGS.2and3", "B60B104FI", "E*", None, "", " ", "⁢", "ﬁt"]
    want = ["a b c d", "A-B-C (I)", "Z=112πi", "Referring to FIG. 1, the wheel", "as shown in FIGS. 2and3", "B60B104FI", "E*", "", "", "", "", "fit"]
    assert column(spark, given, text.normalize_text) == want
    assert column(spark, given, text.is_blank) == [w == "" for w in want]
    once = column(spark, want, text.normalize_text)
    assert once == want


def test_normalize_paragraphs(spark):
    assert column(spark, [["first", "", "   ", "second", "⁢", None, "third"], None], text.normalize_paragraphs, "array<string>") == [["first", "second", "third"], []]


def test_dependencies(spark):
    cases = {
        "An axle body having a middle segment.": [], "2 . The spoke according to claim 1 , wherein x.": [1], "3 . The insert of claim 2 , wherein y.": [2], "4 . The wheel as recited in claim 1 .": [1],
        "5 . The tire as set forth in claim 3 .": [3], "The tire according to any one of claims 1 to 4 .": [1, 2, 3, 4], "The device of claims 2-4 .": [2, 3, 4], "The device according to claims 1 and 3 .": [1, 3],
        "A method of manufacturing, the claim being broad.": [], "": [], "of claims 9-3": [], "of claims 1-300": [], "of claims 1 and 3-5": [1, 3], "as defined in 26 mm": [26],
    }
    assert column(spark, list(cases), text.dependencies) == list(cases.values())
    assert column(spark, [None], text.dependencies) == [[]]


def test_canceled_and_numbered(spark):
    marks = ["1 - 5 . (canceled)", "1 .- 15 . (canceled)", "1 - 15 : (canceled)", "1-10 (cancelled)", "1—12. (Canceled)", "3, 7 (canceled)", "8. (CANCELED)", "0.5 phr", "1) A wheel"]
    got = column(spark, marks, text.canceled_range)
    assert [tuple(g) if g else None for g in got] == [(1, 5), (1, 15), (1, 15), (1, 10), (1, 12), (3, 7), (8, 8), None, None]
    assert column(spark, ["0.5 phr", "1) A", "12 . B", "1000. C", "x"], text.claim_number) == [None, 1, 12, None, None]


def test_hashing_embedding(spark):
    (v,) = column(spark, ["hello"], lambda c: text.hashing_embedding(c, 40))
    digest = hashlib.sha256(b"hello").digest()
    raw = [digest[i % 32] / 255 for i in range(40)]
    norm = sum(x * x for x in raw) ** 0.5
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(v, raw))


def test_overlap(spark):
    df = spark.createDataFrame([("A b c", "b C d"), ("", "x"), (None, None)], "q string, d string")
    assert [round(r.x, 6) for r in df.select(text.lexical_overlap(F.col("q"), F.col("d")).alias("x")).collect()] == [0.666667, 0, 0]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("effective", "effect"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_porter(word, stem):
    assert analyzer.porter(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=20))
def test_porter_never_fails(word):
    assert 0 < len(analyzer.porter(word)) <= len(word) + 1


def test_analyze(spark):
    table = analyzer.canonical_synonyms([["tire", "tyre"], ["tyre", "tyer"]])
    assert table == {"tyre": "tire", "tyer": "tire"}
    got = column(spark, ["The driver's Tyres and the tyre!", None, "\U0001f600 ???"], lambda c: analyzer.analyze(c, table, stem=False))
    assert got == [["driver", "tyres", "tire"], [], []]
    assert column(spark, ["connected connections"], lambda c: analyzer.analyze(c)) == [["connect", "connect"]]


def test_model_specs(spark):
    assert models.parse_spec("minilm")[0] == "st"
    for bad in ("nothing", "who:knows", "st:"):
        with pytest.raises(ValueError):
            models.parse_spec(bad)
    models.embedder("openai-small")  # what a model needs is asked for when it is used
    models.register_loader("toy", lambda name: lambda texts: [[float(len(t))] for t in texts])
    assert column(spark, ["ab", ""], models.embedder("toy:x")) == [[2.0], [1.0]]
