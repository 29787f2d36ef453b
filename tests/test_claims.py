import random

import pytest

from claimloom.operators import claims as C
from claimloom.operators import records as R

CASES = [
    (["an axle body with elements.", "2 . The spoke of claim 1 .", "3 . The spoke of claim 2 ."], [1, 2, 3]),
    (["1 . A wheel comprising: a rim;", "a hub connected to the rim.", "2 . The wheel of claim 1 ."], [1, 2]),
    (["11 . A method of molding.", "a wheel rim, having a rim.", "13 . The wheel of claim 12 ."], [11, 12, 13]),
    (["1 - 5 . (canceled)", "a tread portion here.", "7 . The tire of claim 6 , wherein x."], [1, 6, 7]),
    (["1 . A spoke.", "", "   ", None, "2 . The spoke of claim 1 ."], [1, 2]),
    (["1 . A spoke.", "2 - 4 . (canceled)", "5 . The spoke of claim 1 ."], [1, 2, 5]),
    (["1) A wheel comprising a rim.", "2) The wheel of claim 1, wherein x."], [1, 2]),
    (["1 . A rubber mixture comprising:", "0.5 phr of a;", "5.0 phr of b."], [1]),
    (["one thing.", "another thing.", "a third."], [1, 2, 3]),
    (["one thing.", "another thing.", "a third.", "2 . x."], [1, 2, 1, 2]),
    ([f"{i} . A thing." for i in range(1, 121)], list(range(1, 121))),
    (["a body;", "with a hub.", "2 . The x of claim 1 .", "3 - 4 . (canceled)", "a further element.", "6 . The x of claim 2 ."], [1, 2, 3, 5, 6]),
    ([], []),
]


def table(spark, cases):
    return spark.createDataFrame([(f"P{i}", c) for i, c in enumerate(cases)], "patent_id string, claims_raw array<string>")


@pytest.fixture(scope="module")
def made(spark):
    df = table(spark, [c for c, _ in CASES])
    return df, C.reconstruct_claims(df).cache()


def test_numbers(made):
    got = {}
    for r in made[1].orderBy("seg").collect():
        got.setdefault(r.patent_id, []).append(r.claim_number)
    assert [got.get(f"P{i}", []) for i in range(len(CASES))] == [n for _, n in CASES]


def test_every_entry_once(made):
    assert C.uncovered_entries(*made).count() == 0


def test_fields(made):
    rows = {(r.patent_id, r.seg): r for r in made[1].collect()}
    first = rows["P0", 1]
    assert (first.claim_id, first.status, first.is_independent, first.number_inferred) == ("P0:claim:1", "preamble_stripped", True, True)
    assert rows["P1", 1].status == "rejoined_continuation" and rows["P1", 1].raw_fragment_indexes == [0, 1]
    assert rows["P3", 1].claim_id == "P3:canceled:1-5" and rows["P3", 1].status == "canceled" and not rows["P3", 1].is_independent
    assert rows["P0", 2].depends_on == [1] and not rows["P0", 2].is_independent
    assert made[1].where("array_contains(depends_on, claim_number)").count() == 0


def test_stats_and_parents(made):
    s = C.reconstruction_stats(made[1]).first()
    assert s.claims_total == made[1].count() and s.status_canceled == 3 and s.multi_fragment == 3
    assert s.patents_with_out_of_order_numbering == 1
    parents = {tuple(r) for r in C.claim_parents(made[1]).collect()}
    assert ("P0:claim:3", "P0:claim:2") in parents


def reference_numbers(segments):
    """The numbering rule as a plain recurrence; segments: (explicit or None, end or None)."""
    out = []
    for i, (n, _) in enumerate(segments):
        if n is None:
            ahead = next((j for j in range(i + 1, len(segments)) if segments[j][0] is not None), None)
            if ahead is not None and segments[ahead][0] - (ahead - i) >= 1:
                n = segments[ahead][0] - (ahead - i)
            elif i == 0:
                n = 1
            else:
                n = (segments[i - 1][1] or out[i - 1]) + 1
        out.append(n)
    return out


def test_closed_form_equals_recurrence(spark):
    rng = random.Random(3)
    cases, want = [], []
    for _ in range(300):
        segments, entries = [], []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.5:
                segments.append((None, None))
                entries.append("a thing.")
            elif kind < 0.85:
                n = rng.randint(1, 20)
                segments.append((n, None))
                entries.append(f"{n} . A thing.")
            else:
                lo = rng.randint(1, 9)
                segments.append((lo, lo + 3))
                entries.append(f"{lo} - {lo + 3} . (canceled)")
        cases.append(entries)
        want.append(reference_numbers(segments))
    got = {}
    for r in C.numbered_segments(C.claim_segments(table(spark, cases))).orderBy("seg").collect():
        got.setdefault(int(r.patent_id[1:]), []).append(r.number)
    assert [got[i] for i in range(len(cases))] == want


@pytest.mark.parametrize("sizes,target,most,overlap,check", [
    ([100] * 5, 200, 400, 0, lambda c: len(c) == 3 and c[0][0] == 0),
    ([900, 2], 100, 200, 1, lambda c: c[0][:2] == (0, 0) and len(c[0][2].split()) == 900),
    ([60] * 6, 60, 120, 1, lambda c: all(a[0] < b[0] for a, b in zip(c, c[1:]))),
    ([50] * 20, 50, 60, 99, lambda c: len(c) <= 20),
    ([40] * 10, 80, 160, 0, lambda c: {i for s, e, _ in c for i in range(s, e + 1)} == set(range(10))),
    ([], 1, 1, 0, lambda c: c == []),
])
def test_chunks(sizes, target, most, overlap, check):
    assert check(R.chunk(["w " * n for n in sizes], target, most, overlap))


def test_records(spark):
    p = spark.createDataFrame([("P1", "Title", None, "B60B104FI", ["1 . A spoke.", "2 . (canceled)"], ["some text", "  "]), ("P2", None, None, None, None, None)], "patent_id string, title string, abstract string, classification_raw string, claims_raw array<string>, description_paragraphs array<string>")
    rows = {r.record_id: r for r in R.build_records(p, C.reconstruct_claims(p)).collect()}
    assert set(rows) == {"P1:summary", "P1:claim:1", "P1:description:0-0"}
    assert rows["P1:claim:1"].classification_subclass == "B60B" and rows["P1:claim:1"].is_independent
    assert rows["P1:description:0-0"].paragraph_end == 0 and rows["P1:summary"].claim_number is None
