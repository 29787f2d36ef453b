import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import split

SPACES = " \t\n  　"


def check(text, most, overlap):
    pieces = split.split_text(text, most, overlap)
    assert "".join(text[p[2] : p[3]] for p in pieces) == text
    words = [m.start() for m in split._WORD.finditer(text)]
    for i, (no, start, core, end, n, back, _, piece) in enumerate(pieces):
        assert no == i and piece == text[start:end] and n <= most
        assert n == len(split._WORD.findall(piece))
        assert back == sum(start <= w < core for w in words) and back <= overlap
        if i:
            assert back == min(overlap, sum(pieces[i - 1][2] <= w < core for w in words))
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "End.", "FIG.", "x;", "y,", "# H", "- item", "1.2 Head", "TITLE", "\n", "\n\n", "​", *SPACES]), max_size=120), st.integers(2, 12), st.integers(0, 5))
def test_gives_back_the_text(tokens, most, overlap):
    if overlap < most:
        text = " ".join(tokens)
        if text:
            check(text, most, overlap)
        else:
            assert split.split_text(text, most, overlap) == []


def test_natural_cuts():
    sections = "\n\n".join(f"# Part {i}\n" + " ".join(f"Word{j} end." for j in range(100)) for i in range(4))
    pieces = check(sections, 250, 10)
    assert [p[6] for p in pieces] == ["heading"] * 3 + ["end"]
    sentences = " ".join("The tire has a rim." for _ in range(200))
    assert {p[6] for p in check(sentences, 50, 5)[:-1]} == {"sentence"}
    assert {p[6] for p in check("see FIG. 2 and so on " * 100, 50, 0)[:-1]} == {"word"}
    assert {p[6] for p in check("one two three, " * 100, 50, 0)[:-1]} == {"clause"}
    items = "\n".join(f"- item {i} of a list" for i in range(100))
    assert {p[6] for p in check(items, 60, 0)[:-1]} == {"item"}


def test_edges():
    assert split.split_text(None) == [] and split.split_text("") == []
    assert len(split.split_text("w " * 500)) == 1 and len(split.split_text("w " * 501)) == 2
    assert len(split.split_text("x" * 3_000_000)) == 1
    assert len(check("w " * 200_000, 500, 50)) > 400
    assert len(split.split_text(" \n" * 10)) == 1
    for bad in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split.split_text("a", *bad)


def test_operator(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (None, "e f g", "y"), (1, "a b c d", "x"), (2, None, "z"), (3, "", "z")], "id int, text string, piece_no string")
    rows = split.split_oversized(df, ["id"], "text", 3, 1).collect()
    assert sorted((r.id or 0, r.piece_no, r.text) for r in rows) == [(0, 0, "e f g"), (1, 0, "a b c "), (1, 0, "a b c "), (1, 1, "c d"), (1, 1, "c d")]
    assert split.split_oversized(df.limit(0), ["id"], "text").count() == 0


def test_counting_row_only(spark):
    long, short = "w " * 600, "few words"
    df = spark.createDataFrame([("p", [short, None, " ", long], 1), ("p", [long, short, long], 2), ("p", [long, short, long], 2), ("q", None, 1), (None, [long], 1)], "patent_id string, description_paragraphs array<string>, ingested_at int")
    rows = split.oversized_paragraph_pieces(df).collect()
    assert {(r.patent_id, r.paragraph_no, r.paragraph_start) for r in rows} == {("p", 0, 0), ("p", 2, 2)}
    assert len(rows) == 4


def test_overlap_after_a_short_core():
    sentence = lambda n: "Ab " + "w " * (n - 2) + "end. "
    for sizes in ([25, 655, 61], [460, 20, 455, 300], [655, 3, 655, 3, 655], [400, 40, 700]):
        pieces = check("".join(map(sentence, sizes)), 500, 50)
        assert [p[5] for p in pieces[1:]] == [50] * (len(pieces) - 1), sizes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=1, max_size=20), st.integers(0, 5), st.integers(0, 20))
def test_overlap_is_exact(sizes, overlap, more):
    pieces = check(" ".join("Ab " + "w " * (n - 2) + "end." for n in sizes), max(1, 3 * overlap) + more, overlap)
    assert all(p[5] == overlap for p in pieces[1:])


def test_wrapped_text_is_cut_at_sentences():
    words = ("The tire has a rim and a bead of steel wire. " * 120).split()
    wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    assert {p[6] for p in check(wrapped, 100, 10)[:-1]} <= {"sentence", "line"}
    assert all(p[7].rstrip().endswith(".") for p in check(wrapped, 100, 10))
    lines = "\n".join("one two three four" for _ in range(100))
    assert {p[6] for p in check(lines, 50, 0)[:-1]} == {"line"}


def test_what_is_left_of_an_oversized_block_is_merged_with_the_next():
    block = lambda n: "Ab " + "w " * (n - 2) + "end."
    text = "\n\n".join(" ".join(block(60) for _ in range(k)) for k in (10, 1, 10, 1))  # 600, 60, 600 and 60 words
    pieces = check(text, 500, 50)
    assert [(p[4], p[6]) for p in pieces] == [(480, "sentence"), (230, "block"), (470, "sentence"), (290, "end")]
    pieces = check("\n\n".join(block(n) for n in [458, 2] * 4), 500, 50)
    assert all(p[4] - p[5] >= 50 for p in pieces[:-1])


def test_of_differing_deliveries_of_one_time_one_counts(spark):
    a, b = ["x " * 600, "y " * 700], ["z " * 800, "v " * 900, "u " * 501]
    df = spark.createDataFrame([("p", a, 1), ("p", b, 1), ("p", a, 1)], "patent_id string, description_paragraphs array<string>, ingested_at int")
    texts = {r.text[0] for r in split.oversized_paragraph_pieces(df).collect()}
    assert texts in ({"x", "y"}, {"z", "v", "u"})
