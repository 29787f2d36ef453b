"""Problem 1: cutting oversized texts at natural boundaries.

Method: structure-tree packing. A text is read as a tree (headings by depth, blank-line blocks, list items by indent,
lines, sentences, clauses, wrapped lines, words); sibling subtrees are merged up to the limit from below and only oversized nodes are
descended into. A tree is held as the nested partition that its cut positions make, level by level.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import SPACE, counting_rows
from claimloom.session import quoted

_WORD = re.compile(f"[^{SPACE}]+")
_LINE = re.compile(r"[^\n]*\n?")
_HEADING = re.compile(r"\s*(?:(#{1,6})\s+\S|<h([1-6])\b|(\d+(?:\.\d+)+)\.?\s+[^\W\d_])", re.I)
_ITEM = re.compile(r"([ \t]*)(?:[-*•‣]|\(?(?:\d{1,3}|[A-Za-z])[.)]|<li\b)\s*\S")
_SENTENCE = re.compile(f"[.!?…。！？][\"'”’»)\\]]*[{SPACE}]+")
_SENTENCE_END = re.compile(f"[.!?…。！？][\"'”’»)\\]]*[{SPACE}]*$")
_CLAUSE = re.compile(f"[;:,–—][{SPACE}]+")
_ABBREVIATION = re.compile(r"(?:\b(?:figs?|nos?|abb|bzw|ca|cf|e\.g|i\.e|vgl|etc|approx|z\.b|p\.ej)|\b[^\W\d_])\.\s*$", re.I)
_HEADING_LEVELS, _BLOCK, _ITEM_LEVELS, _LINE_LEVEL, _SENTENCE_LEVEL, _CLAUSE_LEVEL, _WRAP_LEVEL, _WORD_LEVEL = 6, 7, 8, 16, 17, 18, 19, 20

PIECE = T.StructType([
    T.StructField("piece_no", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("core_start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("words", T.IntegerType()),
    T.StructField("overlap_words", T.IntegerType()),
    T.StructField("boundary", T.StringType()),
    T.StructField("text", T.StringType()),
])


def _cuts(text: str, starts: list[int]) -> dict[int, int]:
    """Position of a possible cut -> its level, the highest (smallest) one where several meet. A cut is always before a word.

    A line that begins within a sentence is wrapped text, whose start is worth less than a clause. A line is whole if it
    follows a heading, a sentence end, or a list item and doesn't go on in lower case.
    """
    cut: dict[int, int] = {}

    def add(position: int, level: int) -> None:
        at = bisect_left(starts, position)
        if 0 < at < len(starts) and cut.get(starts[at], 99) > level:
            cut[starts[at]] = level

    blank, before = False, ""
    for line in _LINE.finditer(text):
        s = line.group()
        if not s:
            continue
        if not s.strip():
            blank = True
            continue
        if m := _HEADING.match(s):
            depth = len(m[1]) if m[1] else int(m[2]) if m[2] else m[3].count(".") + 1
            add(line.start(), min(depth, _HEADING_LEVELS))
            kind = "heading"
        elif s.strip().isupper() and len(s) < 90:
            add(line.start(), _HEADING_LEVELS)
            kind = "heading"
        elif m := _ITEM.match(s):
            add(line.start(), _BLOCK if blank else _ITEM_LEVELS + min(len(m[1].expandtabs(4)) // 2, 7))
            kind = "item"
        else:
            whole = before in ("heading", "end") or (before == "item" and not s.lstrip()[:1].islower())
            add(line.start(), _BLOCK if blank else _LINE_LEVEL if whole else _WRAP_LEVEL)
            kind = ""
        m = _SENTENCE_END.search(s)
        before = "end" if m and not kind and not _ABBREVIATION.search(s, max(0, m.start() - 8), m.start() + 1) else kind
        blank = False
    for m in _SENTENCE.finditer(text):
        nxt = text[m.end() : m.end() + 1]
        if not nxt.islower() and not _ABBREVIATION.search(text, max(0, m.start() - 8), m.start() + 1):
            add(m.end(), _SENTENCE_LEVEL)
    for m in _CLAUSE.finditer(text):
        add(m.end(), _CLAUSE_LEVEL)
    return cut


def split_text(text: str | None, max_words: int = 500, overlap: int = 50) -> list[tuple]:
    """Pieces of at most max_words words; each but the first begins with the last `overlap` words of the one before.

    The overlap is exact where max_words is at least 3 * overlap, as no core but the last is then shorter than it; below
    that it is at most the core before.

    The parts [core_start, end) follow each other without gap or overlap and give back the text; a piece's text is
    [start, end). A text within the limit is one piece; an empty one and null give none. A word is never cut.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and below max_words")
    if not text:
        return []
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(starts) <= max_words:
        return [(0, 0, 0, len(text), len(starts), 0, "end", text)]
    cut = _cuts(text, starts)
    room = max_words - overlap
    word_at = {p: i for i, p in enumerate(starts)}
    by_level: dict[int, list[int]] = {}
    for p, level in cut.items():
        by_level.setdefault(level, []).append(word_at[p])
    levels = [sorted(by_level[k]) for k in sorted(by_level)]

    cores: list[tuple[int, int]] = []  # in words

    def limit(begin: int) -> int:
        return room if begin else max_words  # the first piece repeats nothing

    def pack(a: int, b: int, level: int) -> None:
        if b - a <= limit(a):
            cores.append((a, b))
            return
        if level == len(levels):
            while a < b:
                cores.append((a, min(a + limit(a), b)))
                a = cores[-1][1]
            return
        own = levels[level]
        edges = [a, *own[bisect_left(own, a + 1) : bisect_left(own, b)], b]
        begin = a
        for x, y in zip(edges, edges[1:]):
            if y - x > limit(x):  # oversized child: close what was merged, descend
                if begin < x:
                    cores.append((begin, x))
                pack(x, y, level + 1)
                begin = cores.pop()[0]  # what is left of it at its end may be merged with the next sibling
            elif y - begin > limit(begin):
                cores.append((begin, x))
                begin = x
        if begin < b:
            cores.append((begin, b))

    pack(0, len(starts), 0)
    if room >= 2 * overlap:
        cores = _lengthened(cores, overlap, room, lambda i: cut.get(starts[i], _WORD_LEVEL))
    out = []
    for i, (a, b) in enumerate(cores):
        core_start = 0 if i == 0 else starts[a]
        end = starts[b] if b < len(starts) else len(text)
        back = min(overlap, a - cores[i - 1][0]) if i else 0
        start = starts[a - back] if back else core_start
        kind = "end" if b == len(starts) else _name(cut.get(starts[b], _WORD_LEVEL))
        out.append((i, start, core_start, end, b - a + back, back, kind, text[start:end]))
    return out


def _lengthened(cores: list[tuple[int, int]], least: int, room: int, level: Callable[[int], int]) -> list[tuple[int, int]]:
    """Cores of at least `least` words but the last: a short one is joined with the next, or takes the words up to its best cut."""
    out: list[tuple[int, int]] = []
    begin = cores[0][0]
    for k, (_, end) in enumerate(cores):
        if k + 1 < len(cores) and end - begin < least:
            after = cores[k + 1][1]
            if after - begin > room:
                edge = max(range(begin + least, min(begin + room, after - least) + 1), key=lambda i: (-level(i), i))
                out.append((begin, edge))
                begin = edge
            continue
        out.append((begin, end))
        begin = end
    return out


def _name(level: int) -> str:
    if level <= _HEADING_LEVELS:
        return "heading"
    if level == _BLOCK:
        return "block"
    if level < _LINE_LEVEL:
        return "item"
    return {_LINE_LEVEL: "line", _SENTENCE_LEVEL: "sentence", _CLAUSE_LEVEL: "clause", _WRAP_LEVEL: "line"}.get(level, "word")


def split_oversized(df: DataFrame, keys: list[str], text: str, max_words: int = 500, overlap: int = 50) -> DataFrame:
    """One row per piece: the keys, then the fields of PIECE.

    Extra columns are dropped, whatever their names; null and empty texts give no row, repeated rows are kept. Keys may
    be null. No shuffle: a map over Arrow batches; keys only travel along.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[quoted(k).alias(n) for k, n in zip(keys, names)], quoted(text).cast("string").alias("_text"))
    out_schema = T.StructType([*[f for f in base.schema.fields if f.name != "_text"], *PIECE.fields])
    fields = [f.name for f in PIECE.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = [pa.int32()] * 6 + [pa.string()] * 2
        for batch in batches:
            rows, take = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                got = split_text(t, max_words, overlap)
                rows += got
                take += [i] * len(got)
            if rows:
                kept = batch.select(names).take(pa.array(take))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), ints)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*names, *fields])

    out = base.mapInArrow(run, out_schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *fields)


def oversized_paragraph_pieces(patents: DataFrame, max_words: int = 500, overlap: int = 50) -> DataFrame:
    """Pieces of the paragraphs with more than max_words words, in the counting row of each patent.

    paragraph_no is the position in the stored array; paragraph_start and paragraph_end count the non-blank paragraphs.
    Oversized paragraphs are found before anything is shuffled: the texts of the others never leave their task. Of
    deliveries of one time that differ, the one whose paragraphs have the least hash counts.
    """
    counts = F.size(F.filter(F.split("paragraph", r"(?U)\s+"), lambda w: w != ""))
    long = (
        patents.select("patent_id", "ingested_at", F.col("description_paragraphs").alias("_all"), F.posexplode("description_paragraphs").alias("paragraph_no", "paragraph"))
        .where((F.length("paragraph") > 2 * max_words) & (counts > max_words))
        .withColumn("paragraph_start", F.size(F.filter(F.slice("_all", F.lit(1), F.col("paragraph_no")), lambda p: p.rlike(r"(?U)[^\s\p{Cf}]"))))
        .withColumn("_content", F.xxhash64("_all"))
        .drop("_all")
    )
    latest = counting_rows(patents)
    counted = (
        long.join(latest, (F.col("patent_id") == F.col("_key")) & F.col("ingested_at").eqNullSafe(F.col("_at")))
        .withColumn("_first", F.min("_content").over(Window.partitionBy("patent_id")))
        .where(F.col("_content") == F.col("_first"))
        .dropDuplicates(["patent_id", "paragraph_no"])
        .withColumn("paragraph_end", F.col("paragraph_start"))
    )
    return split_oversized(counted, ["patent_id", "paragraph_no", "paragraph_start", "paragraph_end"], "paragraph", max_words, overlap)
