"""Problem 7: evaluation passages inside training documents.

Method: the CGK random walk embeds a window of words so that a small edit distance becomes a small Hamming distance;
repeated bit-sampling hashing of the embeddings finds windows of documents that are near windows of the items; the edit
distance of each hit is then computed exactly. A symbol is a word. Equal windows have equal embeddings, so those are
always found; near ones with the recall that the repetitions give.

Only windows that can be near are embedded: an edit spoils at most GRAM of the runs of GRAM words in a window, so a near
window keeps a known number of the items' runs (the q-gram lemma), which one pass with a rolling key counts. The screen
loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import in_chunks
from claimloom.session import materialise, quoted

WORD = regex.compile(r"[\p{L}\p{Nd}]+")
WALKS = 2
TABLES = 4  # of each walk
SAMPLED = 10  # positions of a table
ITEM_BLOCK = 500_000  # item windows that are broadcast at a time
LEAST_WORDS = 5  # of an item that is searched for
GRAM = 3  # words of the runs that screen windows
CHUNK = 150_000  # windows embedded at a time
WIDTH_OF_EDITS = 8  # a window of fewer words must be equal
LONG_EDITS = 2  # of a window of the common width that a longer one may be looked for around
_BITS = 16  # of the table that screens keys
_GRAM_BITS = 22  # of the table that screens windows

_PAD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text begins in them."""
    known: dict[str, int] = {}
    out: list[int] = []
    begins = [0]
    for t in texts:
        for w in WORD.findall(t.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        begins.append(len(out))
    return np.array(out, np.uint64), np.array(begins, np.int64)


def _keys(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Keys of the windows that begin at the given words: one row a table."""
    rng = np.random.default_rng(11 * width)
    steps = 3 * width
    out = np.zeros((WALKS * TABLES, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        for walk in range(WALKS):
            coins = _mix(words, 77 + walk)  # bit j: whether the walk moves on after it met this word at step j
            sampled = [set(rng.choice(steps, SAMPLED, replace=False).tolist()) for _ in range(TABLES)]
            odd = rng.integers(1, 1 << 62, (TABLES, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            place = np.zeros(len(at), np.int64)
            last = max(max(s) for s in sampled)
            for j in range(last + 1):
                inside = place < width
                here = at + np.where(inside, place, 0)
                used = [t for t in range(TABLES) if j in sampled[t]]
                if used:
                    symbol = np.where(inside, words[here], _PAD)
                    for t in used:
                        out[walk * TABLES + t] += symbol * odd[t, j]
                place += ((coins[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * inside
            for t in range(TABLES):
                out[walk * TABLES + t] = _mix(out[walk * TABLES + t], walk * TABLES + t + 1)
    return out


def _grams(words: np.ndarray) -> np.ndarray:
    """The table cell of the run of GRAM words that begins at each word."""
    with np.errstate(over="ignore"):
        h = words * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, GRAM):
            h[:-i] = (h[:-i] ^ (h[:-i] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[i:]
        h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)


def _edit_distance(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of x, a window, and the beginnings of the row of y; where it's surely above `most`, most + 1.

    y has up to `most` symbols more than x, as its window may have grown by insertions; one that shrank is a shorter
    beginning. An alignment with at most `most` edits keeps all but as many symbols of x at a shift of at most `most`,
    which is cheaper to count than the distance.
    """
    n, w = x.shape
    kept = np.zeros((n, w), bool)
    for s in range(-most, most + 1):
        lo, hi = max(0, -s), min(w, y.shape[1] - s)
        kept[:, lo:hi] |= x[:, lo:hi] == y[:, lo + s : hi + s]
    maybe = kept.sum(axis=1) >= w - most
    out = np.full(n, most + 1, np.int16)
    if most == 0:
        out[maybe] = 0
    elif maybe.any():
        out[maybe] = _full_distance(x[maybe], y[maybe])
    return out


def _keeps_enough(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which rows of x may be within `most` edits of consecutive symbols of y, which has `most` more than x on either side."""
    n, w = x.shape
    kept = np.zeros((n, w), bool)
    for s in range(2 * most + 1):
        kept |= x == y[:, s : s + w]
    return kept.sum(axis=1) >= w - most


def _full_distance(x: np.ndarray, y: np.ndarray, inner: bool = False) -> np.ndarray:
    n, w = x.shape
    v = y.shape[1]
    before = np.tile(np.arange(v + 1, dtype=np.int16) * (not inner), (n, 1)).astype(np.int16)
    for i in range(w):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        for j in range(v):
            now[:, j + 1] = np.minimum(np.minimum(before[:, j + 1], now[:, j]) + 1, before[:, j] + (x[:, i] != y[:, j]))
        before = now
    return before.min(axis=1)


class ItemIndex:
    """The windows of a block of items, by key. Made on the driver from at most ITEM_BLOCK windows, then broadcast."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        self.words, begins = _word_hashes(texts)
        self.width = width
        starts = [np.arange(b, e - width + 1) for b, e in zip(begins[:-1], begins[1:])]
        self.at = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.item = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        self.offset = self.at - begins[self.item] if len(self.at) else self.at
        self.ids = np.array(ids, np.int64)
        self.sizes = np.diff(begins)
        keys = _keys(self.words, self.at, width) if len(self.at) else np.empty((WALKS * TABLES, 0), np.uint64)
        self.order = np.argsort(keys, axis=1)
        self.keys = np.take_along_axis(keys, self.order, 1)
        self.grams = np.zeros(1 << _GRAM_BITS, bool)
        if width >= GRAM and len(self.words):
            cells = _grams(self.words)
            inside = np.zeros(len(cells), bool)  # runs that lie in one item
            for b, e in zip(begins[:-1], begins[1:]):
                inside[b : max(b, e - GRAM + 1)] = True
            self.grams[cells[inside]] = True
        self.screen = np.zeros((len(keys), 1 << _BITS), bool)
        for t, k in enumerate(keys):
            self.screen[t, (k & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def may_be_near(self, marked: np.ndarray, at: np.ndarray, edits: int) -> np.ndarray:
        """Which windows keep as many runs as one with so many edits must. marked: running count of words where a run of the items begins."""
        runs = self.width - GRAM + 1
        least = runs - GRAM * edits
        if least <= 0:
            return np.ones(len(at), bool)
        return marked[np.minimum(at + runs, len(marked) - 1)] - marked[at] >= least

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into at, item window) of every pair that shares a key."""
        found = []
        n = np.int64(len(self.at))
        for t, k in enumerate(_keys(words, at, self.width)):
            maybe = np.flatnonzero(self.screen[t, (k & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            lo = np.searchsorted(self.keys[t], k[maybe], "left")
            count = np.searchsorted(self.keys[t], k[maybe], "right") - lo
            maybe, lo, count = maybe[count > 0], lo[count > 0], count[count > 0]
            if len(maybe):
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found.append(np.repeat(maybe, count) * n + self.order[t][np.repeat(lo, count) + inner])
        both = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        return both // max(n, 1), both % max(n, 1)


def _search(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex], most_edits: int, long: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    pad = 2 * most_edits  # what a window near the end of a text may look beyond it
    for batch in in_chunks(batches, "text"):
        ids = np.asarray(batch.column(0))
        words, begins = _word_hashes([t or "" for t in batch.column(1).to_pylist()])
        text = np.repeat(np.arange(len(ids)), np.diff(begins))
        padded = np.full(len(words) + len(ids) * pad, _PAD)
        padded[np.arange(len(words)) + text * pad] = words
        words, begins = padded, begins + np.arange(len(begins)) * pad
        for index in indexes:
            if found := _found(words, begins, pad, ids, index, most_edits if index.width >= WIDTH_OF_EDITS else 0, long):
                yield found


def _found(words: np.ndarray, begins: np.ndarray, pad: int, ids: np.ndarray, index: ItemIndex, most_edits: int, long: tuple[int, int] | None) -> pa.RecordBatch | None:
    w = index.width
    long = long if long and index.sizes.max(initial=0) >= long[0] else None
    lengths = np.maximum(np.diff(begins) - pad - (w - most_edits) + 1, 0)  # a window that lost words is shorter
    if not lengths.any() or not len(index.at):
        return None
    doc = np.repeat(np.arange(len(ids)), lengths)
    at = begins[doc] + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    marked = np.concatenate([[0], np.cumsum(index.grams[_grams(words)])]) if len(words) >= GRAM else np.zeros(len(words) + 1, np.int64)
    near = index.may_be_near(marked, at, max(most_edits, LONG_EDITS) if long else most_edits)
    doc, at = doc[near], at[near]
    got: list[tuple[np.ndarray, ...]] = []  # text, item, first word of the item's window, its width, edits
    for i in range(0, len(at), CHUNK):
        a, b = index.hits(words, at[i : i + CHUNK])
        for j in range(0, len(a), 200_000):
            x, y = at[i + a[j : j + 200_000]], b[j : j + 200_000]
            reach = np.minimum(x[:, None] + np.arange(w + most_edits), len(words) - 1)
            distance = _edit_distance(index.words[index.at[y][:, None] + np.arange(w)], words[reach], most_edits)
            near = distance <= most_edits
            of = doc[i + a[j : j + 200_000]]
            got.append((of[near], index.item[y][near], index.offset[y][near], np.full(near.sum(), w), distance[near]))
            if long:
                got += _long_hits(words, begins, pad, index, x[~near], y[~near], of[~near], *long)
    if not got:
        return None
    d, item, offset, width, distance = (np.concatenate(c) for c in zip(*got))
    if not len(d):
        return None
    # per document and item: the narrowest window, its least distance and the item's words that lie in some matched window
    pair = d * np.int64(len(index.ids)) + item
    order = np.lexsort((offset, pair))
    pair, offset, width, distance = pair[order], offset[order], width[order], distance[order]
    firsts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    least = np.minimum.reduceat(width * np.int64(1 << 16) + distance, firsts)
    rows = []
    for f, e in zip(firsts, np.r_[firsts[1:], len(pair)]):
        ends = np.maximum.accumulate(offset[f:e] + width[f:e])
        rows.append(int((ends - np.maximum(offset[f:e], np.r_[0, ends[:-1]])).clip(0).sum()))
    who, item = pair[firsts] // len(index.ids), pair[firsts] % len(index.ids)
    columns = [pa.array(ids[who]), pa.array(index.ids[item]), pa.array(least.astype(np.int32)), pa.array(np.array(rows, np.int32)), pa.array(index.sizes[item].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "item", "least", "covered_words", "item_words"])


def _long_hits(words: np.ndarray, begins: np.ndarray, pad: int, index: ItemIndex, at: np.ndarray, y: np.ndarray, of: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hits set against each other again with as many words as `width` of the item, from the hit on or up to the item's end."""
    item = index.item[y]
    enough = index.sizes[item] >= width
    at, y, of, item = at[enough], y[enough], of[enough], item[enough]
    first = np.minimum(index.offset[y], index.sizes[item] - width)
    back = index.offset[y] - first
    _, one = np.unique((at - back) * np.int64(len(index.words) + 1) + (index.at[y] - back), return_index=True)
    at, y, of, item, first, back = (c[one] for c in (at, y, of, item, first, back))
    begin, own, low, high = at - back, index.at[y] - back, begins[of], begins[of + 1] - pad
    halves = words.astype(np.uint32), index.words.astype(np.uint32)  # half of each hash is enough to rule out

    def around(rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        here = begin[rows, None] + np.arange(-most, width + most)
        inside = (here >= low[rows, None]) & (here < high[rows, None])
        return np.where(inside, symbols[np.clip(here, 0, len(symbols) - 1)], _PAD.astype(symbols.dtype))

    kept = [np.empty(0, np.int64)]
    for i in range(0, len(at), 20_000):
        rows = np.arange(i, min(i + 20_000, len(at)))
        kept.append(rows[_keeps_enough(halves[1][own[rows, None] + np.arange(width)], around(rows, halves[0]), most)])
    kept = np.concatenate(kept)
    for i in range(0, len(kept), 20_000):
        rows = kept[i : i + 20_000]
        distance = _full_distance(index.words[own[rows, None] + np.arange(width)], around(rows, words), inner=True)
        rows, distance = rows[distance <= most], distance[distance <= most]
        yield of[rows], item[rows], first[rows], np.full(len(rows), width), distance


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, width: int = 12, most_edits: int = 1, long: tuple[int, int] | None = None) -> DataFrame:
    """(doc, item, edits, window, covered_words, item_words): documents with words near a window of the item.

    A window of `width` words, or of all words of an item that has fewer, is near consecutive words of the document, of
    which there may be up to most_edits more or fewer, at a word edit distance of at most most_edits (0: in common, and
    those are all found; a window under WIDTH_OF_EDITS words must be in common). long is another width and most edits,
    as (40, 8), for hits that aren't near by the first: among stock sentences a few edits in few words say little, and
    an item with a word in five changed, inserted or dropped shows in a long window only. window is the narrowest width
    that was near, edits its least distance; covered_words counts the item's words inside matched windows. Items of
    fewer than LEAST_WORDS words, and null or empty texts, give no row; null ids are left out; several rows of a document
    or item id count together. Ids are integers. Extra columns are ignored.

    The items are a stated query set. Up to ITEM_BLOCK windows are broadcast and set against one scan of the documents;
    more are taken block by block, each block's hits being written before the next is made. The documents are not
    shuffled but for the final grouping of the hits.
    """
    spark = documents.sparkSession
    base = documents.select(quoted(doc).cast("long").alias("doc"), quoted(text).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    given = items.select(quoted(item).cast("long").alias("i"), quoted(passage).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    blocks: list[DataFrame] = []

    def search(held: dict[int, tuple[list[int], list[str]]], last: bool) -> None:
        index = spark.sparkContext.broadcast([ItemIndex(*held[w], w) for w in sorted(held)])
        found = base.mapInArrow(lambda it: _search(it, index.value, most_edits, long), "doc bigint, item bigint, least int, covered_words int, item_words int")
        if not last or blocks:
            found = materialise(found)
            index.unpersist()
        blocks.append(found)

    held: dict[int, tuple[list[int], list[str]]] = {}
    windows = 0
    for row in given.toLocalIterator():
        words = len(WORD.findall(row.t.lower()))
        if words < LEAST_WORDS:
            continue
        w = min(width, words)
        if windows and windows + words - w + 1 > ITEM_BLOCK:
            search(held, last=False)
            held, windows = {}, 0
        ids, texts = held.setdefault(w, ([], []))
        ids.append(row.i)
        texts.append(row.t)
        windows += words - w + 1
    if windows or not blocks:
        search(held, last=True)
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    grouped = out.groupBy("doc", "item").agg(F.min("least").alias("least"), F.max("covered_words").alias("covered_words"), F.max("item_words").alias("item_words"))
    return grouped.select(F.col("doc").alias(doc), F.col("item").alias(item), F.expr("least & 65535").alias("edits"), F.expr("least >> 16").alias("window"), "covered_words", "item_words")
