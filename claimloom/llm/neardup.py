"""Problem 4: near-duplicate records with small edits.

Method: count-vector R-tree. The word sequences of a record are hashed into groups; the counts of the groups are a point.
Points are put in the order of their sizes and contents and packed into a tree: leaves of LEAF points, pages of leaves,
nodes of pages, each with the box that bounds it. Two records can't share more sequences than the sum of their counts'
minima, two boxes' records not more than the sum of the boxes' minima. The tree is joined with itself from the nodes
down; only what survives is opened, and the surviving pairs of records are verified with their full sets.

A point is held as two planes of bits, the groups with at least one and with at least two sequences, and the number of
sequences beyond; minima then are counted by machine words, and a box is the OR of its points. Every step is exact: the
bounds never lose a pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import counting_rows, in_chunks
from claimloom.llm.leaks import WORD
from claimloom.llm.splits import connected_components
from claimloom.session import materialise, quoted

LEAF, PAGE, NODE = 16, 1024, 32  # points of a leaf, points of a page, pages of a node
PAGE_BYTES = 16 << 20  # a page of long records holds fewer points
BANDS = 4  # bands of sizes that partners may lie apart
SALTS = 16


def sequence_hashes(text: str, words: int, known: dict[str, int] | None = None) -> np.ndarray:
    """The distinct sequences of so many consecutive words, as sorted 64-bit hashes. known: hashes of words met before."""
    w = WORD.findall(text.lower())
    if len(w) < words:
        return np.empty(0, np.int64)
    known = {} if known is None else known
    h = np.array([known.get(x) or known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in w], np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - words + 1, np.uint64)
        for i in range(words):
            out = (out ^ h[i : len(w) - words + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return np.unique(out).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in in_chunks(batches, "text", 4_000_000):
        if len(known) > 500_000:
            known.clear()
        rows = [(i, sequence_hashes(t or "", words, known)) for i, t in enumerate(batch.column(1).to_pylist())]
        rows = [r for r in rows if len(r[1])]
        if rows:
            flat = np.concatenate([r[1] for r in rows])
            offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
            names = [np.array([xxhash.xxh3_64_intdigest(r[1].tobytes(), seed=s) for r in rows], np.uint64).view(np.int64) for s in (0, 1)]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array(names[0]), pa.array(names[1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "class", "proof", "n", "hashes"])


def dimensions(n: int) -> int:
    """Groups for a record of n sequences: a power of two, so that a larger number folds onto a smaller."""
    return 1 << max(8, math.ceil(math.log2(2 * max(n, 1))))


def planes(hashes: np.ndarray, dims: int) -> np.ndarray:
    """Which groups hold at least one sequence, and which at least two: two rows of bits."""
    counts = np.bincount(hashes & (dims - 1), minlength=dims)
    return np.packbits(np.stack([counts >= 1, counts >= 2]), axis=1, bitorder="little").view(np.uint64)


def fold(p: np.ndarray, dims: int) -> np.ndarray:
    """Planes (..., 2, words) on a smaller number of groups."""
    w = dims // 64
    if p.shape[-1] == w:
        return p
    parts = p.reshape(*p.shape[:-1], -1, w)
    one, two = parts[..., 0, 0, :].copy(), parts[..., 1, 0, :].copy()
    for i in range(1, parts.shape[-2]):
        two |= parts[..., 1, i, :] | (one & parts[..., 0, i, :])
        one |= parts[..., 0, i, :]
    return np.stack([one, two], axis=-2)


def held(p: np.ndarray) -> np.ndarray:
    """Bits of each plane."""
    return np.bitwise_count(p).sum(axis=-1, dtype=np.int64)


def box(p: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(p, axis=0)


def beyond(ns: np.ndarray, points: np.ndarray) -> list[int]:
    """The most sequences that a point's planes don't show, on all groups, on half of them, and so on."""
    out, dims = [], 64 * points.shape[-1]
    while dims >= 64:
        points = fold(points, dims)
        out.append(int((ns - held(points).sum(axis=1)).max()))
        dims //= 2
    return out


_PAGE_NAMES = ["page", "node", "band", "n_min", "n_max", "beyond", "box", "classes", "ns", "points"]
_PAGE_SCHEMA = "page bigint, node bigint, band int, n_min int, n_max int, beyond array<int>, box binary, classes array<bigint>, ns array<int>, points binary"
_HEAD = ["n_min", "n_max", "beyond", "box"]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs consecutive points of a band; the partition is sorted by band and content."""
    context = TaskContext.get()
    page = node = (context.partitionId() if context else 0) << 32
    in_node, node_band = 0, None
    waiting: list[tuple[int, int, int, np.ndarray]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        nonlocal page, node, in_node, node_band, size
        band = waiting[0][0]
        if node_band is not None and (band != node_band or in_node == NODE):
            node, in_node = node + 1, 0
        node_band, in_node = band, in_node + 1
        ns = np.array([h[2] for h in waiting], np.int32)
        dims = dimensions(int(ns.max()))
        points = np.stack([planes(h[3], dims) for h in waiting])
        row = [page, node, band, int(ns.min()), int(ns.max()), beyond(ns, points), box(points).tobytes(), [h[1] for h in waiting], ns.tolist(), zlib.compress(points.tobytes(), 1)]
        page, size = page + 1, 0
        waiting.clear()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=_PAGE_NAMES)

    for batch in batches:
        hashes = batch.column(3)
        for band, name, n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), range(len(batch))):
            if waiting and (waiting[0][0] != band or len(waiting) == PAGE or size > PAGE_BYTES):
                yield packed()
            waiting.append((band, name, n, np.asarray(hashes[i].values)))
            size += dimensions(n) // 4
    if waiting:
        yield packed()


def _planes_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64).reshape(2, -1)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of a node's pages, at most NODE of them, as one."""
    for batch in batches:
        boxes, rests = [], []
        for pages in batch.column(4).to_pylist():
            p = [_planes_of(x["box"]) for x in pages]
            words = min(x.shape[1] for x in p)
            boxes.append(box(np.stack([fold(x, 64 * words) for x in p])).tobytes())
            folded = [x["beyond"][(y.shape[1] // words).bit_length() - 1 :] for x, y in zip(pages, p)]
            rests.append([max(r) for r in zip(*folded)])
        columns = [*batch.columns[:4], pa.array(rests, pa.list_(pa.int32())), pa.array(boxes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "band", *_HEAD])


def _needed(n_a, n_b, threshold: float):
    """Common sequences of two sets of which they make up at least the threshold of all."""
    return threshold / (1 + threshold) * (n_a + n_b) - 1e-9


def _boxes_meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(p, q) of the rows (p, q, n_min, beyond and box of either) whose boxes may hold a pair."""
    for batch in batches:
        p, q, n_a, n_b, rest_a, rest_b, x, y = (batch.column(i).to_pylist() for i in range(8))
        keep = []
        for i in range(len(p)):
            a, b = _planes_of(x[i]), _planes_of(y[i])
            words = min(a.shape[1], b.shape[1])
            rest = min(r[(z.shape[1] // words).bit_length() - 1] for r, z in ((rest_a[i], a), (rest_b[i], b)))
            if held(fold(a, 64 * words) & fold(b, 64 * words)).sum() + rest >= _needed(n_a[i], n_b[i], threshold):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (p, q)], names=["p", "q"])


class _Side:
    """The points of a page on so many groups, with the boxes of its leaves."""

    def __init__(self, classes: list[int], ns: list[int], points: np.ndarray, dims: int):
        self.classes, self.ns, self.points = np.array(classes, np.int64), np.array(ns, np.int64), fold(points, dims)
        ones, twos = held(self.points).T
        self.after_one, self.after_two = self.ns - ones, self.ns - ones - twos
        begins = np.arange(0, len(ns), LEAF)
        self.boxes = np.bitwise_or.reduceat(self.points, begins, axis=0)
        self.least, self.rest = np.minimum.reduceat(self.ns, begins), np.maximum.reduceat(self.after_two, begins)


def _pairs_within(a: _Side, b: _Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the points of two pages that may be near, leaf by leaf and then point by point."""
    x, y = [], []
    for leaf in range(len(a.boxes)):
        first = leaf if same else 0
        common = held(b.boxes[first:] & a.boxes[leaf]).sum(axis=1) + np.minimum(b.rest[first:], a.rest[leaf])
        leaves = first + np.flatnonzero(common >= _needed(a.least[leaf], b.least[first:], threshold))
        if not len(leaves):
            continue
        whole = len(leaves) * LEAF >= 0.9 * (len(b.ns) - first * LEAF)
        rows = np.arange(first * LEAF, len(b.ns)) if whole else (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(b.ns)]
        ones = b.points[first * LEAF :, 0] if whole else b.points[rows, 0]
        ns, after_one = b.ns[rows], b.after_one[rows]
        for i in range(leaf * LEAF, min((leaf + 1) * LEAF, len(a.ns))):
            least = _needed(a.ns[i], ns, threshold)
            may = np.bitwise_count(ones & a.points[i, 0]).sum(axis=1, dtype=np.int64) + np.minimum(after_one, a.after_one[i]) >= least
            may &= np.minimum(ns, a.ns[i]) >= least
            if same:
                may &= rows > i
            k = np.flatnonzero(may)
            if len(k):
                j = rows[k]
                k = j[held(b.points[j] & a.points[i]).sum(axis=1) + np.minimum(b.after_two[j], a.after_two[i]) >= least[k]]
                x.append(np.full(len(k), i))
                y.append(k)
    if not x:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(x), np.concatenate(y)


def _page_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            r = batch.slice(i, 1).to_pylist()[0]
            raw = [np.frombuffer(zlib.decompress(r[f"points_{s}"]), np.uint64).reshape(len(r[f"ns_{s}"]), 2, -1) for s in "ab"]
            dims = 64 * min(x.shape[2] for x in raw)
            a, b = (_Side(r[f"classes_{s}"], r[f"ns_{s}"], x, dims) for s, x in zip("ab", raw))
            x, y = _pairs_within(a, b, threshold, r["p"] == r["q"])
            x, y = a.classes[x], b.classes[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _meeting(left: DataFrame, right: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(p, q) of the boxes of two tables (p, _HEAD) and (q, _HEAD), joined, that may hold a pair; each pair in one order."""
    both = left.select(*on, "p", *[F.col(c).alias(f"{c}_a") for c in [*_HEAD, "band"]]).join(right.select(*on, "q", *[F.col(c).alias(f"{c}_b") for c in [*_HEAD, "band"]]).hint("merge"), on)
    sizes_fit = (F.col("n_min_b") * threshold <= F.col("n_max_a") + 1e-9) & (F.col("n_min_a") * threshold <= F.col("n_max_b") + 1e-9)
    order = (F.col("band_a") < F.col("band_b")) | ((F.col("band_a") == F.col("band_b")) & (F.col("p") <= F.col("q")))
    rows = both.where(sizes_fit & order).select("p", "q", "n_min_a", "n_min_b", "beyond_a", "beyond_b", "box_a", "box_b")
    return rows.mapInArrow(lambda it: _boxes_meet(it, threshold), "p bigint, q bigint")


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, total): pairs of classes whose common sequences are at least threshold of all of both.

    sets: (class, n, hashes), one row a class. Sizes are put into bands, so that partners are at most BANDS apart; within
    a band points are in the order of their least hash, which puts most near ones side by side. The joins of boxes and
    points never broadcast: what is small compressed may be large.
    """
    step = -math.log(threshold) / BANDS * (1 + 1e-9)
    banded = sets.select(F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("band"), "class", "n", "hashes")
    order = ["band", F.expr("hashes[0]"), "class"]
    pages = materialise(banded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pages, _PAGE_SCHEMA))
    grouped = pages.groupBy("node", "band").agg(F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"), F.collect_list(F.struct("beyond", "box")).alias("pages"))
    nodes = grouped.select("node", "band", "n_min", "n_max", "pages").mapInArrow(_nodes, "node bigint, band int, n_min int, n_max int, beyond array<int>, box binary")
    left = nodes.select(F.col("node").alias("p"), "band", *_HEAD, F.pmod("node", F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.col("band"), F.col("band") + BANDS)).alias("on"))
    right = nodes.select(F.col("node").alias("q"), "band", *_HEAD, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("band").alias("on"))
    node_pairs = _meeting(left, right.withColumn("salt", F.col("salt").cast("bigint")), ["on", "salt"], threshold)
    # the pages of each node pair that meets
    page_left = node_pairs.withColumnRenamed("p", "node").join(pages.select("node", F.col("page").alias("p"), "band", *_HEAD).hint("merge"), "node").select("p", "band", *_HEAD, F.col("q").alias("node"))
    page_right = pages.select("node", F.col("page").alias("q"), "band", *_HEAD)
    pairs = _meeting(page_left, page_right, ["node"], threshold)
    body = lambda key, s: pages.select(F.col("page").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in ("classes", "ns", "points")]).hint("merge")
    candidates = pairs.join(body("p", "a"), "p").join(body("q", "b"), "q").mapInArrow(lambda it: _page_pairs(it, threshold), "a bigint, b bigint").distinct()
    ends = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("class"), "a", "b"), F.struct(F.col("b").alias("class"), "a", "b"))).alias("s")).select("s.*")
    met = ends.join(sets.select("class", "hashes").hint("merge"), "class").groupBy("a", "b").agg(F.collect_list("hashes").alias("h"))  # two sets a pair
    common = F.size(F.array_intersect(F.col("h")[0], F.col("h")[1]))
    verified = met.select("a", "b", common.alias("common"), (F.size(F.col("h")[0]) + F.size(F.col("h")[1]) - common).alias("total"))
    return verified.where(F.col("common") >= threshold * F.col("total") - 1e-9)


def duplicate_sets(texts: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and the classes' sets (class, n, hashes): records with equal sets of sequences are one class.

    A class is a 64-bit name of its set; a second name proves that no two sets share one. Should that ever happen, the
    job fails rather than merge them.
    """
    base = texts.select(quoted(key).cast("string").alias("key"), quoted(text).cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    made = materialise(base.mapInArrow(lambda it: _sets(it, words), "key string, class bigint, proof bigint, n int, hashes array<bigint>"))
    one = F.when(F.min("proof") == F.max("proof"), F.first("n")).otherwise(F.raise_error(F.lit("two sets of sequences have the same 64-bit name"))).alias("n")
    return made.select("key", "class").distinct(), made.groupBy("class").agg(one, F.first("hashes").alias("hashes"))


def near_duplicate_links(texts: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) of the classes of exact copies, and links (a, b, common, total) between classes.

    Similarity is the sequences in both sets over those in either. Records with fewer words than a sequence, null keys
    and null texts are in no class; rows repeated with the same key and text count once, extra columns are ignored.
    """
    members, sets = duplicate_sets(texts, key, text, words)
    return members, similar_classes(sets, threshold)


def near_duplicate_pairs(texts: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b), a < b: near_duplicate_links written out as all pairs of records, copies included.

    m copies make m * (m - 1) / 2 rows; where that is too much, links and members hold the same in m.
    """
    members, links = near_duplicate_links(texts, key, text, words, threshold)
    across = links.select("a", "b").join(members.select(F.col("class").alias("a"), F.col("key").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    within = members.alias("m").join(members.alias("o"), (F.col("m.class") == F.col("o.class")) & (F.col("m.key") < F.col("o.key"))).select(F.col("m.key").alias("x"), F.col("o.key").alias("y"))
    return across.unionByName(within).where("x != y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def near_duplicate_groups(texts: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, group, links): each record with its group, named by its least key, and its links to different texts.

    Groups are the connected components of near_duplicate_links; copies aren't expanded into pairs. Records alone in
    their group have a row too; those with fewer words than a sequence have none.
    """
    members, found = near_duplicate_links(texts, key, text, words, threshold)
    links = materialise(found.select("a", "b"))
    root = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("class"), F.col("component").alias("root"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    placed = members.join(root, "class", "left").withColumn("root", F.coalesce("root", "class")).join(degree, "class", "left")
    names = placed.groupBy("root").agg(F.min("key").alias("group"))
    return placed.join(names, "root").select(F.col("key").alias(key), "group", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def patent_texts(patents: DataFrame) -> DataFrame:
    """(patent_id, text) of the counting row of each patent: abstract, claims and description joined by blanks."""
    whole = F.concat_ws(" ", "abstract", "claims_raw", "description_paragraphs").alias("text")
    rows = patents.select("patent_id", "ingested_at", whole).join(counting_rows(patents), (F.col("patent_id") == F.col("_key")) & F.col("ingested_at").eqNullSafe(F.col("_at")))
    # deliveries of one time that differ: the one with the least text hash counts
    return rows.groupBy("patent_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
