"""Problem 9: text read with the wrong character encoding.

Method: adjacent character pairs are scored by the mutual information that the corpus gives them; maximum-scoring
segments isolate the improbable runs; inverse mappings (write with the wrong encoding, read with the right one) are tried
only inside those runs, and accepted where the corpus finds the result far more probable.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import in_chunks
from claimloom.session import quoted

#: Pairs are counted in so many cells of a hash table, whatever the corpus' size: what is broadcast has a fixed size.
PAIR_CELLS = 1 << 21
CHARS = 1 << 17  # code points beyond are folded
UTF8_READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "gbk", "cp932", "big5", "cp949"]
#: (read as, written as) -> how much more a rarer mix-up has to gain.
SINGLE_BYTE = {(wrong, "cp1252"): 0.0 for wrong in ("mac_roman", "cp437", "cp850", "cp1251")}
SINGLE_BYTE |= {(wrong, "cp1252"): 3.0 for wrong in ("latin-1", "cp1250", "cp866", "koi8_r", "iso8859_2", "cp1253")}
SINGLE_BYTE |= {(wrong, right): 4.0 for wrong in ("cp1252", "latin-1") for right in ("mac_roman", "cp850", "cp1250", "cp1251")}
#: Least gain in log probability: of a run read as UTF-8, whose form alone is strong evidence, and of another.
GAIN_UTF8, GAIN_OTHER = 1.5, 5.0
#: A pair is improbable where its cubic mutual information is below minus this.
IMPROBABLE = 17.0
REPLACEMENT = "�"
#: Islands of at most so many characters are tried in all their parts, longer ones in their runs of whole sequences.
SHORT_ISLAND = 12
#: Longer islands are judged anew each time, which keeps the caches small.
CACHED = 200


def _codes(texts: list[str]) -> np.ndarray:
    """Code points with digits made one and texts set apart by a line feed."""
    a = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return np.where(a < CHARS, a, CHARS - 1 - (a & 1023))


def _cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63)) >> np.uint64(20)) & np.uint64(PAIR_CELLS - 1)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts: cells of pairs at and above 0, characters below 0. At most PAIR_CELLS + CHARS rows."""
    pairs, chars = np.zeros(PAIR_CELLS, np.int64), np.zeros(CHARS, np.int64)
    for batch in in_chunks(batches, "text"):
        c = _codes([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
        chars += np.bincount(c, minlength=CHARS)
        cells, n = np.unique(_cell(c[:-1], c[1:]), return_counts=True)
        pairs[cells.astype(np.int64)] += n
    p, q = np.flatnonzero(pairs), np.flatnonzero(chars)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[p, -1 - q]), pa.array(np.r_[pairs[p], chars[q]])], names=["at", "n"])


class PairModel:
    """Log counts of characters and pairs of the whole corpus, in two arrays of fixed size."""

    def __init__(self, at: np.ndarray, n: np.ndarray):
        self.pairs, self.chars = np.zeros(PAIR_CELLS, np.float32), np.zeros(CHARS, np.float32)
        self.pairs[at[at >= 0]] = n[at >= 0]
        self.chars[-1 - at[at < 0]] = n[at < 0]
        self.total = float(max(self.chars.sum(), 1))

    def improbability(self, c: np.ndarray) -> np.ndarray:
        """Of each adjacent pair: minus its cubic mutual information log(p(xy)^3 / (p(x) p(y))), above the threshold.

        The cube weighs the mutual information by how common the pair is; plain, it would be highest for rare pairs.
        """
        n = np.maximum(self.pairs[_cell(c[:-1], c[1:]).astype(np.int64)], 0.5)
        one = np.maximum(self.chars[c], 0.5)
        information = 3 * np.log(n / self.total) - np.log(one[:-1] / self.total) - np.log(one[1:] / self.total)
        return -information - IMPROBABLE

    def log_probability(self, text: str, own: bool = False) -> float:
        """Of the characters of a text after its first, each given the one before."""
        c = _codes([text])[1:-1]
        if len(c) < 2:
            return 0.0
        # smoothing in proportion to the corpus keeps the gain the same at every size
        s = 2e-8 * self.total
        n = self.pairs[_cell(c[:-1], c[1:]).astype(np.int64)]
        if own:  # the occurrence at hand doesn't speak for itself
            n = np.maximum(n - 1, 0)
        return float(np.sum(np.log((n + s) / (self.chars[c[:-1]] + 400 * s))))


def maximal_segments(scores: np.ndarray, rest: float = -2.0) -> list[tuple[int, int]]:
    """Ruzzo and Tompa's maximal scoring segments [a, b). A score below `rest` counts as `rest`."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(np.maximum(scores, rest))])
    stack: list[tuple[int, int, float, float]] = []
    edges = np.flatnonzero(np.diff(positive) > 1)
    for a, b in zip(positive[np.r_[0, edges + 1]], positive[np.r_[edges, len(positive) - 1]] + 1):
        begin, left, right = int(a), total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, int(b), left, right))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1]) for s in stack]


def _fallback_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes a text was read from; what an encoding leaves undefined was then read as the control of that number."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding in ("gbk", "cp932", "big5", "cp949"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _plausible(text: str) -> bool:
    return all(ch.isprintable() or ch in "\n\t\xa0\xad  " for ch in text)


class Repairer:
    def __init__(self, model: PairModel):
        self.model = model
        self.table: dict[tuple[str, str], dict[str, str]] = {}
        for wrong, right in SINGLE_BYTE:
            both = [(bytes([b]).decode(wrong, "ignore"), bytes([b]).decode(right, "ignore")) for b in range(0x80, 0x100)]
            self.table[wrong, right] = {x: y for x, y in both if x and y and x != y and y.isprintable()}
        self.utf8: dict[tuple[str, int], list[tuple[str, str]]] = {}
        self.tried: dict[tuple, object] = {}

    def _utf8(self, island: str, undone: int = 0) -> list[tuple[str, str]]:
        """(encoding, original) of an island of non-ASCII characters as UTF-8 read with an encoding, up to three times."""
        known = self.utf8.get((island, undone))
        if known is None:
            known = []
            for wrong in UTF8_READ_AS:
                raw = _fallback_bytes(island, wrong)
                if raw is None:
                    continue
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if text != island:
                    if _plausible(text):
                        known.append((wrong, text))
                    if 1 < len(text) < len(island) and undone < 2:
                        known += [(f"{wrong}+{w}", t) for w, t in self._utf8(text, undone + 1)]
            if len(self.utf8) > 50_000:
                self.utf8.clear()
            if len(island) <= CACHED:
                self.utf8[island, undone] = known
        return known

    def _runs(self, island: str) -> Iterator[tuple[int, int]]:
        """Maximal runs of the island that are whole UTF-8 sequences in some encoding, found in one pass for each encoding."""
        n = len(island)
        for wrong in UTF8_READ_AS:
            coded = [_fallback_bytes(ch, wrong) for ch in island]
            i = 0
            while i < n:
                end, due = i, 0
                for j in range(i, n):
                    for byte in coded[j] or b"\0":
                        if due:
                            due = due - 1 if 0x80 <= byte < 0xC0 else -1
                        else:
                            due = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else -1
                        if due < 0:
                            break
                    if due < 0:
                        break
                    if not due:
                        end = j + 1
                if end > i + 1:
                    yield i, end
                i = max(end, i + 1)

    def repair(self, text: str) -> tuple[str, list[str], int]:
        """(repaired text, encodings undone, characters that came out wrong)."""
        c = _codes([text])
        bad = text.count(REPLACEMENT)
        scores = self.model.improbability(c[1:-1]) if len(c) > 3 else np.empty(0)
        runs = []
        for a, b in maximal_segments(scores):
            lo, hi = a, b + 1  # characters; widened to whole islands of non-ASCII ones
            while lo > 0 and ord(text[lo - 1]) > 127:
                lo -= 1
            while hi < len(text) and ord(text[hi]) > 127:
                hi += 1
            if any(ord(ch) > 127 for ch in text[lo:hi]):
                if runs and lo <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
                else:
                    runs.append((lo, hi))
        out, undone, wrong, last = [], [], bad, 0
        plan: list[tuple[int, int, str, str, float]] = []
        for lo, hi in runs:
            plan += self._utf8_islands(text, lo, hi)
        taken = {(p[0], p[1]) for p in plan}
        plan += self._single_bytes(text, runs, taken)
        for lo, hi, name, new, _ in sorted(plan):
            out += [text[last:lo], new]
            last = hi
            undone.append(name)
            wrong += hi - lo
        return "".join(out) + text[last:], undone, wrong

    def _islands(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        i = lo
        while i < hi:
            if ord(text[i]) > 127:
                j = i
                while j < len(text) and ord(text[j]) > 127:
                    j += 1
                yield i, j
                i = j
            else:
                i += 1

    def _gain(self, before: str, old: str, after: str, new: str) -> float:
        return self.model.log_probability(before + new + after) - self.model.log_probability(before + old + after, own=True)

    def _utf8_best(self, before: str, old: str, after: str) -> list[tuple[int, int, str, str, float]]:
        """The parts of an island that are most surely UTF-8 read wrongly.

        Of a short one that is the whole or, where another character joins it, the longest part; of a long one its
        maximal runs of whole sequences, the surest first.
        """
        n = len(old)
        short = n <= SHORT_ISLAND
        if short:
            parts = sorted(((a, b) for a in range(n) for b in range(a + 2, n + 1)), key=lambda x: x[0] - x[1]) if n > 1 else [(0, n)]
        else:
            parts = sorted({(0, n), *self._runs(old)}, key=lambda x: x[0] - x[1])
        found: list[tuple[int, int, str, str, float]] = []
        for a, b in parts:
            for wrong, original in self._utf8(old[a:b]):
                gain = self._gain(old[a - 1] if a else before, old[a:b], old[b] if b < n else after, original)
                if gain >= GAIN_UTF8:
                    found.append((a, b, wrong, original, gain))
            if found and (a, b) == (0, n):
                break
        best: list[tuple[int, int, str, str, float]] = []
        for option in sorted(found, key=lambda x: -x[4]):  # sorting is stable: of equal gains the longer part
            if not any(option[0] < b and a < option[1] for a, b, *_ in best):
                best.append(option)
                if short:
                    break
        return best

    def _single_options(self, before: str, old: str, after: str) -> list[tuple[tuple[str, str], str, float]]:
        found = []
        for names, table in self.table.items():
            new = "".join(table.get(ch, ch) for ch in old)
            if new != old and _plausible(new) and (gain := self._gain(before, old, after, new)) > 2:
                found.append((names, new, gain))
        return found

    def _tried(self, kind: int, text: str, i: int, j: int):
        """What the mappings make of an island between its neighbours; the same ones come again and again."""
        key = (kind, text[max(0, i - 1) : i] or "\n", text[i:j], text[j : j + 1] or "\n")
        known = self.tried.get(key)
        if known is None:
            known = (self._single_options if kind else self._utf8_best)(*key[1:])
            if len(self.tried) > 200_000:
                self.tried.clear()
            if j - i <= CACHED:
                self.tried[key] = known
        return known

    def _utf8_islands(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str, str, float]]:
        found = []
        for i, j in self._islands(text, lo, hi):
            found += [(i + a, i + b, *rest) for a, b, *rest in self._tried(0, text, i, j)]
        return found

    def _single_bytes(self, text: str, runs: list[tuple[int, int]], taken: set[tuple[int, int]]) -> list[tuple[int, int, str, str, float]]:
        """One mapping for all islands of the text that it explains: a passage is read with one encoding."""
        plans: dict[tuple[str, str], list[tuple[int, int, str, str, float]]] = {}
        for lo, hi in runs:
            for i, j in self._islands(text, lo, hi):
                if not any(a < j and i < b for a, b in taken):
                    for names, new, gain in self._tried(1, text, i, j):
                        plans.setdefault(names, []).append((i, j, "<".join(names), new, gain))
        best: tuple[float, list[tuple[int, int, str, str, float]]] = (0.0, [])
        for names, plan in plans.items():
            sure: dict[str, float] = {}
            for i, j, _, _, gain in plan:  # the same characters again are no further evidence
                sure[text[i:j]] = min(gain, sure.get(text[i:j], gain))
            gained = sum(sure.values()) - SINGLE_BYTE[names]
            if gained > best[0]:
                best = (gained, plan)
        return best[1] if best[0] >= GAIN_OTHER else []


def _mend(batches: Iterator[pa.RecordBatch], model: PairModel) -> Iterator[pa.RecordBatch]:
    repairer = Repairer(model)
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new, undone, wrong = repairer.repair(text)
            if wrong:
                rows.append((key, wrong, sorted(set(undone)), REPLACEMENT not in new, new))
        if rows:
            columns = list(zip(*rows))
            types = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "wrong_chars", "undone", "restored", "text"])


def mend_encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, wrong_chars, undone, restored, text): one row for each row of df whose text was read with a wrong encoding.

    wrong_chars counts the characters affected, undone names the encodings undone, restored is false where replacement
    characters stay. Null, empty and all-ASCII texts give no row; a null key is kept; repeated rows are judged alike;
    extra columns are ignored. The model counts the pairs of all texts in a table of fixed size; nothing is shuffled
    but its cells.
    """
    spark = df.sparkSession
    base = df.select(quoted(key).alias("id"), quoted(text).cast("string").alias("text")).where("text IS NOT NULL AND text != ''")
    cells = base.mapInArrow(_pair_counts, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most PAIR_CELLS + CHARS rows
    model = spark.sparkContext.broadcast(PairModel(cells["at"].to_numpy(), cells["n"].to_numpy()))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, wrong_chars int, undone array<string>, restored boolean, text string"
    mended = base.where(F.col("text").rlike("[^\\x00-\\x7F]")).mapInArrow(lambda it: _mend(it, model.value), schema)
    return mended.withColumnRenamed("id", key)
