"""Problem 8: mixing sources to target weights.

Method: soft-membership mixing. A classifier trained on labelled rows predicts the posteriors of the sources (domains) of
every record, with its label, where it has one, as the prior; distributed projected-gradient least squares then fits a
nonnegative rate for each record, at most its cap, so that the expected token totals of the domains match their targets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import materialise, quoted

#: Labelled rows that the classifier is trained on, at most; the bound is this parameter, not the data's size.
TRAIN_ROWS = 6_000
FEATURES = 1 << 11
STEPS = 60
#: The share of labels taken to be right before a text is read: a label yields only to a classifier that is very sure.
LABEL_PRIOR = 0.999
#: Domains kept of a record's posteriors, the likeliest ones.
MOST_DOMAINS = 16
#: The fit ends when twice no domain's total moved by more than this share of its size; the report says if it didn't get
#: there in so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-3, 500
HELD_OUT = 10  # one in so many rows of the sample tests the classifier
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
MOST_SOURCES = 10_000


def tidy(column: str):
    """A source's name without blanks around it, in lower case; null where nothing is left."""
    c = F.lower(F.trim(quoted(column).cast("string")))
    return F.when(c != "", c)


_columns: dict[str, int] = {}


def _features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(_columns) > 500_000:
        _columns.clear()
    for i, t in enumerate(texts):
        at = [_columns[w] if w in _columns else _columns.setdefault(w, zlib.crc32(w.encode()) % FEATURES) for w in _WORD.findall(t.lower())]
        if at:
            out[i] = np.bincount(at, minlength=FEATURES)
    out = np.log1p(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class SourceClassifier:
    """Softmax regression on hashed words, fitted with plain gradient steps (momentum) on the driver's bounded sample."""

    def __init__(self, texts: list[str], labels: list[int], classes: int, steps: int = STEPS):
        x = _features(texts)
        y = np.zeros((len(texts), classes), np.float32)
        y[np.arange(len(texts)), labels] = 1
        self.w, v = np.zeros((FEATURES, classes), np.float32), np.zeros((FEATURES, classes), np.float32)
        self.b = np.log(y.sum(axis=0) + 1.0).astype(np.float32)
        for _ in range(steps if len(texts) else 0):
            g = x.T @ (self._softmax(x) - y) / len(texts) + 1e-4 * self.w
            v = 0.9 * v - 8.0 * g
            self.w += v

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        if not len(self.b):
            return np.empty((len(texts), 0), np.float32)
        return np.concatenate([self._softmax(_features(texts[i : i + 512])) for i in range(0, len(texts), 512)]) if texts else np.empty((0, len(self.b)), np.float32)


def tokenizer_sizes(path: str) -> Callable[[list[str]], list[int]]:
    """Sizes in tokens of a public byte-level vocabulary; loaded once in each worker from the path given."""
    held: list = []

    def sizes(texts: list[str]) -> list[int]:
        if not held:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held.append(tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return [len(held[0].encode_ordinary(t)) for t in texts]

    return sizes


def membership(posterior: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest domains of each record and their probabilities. label: its domain, below 0 where it has none."""
    p = posterior.astype(np.float64)
    domains = p.shape[1]
    known = np.flatnonzero(label >= 0)
    if len(known) and domains > 1:
        prior = np.full((len(known), domains), (1 - LABEL_PRIOR) / (domains - 1))
        prior[np.arange(len(known)), label[known]] = LABEL_PRIOR
        p[known] = np.maximum(p[known], 1e-12) * prior
    kept = min(MOST_DOMAINS, domains)
    at = np.argpartition(-p, kept - 1, axis=1)[:, :kept] if kept < domains else np.tile(np.arange(domains), (len(p), 1))
    p = np.take_along_axis(p, at, 1)
    return at.astype(np.int32), (p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)


_MEASURED = "label int, size bigint, cap int, coin double, at array<int>, p array<float>"


def _measured(batches: Iterator[pa.RecordBatch], sizes: Callable[[list[str]], list[int]] | None, classifier, known: dict[str, int], caps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Size, membership and cap of each record. Records of sources that aren't listed are left out.

    The cap of a labelled record is its source's, that of another its likeliest domain's.
    """
    for batch in batches:
        names = batch.column(1).to_pylist()
        mine = [i for i, x in enumerate(names) if x is None or x in known]
        for begin in range(0, len(mine), 1000):
            rows = mine[begin : begin + 1000]
            part = batch.take(pa.array(rows))
            texts = [t or "" for t in part.column(2).to_pylist()]
            label = np.array([known.get(names[i], -1) for i in rows])
            at, p = membership(classifier.posteriors(texts), label)
            cap = caps[np.where(label >= 0, label, at[np.arange(len(at)), p.argmax(axis=1)])]
            n = sizes(texts) if sizes else part.column(3).to_pylist()
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), t))
            columns = [part.column(0), pa.array([x if x >= 0 else None for x in label.tolist()], pa.int32()), pa.array(n, pa.int64()), pa.array(cap.astype(np.int32)), part.column(4), lists(at, pa.int32()), lists(p, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "size", "cap", "coin", "at", "p"])


class _Rows:
    """The records of a batch as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.label = np.asarray(batch.column(1).fill_null(-1))
        self.size, self.cap, self.coin = (np.asarray(batch.column(i)) for i in (2, 3, 4))
        self.at, self.p = (np.asarray(batch.column(i).flatten()).reshape(len(batch), -1) for i in (5, 6))

    def rates(self, first: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rates after the steps so far, and the point the next step starts from, which carries on the last move (momentum).

        They are replayed from the sources' first rates and the steps' residuals: nothing is kept for a record between passes.
        """
        rate = start = np.minimum(np.where(self.label >= 0, first[self.label], 1.0), self.cap)
        for step, residual in enumerate(history):
            before, rate = rate, np.clip(start - (self.p * residual[self.at]).sum(axis=1), 0.0, self.cap)
            start = rate + step / (step + 3) * (rate - before)
        return rate, start

    def copies(self, first: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and how often each record is taken: the rate rounded up or down by the record's coin."""
        r, _ = self.rates(first, history)
        return r, np.floor(r) + (self.coin < r - np.floor(r))

    def totals(self, amount: np.ndarray, domains: int) -> np.ndarray:
        """Expected totals of the domains when so much of each record is taken."""
        return np.bincount(self.at.ravel(), (self.p * amount[:, None]).ravel(), domains)

    def labelled(self, amount: np.ndarray, domains: int) -> np.ndarray:
        known = self.label >= 0
        return np.bincount(self.label[known], amount[known], domains)


_EXPECTED, _AHEAD, _TAKEN, _REACH, _SIZE, _DOCUMENTS, _PLANNED = range(7)


def _pass(batches: Iterator[pa.RecordBatch], domains: int, first: np.ndarray, history: list[np.ndarray], planned: bool = False) -> Iterator[pa.RecordBatch]:
    """Totals of the domains under the rates so far: a few numbers for each domain and task."""
    out = np.zeros((7, domains))
    for batch in batches:
        if not len(batch):
            continue
        x = _Rows(batch)
        r, start = x.rates(first, history)
        if planned:
            taken = x.copies(first, history)[1] * x.size
            out[_PLANNED] += x.labelled(taken, domains) + x.totals(np.where(x.label < 0, taken, 0.0), domains)
        out[_EXPECTED] += x.totals(r * x.size, domains)
        out[_AHEAD] += x.totals(start * x.size, domains)
        out[_TAKEN] += x.labelled(r * x.size, domains)
        out[_REACH] += x.labelled(x.cap.astype(float) * x.size, domains)
        out[_SIZE] += x.labelled(x.size.astype(float), domains)
        out[_DOCUMENTS] += x.labelled(np.ones(len(batch)), domains)
    kind, domain = np.indices(out.shape)
    yield pa.RecordBatch.from_arrays([pa.array(kind.ravel().astype(np.int32)), pa.array(domain.ravel().astype(np.int32)), pa.array(out.ravel())], names=["kind", "domain", "total"])


class Mixture:
    """A fitted mix; report and plan are its two results."""

    def __init__(self, records: DataFrame, source: str, text: str, key: str, weights: DataFrame, w_source: str = "source", weight: str = "weight", repeats: str = "max_repeats", sizes: Callable[[list[str]], list[int]] | None = None, train_rows: int = TRAIN_ROWS, seed: int = 5):
        """sizes: texts to sizes; None: maximal runs of characters that aren't Unicode white space.

        Sources are trimmed and lower-cased. Listed sources with a null, NaN or negative weight have weight 0, those with
        null or negative max_repeats 1; a source listed twice keeps its largest weight. Records of sources that aren't
        listed are left out of the mix, records without a source belong to the listed ones by posterior; null and empty
        texts have size 0. The classifier is fitted on at most train_rows labelled rows, drawn by a hash of their key.
        Sources are a list of names that is broadcast, so there can be at most MOST_SOURCES.
        """
        spark = records.sparkSession
        w = F.coalesce(F.when(~F.isnan(quoted(weight).cast("double")) & (quoted(weight).cast("double") >= 0), quoted(weight).cast("double")), F.lit(0.0))
        m = F.coalesce(F.when(quoted(repeats).cast("int") >= 0, quoted(repeats).cast("int")), F.lit(1))
        listed = weights.select(tidy(w_source).alias("s"), w.alias("w"), m.alias("m")).where("s IS NOT NULL").groupBy("s").agg(F.max("w").alias("w"), F.max("m").alias("m")).orderBy("s").limit(MOST_SOURCES + 1).collect()
        if len(listed) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources have weights")
        self.names = [x.s for x in listed]
        self.weights = np.array([x.w for x in listed], float)
        self.caps = caps = np.array([x.m for x in listed], float)
        self.key_type = records.select(quoted(key)).dtypes[0][1]
        known = {s: i for i, s in enumerate(self.names)}
        count = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")) if sizes is None else F.lit(0)
        coin = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        base = records.select(quoted(key).alias("id"), tidy(source).alias("label"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).select("*", count.cast("long").alias("words"), coin.alias("coin"))
        labelled = base.where(F.col("label").isin(self.names)) if self.names else base.limit(0)
        # a hash below a threshold thins the rows to about the bound before the few of each task are ordered and cut
        share = min(1.0, 1.5 * train_rows / max(labelled.count(), 1))
        thinned = labelled.where(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 40)) <= int(share * (1 << 40)))
        sample = thinned.orderBy(F.xxhash64("id", "label"), "id").limit(train_rows).select("text", "label").collect()
        texts, labels = [r.text for r in sample], [known[r.label] for r in sample]
        fitted, self.accuracy = fitted_classifier(texts, labels, len(self.names))
        classifier = spark.sparkContext.broadcast(fitted)
        schema = f"id {self.key_type}, {_MEASURED}"
        if self.names:
            self.rows = materialise(base.mapInArrow(lambda it: _measured(it, sizes, classifier.value, known, caps), schema))
        else:
            self.rows = spark.createDataFrame([], schema)
        self._fit()

    def _fit(self) -> None:
        """Projected gradient steps with momentum, each scaled by the domains' sizes: the least-squares operator then has norm 1 at most.

        A source's records start at the rate that brings their own total to its target, as far as their cap lets them.
        history holds the residuals of the steps taken, expected and taken the totals under the rates they lead to.
        """
        domains = len(self.names)
        self.first, self.history = np.ones(domains), []
        self.moved = 0.0
        scale = before = None
        settled = 0
        while True:
            got = self._totals()
            self.expected, self.taken, self.reach, self.sizes, self.documents = (got[k] for k in (_EXPECTED, _TAKEN, _REACH, _SIZE, _DOCUMENTS))
            if scale is None:  # at the first pass the rates are 1 or the caps below
                scale = np.maximum(np.maximum(self.sizes, self.expected), 1.0)
                all_weight = self.weights.sum()
                self.total = self.sizes.sum()
                self.targets = self.total * self.weights / all_weight if all_weight > 0 else np.zeros(domains)
                self.first = self.targets / np.maximum(self.sizes, 1.0)
                if domains:
                    continue
            elif before is not None:
                self.moved = float((np.abs(self.expected - before) / scale).max(initial=0.0))
                settled = settled + 1 if self.moved < TOLERANCE else 0
            self.converged = not domains or settled == 2
            if self.converged or len(self.history) == MOST_ROUNDS:
                return
            before = self.expected
            self.history = [*self.history, (got[_AHEAD] - self.targets) / scale]

    def _totals(self, planned: bool = False) -> np.ndarray:
        domains, first, history = len(self.names), self.first, self.history
        out = np.zeros((7, domains))
        if domains:
            totals = self.rows.mapInArrow(lambda it: _pass(it, domains, first, history, planned), "kind int, domain int, total double")
            for r in totals.groupBy("kind", "domain").agg(F.sum("total").alias("s")).collect():  # 7 a domain
                out[r.kind, r.domain] = r.s
        return out

    def report(self) -> DataFrame:
        """A row for each listed source: what it has, what it should have, and what the mix reaches.

        size and documents count the source's labelled records; rate is what the fit takes of them in the mean.
        expected_size and reached_share are the fit's totals of the domain, by membership; planned_size and planned_share
        those of the copies that plan hands out, a labelled record counting for its source. short: its labelled records,
        each at its cap in the fit, fall short of the target. rounds, moved (the last step's largest change of a domain's
        total, as a share of its size) and converged tell how far the fit got, accuracy that of the classifier on sample rows it didn't see.
        """
        planned = self._totals(planned=True)[_PLANNED]
        every, handed, all_weight = max(self.expected.sum(), 1e-300), max(planned.sum(), 1e-300), max(self.weights.sum(), 1e-300)
        rows = [
            (
                s, int(self.documents[i]), int(self.sizes[i]), int(self.caps[i]), float(self.weights[i] / all_weight), float(self.targets[i]), float(self.taken[i] / max(self.sizes[i], 1.0)),
                float(self.expected[i]), float(self.expected[i] / every), float(planned[i]), float(planned[i] / handed), bool(self.reach[i] < self.total * self.weights[i] / all_weight),
                len(self.history), float(self.moved), bool(self.converged), self.accuracy,
            )
            for i, s in enumerate(self.names)
        ]
        schema = "source string, documents bigint, size bigint, max_repeats int, target_share double, target_size double, rate double, expected_size double, reached_share double, planned_size double, planned_share double, short boolean, rounds int, moved double, converged boolean, accuracy double"
        return self.rows.sparkSession.createDataFrame(rows, schema)

    def plan(self, key: str) -> DataFrame:
        """(key, source, size, rate, copies): how often each record of the mix is taken. source is null for soft members.

        copies is the rate, rounded up or down by a hash of the key so that its mean is the rate; it is never above the cap.
        """
        first, history, names = self.first, self.history, self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = _Rows(batch)
                    rate, copies = x.copies(first, history)
                    source = pa.array([names[i] if i >= 0 else None for i in x.label.tolist()], pa.string())
                    out = pa.RecordBatch.from_arrays([batch.column(0), source, batch.column(2), pa.array(rate), pa.array(copies.astype(np.int32))], names=["id", "source", "size", "rate", "copies"])
                    yield out.filter(pa.array(copies > 0))

        return self.rows.mapInArrow(run, f"id {self.key_type}, source string, size bigint, rate double, copies int").withColumnRenamed("id", key)


def fitted_classifier(texts: list[str], labels: list[int], classes: int) -> tuple[SourceClassifier, float | None]:
    """A classifier, and the share of the rows held out of its fitting (every HELD_OUT-th) whose label it finds; None and all rows fitted for too few."""
    if len(texts) < 5 * HELD_OUT:
        return SourceClassifier(texts, labels, classes), None
    rest, held = ([i for i in range(len(texts)) if (i % HELD_OUT == 0) == out] for out in (False, True))
    c = SourceClassifier([texts[i] for i in rest], [labels[i] for i in rest], classes)
    return c, float(np.mean(c.posteriors([texts[i] for i in held]).argmax(axis=1) == [labels[i] for i in held]))
