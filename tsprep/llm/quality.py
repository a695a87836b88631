"""Quality classification by a generalised additive model with pairwise interactions.

Each text becomes some twenty figures. Boosting goes round the features in turn: each step fits a shallow tree on one
feature's bins to the loss's gradient and adds it to that feature's table. Then the pairs of features
whose joint bins explain most of what is left get tables of their own, boosted the same way. The model is
nothing but bin edges and tables, so a score is a sum of looked-up values, made for a whole batch at once.

Learning uses a bounded sample of labels (`max_sample`) with their whole texts, whose figures are the only part that the driver sees. Defined results: null texts count as empty and get a score like any other; without
labelled rows every score is 0.5; with one class only it is near that class. Ties in a split go to the first;
repeated rows get equal scores. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, record_batch, rows_map, slices

#: Labelled rows that are learned from at most.
MAX_SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 10, 120, 60, 0.15, 3
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "top_pair", "repeated_next",
    "upper", "caps_words", "digits", "spaces", "symbols", "stops", "commas", "lines_mean", "repeated_lines", "symbol_words", "lone_symbols", "ending_stops", "capital_words", "common_words", "deflated",
)


def _spread() -> np.ndarray:
    """The kind of each byte: 1 upper, 2 digit, 3 space, 4 stop, 5 comma, 6 other sign, 0 letters and the bytes of long characters."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 6
    kinds[[*range(ord("a"), ord("z") + 1)]] = 0
    kinds[[*range(ord("A"), ord("Z") + 1)]] = 1
    kinds[[*range(ord("0"), ord("9") + 1)]] = 2
    kinds[[9, 10, 11, 12, 13, 32]] = 3
    kinds[[ord(c) for c in ".!?"]] = 4
    kinds[[ord(c) for c in ",;:'\"-()"]] = 5
    return kinds


_KINDS = _spread()


def figures(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=7) / n
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    common = counts.most_common(3)
    pairs = Counter(zip(words, words[1:], strict=False)).most_common(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    head = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    ends, heads = _KINDS[last], _KINDS[head]
    packed = len(zlib.compress(data, 1)) / n if data else 1.0
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / m, float((lengths > 14).sum()) / m, float((lengths < 4).sum()) / m,
        len(counts) / m, (common[0][1] if common else 0) / m, (pairs[0][1] if pairs else 0) / m, sum(map(bytes.__eq__, words[1:], words)) / m,
        kinds[1], sum(map(bytes.isupper, words)) / m, kinds[2], kinds[3], kinds[6], kinds[4], kinds[5],
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), float((ends == 6).sum()) / m, float(((lengths == 1) & (heads >= 4)).sum()) / m,
        float((ends == 4).sum()) / m, float((heads == 1).sum()) / m, sum(c for _, c in common) / m, packed,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([figures(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """The values of a tree with so many leaves on ordered bins: greedy best cuts, a Newton step in each leaf."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    fit = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = fit(a, cut) + fit(cut, b) - fit(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], s, int(cut[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    values = np.zeros(len(gradient))
    for a, b in spans:
        values[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return values


class Model:
    """Bin edges, a table for each feature, coarser edges and a table for each chosen pair."""

    def __init__(self):
        self.bias, self.edges, self.tables, self.coarse, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y):
            return self
        rate = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        self.edges = [self._edges(x[:, k], BINS) for k in range(x.shape[1])]
        self.coarse = [self._edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for k, bins in enumerate(fine):
                if not len(self.edges[k]):
                    continue
                p = 1 / (1 + np.exp(-total))
                size = len(self.tables[k])
                step = RATE * _tree(np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size), LEAVES)
                self.tables[k] += step
                total += step[bins]
        p = 1 / (1 + np.exp(-total))
        worth = []
        for i, j in combinations(range(len(coarse)), 2):
            size = (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)
            cell = coarse[i] * (len(self.coarse[j]) + 1) + coarse[j]
            worth.append((-float((np.bincount(cell, y - p, size) ** 2 / (np.bincount(cell, p * (1 - p), size) + 1)).sum()), i, j))
        self.pairs = [[i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))] for _, i, j in sorted(worth)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-total))
                cell = coarse[i] * table.shape[1] + coarse[j]
                g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
                # A cut of one feature, and within each side a tree on the other.
                cut = int(np.argmax([(g[:c].sum() ** 2) / (h[:c].sum() + 1) + (g[c:].sum() ** 2) / (h[c:].sum() + 1) for c in range(1, len(g))])) + 1 if len(g) > 1 else len(g)
                step = np.zeros(table.shape)
                for side in (slice(0, cut), slice(cut, None)):
                    if g[side].size:
                        step[side] = RATE * _tree(g[side].sum(0), h[side].sum(0), 2, ridge=5.0)
                table += step
                total += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if self.edges and len(x):
            for table, bins in zip(self.tables, self._bins(x, self.edges), strict=True):
                total += table[bins]
            coarse = self._bins(x, self.coarse)
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _measured(batches):
    for batch in slices(batches, "text", rows=256, max_bytes=2 << 20):
        found = matrix(batch.column("text").to_pylist())
        yield record_batch(label=batch.column("label"), x=list(found))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_sample: int = MAX_SAMPLE) -> Model:
    """A model of the labelled rows of docs; labels that are not 0 or 1 are left out.

    The sample is drawn from the labels, those of least hash of the id, so that it is small enough to be sent to the texts."""
    drawn = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(drawn), "doc_id").select("text", "label")
    found = arrow_map(rows, _measured, "label int, x array<double>").collect()
    found.sort(key=lambda r: (r.x, r.label))
    x = np.array([r.x for r in found], np.float64).reshape(len(found), len(FEATURES))
    return Model().fit(x, np.array([r.label for r in found], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with all its columns and the score in the column `into`, which takes the place of one of that name."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at, names = docs.columns.index(text), [*docs.columns, into]

    def work(batches):
        import pyarrow as pa

        found = pickle.loads(shared.value)
        for batch in slices(batches, at, rows=256, max_bytes=2 << 20):
            scores = found.score(matrix(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names)

    return rows_map(docs, work, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
