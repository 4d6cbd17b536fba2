"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

A bounded sample of the labelled rows trains the trees on the driver; the flattened trees are sent to
the executors, which compute the statistics of each whole text in one pass and walk all trees level
by level with numpy.

Defined results: null and empty texts are scored from the statistics of the empty text; repeated
rows get equal scores; a null id counts as held out (crc32 of the empty text is 0); with no labels
of either class every score is the share of label 1, or 0.5 without any label. Of several labels of
one id each is a training row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import prepare, remainder_col

#: Labelled rows that train the trees: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Bins of a histogram.
BINS = 64

_LINE = re.compile(rb"[^\n]+")
_SENTENCE = re.compile(rb"[.!?]+")


def statistics(raw: bytes) -> list[float]:
    """Numbers about one text in UTF-8; nothing of its id, source or language."""
    n = len(raw)
    if n == 0:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    words = raw.split()
    n_words = max(1, len(words))
    kinds = set(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = _LINE.findall(raw)
    n_lines = max(1, len(lines))
    ends = _SENTENCE.findall(raw)
    marks = np.r_[0:10, 11:32, 33:48, 58:65, 91:97, 123:127]
    punctuation = counts[marks].sum()
    top = max(map(len, lines)) if lines else 0
    used = share[share > 0]
    pairs = set(zip(words, words[1:], strict=False))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        len(kinds) / n_words,
        same / n_words,
        len(pairs) / n_words,
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        (lengths <= 2).mean(),
        share[65:91].sum(),
        share[48:58].sum(),
        share[32],
        share[10],
        share[128:].sum(),
        punctuation / n,
        share[33],
        share[124],
        (share[35] + share[36] + share[37] + share[38] + share[42]),
        share[46],
        share[44],
        share[47] + share[58] + share[61],
        share[marks].max(),
        len(ends) / n_words,
        max(map(len, ends)) if ends else 0,
        len(lines) / n * 100,
        len(set(lines)) / n_lines,
        top / n,
        float(-(used * np.log(used)).sum()),
        sum(map(bytes.isupper, words)) / n_words,
        sum(map(bytes.istitle, words)) / n_words,
    ]


N_STATISTICS = 30


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the numbers of statistics() in _stats."""
    prepare(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c != "_stats"])
    rest = [c for c in docs.columns if c != text]
    where = docs.columns.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + ["_stats array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [statistics(x or b"") for x in batch.column(where).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.asarray(numbers, np.float32).reshape(-1))
            ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * N_STATISTICS)
            own = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(ends, flat)], names=[*rest, "_stats"])

    return docs.mapInArrow(run, schema)


@dataclass
class Trees:
    """Trees of one depth, flattened: node k of a level has children 2k and 2k+1 of the next."""

    depth: int
    start: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows go down all trees, one level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)  # heap order: children of k are 2k+1 and 2k+2
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, ridge: float = 1.0, least: int = 5
) -> Trees:
    """Boosting on logistic loss; each level's splits come from histograms of gradients over BINS quantile bins."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    trees = Trees(depth, float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return trees
    x = x.astype(np.float32)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS).astype(np.float32)) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    offset = np.arange(d) * BINS
    margin = np.full(n, trees.start)
    features, values, leaves = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature = np.zeros(2**depth - 1, np.int32)
        cut = np.full(2**depth - 1, np.inf, np.float32)  # nothing is above: all rows go left
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            local = node - first
            where = (local[:, None] * d * BINS + offset + binned).ravel()
            size = width * d * BINS
            sums = [np.bincount(where, np.repeat(v, d), size).reshape(width, d, BINS) for v in (g, h, np.ones(n))]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            right = [w - a for w, a in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain = np.where((left[2] >= least) & (right[2] >= least), gain, -1.0).reshape(width, -1)
            best = gain.argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        last = node - (2**depth - 1)
        leaf = -rate * np.bincount(last, g, 2**depth) / (np.bincount(last, h, 2**depth) + ridge)
        margin += leaf[last]
        features.append(feature)
        values.append(cut)
        leaves.append(leaf)
    trees.feature, trees.cut, trees.leaf = np.array(features), np.array(values), np.array(leaves)
    return trees


def train(docs: DataFrame, labels: DataFrame, text: str, label: str, train_rows: int = TRAIN_ROWS, modulus: int = 5) -> Trees:
    """Trees from labelled rows outside the held-out fold; at most train_rows, those of the smallest hash.

    The ids of that sample, whose number train_rows bounds, are broadcast to pick its texts.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
    known = known.filter(F.col("_y").isin(0.0, 1.0) & (remainder_col(F.col("_id"), modulus) != 0))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows = document_statistics(rows, "_text").orderBy(F.xxhash64("_id"), "_id", "_y", "_stats").limit(train_rows)
    table = rows.select("_y", "_stats").toArrow()
    if table.num_rows == 0:
        return fit_trees(np.zeros((0, N_STATISTICS)), np.zeros(0))
    x = table.column("_stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
    return fit_trees(x, table.column("_y").to_numpy())


def _features(batch: pa.RecordBatch, where: int) -> np.ndarray:
    numbers = [statistics(x or b"") for x in batch.column(where).cast(pa.binary()).to_pylist()]
    return np.asarray(numbers, np.float32).reshape(-1, N_STATISTICS)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_features(batch, 1))
            new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", (remainder_col(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are predicted 1, with their columns."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels, text, label))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(_features(batch, where)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
