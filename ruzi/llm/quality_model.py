"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone.  Labels are learnt from a bounded
sample of labelled rows (``max_rows``, those with the least hash, drawn below a threshold of it), on the driver:
features are binned at quantiles, each tree grows level by level from histograms
of gradients, and the fitted trees are flattened into three arrays.  Scoring
walks all trees of a batch of documents at once by array indexing.

Scale: fitting joins at most ``max_rows`` ids, broadcast for that bound, with the
documents; scoring is one pass without a shuffle and holds one Arrow batch.

Defined results: a null or empty text gets the score of all-zero statistics;
labels that are null or name no document are ignored, of several for one document
the greatest counts, and of several documents of one id the least statistics; with no labels, or one class only, every score is that
class's rate (0.5 with none); repeated rows score equally; an empty table gives
an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import bounded_sample, discard, even, map_batches, written

#: Labelled rows that fitting takes at most.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 1.0
MIN_HESSIAN = 2.0
THRESHOLD = 0.7
#: Rows with this remainder of crc32(doc_id as text) modulo 4 are held out.
HELD_OUT = 2

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "symbol", "mark", "bang", "bar", "control",
    "beyond_ascii", "newline", "distinct_words", "same_next", "distinct_pairs", "top_word", "dup_lines", "line_words",
    "word_entropy", "byte_entropy", "upper_words", "symbol_words",
)


def _classes() -> np.ndarray:
    """A row of 0 and 1 per character class, a column per byte."""
    sets = [
        bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#*$%&<>^~_=+\\/@{}[]", b".,;:'\"()-", b"!?", b"|",
        bytes(b for b in range(32) if b not in b"\t\n\r"), bytes(range(128, 256)), b"\n",
    ]
    table = np.zeros((len(sets), 256))
    for i, members in enumerate(sets):
        table[i, list(members)] = 1
    return table


CLASSES = _classes()
SYMBOL_ENDS = frozenset(b"#*$%&|<>!")


def entropy(counts: np.ndarray) -> float:
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def features(text: str) -> list[float]:
    """The statistics named in FEATURES; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, symbol, mark, bang, bar, control, beyond, newline = (CLASSES @ by_byte / size).tolist()
    seen = Counter(words)
    counts = np.fromiter(seen.values(), np.float64, len(seen))
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    rare = [(word, times) for word, times in seen.items() if len(word) > 1]
    shouted = sum(times for word, times in rare if word.isupper())
    marked = sum(times for word, times in rare if word[-1] in SYMBOL_ENDS)
    return [
        float(np.log1p(size)), float(np.log1p(n)), size / n, upper, lower, digit, symbol, mark, bang, bar, control,
        beyond, newline, len(seen) / n, same / n, pairs / max(n - 1, 1), float(counts.max()) / n, 1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), entropy(counts), entropy(by_byte[by_byte > 0]), shouted / n, marked / n,
    ]


class Forest(NamedTuple):
    """Complete trees of one depth, flattened: a row per tree, a column per node in heap order."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cuts at quantiles, midway between values that occur."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost trees on the logistic loss."""
    inner = 2**depth - 1
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(mean, 1e-3, 1 - 1e-3) / (1 - np.clip(mean, 1e-3, 1 - 1e-3))))
    shape = (trees if len(y) and 0 < mean < 1 else 0, inner)
    feature, threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
    leaf = np.zeros((shape[0], inner + 1))
    cuts = [cut_points(column, bins) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1) if len(x) else x
    margin, width = np.full(len(y), base), x.shape[1]
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
            g, h = (np.bincount(slot, np.repeat(w, width), count * width * bins).reshape(count, width, bins) for w in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (gl[:, :, -1:] ** 2) / (hl[:, :, -1:] + L2)
            gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + (x[np.arange(len(y)), feature[t, first + node]] > threshold[t, first + node])
        sums = [np.bincount(node, w, inner + 1) for w in (grad, hess)]
        leaf[t] = -rate * sums[0] / (sums[1] + L2)
        margin = margin + leaf[t, node]
    return Forest(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(value.as_py() or "") for value in texts]).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    known = written(known.groupBy("label_id").agg(F.max("label").alias("label")))
    sample = bounded_sample(known, even("label_id"), max_rows, max_rows / max(1, known.count()))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(2))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in x.T)], names=["id", "label", *FEATURES])

        return work

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text")
    measured = map_batches(rows, make, "id long, label int, " + ", ".join(f"{name} double" for name in FEATURES))
    # Documents may repeat an id: it counts once, by its least statistics, and the bound on ids is one on rows.
    once = measured.groupBy("id").agg(F.min(F.struct("label", *FEATURES)).alias("row")).select("id", "row.*")
    found = once.toPandas().sort_values("id", ignore_index=True)
    discard(known)
    return fit(found[list(FEATURES)].to_numpy(float), (found["label"] > 0).to_numpy(float))


def scored(text: Column, forest: Forest) -> Column:
    """A score column for a text column."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = np.array([features(value or "") for value in values]).reshape(len(values), len(FEATURES))
        return pd.Series(forest.scores(x))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    forest = train(docs, labels, max_rows)
    rows = docs.select("doc_id", scored(F.col("text"), forest).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
