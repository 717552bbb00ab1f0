"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.llm.text import _LOWER, chunks, distinct, span_hashes, string_buffers, word_bounds
from plumeflux.session import released

SAMPLE_ROWS = 20_000
_CLASSES = [
    (np.arange(256) >= 65) & (np.arange(256) <= 90),  # capitals
    (np.arange(256) >= 97) & (np.arange(256) <= 122),  # small letters
    (np.arange(256) >= 48) & (np.arange(256) <= 57),  # digits
    np.arange(256) >= 128,  # bytes outside ASCII
    np.arange(256) == 10,
    np.arange(256) == 32,
    np.isin(np.arange(256), [ord(c) for c in ".,;:?"]),
    np.arange(256) == ord("!"),
    np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~+=<>"]),
    np.isin(np.arange(256), [ord(c) for c in "|_/\\{}[]()"]),
    np.isin(np.arange(256), [ord(c) for c in "\"'`-"]),
    (np.arange(256) < 32) & (np.arange(256) != 10),
]
N_FEATURES = 2 * len(_CLASSES) + 13


def statistics(column: pa.Array) -> np.ndarray:
    """One row of features per text: shares of kinds of bytes and words, repetition, lengths. Empty text: zeros."""
    offsets, raw = string_buffers(column)
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.float32)
    for lo, hi in chunks(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        size = np.maximum(np.diff(at), 1).astype(np.float64)
        starts, ends, counts = word_bounds(at, part)
        first = np.cumsum(counts) - counts
        words = np.maximum(counts, 1).astype(np.float64)
        lengths = (ends - starts).astype(np.float64)
        h = span_hashes(part, starts, ends)
        place = np.cumsum(np.concatenate([[0], lengths]))
        squares = np.cumsum(np.concatenate([[0], lengths**2]))
        last = first + counts
        mean = (place[last] - place[first]) / words
        f = []
        for kind in _CLASSES:
            hit = kind[part]
            total = np.concatenate([[0], np.cumsum(hit)])
            f.append((total[at[1:]] - total[at[:-1]]) / size)
            # words that end in this kind
            ending = np.concatenate([[0], np.cumsum(hit[ends - 1])]) if len(ends) else np.zeros(1)
            f.append((ending[last] - ending[first]) / words)
        upper = _CLASSES[0][part]
        letters = np.concatenate([[0], np.cumsum(upper)])
        shouted = np.concatenate([[0], np.cumsum((letters[ends] - letters[starts]) * 2 > lengths)]) if len(ends) else np.zeros(1)
        capital = np.concatenate([[0], np.cumsum(upper[starts])]) if len(starts) else np.zeros(1)
        short = np.concatenate([[0], np.cumsum(lengths <= 3)])
        long = np.concatenate([[0], np.cumsum(lengths >= 12)])
        f += [
            np.log1p(size), np.log1p(words), mean,
            np.sqrt(np.maximum((squares[last] - squares[first]) / words - mean**2, 0)),
            (shouted[last] - shouted[first]) / words, (capital[last] - capital[first]) / words,
            (short[last] - short[first]) / words, (long[last] - long[first]) / words,
        ]
        lines = np.concatenate([[0], np.cumsum(part == 10)])
        f.append(words / (lines[at[1:]] - lines[at[:-1]] + 1))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
        repeat = np.zeros((hi - lo, 4))
        low = _LOWER[part]
        for k, (a, b, c, d) in enumerate(zip(first.tolist(), last.tolist(), at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                own, two = distinct(h[a:b]), distinct(pairs[a : b - 1])
                repeat[k, 0] = len(own) / (b - a)
                repeat[k, 1] = len(two) / max(b - a - 1, 1)
                bytes_ = np.bincount(low[c:d], minlength=256)
                share = bytes_[bytes_ > 0] / (d - c)
                repeat[k, 2] = -(share * np.log2(share)).sum()
                repeat[k, 3] = len(own) / np.sqrt(b - a)
        out[lo:hi] = np.column_stack([*f, repeat])
        out[lo:hi][counts == 0] = 0
    return out


@dataclass
class BoostedTrees:
    """Trees of equal depth in heap order, flattened: feature and threshold of inner nodes, values of leaves."""

    depth: int
    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features; all rows walk one tree at once."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> BoostedTrees:
    """Logistic boosting; splits are searched on histograms of at most ``bins`` quantile bins a feature.

    Without rows the score is 0.5; with one label only, it is that label's smoothed share.
    """
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 1.0) / (n + 2.0)
    model = BoostedTrees(depth, float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])  # bin b: edges[b-1] < x <= edges[b]
    total = np.full(n, model.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, count = (1 << level) - 1, 1 << level
            slot = node - base
            best = np.full(count, 1e-9)
            for k in range(width):
                if not len(edges[k]):
                    continue
                cell = slot * bins + binned[k]
                g = np.bincount(cell, grad, count * bins).reshape(count, bins).cumsum(1)
                w = np.bincount(cell, hess, count * bins).reshape(count, bins).cumsum(1)
                gl, wl = g[:, : len(edges[k])], w[:, : len(edges[k])]
                gr, wr = g[:, -1:] - gl, w[:, -1:] - wl
                gain = gl**2 / (wl + ridge) + gr**2 / (wr + ridge) - g[:, -1:] ** 2 / (w[:, -1:] + ridge)
                gain[(wl < least / 4) | (wr < least / 4)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[base : base + count][better] = k
                threshold[base : base + count][better] = edges[k][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return BoostedTrees(depth, model.base, np.stack(features), np.stack(thresholds), np.stack(values))


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the key as text, modulo 3, is 1. Null keys are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold, chosen by a hash of the key.

    Several labels of one key count by their mean, a tie not at all; keys without document, null keys
    and null labels do not count. Of several documents with one key one is used.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~held_out(key))
    votes = votes.groupBy(F.col(key).alias("__key")).agg(F.avg(F.col(label).cast("double")).alias("__y")).where("__y <> 0.5")
    # a bounded number of rows: at most ``sample_rows`` keys go to every executor and to the driver
    chosen = votes.orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    kind = rows.schema["__key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], names=["key", "y", "x"])

    found = rows.select("__key", "__text", "__y").mapInArrow(released(measure), f"key {kind}, y double, x binary")
    # one row a key, the same whatever the order of tasks
    got = found.groupBy("key").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("key")
    x = np.frombuffer(b"".join(bytes(v) for v in got["x"]), np.float32).reshape(len(got), N_FEATURES)
    return fit_trees(x, (got["y"].to_numpy(np.float64) > 0.5).astype(np.float64))


def score_documents(docs: DataFrame, model: BoostedTrees, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_label`` (1 if score >= 0.5); one scan, no shuffle.

    A clashing column of these names is replaced. The model travels with the task, some 10 kB.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("quality_score", "quality_label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(batch.column(batch.schema.get_field_index(text))))
            columns = [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "quality_score", "quality_label"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f.name for f in kept]).mapInArrow(released(run), schema + ", quality_score double, quality_label int")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, held_out, score, predicted. Only the text is an input of the score.

    Null and empty texts have all statistics at 0 and get a score like any other; null keys and repeated
    rows keep rows of their own; without labels every score is 0.5.
    """
    model = train(docs, labels, key, text)
    scored = score_documents(docs.select(key, text), model, text)
    return scored.select(key, held_out(key).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))
