"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

A model is fitted on a bounded sample of labelled rows and flattened into arrays, a row for each tree; scoring walks all
rows of a batch through a tree at once, level by level.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "log_lines", "mean_word", "longest_word", "upper", "lower", "digits", "high_bytes", "full_stops", "commas",
    "bars", "bangs", "signs", "other_marks", "blanks", "distinct_words", "repeated_next", "top_word", "distinct_lines", "mean_line",
    "ends_in_sign", "capitalised", "one_letter",
)
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[128:] = 3
for _k, _chars in ((4, b"."), (5, b","), (6, b"|"), (7, b"!"), (9, b"*#%$&@~^_=+<>{}[]\\"), (10, b" \t\n\x0b\f\r")):
    _CLASS[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """The numbers of FEATURES; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=11) / n
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), sum(map(len, words)) / w, float(max(map(len, words), default=0)),
        kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[9], kinds[8], kinds[10],
        len(counts) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, max(counts.values(), default=0) / w,
        len(set(lines)) / len(lines), n / len(lines), sum(x[-1] in b"*#%$&!|" for x in words) / w, sum(65 <= x[0] <= 90 for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())]
    return np.asarray(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


@dataclasses.dataclass(frozen=True)
class Forest:
    """Trees as arrays [tree, node]; the children of node k are 2k + 1 and 2k + 2, a leaf has feature -1. rows counts what it was fitted on."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    rows: int = 0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        each = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                down = 2 * node + 1 + (rows[each, np.maximum(f, 0)] > threshold[node])
                node = np.where(f < 0, node, down)
            total += value[node]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def boost(rows: np.ndarray, target: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Trees for the logistic loss, grown level by level from histograms of gradients over binned columns.

    Without rows the score is 0.5; with one class it is near that class. least is the least sum of curvature times four
    that a leaf may hold.
    """
    n, width = rows.shape
    edges = [_edges(rows[:, f], bins) if n else np.empty(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)], axis=1) if n else np.empty((0, width), dtype=np.int64)
    size = 2 ** (depth + 1) - 1
    up = (target.sum() + 1) / (n + 2)
    start = float(np.log(up / (1 - up)))
    total = np.full(n, start)
    grown = []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        slope, curve = target - p, p * (1 - p)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth + 1):
            first, count = 2**level - 1, 2**level
            here = (node >= first) & (node < first + count)
            at = node[here] - first
            g, h = np.bincount(at, slope[here], count), np.bincount(at, curve[here], count)
            value[first : first + count] = rate * g / (h + ridge)
            if level == depth:
                break
            best, pick = np.full(count, 1e-6), [None] * count
            for f in range(width):
                cells = at * bins + binned[here, f]
                gl = np.cumsum(np.bincount(cells, slope[here], count * bins).reshape(count, bins), axis=1)[:, : len(edges[f])]
                hl = np.cumsum(np.bincount(cells, curve[here], count * bins).reshape(count, bins), axis=1)[:, : len(edges[f])]
                gr, hr = g[:, None] - gl, h[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(4 * hl < least) | (4 * hr < least)] = 0
                if gain.size:
                    k = gain.argmax(axis=1)
                    for c in np.flatnonzero(gain[np.arange(count), k] > best):
                        best[c], pick[c] = gain[c, k[c]], (f, k[c])
            for c, found in enumerate(pick):
                if found:
                    f, k = found
                    feature[first + c], threshold[first + c] = f, edges[f][k]
                    inside = node == first + c
                    node[inside] = 2 * (first + c) + 1 + (binned[inside, f] > k)
        total += value[node]
        grown.append((feature, threshold, value))
    empty = [(np.full(size, -1), np.zeros(size), np.zeros(size))]
    f, t, v = (np.stack(x) for x in zip(*(grown or empty), strict=True))
    return Forest(f, t, v, start, n)


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text, modulo 4, is 2. A null id is never one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Forest:
    """Fit on docs (doc_id, text) with labels (doc_id, quality), without the held-out rows.

    The sample is bounded: the most_rows labelled ids with the smallest hashes, whatever the size of the tables. Only
    their statistics reach the driver. Labels that are null or neither 0 nor 1 teach nothing; of several labels of one
    id the largest counts, and of several texts of one id the one with the smallest statistics.
    """
    chosen = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )

    def measure(batches):
        for batch in batches:
            rows = _matrix(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("target"), *[pa.array(rows[:, k]) for k in range(len(FEATURES))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "target", *FEATURES])

    schema = ", ".join(["doc_id bigint", "target int", *[f"{f} double" for f in FEATURES]])
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "target", "text")
    measured = known.mapInArrow(measure, schema).groupBy("doc_id", "target").agg(F.min(F.struct(*FEATURES)).alias("x"))
    rows = measured.select("doc_id", "target", "x.*").toPandas().sort_values("doc_id")
    return boost(rows[list(FEATURES)].to_numpy(dtype=np.float64), rows["target"].to_numpy(dtype=np.float64))


def quality_score(text: Column, model: Forest) -> Column:
    """0 to 1, higher where label 1 is likelier. A null text scores as an empty one."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(_matrix(texts)), pa.float64())

    return score(text)
