"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts and ratios of a text's bytes, words and lines, computed for whole batches with numpy. Trees grow
level by level on features cut into quantile bins, by second-order gains of the logistic loss. The forest is flattened into arrays
(feature, threshold, children, value), which all rows walk at once, one level a step.

Training reads the statistics of at most ``max_rows`` labelled rows (those with the smallest id hashes); texts stay
where they are.

Defined results: a null text counts as an empty one, and empty texts are scored like all others. Without labelled
rows, or with labels of one kind only, every score is the smoothed mean label (0.5 if there is none). Repeated rows are
scored each for itself; result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, chunks, lean, span_hashes, text_bytes, words

CHUNK = 1 << 20
MAX_ROWS = 20_000

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _bytes(which: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which.encode())] = True
    return out


#: Byte classes whose shares are features.
CLASSES = {
    "upper": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _bytes("0123456789"),
    "wide": np.arange(256) >= 128,
    "end": _bytes(".!?"),
    "shout": _bytes("!"),
    "comma": _bytes(",;:"),
    "bar": _bytes("|<>{}[]"),
    "symbol": _bytes("#$%&*@^~+=_\\/"),
    "newline": _bytes("\n"),
    "space": ~_NOT_SPACE,
}
FEATURES = [*CLASSES, "log_bytes", "log_words", "word_size", "word_size_sd", "one_letter", "distinct", "again", "line_words", "line_again", "top_word"]


def statistics(col: pa.Array) -> np.ndarray:
    """(rows x FEATURES) of a string column."""
    data, offsets = text_bytes(col)
    return np.concatenate([_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(np.diff(offsets), CHUNK)] or [np.zeros((0, len(FEATURES)), np.float32)])


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)
    out = np.zeros((n, len(FEATURES)), np.float32)

    def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]

    for k, which in enumerate(CLASSES.values()):
        out[:, k] = sums(which[data], offsets) / per
    start, end, first = words(data, offsets, _NOT_SPACE)
    n_words = np.diff(first)
    per_word = np.maximum(n_words, 1)
    length = (end - start).astype(np.float64)
    mean = sums(length, first) / per_word
    k = len(CLASSES)
    out[:, k], out[:, k + 1], out[:, k + 2] = np.log1p(size), np.log1p(n_words), mean
    out[:, k + 3] = np.sqrt(np.maximum(0, sums(length**2, first) / per_word - mean**2))
    out[:, k + 4] = sums(length == 1, first) / per_word
    if len(start):
        h = span_hashes(data, start, end)
        row = np.repeat(np.arange(n), n_words)
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
        out[:, k + 5] = sums(new, first) / per_word  # rows keep their places under the sort
        runs = np.diff(np.append(np.flatnonzero(new), len(new)))
        top = np.zeros(n)
        np.maximum.at(top, rs[new], runs)
        out[:, k + 9] = top / per_word
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
        out[:, k + 6] = sums(again, first) / per_word
    begin, stop, line = words(data, offsets, ~CLASSES["newline"])
    n_lines = np.diff(line)
    out[:, k + 7] = np.log1p(n_words / np.maximum(n_lines, 1))
    if len(begin):
        h = span_hashes(data, begin, stop)
        row = np.repeat(np.arange(n), n_lines)
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        same = np.concatenate([[False], (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])])
        out[:, k + 8] = sums(same, line) / np.maximum(n_lines, 1)
    return out


@dataclass
class Forest:
    """Trees flattened one after another; leaves are their own children. Rows go left if the feature is <= threshold."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1."""
    n, n_features = x.shape
    mean = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
        code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # value <= cut k has code <= k
        margin = np.full(n, base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(node(0.0))
            at = np.full(n, roots[-1])
            level = [roots[-1]]
            for d in range(depth):
                grown = []
                local = {k: i for i, k in enumerate(level)}
                which = np.array([local.get(k, -1) for k in range(len(feature))])[at]
                ok = which >= 0
                best = [(1e-6, -1, -1)] * len(level)
                sums = np.zeros((len(level), 2))
                for k, w in enumerate((g, h)):
                    sums[:, k] = np.bincount(which[ok], w[ok], len(level))
                whole = sums[:, 0] ** 2 / (sums[:, 1] + ridge)
                for f in range(n_features):
                    cells = which[ok] * bins + code[ok, f]
                    gl, hl, nl = (np.cumsum(np.bincount(cells, w, len(level) * bins).reshape(-1, bins), 1) for w in (g[ok], h[ok], np.ones(ok.sum())))
                    gain = gl**2 / (hl + ridge) + (sums[:, :1] - gl) ** 2 / (sums[:, 1:] - hl + ridge) - whole[:, None]
                    gain[(nl < least) | (nl[:, -1:] - nl < least)] = -1
                    gain[:, len(cuts[f]) :] = -1
                    b = gain.argmax(1)
                    for i in range(len(level)):
                        if gain[i, b[i]] > best[i][0]:
                            best[i] = (gain[i, b[i]], f, int(b[i]))
                for i, k in enumerate(level):
                    _, f, b = best[i]
                    rows = np.flatnonzero(at == k)
                    if f < 0:
                        value[k] = -rate * sums[i, 0] / (sums[i, 1] + ridge)
                        continue
                    feature[k], threshold[k] = f, float(cuts[f][b])
                    left[k], right[k] = node(0.0), node(0.0)
                    low = code[rows, f] <= b
                    at[rows[low]], at[rows[~low]] = left[k], right[k]
                    grown += [left[k], right[k]]
                level = grown
                if not level:
                    break
            for k in level:
                rows = at == k
                value[k] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
            margin += np.array(value)[at]
    if not roots:
        node(0.0)
        roots = [0]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), depth)


STATS = T.ArrayType(T.FloatType())


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """docs without the text, with the statistics as array<float>."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, out)]
    docs = docs.select(*kept, text_col)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(len(kept)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = MAX_ROWS, **options) -> Forest:
    """A forest from at most max_rows labelled rows, those of the least id hashes. stats: (id_col, stats); ids with several labels take the smallest.

    A bound on the hash leaves little more than max_rows rows before they are ordered, whatever the number of partitions.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    n, key = stats.select(id_col).join(y, id_col).count(), F.xxhash64(id_col)
    wanted = max_rows + 10 * math.isqrt(max_rows) + 100  # more than max_rows nearly always; a few rows less do no harm
    if n > wanted:
        least = F.lit(-(1 << 63) + (1 << 64) * wanted // n)
        stats, y = stats.where(key < least), y.where(key < least)
    rows = stats.select(id_col, "stats").join(y, id_col).orderBy(key, "stats").limit(max_rows).select("stats", "y").collect()
    return fit(np.array([r[0] for r in rows], np.float32).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], np.float64), **options)


def score_statistics(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with a score for each row (its column stats goes)."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    kept = [c for c in stats.columns if c not in ("stats", "score")]
    stats = stats.select(*kept, "stats")
    schema = T.StructType([*(stats.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(x))], schema.fieldNames())

    return stats.mapInArrow(lean(run), schema)


def score_texts(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """docs with a score for each row; texts stay in their partitions."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest)
    docs = docs.select(*[c for c in docs.columns if c != "score"])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(statistics(batch.column(at))))], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)
