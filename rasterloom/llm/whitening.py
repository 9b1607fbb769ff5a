"""Whitening of embeddings by a two-pass covariance.

The first pass adds up the integer entries exactly, which gives the mean as a fraction. The second one centres each block of vectors by
that mean and adds outer products by matrix multiplication; treeAggregate merges the partial matrices in as many
levels as keep the driver at FAN_IN of them. LAPACK's symmetric solver gives the components, which go out with the mean in a broadcast
(two arrays of the vectors' length, bounded by it). A third pass measures how far the whitened vectors' covariance is from the identity.

Entries: x = floor(scale * c) + shift, as integers. Components are numbered from 1 by falling eigenvalue; the entry of largest size
of each is positive, so that runs agree.

Defined results: vectors that are null, empty, or hold a null or non-finite entry take no part. Rows with a null id do, and so does each
of repeated rows. Of vectors of different lengths, those of the most frequent length take part (of equally
frequent ones the shortest). A component without variance (an eigenvalue within rounding of 0) has null ``whitened`` and isn't part of
identity_error; with no variance at all ``explained`` is 0. A deviation of over 38 digits is null; an entry over 2**61 after scaling is an error. Empty tables give empty results.
Columns other than the id and the vector play no role.
"""

from __future__ import annotations

import dataclasses
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, lean

#: Partial matrices that the driver merges at most, and entries of a block of vectors.
FAN_IN, CELLS = 16, 1 << 21
LARGEST = 1 << 61
#: Bits of the low part when products don't fit in a long.
LIMB = 20

OUT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
])


@dataclasses.dataclass
class Fitted:
    """The mean is (whole + rest / n); rows of axes are unit eigenvectors, values their eigenvalues."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - (self.rest / self.n).astype(np.float64)

    def seen(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > (self.values[0] if len(self.values) else 0) * self.axes.shape[1] * np.finfo(float).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; nan where a component has no variance."""
        scale = np.where(self.seen(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return self.centred(x) @ self.axes.T / scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n * x - S)**2 of each row, exactly."""
        y, d = x - self.whole, x.shape[1]
        top = int(np.abs(y).max(initial=0))
        if ((top + 1) * self.n) ** 2 * d < 1 << 63:
            t = y * self.n - self.rest.astype(np.int64)
            return pa.array((t * t).sum(1)).cast(pa.decimal128(38, 0))
        if top * top * d < 1 << 63 and (top << LIMB) * d < 1 << 63 and (self.n >> LIMB) * top * d < 1 << 63:
            # n**2 * sum y**2 - 2 * n * sum r * y + sum r**2
            low, high = (self.rest & ((1 << LIMB) - 1)).astype(np.int64), (self.rest >> LIMB).astype(np.int64)
            squares, cross = (y * y).sum(1).tolist(), [(h << LIMB) + l for h, l in zip((y @ high).tolist(), (y @ low).tolist())]
            fixed = sum(int(r) ** 2 for r in self.rest)
            sums = [self.n * (self.n * a - 2 * b) + fixed for a, b in zip(squares, cross)]
        else:
            sums = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in y]
        return pa.array([s if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def blocks(batches: Iterator[pa.RecordBatch], scale: float, shift: int, dim: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, entries) of usable vectors of one length (that wanted, or each there is) in blocks of about CELLS entries."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        for d in np.unique(size[size > 0]) if dim is None else [dim]:
            rows = np.flatnonzero(size == d)
            step = max(1, CELLS // int(d))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                c = flat[start[r][:, None] + np.arange(d)]
                ok = np.isfinite(c).all(1)
                x = np.floor(c[ok] * float(scale))
                if (np.abs(x) > LARGEST - abs(shift)).any():
                    raise OverflowError("an entry of a vector is over 2**61 after scaling")
                if len(x):
                    yield ids.take(pa.array(r[ok])), x.astype(np.int64) + shift


def merged(vectors: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], object], add: Callable[[object, object], object]):
    """The partial results of all partitions added up on the executors, in levels; None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(partial(batches))], pa.binary())], ["partial"])

    def both(a: object, b: object) -> object:
        return b if a is None else a if b is None else add(a, b)

    parts = vectors.mapInArrow(lean(run), "partial binary").rdd
    depth = max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN_IN)))
    return parts.map(lambda row: pickle.loads(row[0])).treeAggregate(None, both, both, depth)


def fit(vectors: DataFrame, k: int = 8, scale: float = 1024, shift: int = 0) -> Fitted | None:
    """The mean and the first k components of vectors (id, vector); None if no vector is usable."""

    def sums(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[int, np.ndarray]] | None:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for _, x in blocks(batches, scale, shift):
            n, s = found.get(x.shape[1], (0, 0))
            # sums of both halves fit in a long for 2**31 rows; Python's integers take them from there
            own = (x >> 31).sum(0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)
            found[x.shape[1]] = n + len(x), s + own
        return found or None

    def add_sums(a: dict, b: dict) -> dict:
        return a | {d: (a[d][0] + n, a[d][1] + s) if d in a else (n, s) for d, (n, s) in b.items()}

    by_length = merged(vectors, sums, add_sums)
    if not by_length:
        return None
    dim = min(by_length, key=lambda d: (-by_length[d][0], d))
    n, s = by_length[dim]
    model = Fitted(n, (s // n).astype(np.int64), s % n, np.zeros(0), np.zeros((0, dim)), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in blocks(batches, scale, shift, dim):
            y = model.centred(x)
            total = y.T @ y if total is None else total + y.T @ y
        return total

    covariance = merged(vectors, products, np.add) / n
    values, axes = np.linalg.eigh(covariance)
    model.values, model.axes = values[::-1][:k].copy(), axes.T[::-1][:k].copy()
    largest = np.take_along_axis(model.axes, np.abs(model.axes).argmax(1)[:, None], 1)
    model.axes *= np.where(largest < 0, -1, 1)
    model.trace = float(np.trace(covariance))

    def moments(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
        total = None
        for _, x in blocks(batches, scale, shift, dim):
            z = model.whitened(x)[:, model.seen()]
            own = z.sum(0), z.T @ z
            total = own if total is None else (total[0] + own[0], total[1] + own[1])
        return total

    first, second = merged(vectors, moments, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    # the whitened vectors are centred, so their mean's share is within rounding
    model.identity_error = float(np.abs(second / n - np.outer(first, first) / n**2 - np.eye(len(first))).max(initial=0))
    return model


def whiten(vectors: DataFrame, k: int = 8, scale: float = 1024, shift: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    vectors = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].alias("v")).where("v IS NOT NULL")
    model = fit(vectors, k, scale, shift)
    if model is None:
        return spark.createDataFrame([], OUT)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        c = len(m.values)
        share = np.maximum(m.values, 0) / m.trace if m.trace > 0 else np.zeros(c)
        for ids, x in blocks(batches, scale, shift, m.axes.shape[1]):
            z = m.whitened(x).ravel()
            row = pa.array(np.repeat(np.arange(len(x)), c))
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(z), m.n)), m.deviation(x).take(row), pa.array(z, pa.float64(), mask=np.isnan(z)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(z), m.identity_error))],
                OUT.fieldNames(),
            )

    return vectors.mapInArrow(lean(run), OUT)
