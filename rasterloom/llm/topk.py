"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate. No score is kept: each pass scores anew and counts, in each partition,
how many scores fall into each bin of a query's current score range. The global histogram (a sum of small partial
ones) tells which bin holds the query's kth value; the next pass refines that bin, until bins are one score wide. A last
pass filters by the kth value and breaks ties by the smaller id.

A partition reports only its top bins that hold its own k best scores (the global kth value is never below a
partition's), so at most k bins leave a partition for a query. In the last pass a partition reports at most its own k
best rows of a query, which keeps results whole under any number of ties.

Queries are worked off in blocks of about ``block`` vectors; only one block (block x dimension x 16 bytes) is broadcast at a time and
freed when its results are written, so neither the bound nor a plan depends on the number of queries.

Scores are exact for components of any size: products that may pass 2**53 are added up modulo 2**64, and where even the sum of their
sizes may not fit in a long, a score in doubles with its error tells whether it does; in doubt Python's integers decide.

Defined results: rows take no part if the id or the vector is null, or a component is null or not finite. Vectors of
another length than a query's are no candidates for it. Rows with a query's id are its own. Among repeated query ids
the smallest vector counts. Fewer than k candidates: all are returned. Empty tables give empty results.
A score that doesn't fit in a long is an error that names its pair.
Columns other than the id and the vector play no role, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rasterloom.llm.common import bounded_batches, drop_staged, fresh_path, lean, stage

#: Scores held at once in a worker.
CELLS = 1 << 21
RADIX_BITS = 11
LONG = 1 << 63

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v): v = floor(scale * x) of usable vectors, as doubles that hold whole numbers. Empty ones are usable; their products are 0."""
    x = F.col(vec_col)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles from 2**52 on are whole
    whole = lambda z: F.when(F.abs(z) < float(1 << 52), F.floor(z).cast("double")).otherwise(z)
    v = F.transform(F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double")), whole)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def wrapped(x: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles, modulo 2**64, as int64."""
    big = np.abs(x) >= float(LONG)
    out = np.where(big, 0, x).astype(np.int64)
    if big.any():
        out[big] = np.array([int(v) % (1 << 64) for v in x[big]], np.uint64).view(np.int64)
    return out


def exact_scores(q: np.ndarray, q_wrapped: np.ndarray, m: np.ndarray, q_ids: np.ndarray, m_ids: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and m (whole numbers in doubles) as int64."""
    if not q.shape[1]:
        return np.zeros((len(q), len(m)), np.int64)
    most = np.abs(q).max(1, initial=0)[:, None] * np.abs(m).sum(1)[None, :]
    top = most.max(initial=0)
    if top < 1 << 53:
        return (q @ m.T).astype(np.int64)
    s = q_wrapped @ wrapped(m).T
    if not top < 1 << 62:
        with np.errstate(over="ignore", invalid="ignore"):
            sizes = np.abs(q) @ np.abs(m).T
            near, off = q @ m.T, sizes * (2.0 * q.shape[1] * np.finfo(float).eps)
        for i, j in np.argwhere(~(sizes < 1 << 62) & ~(np.abs(near) + off < float(LONG)) & (q_ids[:, None] != m_ids[None, :])):
            true = sum(int(a) * int(b) for a, b in zip(q[i], m[j]))
            if not -LONG <= true < LONG:
                raise OverflowError(f"the score of query {q_ids[i]} and vector {m_ids[j]} doesn't fit in a long")
    return s


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best inner products of each query among all other rows: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = quantised(vectors, id_col, vec_col, scale)
    chosen = quantised(vectors.where(is_query), id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    largest, longest = base.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.max(F.size("v"))).first()
    n_blocks = math.ceil(chosen.count() / block) if longest is not None else 0
    if not n_blocks:
        return spark.createDataFrame([], FOUND)
    bound = min(int(largest or 0) ** 2 * int(longest), LONG - 1)
    # blocks by hash: about ``block`` queries each
    parts = stage(chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "queries")
    path, wrote = fresh_path(spark, "top-k"), False
    for b in range(n_blocks):
        rows = parts.where(F.col("block") == b).select("vec_id", "v").orderBy("vec_id").collect()  # one block
        if rows:
            found, held = _one_block(base, [r[0] for r in rows], [r[1] for r in rows], k, bound)
            found.write.mode("append").parquet(path)
            wrote = True
            for x in held:
                x.destroy()
    drop_staged(parts)
    return spark.read.schema(FOUND).parquet(path) if wrote else spark.createDataFrame([], FOUND)


def _one_block(base: DataFrame, ids: list[int], vectors: list[list[float]], k: int, bound: int) -> tuple[DataFrame, list]:
    """The block's results, and what to free when they are written."""
    spark = base.sparkSession
    dims = sorted({len(v) for v in vectors})
    of = {d: (np.array([i for i, v in enumerate(vectors) if len(v) == d]), np.array([v for v in vectors if len(v) == d], np.float64).reshape(-1, d) if d else np.zeros((sum(not v for v in vectors), 0))) for d in dims}
    held = spark.sparkContext.broadcast({"ids": np.array(ids, np.int64), "of": {d: (which, q, wrapped(q)) for d, (which, q) in of.items()}})
    n = len(ids)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query indexes, candidate ids, scores, usable) by blocks of at most CELLS scores."""
        h = held.value
        for batch in batches:
            cand, lists = batch.column(0).to_numpy(), batch.column(1)
            size, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            for d, (which, q, q_wrapped) in h["of"].items():
                rows = np.flatnonzero(size == d)
                step = max(1, CELLS // len(which))
                for i in range(0, len(rows), step):
                    r = rows[i : i + step]
                    m = values[at[r][:, None] + np.arange(d)] if len(r) < len(size) else values.reshape(len(r), d)
                    s = exact_scores(q, q_wrapped, m, h["ids"][which], cand[r])
                    yield which, cand[r], s, h["ids"][which][:, None] != cand[r][None, :]

    low, left = np.full(n, -bound, np.int64), np.full(n, k, np.int64)  # start of each query's range, rank of the wanted value in it
    width_bits = max(1, (2 * bound).bit_length())
    few = np.zeros(n, bool)  # queries with fewer than k candidates keep all
    while width_bits:
        shift = max(0, width_bits - RADIX_BITS)
        bins = 1 << (width_bits - shift)
        state = spark.sparkContext.broadcast((low, left, few))

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, bins: int = bins, state=state) -> Iterator[pa.RecordBatch]:
            low, left, few = state.value
            hist = np.zeros((n, bins), np.int64)
            for which, _, s, ok in scored(batches):
                from_ = low[which][:, None]
                bin_ = ((s.view(np.uint64) - from_.view(np.uint64)) >> np.uint64(shift)).astype(np.int64)  # a distance may be over 63 bits
                ok &= (s >= from_) & (bin_ >= 0) & (bin_ < bins) & ~few[which][:, None]
                flat = (which[:, None] * bins + bin_)[ok]
                hist += np.bincount(flat, minlength=n * bins).reshape(n, bins)
            above = np.cumsum(hist[:, ::-1], 1)[:, ::-1] - hist  # scores in higher bins
            q, bin_ = np.nonzero((hist > 0) & (above < left[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(hist[q, bin_])], ["q", "bin", "n"])

        hist = base.mapInArrow(lean(count), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        up_to = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
        wanted = spark.createDataFrame([(i, int(v)) for i, v in enumerate(left)], "q int, wanted long")
        hit = (
            hist.withColumn("up_to", up_to)
            .join(F.broadcast(wanted), "q")  # one row for each query of the block
            .where(F.col("up_to") >= F.col("wanted"))
            .groupBy("q")
            .agg(F.max(F.struct("bin", (F.col("up_to") - F.col("n")).alias("above"))).alias("at"))
            .select("q", "at.bin", "at.above")
            .collect()  # one row for each query of the block
        )
        state.destroy()
        seen = np.zeros(n, bool)
        for q, bin_, above in hit:
            seen[q] = True
            low[q] += bin_ << shift
            left[q] -= above
        few |= ~seen
        width_bits = shift
    kth = spark.sparkContext.broadcast(np.where(few, np.iinfo(np.int64).min, low))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = kth.value
        q_all, c_all, s_all, rows = [], [], [], 0

        def cut() -> None:
            q, c, s = map(np.concatenate, (q_all, c_all, s_all))
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
            at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            for x, y in ((q_all, q), (c_all, c), (s_all, s)):
                x[:] = [y[at < k]]

        for which, cand, s, ok in scored(batches):
            i, j = np.nonzero(ok & (s >= least[which][:, None]))
            q_all.append(which[i]), c_all.append(cand[j]), s_all.append(s[i, j])
            rows += len(i)
            if rows > CELLS:
                cut()
                rows = len(q_all[0])
        if q_all:
            cut()
            yield pa.RecordBatch.from_arrays([pa.array(held.value["ids"][q_all[0]]), pa.array(c_all[0]), pa.array(s_all[0])], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return base.mapInArrow(lean(best), "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), [held, kth]
