r"""Ranked lexical search by Fagin's threshold algorithm.

``build_index`` goes over the documents once and stores segments of some SEGMENT bytes of text: the terms (exact bytes, sorted), the ids and
lengths of the documents, and the forward index, i.e. each document's terms with their counts. Documents don't move between
tasks. From the segments' own counts come the numbers that weights need: documents, terms, and documents of each term.

``Index.search`` works off the query items in blocks of a bounded number of terms; a block is what is broadcast. In each segment the lists of
the block's terms are sorted by impact. For an item, its lists are read in rounds, all to the same depth; a document that shows
up first gets its whole score by a lookup in the forward index. What the last impacts read could add up to is the
threshold: when it falls strictly below the kth best score known, no unseen document can matter, not even by a tie. The kth best score
known holds for all segments of a task, and starts from what a first pass over one segment in SEED_SHARE found, so
that most segments are left early and few rows are sent. The best rows of all tasks are ranked with a window.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. With N documents that have terms, L terms in all, n terms in
a document and tf of one of them, which df documents have: w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 75 + (25 * n * N) div L, and
a document's score is the sum of w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats included.

Defined results: null and empty texts have no terms; such documents aren't counted and never found, and such items have no rows.
Each of repeated documents is one of its own, and so is each of repeated items. Equal scores go by ascending id, null ids last. Texts of any
length are taken whole; a text longer than a segment is one. Empty tables give empty results. Columns other than ids and texts play no role.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rasterloom.llm.common import LOWER, bounded_batches, drop_staged, fresh_path, lean, stage, text_bytes, words

#: Text bytes of a segment.
SEGMENT = 8 << 20
#: Different terms of a block of items (one longer item is a block of its own).
BLOCK_TERMS = 1 << 18
#: One segment in so many gives the first bounds.
SEED_SHARE = 16
#: Depth of the first round; each round goes twice as deep as the one before.
DEPTH = 16

IS_TERM = np.ones(256, bool)
IS_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False  # after lower-casing

SEGMENTS = "segment long, n_docs long, n_terms long, terms array<binary>, df array<int>, doc_ids array<long>, lengths binary, starts binary, codes binary, tf binary"
FOUND = "item int, doc_id long, score long"
RANKED = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
_LAST = np.iinfo(np.int64).max


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All rows' terms, and how many each row has."""
    data = LOWER[data]
    start, end, first = words(data, offsets, IS_TERM)
    at = np.concatenate([[0], np.cumsum(end - start)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[IS_TERM[data]]))]), np.diff(first)


def _row(columns: dict[str, object], schema: str) -> pa.RecordBatch:
    """One row; numpy arrays are stored by their bytes."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"terms": pa.list_(pa.binary()), "df": pa.list_(pa.int32()), "doc_ids": pa.list_(pa.int64())}
    made = []
    for name in names:
        x = columns[name]
        if name in kinds:
            made.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kinds[name].value_type)))
        else:
            made.append(pa.array([x.tobytes()], pa.binary()) if isinstance(x, np.ndarray) else pa.array([x], pa.int64()))
    return pa.RecordBatch.from_arrays(made, names)


def segment_of(ids: pa.Array, text: pa.ChunkedArray, number: int) -> pa.RecordBatch | None:
    """The segment of some documents, ordered by id; None if they have no terms."""
    none = np.asarray(ids.is_null())
    key = ids.fill_null(_LAST).to_numpy()
    order = np.lexsort((key, none))
    ids = ids.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms, n = terms_of(*text_bytes(text))
    if not len(terms):
        return None
    coded = terms.dictionary_encode()
    own = pc.array_sort_indices(coded.dictionary)
    code = np.empty(len(own), np.int64)
    code[own.to_numpy()] = np.arange(len(own))
    pairs, tf = np.unique(np.repeat(place, n) * len(own) + code[coded.indices.to_numpy()], return_counts=True)
    doc, at = pairs // len(own), pairs % len(own)
    return _row({
        "segment": number, "n_docs": int((n > 0).sum()), "n_terms": len(terms), "terms": coded.dictionary.take(own), "df": pa.array(np.bincount(at, minlength=len(own)).astype(np.int32)), "doc_ids": ids,
        "lengths": n[order].astype("<i4"), "starts": np.searchsorted(doc, np.arange(len(order) + 1)).astype("<i4"), "codes": at.astype("<i4"), "tf": tf.astype("<i4"),
    }, SEGMENTS)


@dataclasses.dataclass
class Index:
    """Stored segments; n_docs and n_terms count the documents that have terms and all their terms."""

    spark: SparkSession
    path: str
    n_docs: int
    n_terms: int

    @property
    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENTS).parquet(self.path)

    def vocabulary(self) -> DataFrame:
        """term and df, the number of documents that have it."""
        return self.segments.selectExpr("inline(arrays_zip(terms, df))").groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))

    def weighted(self, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """A staged row for each item that has known terms: item_id, terms, df and times (how often the item has each)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms, n = terms_of(*text_bytes(batch.column(2)))
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), terms.cast(pa.binary())], ["item", "item_id", "term"])

        items = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
        terms = stage(items.mapInArrow(lean(run), "item long, item_id long, term binary").groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "item-terms")
        wanted = self.vocabulary().join(terms.select("term").distinct(), "term")
        of = terms.join(wanted, "term").groupBy("item", "item_id").agg(F.array_sort(F.collect_list(F.struct("term", "df", "times"))).alias("of"))
        out = stage(of.select("item", "item_id", F.col("of.term").alias("terms"), F.col("of.df").alias("df"), F.col("of.times").alias("times")), "items")
        drop_staged(terms)
        return out

    def search(self, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
        if not self.n_terms:
            return self.spark.createDataFrame([], RANKED)
        queries = self.weighted(items, id_col, text_col)
        total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
        n_blocks = max(1, math.ceil(total / BLOCK_TERMS))
        path, any_ = fresh_path(self.spark, "ranked"), False
        for b in range(n_blocks):
            block = queries.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).orderBy("item").collect()  # a bounded number of terms
            if block:
                self._search_block(block, k).write.mode("append").parquet(path)
                any_ = True
        drop_staged(queries)
        return self.spark.read.schema(RANKED).parquet(path) if any_ else self.spark.createDataFrame([], RANKED)

    def _search_block(self, block: list, k: int) -> DataFrame:
        known = sorted({bytes(t) for row in block for t in row.terms})
        code = {t: i for i, t in enumerate(known)}
        weight = {(d): math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1))) for row in block for d in row.df}
        items = [(np.array([code[bytes(t)] for t in row.terms]), np.array([weight[d] * n for d, n in zip(row.df, row.times)], np.int64)) for row in block]
        held = self.spark.sparkContext.broadcast((known, items))
        n_docs, n_terms = self.n_docs, self.n_terms

        def searched(segments: DataFrame, least: dict[int, int]) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known, items = held.value
                value_set = pa.array(known, pa.binary())
                best = [Best(k, least.get(i, 1)) for i in range(len(items))]
                weights = np.zeros(len(known), np.int64)
                for batch in batches:
                    for r in range(batch.num_rows):
                        own = Lists(batch.slice(r, 1), value_set, n_docs, n_terms)
                        for (terms, w), b in zip(items, best):
                            weights[terms] = w
                            own.threshold_search(terms, w, weights, b)
                            weights[terms] = 0
                sizes = [len(b.score) for b in best]
                score, none, ids = (np.concatenate([getattr(b, x) for b in best]) for x in ("score", "none", "id"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), pa.array(ids, mask=none), pa.array(score)], ["item", "doc_id", "score"])

            return segments.select("terms", "doc_ids", "lengths", "starts", "codes", "tf").mapInArrow(lean(run), FOUND)

        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        rank = F.row_number().over(W.partitionBy("item").orderBy(*order))
        seeds = searched(self.segments.where(F.pmod(F.xxhash64("segment"), F.lit(SEED_SHARE)) == 0), {})
        # one row for each item of the block
        least = dict(seeds.withColumn("rank", rank).where(F.col("rank") == k).select("item", "score").collect())
        ids = self.spark.createDataFrame([(i, row.item_id) for i, row in enumerate(block)], "item int, item_id long")
        found = searched(self.segments, least).withColumn("rank", rank).where(F.col("rank") <= k)
        return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")


class Best:
    """The k best documents of an item so far; ``least`` is a score that at least k documents reach, or 1."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, least
        self.score, self.none, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, none: np.ndarray, id_: np.ndarray) -> None:
        score, none, id_ = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, none, -score))[: self.k]
        self.score, self.none, self.id = score[order], none[order], id_[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Lists:
    """One segment's documents and the terms that a block of items has: lists sorted by impact, and the forward index."""

    def __init__(self, row: pa.RecordBatch, value_set: pa.Array, n_docs: int, n_terms: int) -> None:
        terms, ids = row.column(0).flatten(), row.column(1).flatten()
        self.none, self.id = np.asarray(ids.is_null()), ids.fill_null(_LAST).to_numpy()
        lengths, starts, codes, tf = (np.frombuffer(row.column(i)[0].as_buffer(), "<i4") for i in range(2, 6))
        place = pc.index_in(terms, value_set).fill_null(-1).to_numpy()  # of each of the segment's terms in the block
        term, doc = place[codes], np.repeat(np.arange(len(lengths)), np.diff(starts))
        on = term >= 0
        self.term, doc, tf = term[on], doc[on], tf[on].astype(np.int64)
        size, which = np.unique(lengths, return_inverse=True)
        m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in size], np.int64)[which]  # products may be over 64 bits
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        self.start = np.searchsorted(doc, np.arange(len(lengths) + 1))
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_start = np.searchsorted(self.term[order], np.arange(len(value_set) + 1))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by lookups in the forward index."""
        size = self.start[docs + 1] - self.start[docs]
        at = _ranges(self.start[docs], size)
        return np.add.reduceat(weights[self.term[at]] * self.impact[at], np.cumsum(size) - size)

    def threshold_search(self, terms: np.ndarray, w: np.ndarray, weights: np.ndarray, best: Best) -> None:
        start = self.list_start[terms]
        size = self.list_start[terms + 1] - start
        on = size > 0
        start, size, w = start[on], size[on], w[on]
        # what the lists' heads could add up to is the threshold before the first round
        if not len(size) or int((w * self.list_impact[start]).sum()) < best.least:
            return
        seen = np.zeros(len(self.id), bool)
        done, depth = 0, DEPTH
        while True:
            more = size > done
            docs = self.list_doc[_ranges(start[more] + done, np.minimum(size[more], depth) - done)]
            docs = np.unique(docs[~seen[docs]])
            if len(docs):
                seen[docs] = True
                score = self.scores(docs, weights)
                good = score >= best.least
                if good.any():
                    docs = docs[good]
                    best.add(score[good], self.none[docs], self.id[docs])
            on = size > depth
            if not on.any() or int((w[on] * self.list_impact[start[on] + depth - 1]).sum()) < best.least:
                return
            done, depth = depth, depth * 2


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """Index all documents below path (by default a new folder of the shared one)."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def segment() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            own = segment_of(rows.column(0).combine_chunks(), rows.column(1), number)
            if own is not None:
                yield own

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= SEGMENT:
                yield from segment()
                held, size, number = [], 0, number + 1
        if size:
            yield from segment()

    path = path or fresh_path(spark, "lexical-index")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SEGMENTS).write.option("compression", "zstd").parquet(path)
    n_docs, n_terms = spark.read.schema(SEGMENTS).parquet(path).agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(spark, path, n_docs or 0, n_terms or 0)
