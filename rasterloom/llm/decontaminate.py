"""Benchmark decontamination with a positional inverted index.

Indexing: documents are indexed in blocks of bounded size. A block's index holds, for each of its terms, the sorted positions at
which it stands (postings, ordered by term then position); documents in a block are set apart by a gap that no
phrase or stretch can bridge. Blocks are rows of a stored table, so the index is distributed by document and every list of a
phrase is in one place. All terms have postings, so a stored index also answers items that come later.

Exact search: for each phrase the shortest list of the block is taken first; its positions, adjusted by the term's offset,
are intersected with the next shortest list by binary probes, and so on.

Proximity search: a phrase is found where a stretch of ``within`` consecutive words of one document holds all its words, in any
order and each as often as the phrase has it. Occurrences of its rarest term without all others around them are left out by binary probes;
the words of all stretches that hold the phrase are hit.

Test items are taken in blocks of bounded bytes, and only one is broadcast at a time; hits of several blocks are joined.

Defined results: a null or empty text has no words and no hits. Items without id, text or words take no part. An item
with fewer words than a window is one window. Items that share an id count once. Repeated documents are judged each
for itself. Result columns replace input columns of the same name; ``clean`` keeps all columns. Empty tables give empty
results, and no hits without items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import BASE, LOWER, bounded_batches, chunks, lean, span_hashes, stage, text_bytes, words

#: Text bytes in a block of the index, and of test items that are broadcast at once.
BLOCK_BYTES = 4 << 20
ITEM_BYTES = 8 << 20

IS_WORD = np.ones(256, bool)  # the complement of \x00-\x2F \x3A-\x60 \x7B-\x7F
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
assert BASE & 1

INDEX = "doc_ids array<long>, first_word binary, terms binary, starts binary, positions binary, gap int, rows binary"
INDEX_COLUMNS = ("doc_ids", "first_word", "terms", "starts", "positions", "gap")
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("contaminated", T.BooleanType())]

NEAR = T.StructField("near_items", T.ArrayType(T.StringType()))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in order, and the first word of each row (n + 1)."""
    data, offsets = text_bytes(col)
    data = LOWER[data]
    start, end, first = words(data, offsets, IS_WORD)
    return (span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)), first


class Phrases:
    """The distinct windows of a block of test items; terms are numbered in order of their hashes.

    stride: words from one window of an item to the next; the last ``window`` words always are one.
    """

    def __init__(self, items: list[tuple[str, str]], window: int, stride: int = 1) -> None:
        h, first = tokens(pa.array([t for _, t in items], pa.string()))
        self.terms = np.unique(h)
        t = np.searchsorted(self.terms, h)
        found: dict[tuple[int, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            own = t[first[i] : first[i + 1]].tolist()
            last = max(0, len(own) - window)
            for j in {*range(0, last, stride), last} if own else ():
                found.setdefault(tuple(own[j : j + window]), set()).add(item)
        self.names = sorted({x for s in found.values() for x in s})
        number = {x: i for i, x in enumerate(self.names)}
        self.groups = []  # (length, terms of windows, starts of their items, their items)
        for n in sorted({len(w) for w in found}):
            of = [w for w in found if len(w) == n]
            lists = [sorted(number[x] for x in found[w]) for w in of]
            self.groups.append((n, np.array(of, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.array([y for x in lists for y in x], np.int64)))
        self.longest = max([n for n, *_ in self.groups], default=1)


class BlockIndex:
    """Postings of one block: keys = term << 32 | position, sorted; position counts words plus a gap after each document."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, first_word: np.ndarray, gap: int) -> None:
        self.terms, self.starts, self.positions, self.first_word, self.gap = terms, starts, positions, first_word, gap

    @classmethod
    def build(cls, h: np.ndarray, first: np.ndarray, gap: int) -> BlockIndex:
        at = np.arange(len(h)) + gap * np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(h[starts], np.append(starts, len(h)), at.astype(np.int32), first + gap * np.arange(len(first)), gap)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """terms, starts and positions (as differences) as bytes."""
        return self.terms.tobytes(), self.starts.astype(np.int32).tobytes(), np.diff(self.positions, prepend=np.int32(0)).astype(np.int32).tobytes()

    @classmethod
    def opened(cls, terms: bytes, starts: bytes, positions: bytes, first: np.ndarray, gap: int) -> BlockIndex:
        at = np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int32)
        return cls(np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32).astype(np.int64), at, first + gap * np.arange(len(first)), gap)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each wanted term's list; length 0 for terms that don't occur."""
        i = np.searchsorted(self.terms, wanted)
        i[i == len(self.terms)] = 0
        there = (self.terms[i] == wanted) if len(self.terms) else np.zeros(len(wanted), bool)
        return np.where(there, self.starts[i], 0), np.where(there, self.starts[np.minimum(i + 1, len(self.starts) - 1)] - self.starts[i], 0)

    def phrases(self, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts of matches, their windows, item lists) for each window length."""
        begin, size = self.lists(p.terms)
        own = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        positions = self.positions[own].astype(np.int64)
        keys = np.repeat(np.arange(len(size)), size) << 32 | positions  # the lists of p's terms, one after the other
        begin = np.concatenate([[0], np.cumsum(size)])[: len(size)]
        for n, windows, item_at, item_ids in p.groups:
            count = size[windows]
            rank = np.argsort(count, 1, kind="stable")  # rarest first
            w = np.flatnonzero(count.min(1) > 0)
            rare = rank[w, 0]
            term = windows[w, rare]
            times = size[term]
            which = np.repeat(w, times)
            place = np.repeat(begin[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            at = positions[place] - np.repeat(rare, times)
            for k in range(1, n):  # the next rarest term
                off = rank[which, k]
                want = windows[which, off] << 32 | (at + off)
                i = np.searchsorted(keys, want)
                i[i == len(keys)] = 0
                keep = (keys[i] == want) & (at + off >= 0)
                which, at = which[keep], at[keep]
                if not len(at):
                    break
            yield n, at, which, item_at, item_ids

    def stretches(self, p: Phrases, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of hit words, items) of each phrase that ``within`` consecutive words of a document hold in any order."""
        begin, size = self.lists(p.terms)
        for n, windows, item_at, item_ids in p.groups:
            if n > within:
                continue
            for w in np.flatnonzero(size[windows].min(1) > 0).tolist():
                terms, times = np.unique(windows[w], return_counts=True)
                by = np.argsort(size[terms], kind="stable")  # rarest first
                lists = [self.positions[begin[t] : begin[t] + size[t]] for t in terms[by]]
                at = lists[0]
                for own in lists[1:]:
                    i = np.searchsorted(own, at - within + 1)
                    i[i == len(own)] = len(own) - 1
                    at = at[np.abs(own[i] - at) < within]
                    if not len(at):
                        break
                if not len(at):
                    continue
                around = []
                for own in lists:
                    lo, hi = np.searchsorted(own, at - within + 1), np.searchsorted(own, at + within)
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, lo, 1), np.add.at(edge, hi, -1)
                    around.append(own[np.cumsum(edge[:-1]) > 0])
                places = np.sort(np.concatenate(around))
                full = np.ones(len(places), bool)  # the stretch that begins here holds the phrase
                for own, k in zip(around, times[by].tolist()):
                    full &= np.searchsorted(own, places + within) - np.searchsorted(own, places) >= k
                start = places[full]
                if len(start):
                    i = np.searchsorted(start, places, "right") - 1
                    yield places[(i >= 0) & (places - start[i] < within)].astype(np.int64), item_ids[item_at[w] : item_at[w + 1]]

    def matches(self, p: Phrases, within: int | None = None) -> list[tuple[int, list[str], list[list[int]]] | None]:
        """For each document: (words hit, items, spans of hit words) or None. Spans are [first, end) in words of the document.

        within: proximity instead of order.
        """
        n_docs = len(self.first_word) - 1
        change = np.zeros(int(self.first_word[-1]) + p.longest + 2, np.int32)
        pairs = []
        for n, at, which, item_at, item_ids in self.phrases(p) if within is None else ():
            if not len(at):
                continue
            np.add.at(change, at, 1), np.add.at(change, at + n, -1)
            doc = np.searchsorted(self.first_word, at, "right") - 1
            times = item_at[which + 1] - item_at[which]
            items = item_ids[np.repeat(item_at[which] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]
            pairs.append(np.unique(np.repeat(doc, times) << 32 | items))
        for at, items in self.stretches(p, within) if within is not None else ():
            np.add.at(change, at, 1), np.add.at(change, at + 1, -1)
            doc = np.unique(np.searchsorted(self.first_word, at, "right") - 1)
            pairs.append((doc[:, None] << 32 | items).ravel())
        out: list = [None] * n_docs
        if not pairs:
            return out
        edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(self.first_word, begin, "right") - 1
        spans: dict[int, list[list[int]]] = {}
        for d, b, e in zip(doc.tolist(), (begin - self.first_word[doc]).tolist(), (end - self.first_word[doc]).tolist()):
            spans.setdefault(d, []).append([b, e])
        items_of: dict[int, list[str]] = {}
        for x in np.unique(np.concatenate(pairs)).tolist():
            items_of.setdefault(x >> 32, []).append(p.names[x & 0xFFFFFFFF])
        for d, s in spans.items():
            out[d] = (sum(e - b for b, e in s), sorted(items_of[d]), s)
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int | None = None) -> Iterator[list[tuple[str, str]]]:
    """The items as (id as text, text), in blocks of about block_bytes (ITEM_BYTES); one block is in the driver at a time."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / (block_bytes or ITEM_BYTES)))
    if n > 1:
        rows = stage(rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), "items")
    for b in range(n):
        yield sorted(map(tuple, (rows.where(F.col("b") == b).select("i", "t") if n > 1 else rows).collect()))


def build_index(docs: DataFrame, gap: int = 64, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """The (staged) index of docs, a row for each block.

    gap: no phrase and no stretch that is searched may be longer. whole_rows: the documents with all columns stand beside their postings.
    """
    bounded_batches(docs.sparkSession)
    if not whole_rows:
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        id_col, text_col = "doc_id", "text"
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(text_at))
            for i, j in chunks(np.diff(offsets), BLOCK_BYTES):
                part = batch.slice(i, j - i)
                h, first = tokens(part.column(text_at))
                values = [part.column(id_at).cast(pa.int64()).to_pylist(), first.astype(np.int64).tobytes(), *BlockIndex.build(h, first, gap).packed(), gap, _closed(part) if whole_rows else None]
                kinds = [pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [*INDEX_COLUMNS, "rows"])

    return stage(docs.mapInArrow(lean(index), INDEX).withColumn("block", F.monotonically_increasing_id()), "postings")


def _closed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, list, np.ndarray, BlockIndex]]:
    """(row, ids, first words, index) of each block in a batch of INDEX_COLUMNS."""
    for k in range(batch.num_rows):
        ids, first, terms, starts, positions, gap = (batch.column(c)[k].as_py() for c in range(6))
        if gap < longest:
            raise ValueError("the index's gap is smaller than a window or stretch")
        first = np.frombuffer(first, np.int64)
        yield k, ids, first, BlockIndex.opened(terms, starts, positions, first, gap)


def search(index: DataFrame, items: list[tuple[str, str]], window: int = 10, within: int | None = None, near: int | None = None) -> DataFrame:
    """(block, row, doc_id, n_words, n_hit, items, spans, contaminated) of every indexed document for one block of items.

    within: proximity instead of exact phrases. near: exact phrases, and beside them ``near_items``, the items of which one of the windows
    that follow each other stands in ``near`` consecutive words in any order.
    """
    held = index.sparkSession.sparkContext.broadcast((Phrases(items, window), Phrases(items if near else [], window, window)))
    index = index.select(*INDEX_COLUMNS, "block")
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("block", "row", "doc_id")), *FOUND, *([NEAR] if near else [])])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tiles = held.value
        for batch in batches:
            for k, ids, first, x in _blocks(batch, max(p.longest, within or 0, near or 0)):
                keys = [pa.array([batch.column(6)[k].as_py()] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())]
                more = [pa.array([m[1] if m else [] for m in x.matches(tiles, near)], pa.list_(pa.string()))] if near else []
                yield pa.RecordBatch.from_arrays([*keys, *_found(np.diff(first), x.matches(p, within)), *more], schema.fieldNames())

    return index.mapInArrow(lean(look), schema)


def _found(n_words: np.ndarray, found: list) -> list[pa.Array]:
    return [pa.array(n_words.astype(np.int64)), pa.array([x[0] if x else 0 for x in found], pa.int64()), pa.array([x[1] if x else [] for x in found], pa.list_(pa.string())), pa.array([x[2] if x else [] for x in found], pa.list_(pa.list_(pa.int64()))), pa.array([x is not None for x in found], pa.bool_())]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", near: int | None = None) -> DataFrame:
    """Hits of all items in every document, through a stored index: doc_id, n_words, n_hit, items, spans, contaminated (and near_items, see ``search``).

    Several item blocks: each is searched in the stored index, and a document's spans and items are joined.
    """
    index = build_index(docs, max(window, near or 0) + 1, id_col, text_col)
    found, several = None, False
    for block in item_blocks(items, item_id, item_text):
        one = search(index, block, window, near=near)
        found, several = (one, False) if found is None else (found.unionByName(stage(one, "hits")), True)
    return (join_hits(found, ["block", "row", "doc_id", "n_words"]) if several else found).drop("block", "row")


def join_hits(found: DataFrame, keys: list[str]) -> DataFrame:
    """Spans and items of rows with equal keys joined; n_hit counts words in the union of spans."""
    near = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items")] if "near_items" in found.columns else []
    merged = found.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("contaminated").alias("contaminated"), *near)
    union = F.aggregate(
        "all",
        F.array().cast("array<array<bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= s[0]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.element_at(F.element_at(acc, -1), 1), F.greatest(F.element_at(F.element_at(acc, -1), 2), s[1]))))).otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", union)
    return merged.select(*keys, F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]).alias("n_hit"), "items", "spans", "contaminated", *(["near_items"] if near else []))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns, through a stored index for each block of items.

    The documents stand beside their postings, so no text moves between tasks.
    """
    for block in item_blocks(items, item_id, item_text):
        index = build_index(docs, window + 1, id_col, text_col, whole_rows=True)
        docs = _survivors(index, block, window, docs.schema)
    return docs


def _survivors(index: DataFrame, items: list[tuple[str, str]], window: int, schema: T.StructType) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, _, x in _blocks(batch, held.value.longest):
                rows = pa.ipc.open_stream(batch.column(6)[k].as_py()).read_next_batch()
                yield rows.filter(pa.array([m is None for m in x.matches(held.value)], pa.bool_()))

    return index.select(*INDEX_COLUMNS, "rows").mapInArrow(lean(look), schema)
