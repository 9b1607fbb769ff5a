"""N-gram Jaccard join by T-occurrence search.

A document is its set of distinct word shingles (64-bit hashes; see ``shingles`` and ``token_exchange``). Two documents
link when their sets' Jaccard similarity reaches num / den. The steps, each exact for what it drops:

1. Frequencies: a document whose partner must share ceil(num / den * n) shingles with it goes on only if at least so many of its
   shingles occur elsewhere. Equal sets become one class, and the same is asked of the classes again.
2. Candidates: a class lists the prefix of its shingles, rarest first, of which any partner must hold one. Lists of
   at most ``hot`` classes name their pairs (a bound on pairs for each entry); classes of longer lists become the members of cells,
   the components of those lists.
3. Search: index members and queries meet in blocks of bounded size. In each block the inverted lists of a
   query are searched for the members that occur T times or more: by DivideSkip, the short lists are merged with a heap (by
   counting, where they are long), and those found often enough are probed in the long lists by binary search. T depends on both sizes.
   Members of one component so far aren't probed again, so a block gives a spanning forest of its links.
4. Components of all links; each document gets the smallest id of its component.

Defined results: documents without words or text have no shingles and link with nothing; fewer words than a shingle are
one shingle. Repeated rows and repeated ids are documents of their own that share an id. Null ids are never the
smallest unless a component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rasterloom.llm.common import chunks, input_bytes, lean, mix64, stage, text_bytes
from rasterloom.llm.graph import connected_components
from rasterloom.llm.shingles import shingle_sets
from rasterloom.llm.token_exchange import Batch, exchange

#: Text bytes whose shingles are made at once.
CHUNK = 2 << 20
#: Members of an index block, and classes in a list above which it is hot.
BLOCK_MEMBERS, HOT = 1024, 64
#: Entries of short lists from which counting replaces the heap.
COUNTED = 4096
#: Ids that are broadcast at most (some 56 bytes each as a hash table); more are joined by a shuffle of the documents.
MOST_IDS = 2_000_000


def set_keys(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 16-byte key of each set; equal for equal sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    return out.view(np.uint8).reshape(-1, 16)


def _binaries(tokens: np.ndarray, offsets: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(tokens).view(np.uint8))
    valid = None if none is None else pa.py_buffer(np.packbits(~none, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [valid, pa.py_buffer((offsets * 8).astype(np.int32)), data])


def _fixed(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


def range_bits(n_bytes: int | None, range_bytes: int = 8 << 20, least: int = 6) -> int:
    """Ranges of the hash space for about n_bytes of text files: each then holds about range_bytes."""
    return min(24, max(least, math.ceil(math.log2(max(1, (n_bytes or 1) * 1.5 / range_bytes)))))


def frequent_enough(docs: DataFrame, size: int, num: int, den: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, tokens): every document; tokens are null if too few of them occur in other documents."""

    def read(batch: pa.RecordBatch) -> Iterator[Batch]:
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in chunks(np.diff(offsets), CHUNK):
            tokens, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            yield ids[i:j], set_keys(tokens, at), np.diff(at), tokens, at

    def finish(ids: list, keys: np.ndarray, n: np.ndarray, tokens: np.ndarray, at: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        shared = np.diff(at)
        stays = (n > 0) & (den * shared >= num * n)
        keep = np.repeat(stays, shared)
        at = np.concatenate([[0], np.cumsum(np.where(stays, shared, 0))])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _fixed(keys), pa.array(n), _binaries(tokens[keep], at, ~stays)], ["doc_id", "key", "n", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return exchange(rows, read, finish, "doc_id long, key binary, n long, tokens binary", bits)


def prefixes(classes: DataFrame, num: int, den: int, bits: int) -> DataFrame:
    """(key, n, tokens, prefix) of the classes that may have a partner among the others."""

    def read(batch: pa.RecordBatch) -> Iterator[Batch]:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 16)
        parts = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        if len(parts):
            yield [None] * len(parts), keys, batch.column(1).to_numpy(), np.concatenate(parts), at

    def finish(ids: list, keys: np.ndarray, n: np.ndarray, tokens: np.ndarray, at: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        shared = np.diff(at)
        doc = np.repeat(np.arange(len(n)), shared)
        least = -(-num * n // den)  # shingles that any partner holds
        stays = shared >= least
        order = np.lexsort((tokens, df, doc))  # rarest first; shingles of this class alone come before all these
        rank = np.arange(len(tokens)) - np.repeat(at[:-1], shared)
        first = stays[doc] & (rank < np.repeat(shared - least + 1, shared))
        kept = np.flatnonzero(stays)
        size = np.bincount(doc[first], minlength=len(n))[kept]
        inside = stays[doc]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(tokens[order][first].view(np.int64)))
        return pa.RecordBatch.from_arrays([_fixed(keys[kept]), pa.array(n[kept]), _binaries(tokens[inside], np.concatenate([[0], np.cumsum(shared[kept])])), lists], ["key", "n", "tokens", "prefix"])

    return exchange(classes, read, finish, "key binary, n long, tokens binary, prefix array<long>", bits, shifted=True)


class InvertedBlock:
    """Inverted lists of the members of one block, and T-occurrence search in them."""

    def __init__(self, sizes: list[int], sets: list[np.ndarray], num: int, den: int) -> None:
        self.num, self.den, self.sizes = num, den, np.array(sizes, np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.member = member[order]
        self.token, start = np.unique(token[order], return_index=True)
        self.start = np.append(start, len(token))

    def needed(self, n: int, m: np.ndarray | int):
        """Shared shingles at which sets of n and m link."""
        return -(-self.num * (n + m) // (self.den + self.num))

    def search(self, n: int, tokens: np.ndarray, skip=None) -> list[int]:
        """Members that link with a set of size n (tokens: those of it that may occur here). skip: members not asked for, given an array of them."""
        at = np.searchsorted(self.token, tokens)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == tokens] if len(self.token) else at[:0]
        size = self.start[at + 1] - self.start[at]
        t = -(-self.num * n // self.den)  # no partner shares fewer
        if len(at) < t:
            return []
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        # DivideSkip: the longest lists are only probed; at most t - 1 of them, so each partner shows in a short list
        n_long = min(t - 1, max(int(t / (0.01 * math.log2(max(2, size[-1])) + 1)), 0))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found, count = self._merge(short, t - n_long)
        if not len(found):
            return []
        m = self.sizes[found]
        fits = (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)) & (count + n_long >= self.needed(n, m))
        if skip is not None:
            fits &= ~skip(found)
        found, count = found[fits], count[fits]
        need = self.needed(n, self.sizes[found])
        for k, p in enumerate(long[::-1] if len(found) else ()):
            own = self.member[self.start[p] : self.start[p + 1]]
            i = np.searchsorted(own, found)
            i[i == len(own)] = 0
            count = count + (own[i] == found)
            alive = count + (n_long - k - 1) >= need
            if not alive.all():
                found, count, need = found[alive], count[alive], need[alive]
                if not len(found):
                    return []
        return found[count >= need].tolist()

    def _merge(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Members in ``least`` of the lists or more, ascending, and in how many."""
        spans = [(int(self.start[p]), int(self.start[p + 1])) for p in lists]
        if sum(e - b for b, e in spans) > COUNTED:
            n = np.bincount(np.concatenate([self.member[b:e] for b, e in spans]), minlength=len(self.sizes))
            found = np.flatnonzero(n >= least)
            return found, n[found]
        heap = [(int(self.member[b]), b, e) for b, e in spans]
        heapq.heapify(heap)
        found, count = [], []
        while len(heap) >= least:
            top, taken = heap[0][0], []
            while heap and heap[0][0] == top:
                taken.append(heapq.heappop(heap))
            if len(taken) >= least:
                found.append(top)
                count.append(len(taken))
                jump = top + 1
            else:  # no member before the least-th smallest head can occur often enough
                while heap and len(taken) < least - 1:
                    taken.append(heapq.heappop(heap))
                jump = max(top + 1, heap[0][0]) if heap else None
            if jump is None:
                break
            for _, b, e in taken:
                b = bisect_left(self.member, jump, b, e)
                if b < e:
                    heapq.heappush(heap, (int(self.member[b]), b, e))
        return np.array(found, np.int64), np.array(count, np.int64)


def search_cells(rows: DataFrame, num: int, den: int, n_cells: int) -> DataFrame:
    """Links (a, b) within cells. rows: (cell, role, key, n, tokens); role 0: member of the index and query, 1: query only, 2: index only.

    Members of a cell are read first and bounded by whoever made the cell; queries stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, index, parent = None, [], None, []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out: list[tuple[bytes, bytes]] = []

        def ready() -> None:
            nonlocal index, parent
            index = InvertedBlock([m[1] for m in members], [m[2] for m in members], num, den)
            parent = list(range(len(members)))
            for i, (key, n, tokens, asks) in enumerate(members):
                if not asks:
                    continue
                roots = np.array([find(x) for x in range(len(members))])
                for j in index.search(n, tokens, lambda f, i=i, roots=roots: (roots[f] == roots[i]) | (f == i)):
                    a, b = find(i), find(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((key, members[j][0]))

        def query(key: bytes, n: int, tokens: np.ndarray) -> None:
            seen = set()
            for j in index.search(n, tokens):
                if members[j][0] != key and (r := find(j)) not in seen:
                    seen.add(r)
                    out.append((key, members[j][0]))

        for batch in batches:
            for c, role, key, n, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if c != cell:
                    if members and index is None:
                        ready()
                    cell, members, index = c, [], None
                tokens = np.frombuffer(tokens, np.uint64)
                if role != 1:
                    members.append((key, n, tokens, role == 0))
                else:
                    if index is None:
                        ready()
                    query(key, n, tokens)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])
                out.clear()
        if members and index is None:
            ready()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    order = F.when(F.col("role") == 1, 1).otherwise(0)
    return rows.select("cell", "role", "key", "n", "tokens").repartition(n_cells, "cell").sortWithinPartitions("cell", order, "key").mapInArrow(lean(run), "a binary, b binary")


def class_links(classes: DataFrame, num: int, den: int, hot: int = HOT, members: int = BLOCK_MEMBERS) -> DataFrame:
    """Links between classes (key, n, tokens, prefix), enough to connect every component."""
    spark = classes.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    post = classes.select("key", "n", F.explode("prefix").alias("token"))
    length = post.groupBy("token").agg(F.count(F.lit(1)).alias("len"), F.min("key").alias("pivot")).where("len > 1")
    sets = classes.select("key", "n", "tokens")
    # short lists name their pairs: at most ``hot`` for each entry. A pair meets where its larger key is indexed
    short = post.join(length.where(F.col("len") <= hot).select("token"), "token").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("of"))
    later = lambda x, i: F.filter(F.slice(F.col("of"), i + 2, F.size("of")), lambda y: den * x["n"] >= num * y["n"])  # noqa: E731  sorted by size
    pairs = short.select(F.explode(F.flatten(F.transform("of", lambda x, i: F.transform(later(x, i), lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))))).alias("p"))
    pairs = stage(pairs.select("p.a", "p.b").distinct(), "pairs")
    n_cells = max(n_parts, math.ceil(pairs.count() / members))
    cell = F.pmod(F.xxhash64("b"), F.lit(n_cells)).cast("string")
    asked = pairs.select(F.col("a").alias("key"), cell.alias("cell")).distinct().join(sets, "key").withColumn("role", F.lit(1))
    held = pairs.select(F.col("b").alias("key"), cell.alias("cell")).distinct().join(sets, "key").withColumn("role", F.lit(2))
    links = search_cells(asked.unionByName(held), num, den, n_cells)
    # long lists: cells are components of their members, worked off in pairs of blocks
    stars = stage(post.join(length.where(F.col("len") > hot), "token").where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    if not stars.isEmpty():
        cells = stage(connected_components(stars).join(sets.select("key", "n"), F.col("node") == F.col("key")).select("key", "n", "root"), "cells")
        sizes = cells.groupBy("root").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / members).cast("int"))
        # blocks by hash: a cell's members are spread evenly without ordering them in one task
        placed = cells.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
        meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block"))))
        meets = meets.select("key", F.concat(F.lit("h"), F.hex("root"), F.lit("/"), "other").alias("cell"), F.when(F.col("other") == F.col("block"), 0).otherwise(1).alias("role"))
        links = links.unionByName(search_cells(meets.join(sets, "key"), num, den, n_cells))
    return links


def _keyed(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """docs with the key of their shingle set."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(np.diff(offsets), CHUNK):
                tokens, o = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, _fixed(set_keys(tokens, o))], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)


def representatives(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of docs with the smallest id of each component; all columns stay.

    Documents without shingles all stay. Of several rows with that id (or, in a component without ids, of all rows)
    the first in the order of their set keys and texts stays.
    """
    found = stage(components(docs, size, num, den, id_col, text_col, bits), "components")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # an id of one row decides by itself; others need their keys as well
    shared = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"))
    shared = stage(shared, "shared")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    gone = stage(gone.unionByName(shared).where("__id IS NOT NULL").distinct(), "gone")
    # only ids that go are joined: while they are few enough to broadcast, the texts need no shuffle
    gone = F.broadcast(gone) if gone.count() <= MOST_IDS else gone.hint("merge")
    own = docs[id_col].cast("long")
    one = docs.where(own.isNotNull()).join(gone, own == F.col("__id"), "left_anti")
    if shared.isEmpty():
        return one
    several = _keyed(docs.join(shared, docs[id_col].cast("long").eqNullSafe(F.col("__id")), "left_semi"), size, text_col)
    roots = first.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), "n_shingles", F.col("root").alias("__root")).distinct()
    several = several.join(roots, several[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    rank = F.row_number().over(W.partitionBy("__root", "__id").orderBy("__key", text_col))
    several = several.withColumn("__rank", rank).where("n_shingles = 0 OR __rank = 1").select(*docs.columns)
    return one.unionByName(several)


def components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, key, root, component_id) of every document; key is equal for equal sets, root for equal components.

    bits: 2**bits ranges of the hash space (None: by the input's size).
    """
    bits = bits or range_bits(input_bytes(docs.select(text_col)))
    every = stage(frequent_enough(docs, size, num, den, bits, id_col, text_col), "sets")
    # one row for each set: copies are folded before the shuffle
    held = every.where(F.col("tokens").isNotNull()).groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("doc_id").alias("least"))
    held = stage(held, "classes")
    classes = stage(prefixes(held.select("key", "n", "tokens"), num, den, bits), "prefixes")
    roots = connected_components(class_links(classes, num, den)).withColumnRenamed("node", "key")
    member = held.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    member = stage(member, "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = member.join(least, "root").select("key", "root", "component_id")
    alone = every.where(F.col("tokens").isNull()).select("doc_id", F.col("n").alias("n_shingles"), "key", F.col("key").alias("root"), F.col("doc_id").alias("component_id"))
    linked = every.where(F.col("tokens").isNotNull()).select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key.hint("merge"), "key").select("doc_id", "n_shingles", "key", "root", "component_id")
    return alone.unionByName(linked)
