"""Document frequencies of all tokens of all documents, brought back to the documents.

Tokens are 64-bit hashes. A batch of documents sends each range of the hash space one packed block (five bytes of hash
and about one byte of document number for each token) instead of a row for each token. The range's task sorts its tokens, which
makes its inverted lists, and answers each batch with those of its tokens that other documents hold too. The
answers are put together by document again. Hash bits: those of the range and 40 more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rasterloom.llm.common import bounded_batches, lean, tasks_for

REST = np.uint64(40)
MASK = np.uint64((1 << 40) - 1)
BLOCK = "part int, batch long, n int, docs binary, low binary, high binary, df binary, ids array<long>, keys binary, sizes binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]

#: A batch's documents: ids (with None), keys (n x 16 bytes), set sizes, tokens sorted within each document, offsets.
Batch = tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _row(**v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.get(n)], k) for n, k in zip(_NAMES, _KINDS)], _NAMES)


def _pack(docs: np.ndarray) -> bytes:
    """Ascending document numbers as differences of one, two or four bytes."""
    d = np.diff(docs, prepend=0)
    top = d.max(initial=0)
    return d.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n]
    return np.cumsum(np.frombuffer(data, kind), dtype=np.int64)


def _rest(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)


def _split(x: np.ndarray) -> dict[str, bytes]:
    return {"low": x.astype(np.uint32).tobytes(), "high": (x >> np.uint64(32)).astype(np.uint8).tobytes()}


def exchange(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Batch]], finish: Callable[[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, bits: int, shifted: bool = False) -> DataFrame:
    """read: documents of an Arrow batch. finish(ids, keys, sizes, tokens, offsets, df): result rows of one batch, given
    each document's tokens that others hold too, with the number of documents holding them.

    bits: 2**bits ranges. shifted: tokens have bits + 40 bits already (they come from an exchange with as many).
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    ranges = 1 << bits
    down = np.uint64(0 if shifted else 24 - bits)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for ids, keys, sizes, tokens, offsets in read(batch):
                number = base + seq
                seq += 1
                yield _row(part=-1, batch=number, n=len(ids), ids=ids, keys=keys.tobytes(), sizes=sizes.astype(np.int32).tobytes())
                tokens = tokens >> down
                part = (tokens >> REST).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
                order = np.argsort(part.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
                tokens, doc, cut = tokens[order] & MASK, doc[order], np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))])
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    i, j = cut[p], cut[p + 1]
                    yield _row(part=p, batch=number, n=int(j - i), docs=_pack(doc[i:j]), **_split(tokens[i:j]))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def answer() -> Iterator[pa.RecordBatch]:
            rest = np.concatenate([r for _, _, r in held])
            order = np.argsort(rest, kind="stable")
            s = rest[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(s)))
            df = np.empty(len(s), np.uint32)
            df[order] = np.repeat(size, size)
            at = 0
            for number, docs, r in held:
                own = df[at : at + len(r)]
                at += len(r)
                keep = own >= 2
                if keep.any():
                    yield _row(part=now, batch=number, n=int(keep.sum()), docs=_pack(docs[keep]), df=own[keep].tobytes(), **_split(r[keep]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    yield _row(**row)
                    continue
                if row["part"] != now:
                    if held:
                        yield from answer()
                    held.clear()
                    now = row["part"]
                held.append((row["batch"], _unpack(row["docs"], row["n"]), _rest(row["low"], row["high"])))
        if held:
            yield from answer()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, docs, tokens, df = None, [], [], []

        def done() -> pa.RecordBatch:
            n = head["n"]
            d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            f = np.concatenate(df) if df else np.zeros(0, np.uint32)
            order = np.lexsort((t, d))
            keys = np.frombuffer(head["keys"], np.uint8).reshape(n, 16)
            return finish(head["ids"], keys, np.frombuffer(head["sizes"], np.int32).astype(np.int64), t[order], np.searchsorted(d[order], np.arange(n + 1)), f[order])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    if head:
                        yield done()
                    head, docs, tokens, df = row, [], [], []
                else:
                    docs.append(_unpack(row["docs"], row["n"]))
                    tokens.append(_rest(row["low"], row["high"]) | np.uint64(row["part"]) << REST)
                    df.append(np.frombuffer(row["df"], np.uint32))
        if head:
            yield done()

    # heads (part -1) need no range; they are spread by their batch
    dealt = rows.mapInArrow(lean(scatter), BLOCK)
    n = tasks_for(spark, ranges)
    answered = dealt.repartition(n, "part", dealt["ids"].isNotNull().cast("long") * dealt["batch"]).sortWithinPartitions("part", "batch").mapInArrow(lean(invert), BLOCK)
    return answered.repartition(n, "batch").sortWithinPartitions("batch", "part").mapInArrow(lean(gather), schema)
