"""Suffix-array deduplication of long repeated strings with a logarithmic index family.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts in a document with a smaller id. The suffix
arrays are sparse: they hold the suffixes that start at *anchors*. A window's anchor is its 20-byte substring with the least hash,
so equal windows have equal anchors at equal places, and no match is missed. Suffixes are ordered by their letters; beside
each stands the text before the anchor, so that a window counts as found when the common prefix of two suffixes and the
common text before them cover it. Every removal is decided by bytes, never by hashes.

1. Anchors whose 20 bytes stand in one document only can't match. Each batch of documents sends the hashes of its distinct
   anchors to ranges of the hash space, which answer which of them other documents hold too.
2. Each batch deals its remaining strings (an anchor with all windows around it) to the anchors' ranges. Equal strings of a batch are
   folded: larger documents' ones go at once, and the smallest's one travels. Anchors that very many batches hold are dealt
   window by window, by the hash of the whole window, which spreads them over all tasks.
3. In a range, documents come in order of their ids, in batches. A batch gets a suffix array, which is merge-scanned with each
   older level for common strings, and becomes a level; levels merge when they are about equal in size (``LevelFamily``).
4. Removed windows are marked in their documents, and what is left is kept.

``StoredFamily`` keeps the levels of all ranges as tables in a shared folder: documents that come later are scanned against them
without reading the older documents again, and stored levels merge in the same geometric way.

Batches are made anew by each scan of the input; a checksum of ids and texts travels with them, and a scan that gives
other batches is an error (the input must then be written to a table first).

Defined results: a null text has no bytes. Documents that share an id don't remove each other's strings. Null ids are larger than
all others and don't remove each other's strings. Texts shorter than ``length`` stay. Ids must be below 2**63 - 1. Result
columns replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, chunks, drop_path, input_bytes, lean, mix64, stage, text_bytes, tasks_for

#: Text bytes of a batch, bytes of an anchor, and places whose hashes are made at once.
BATCH, GRAM, BLOCK = 4 << 20, 20, 1 << 16
#: Strings of a batch of the index family, and batches that hold an anchor above which its windows are dealt one by one.
LEVEL, HOT = 1 << 16, 1 << 12
#: Strings that are put together at once.
GATHER = 1 << 12
#: The part of rows that carry removed spans to their batch; it sorts last.
SPANS = (1 << 31) - 1
NONE = np.int64((1 << 63) - 1)
#: The id of strings in stored levels: smaller than all.
EARLIER = np.int64(-(1 << 63))

ROW = "part int, batch long, n int, sum long, at binary, which binary, ids binary, place binary, strings binary, head binary"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _row(**v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.get(n)], k) for n, k in zip(_NAMES, _KINDS)], _NAMES)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number."""
    return np.ndarray((max(0, len(data) - 7),), np.uint64, data, 0, (1,))


def gram_hashes(word: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on."""
    i = (lambda k: slice(at.start + k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    h = word[i(0)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[i(8)]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h += word[i(GRAM - 8)]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, document) of each anchor, in order; windows start from first to last."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    width = length - GRAM + 1  # anchors that a window may have
    word, mask, own = _words(data), np.uint64((1 << 24) - 1), np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    numbers = np.arange(BLOCK + width - 1, dtype=np.uint64)
    for b in range(0, n, BLOCK):
        e = min(n, b + BLOCK)
        low = gram_hashes(word, slice(b, e + width - 1)) & ~mask
        low |= numbers[: len(low)]  # the leftmost of equal hashes
        span = 1
        while span * 2 <= width:  # minima of 1, 2, 4, ... neighbours
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if rest := width - span:
            low = np.minimum(low[: len(low) - rest], low[rest:])
        own[b:e] = low[: e - b] & mask
        own[b:e] += own.dtype.type(b)
    inside = np.zeros(n + 1, bool)  # windows that don't cross documents
    inside[:n] = True
    ends = offsets[1:-1]
    for k in range(1, length):
        at = ends - k
        inside[at[(at >= 0) & (at < n)]] = False
    new = inside[:n].copy()
    new[1:] &= (own[1:] != own[:-1]) | ~inside[: n - 1]
    last = inside[:n].copy()
    last &= np.append(new[1:], True) | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    return own[first].astype(np.int64), first, last, np.searchsorted(offsets, first, "right") - 1


def _pack(x: np.ndarray) -> bytes:
    d = np.diff(x, prepend=0)
    top = int(d.max(initial=0))
    return d.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n]), dtype=np.int64) if n else np.zeros(0, np.int64)


class SuffixArray:
    """Strings around anchors, ordered by the letters from the anchor on.

    ahead: the bytes from the anchor on; behind: those before it, backwards; both are padded with zeros. ``most`` and
    ``least`` are the largest and smallest number of bytes before the anchor among the string's windows: its places.
    """

    def __init__(self, ahead: np.ndarray, behind: np.ndarray, most: np.ndarray, least: np.ndarray, ids: np.ndarray) -> None:
        self.ahead, self.behind, self.most, self.least, self.ids = ahead, behind, most, least, ids

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def build(cls, data: np.ndarray, most: np.ndarray, more: np.ndarray, ids: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """The array of the strings that stand in data one after the other, and their order. more: windows besides the first."""
        size, n = more + length, len(most)
        begin = np.concatenate([[0], np.cumsum(size)])[:n].astype(np.int64)
        back, least = length - GRAM, most - more
        wide = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(length, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view
        ahead = view(wide, length)[begin + most + back]
        ahead[np.arange(length) >= (length - least)[:, None]] = 0
        behind = view(wide, back)[begin + most][:, ::-1]
        behind = np.where(np.arange(back) < most[:, None], behind, 0).astype(np.uint8)
        order = _order(ahead)
        return cls(ahead[order], behind[order], most[order], least[order], ids[order]), order

    def merged(self, other: SuffixArray) -> tuple[SuffixArray, np.ndarray]:
        """Both arrays in one, and where its rows come from (other's after own); a stable sort merges the two runs."""
        order = _order(np.concatenate([self.ahead, other.ahead]))
        both = lambda a, b: np.concatenate([a, b])[order]
        return SuffixArray(both(self.ahead, other.ahead), both(self.behind, other.behind), both(self.most, other.most), both(self.least, other.least), both(self.ids, other.ids)), order

    def chosen(self, rows: np.ndarray) -> SuffixArray:
        return SuffixArray(self.ahead[rows], self.behind[rows], self.most[rows], self.least[rows], self.ids[rows])

    def found(self) -> np.ndarray:
        """For each string and place whether its window also stands in a string with a smaller id."""
        n, back = self.behind.shape
        length = self.ahead.shape[1]
        out = np.zeros((n, back + 1), bool)
        if n < 2:
            return out
        common = _common(self.ahead)  # with the suffix before
        order = _order(self.behind)
        common_back = _common(self.behind[order])
        class_back = np.zeros(n, np.int64)
        for place in range(back + 1):
            # runs of suffixes with a common prefix that reaches the windows' ends
            run = np.concatenate([[0], np.cumsum(common < length - place)])
            rows = np.flatnonzero((self.least <= place) & (place <= self.most))
            rows = rows[np.bincount(run[rows], minlength=run[-1] + 1)[run[rows]] > 1]
            if not len(rows):
                continue
            key = run[rows]
            if place:  # and with common text back to their starts
                class_back[order] = np.concatenate([[0], np.cumsum(common_back < place)])
                key = key * n + class_back[rows]
            by = np.argsort(key, kind="stable")
            key, rows = key[by], rows[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            least = np.minimum.reduceat(self.ids[rows], np.flatnonzero(new))
            out[rows, place] = self.ids[rows] > least[np.cumsum(new) - 1]
        return out


def _order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes by their letters; sorted runs are merged."""
    rows = np.ascontiguousarray(rows)
    return np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")


def _common(rows: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring rows."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


class LevelFamily:
    """Suffix arrays of older batches; sizes at least double from level to level."""

    def __init__(self, levels: list[SuffixArray] = ()) -> None:
        self.levels = list(levels)

    def scan(self, batch: SuffixArray) -> np.ndarray:
        """Windows of the batch (as ``SuffixArray.found``) that stand in strings with smaller ids, of all levels or of the batch."""
        if not self.levels:
            return batch.found()
        out = np.zeros((len(batch), batch.behind.shape[1] + 1), bool)
        for level in self.levels:
            both, source = level.merged(batch)
            of_batch = source >= len(level)
            out[source[of_batch] - len(level)] |= both.found()[of_batch]
        return out

    def add(self, batch: SuffixArray) -> None:
        """The batch's array becomes a level; levels that aren't much larger merge with it."""
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch, _ = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def take(self, array: SuffixArray) -> np.ndarray:
        """Scan a batch and add those of its strings that have a window of their own; gives the windows found."""
        gone = self.scan(array)
        places = np.arange(gone.shape[1])
        covered = (array.least[:, None] <= places) & (places <= array.most[:, None])
        fresh = np.flatnonzero((covered & ~gone).any(1))
        if len(fresh):
            self.add(array.chosen(fresh))
        return gone


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[b : b + s] for all begins and sizes, one behind the other; places are made for GATHER strings at once."""
    out, at = np.empty(int(size.sum()), data.dtype), 0
    for i in range(0, len(begin), GATHER):
        b, s = begin[i : i + GATHER], size[i : i + GATHER]
        stop = at + int(s.sum())
        out[at:stop] = data[np.arange(stop - at) + np.repeat(b - (np.cumsum(s) - s), s)]
        at = stop
    return out


def find_windows(data: np.ndarray, most: np.ndarray, more: np.ndarray, ids: np.ndarray, length: int, family: LevelFamily | None = None, level: int = LEVEL) -> np.ndarray:
    """For each string and place whether its window stands in a string with a smaller id; batches of ``level`` strings."""
    family = family or LevelFamily()
    out = np.zeros((len(ids), length - GRAM + 1), bool)
    begin = np.concatenate([[0], np.cumsum(more + length)])
    by = np.argsort(ids, kind="stable")
    for i in range(0, len(by), level):
        rows = by[i : i + level]
        size = more[rows] + length
        array, order = SuffixArray.build(_gathered(data, begin[rows], size), most[rows], more[rows], ids[rows], length)
        out[rows[order]] = family.take(array)
    return out


def _head(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open_head(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


@dataclass(frozen=True)
class _Job:
    """The functions that tasks run; picklable."""

    length: int
    bits: int
    id_at: int
    text_at: int
    kept: str | None
    names: list[str]
    hot: int = HOT
    level: int = LEVEL

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, int]]:
        """(number, rows, bytes, offsets, checksum) of the batches that a task's rows are cut into."""
        base, seq = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(self.text_at))
            for i, j in chunks(np.diff(offsets), BATCH):
                part = batch.slice(i, j - i)
                data, own = text_bytes(part.column(self.text_at))
                yield base + seq, part, data, own, zlib.crc32(data, zlib.crc32(own.tobytes(), zlib.crc32(self.ids(part).tobytes())))
                seq += 1

    def ids(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(self.id_at).cast(pa.int64()).fill_null(int(NONE)).to_numpy(zero_copy_only=False)

    def keys(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Range and 32 more bits of anchors' hashes, mixed anew: an anchor was chosen for a small hash."""
        h = mix64(gram_hashes(_words(data), place) ^ np.uint64(0xD1B54A32D192ED03)) if len(place) else np.zeros(0, np.uint64)
        return (h >> np.uint64(32 - self.bits)).astype(np.int64)

    def scatter(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchors of each batch, and whether several of its documents hold them."""
        for number, batch, data, offsets, total in self.pieces(batches):
            place, _, _, doc = anchors(data, offsets, self.length)
            if not len(place):
                continue
            key, back = np.unique(self.keys(data, place), return_inverse=True)
            least, most = np.full(len(key), len(offsets)), np.zeros(len(key), np.int64)
            np.minimum.at(least, back, doc), np.maximum.at(most, back, doc)
            part, low, several = key >> 32, key.astype(np.uint32), least < most
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield _row(part=int(part[i]), batch=number, sum=total, n=j - i, at=low[i:j].tobytes(), which=np.packbits(several[i:j]).tobytes())

    def heads(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, _, _, total in self.pieces(batches):
            yield _row(part=-1, batch=number, sum=total, n=batch.num_rows, head=_head(batch))

    @staticmethod
    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict] | dict]:
        """Rows of one range together; spans as they come."""
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == SPANS:
                    yield row
                    continue
                if held and held[0]["part"] != row["part"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    @staticmethod
    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
        head, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    if head:
                        yield head, rows
                    head, rows = row, []
                    continue
                if head is None or (row["batch"], row["sum"]) != (head["batch"], head["sum"]):
                    raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
                rows.append(row)
        if head:
            yield head, rows

    def find_shared(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which anchors of each batch several documents hold (at), and which very many batches do (which)."""
        for rows in self.by_part(batches):
            key = np.concatenate([np.frombuffer(r["at"], np.uint32) for r in rows])
            several = np.concatenate([np.unpackbits(np.frombuffer(r["which"], np.uint8), count=r["n"]) for r in rows])
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            group, start = np.cumsum(new) - 1, np.flatnonzero(new)
            times = np.diff(np.append(start, len(key)))
            shared, hot = np.empty(len(key), bool), np.empty(len(key), bool)
            shared[order] = ((times > 1) | (np.maximum.reduceat(several[order], start) > 0))[group]
            hot[order] = (times > self.hot)[group]
            at = 0
            for r in rows:
                own = slice(at, at + r["n"])
                at += r["n"]
                if shared[own].any():
                    yield _row(part=r["part"], batch=r["batch"], sum=r["sum"], n=r["n"], at=np.packbits(shared[own]).tobytes(), which=np.packbits(hot[own]).tobytes() if hot[own].any() else None)

    def ask(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in self.by_batch(batches):
            if rows:
                batch = _open_head(head["head"])
                data, offsets = text_bytes(batch.column(self.text_at))
                place, first, last, doc = anchors(data, offsets, self.length)
                key, back = np.unique(self.keys(data, place), return_inverse=True)
                shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
                for r in rows:
                    i = np.searchsorted(key, r["part"] << 32)
                    shared[i : i + r["n"]] = np.unpackbits(np.frombuffer(r["at"], np.uint8), count=r["n"])
                    if r["which"]:
                        hot[i : i + r["n"]] = np.unpackbits(np.frombuffer(r["which"], np.uint8), count=r["n"])
                own = np.flatnonzero(shared[back])
                yield from self.deal(head["batch"], head["sum"], data, place[own], first[own], last[own], self.ids(batch)[doc[own]], key[back[own]] >> 32, hot[back[own]])

    def deal_all(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of all anchors, for a stored family."""
        for number, batch, data, offsets, total in self.pieces(batches):
            place, first, last, doc = anchors(data, offsets, self.length)
            yield from self.deal(number, total, data, place, first, last, self.ids(batch)[doc], self.keys(data, place) >> 32, np.zeros(len(place), bool))

    def deal(self, number: int, total: int, data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, part: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each range with the strings of a batch, and one with the spans that smaller documents of the batch remove."""
        if hot.any():  # window by window, by the whole window's hash
            at = np.flatnonzero(hot)
            times = last[at] - first[at] + 1
            t = np.repeat(first[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            h, word = np.zeros(len(t), np.uint64), _words(data)
            for k in (*range(0, self.length - 7, 8), self.length - 8):
                h = mix64(h + word[t + k])
            cool = ~hot
            join = lambda x, y: np.concatenate([x[cool], y])
            place, ids, part = join(place, np.repeat(place[at], times)), join(ids, np.repeat(ids[at], times)), join(part, (h >> np.uint64(64 - self.bits)).astype(np.int64))
            first, last = join(first, t), join(last, t)
        blob, seen = data.tobytes(), {}
        which = np.array([seen.setdefault(blob[f:e], len(seen)) for f, e in zip(first.tolist(), (last + self.length).tolist())], np.int64)
        least = np.full(len(seen), NONE)
        np.minimum.at(least, which, ids)
        gone = ids > least[which]  # folded: a smaller document of this batch has the whole string
        if gone.any():
            yield _row(part=SPANS, batch=number, sum=total, n=int(gone.sum()), at=np.stack([first[gone], last[gone] + self.length], 1).tobytes())
        strings, left = list(seen), np.flatnonzero(~gone)
        left = left[np.lexsort((first[left], part[left]))]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part[left])) + 1, [len(left)]]) if len(left) else [0]
        for i, j in zip(cut[:-1], cut[1:]):
            rows = left[i:j]
            own, at, back = np.unique(which[rows], return_index=True, return_inverse=True)
            one = rows[at]  # an entry of each distinct string
            places = np.stack([place[one] - first[one], last[one] - first[one]]).astype(np.int32)
            yield _row(part=int(part[rows[0]]), batch=number, sum=total, n=len(rows), at=_pack(first[rows]), which=_squeeze(back.astype(np.uint32).tobytes()), ids=_squeeze(ids[one].tobytes()), place=_squeeze(places.tobytes()), strings=_squeeze(b"".join([strings[k] for k in own.tolist()])))

    @staticmethod
    def opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(most, more, ids, bytes) of a row's distinct strings."""
        most, more = np.frombuffer(_open(r["place"]), np.int32).reshape(2, -1).astype(np.int64)
        return most, more, np.frombuffer(_open(r["ids"]), np.int64), _open(r["strings"])

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed windows of each batch. Rows of batches below 0 are stored levels, and then the new level comes out too."""
        for rows in self.by_part(batches):
            if isinstance(rows, dict):
                yield _row(**rows)
                continue
            older = [self.load(r) for r in rows if r["batch"] < 0]
            rows = [r for r in rows if r["batch"] >= 0]
            if not rows:
                continue
            of = [self.opened(r) for r in rows]
            most, more, ids = (np.concatenate([x[k] for x in of]) for k in range(3))
            data = np.frombuffer(b"".join(x[3] for x in of), np.uint8)
            gone = find_windows(data, most, more, ids, self.length, LevelFamily(older), self.level)
            at = 0
            for r, x in zip(rows, of):
                own, mine = gone[at : at + len(x[0])], slice(at, at + len(x[0]))
                at += len(x[0])
                string, place = np.nonzero(own)
                if not len(string):
                    continue
                # windows of every entry of each string
                back = np.frombuffer(_open(r["which"]), np.uint32).astype(np.int64)
                first, times = _unpack(r["at"], r["n"]), np.bincount(string, minlength=len(own))
                begin = np.concatenate([[0], np.cumsum(times)])
                n = times[back]
                t = np.repeat(begin[back] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                windows = np.sort(np.repeat(first, n) + most[mine][np.repeat(back, n)] - place[t])
                yield _row(part=r["part"], batch=r["batch"], sum=r["sum"], n=len(windows), at=_pack(windows))

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_at, kept, length = self.text_at, self.kept, self.length
        for head, rows in self.by_batch(batches):
            batch = _open_head(head["head"])
            data, offsets = text_bytes(batch.column(text_at))
            change = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
            for r in rows:
                if r["part"] == SPANS:
                    spans = np.frombuffer(r["at"], np.int64).reshape(-1, 2)
                    np.add.at(change, spans[:, 0], 1), np.add.at(change, spans[:, 1], -1)
                    continue
                t = _unpack(r["at"], r["n"])
                np.add.at(change, t, 1), np.add.at(change, t + length, -1)
            gone = np.cumsum(change[:-1], out=change[:-1]) > 0
            left = data[~gone].tobytes()
            change[0] = 0
            np.cumsum(~gone, dtype=change.dtype, out=change[1:])  # now the bytes kept before each place
            kept_at = change[offsets].astype(np.int64)
            del change
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            inner = offsets[(offsets < len(data))]
            start[inner] = gone[inner]  # runs don't cross documents
            stop = gone.copy()
            stop[:-1] &= ~gone[1:] | start[1:]
            b, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
            span_at = np.searchsorted(b, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(span_at))
            pairs = np.stack([b - offsets[doc], e - offsets[doc]], 1).astype(np.int64)
            inner_list = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(pairs) + 1, 2, dtype=np.int32)), pa.array(pairs.ravel()))
            texts = [left[i:j] for i, j in zip(kept_at[:-1], kept_at[1:])]
            size = np.diff(offsets)
            cols = [pa.array(size), pa.array(size - np.diff(kept_at)), pa.array(np.diff(span_at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), inner_list), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            if kept == "bytes":
                cols.append(pa.array(texts, pa.binary()))
            elif kept == "text":
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string(), mask=np.asarray(batch.column(text_at).is_null())))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != text_at), *cols], self.names)


    # stored levels

    @staticmethod
    def load(r: dict) -> SuffixArray:
        most, more, ids, data = _Job.opened(r)
        length = (len(data) - int(more.sum())) // max(1, len(most))
        return SuffixArray.build(np.frombuffer(data, np.uint8), most, more, np.full(len(ids), EARLIER), length)[0]

    def save(self, part: int, array: SuffixArray) -> pa.RecordBatch:
        """A row with the array's strings in their order."""
        more, strings = array.most - array.least, []
        for ahead, behind, most, least in zip(array.ahead, array.behind, array.most.tolist(), array.least.tolist()):
            strings.append(behind[:most][::-1].tobytes() + ahead[: self.length - least].tobytes())
        return _row(part=part, batch=-1, n=len(array), ids=_squeeze(array.ids.tobytes()), place=_squeeze(np.stack([array.most, more]).astype(np.int32).tobytes()), strings=_squeeze(b"".join(strings)))

    def new_level(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One array for each range of the strings of all batches."""
        for rows in self.by_part(batches):
            if isinstance(rows, list):
                of = [self.opened(r) for r in rows]
                distinct: dict[bytes, tuple[int, int]] = {}
                for most, more, _, data in of:
                    at = 0
                    for m, k in zip(most.tolist(), more.tolist()):
                        distinct[data[at : at + k + self.length]] = (m, k)
                        at += k + self.length
                places = np.array(list(distinct.values()), np.int64).T
                array, _ = SuffixArray.build(np.frombuffer(b"".join(distinct), np.uint8), *places, np.full(len(distinct), EARLIER), self.length)
                yield self.save(rows[0]["part"], array)


ADDED = (T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()))


def _prepare(docs: DataFrame, length: int, id_col: str, text_col: str, kept: str | None, bits: int, hot: int, level: int) -> tuple[DataFrame, _Job, T.StructType]:
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    bounded_batches(docs.sparkSession)
    added = [*ADDED[:5], *({"bytes": ADDED[5:6], "text": ADDED[6:7]}.get(kept, ()))]
    docs = docs.select(*[c for c in docs.columns if c == text_col or c == id_col or c not in {f.name for f in ADDED}])
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *added])
    return docs, _Job(length, bits, docs.columns.index(id_col), docs.columns.index(text_col), kept, schema.fieldNames(), hot, level), schema


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    spread = F.when(F.col("part") == SPANS, F.col("batch")).otherwise(-1)  # spans go evenly to all tasks
    return rows.repartition(n, "part", spread).sortWithinPartitions("part", "batch")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", kept: str | None = "bytes", bits: int | None = None, hot: int = HOT, level: int = LEVEL) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans ([first, end) bytes) and kept_sha256, and with what is left.

    kept: "bytes" adds kept (binary), "text" adds kept_text (null for a null text; characters that a removal cut in two are
    left out), None neither. The text column is dropped. bits: 2**bits ranges (None: by the input's size).
    """
    if bits is None:
        bits = min(22, max(6, ((input_bytes(docs) or 1) >> 21).bit_length()))
    docs, job, schema = _prepare(docs, length, id_col, text_col, kept, max(1, bits), hot, level)
    n_tasks = tasks_for(docs.sparkSession, 1 << job.bits)
    heads = docs.mapInArrow(lean(job.heads), ROW)
    batches = lambda rows: rows.repartition(n_tasks, "batch").sortWithinPartitions("batch", "part")
    shared = _dealt(docs.mapInArrow(lean(job.scatter), ROW), n_tasks).mapInArrow(lean(job.find_shared), ROW)
    asked = batches(heads.unionByName(shared)).mapInArrow(lean(job.ask), ROW)
    found = _dealt(asked, n_tasks).mapInArrow(lean(job.find), ROW)
    # the scan makes the same batches again, which costs less than to carry them through a shuffle by range
    return batches(heads.unionByName(found)).mapInArrow(lean(job.finish), schema)


class StoredFamily:
    """The levels of all ranges as tables below a shared folder, for documents that come batch by batch.

    Strings of documents that came earlier count as those of smaller ids. A batch that is added becomes a level; levels merge while the older
    one isn't more than twice as large. The list of live levels is written last, so a failed call leaves the family as it was.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 50, bits: int = 6) -> None:
        self.spark, self.path, self.length, self.bits = spark, path.rstrip("/"), length, bits
        self.generation, self.levels = 0, []
        jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            names = sorted(f.getPath().getName() for f in fs.listStatus(at))
            done = [n for n in names if n.startswith("list-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
            if done:
                self.generation = int(done[-1][5:])
                self.levels = [tuple(r) for r in spark.read.parquet(f"{self.path}/{done[-1]}").orderBy(F.desc("strings")).collect()]

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str | None = "bytes") -> DataFrame:
        """What ``remove_repeats`` gives, against all documents so far; their strings then belong to the family."""
        spark = self.spark
        docs, job, schema = _prepare(docs, self.length, id_col, text_col, kept, self.bits, HOT, LEVEL)
        n_tasks = tasks_for(spark, 1 << job.bits)
        dealt = stage(docs.mapInArrow(lean(job.deal_all), ROW), "strings")
        older = self._read([n for n, _ in self.levels])
        found = _dealt(dealt if older is None else dealt.unionByName(older), n_tasks).mapInArrow(lean(job.find), ROW)
        both = docs.mapInArrow(lean(job.heads), ROW).unionByName(found)
        out = stage(both.repartition(n_tasks, "batch").sortWithinPartitions("batch", "part").mapInArrow(lean(job.finish), schema), "kept")
        self.generation += 1
        mine, merged = dealt.where(F.col("part") != SPANS), []
        levels = list(self.levels)
        n = mine.agg(F.sum("n")).first()[0] or 0
        while levels and levels[-1][1] <= 2 * n:
            merged.append(levels.pop())
            n += merged[-1][1]
        if merged:
            mine = mine.unionByName(self._read([name for name, _ in merged]))
        name = f"level-{self.generation:06d}"
        _dealt(mine, n_tasks).mapInArrow(lean(job.new_level), ROW).write.parquet(f"{self.path}/{name}")
        n = self._read([name]).agg(F.sum("n")).first()[0] or 0
        self.levels = [*levels, (name, n)]
        spark.createDataFrame(self.levels, "name string, strings long").coalesce(1).write.parquet(f"{self.path}/list-{self.generation:06d}")
        for old, _ in merged:
            drop_path(spark, f"{self.path}/{old}")
        return out
