"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives bytes and ranks; a byte-level model of the tokenizers library is made from it: each byte is written as one
character (the library's own alphabet), and each token's merge is the last pair that merging its own bytes by rank comes to. A
token that is a whole match of the pattern is taken as it is. So ids are those of merging by ranks.

A text is cut into units before each ASCII white space that follows another character. No match of the pattern crosses such a
cut, and none looks back over it, so units are encoded on their own. The distinct new units of a slice are joined again
where a cut is safe, go through the library together, and get their ids back by byte offsets. Units that recur are kept up to a bound.

Decoding reverses the byte table: the tokens' bytes are joined first and read as UTF-8 afterwards, so characters that were
split between tokens come back whole. Incomplete characters of cut lists of ids become U+FFFD; ``decoded_bytes`` has the bytes.

Character offsets: a token that holds a part of a character spans that whole character.

Defined results: a null text has null results, an empty one empty lists; repeated rows are each encoded. Texts of any length are
encoded whole; a unit of more than UNIT bytes is cut at further places that no match crosses, where it has them. Empty tables
give empty results. Lists of ids that hold a null or an unknown id are decoded to null. Result columns replace input columns of
the same name.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, chunks, lean, parted, text_bytes

#: Bytes of text that go through the library at once, and from which a single unit is cut further.
UNIT = 64 << 10
#: Bytes of units that a worker keeps, with what Python adds to each.
KEPT_BYTES, UNIT_BYTES = 24 << 20, 150
#: Text bytes of a slice.
SLICE = 4 << 20

#: ASCII white space, and the last bytes of other white space characters behind their lead bytes (fixed values of Unicode).
_ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_JOINT = frozenset(b"\t\n\v\f\r ")
_SPACE_2 = [0xC285, 0xC2A0]
_SPACE_3 = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
#: Letters and digits that every Unicode version knows as such, before punctuation: no match of the pattern goes on there.
_LONG_CUT = re.compile("[0-9A-Za-zа-яぁ-ゖァ-ヺ一-龥가-힣](?=[!-/:-@、。！，：？])")

RESULTS = {
    "n_tokens": T.LongType(),
    "token_ids": T.ArrayType(T.IntegerType()),
    "token_data": T.BinaryType(),
    "char_starts": T.ArrayType(T.IntegerType()),
    "char_ends": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "decoded_bytes": T.BinaryType(),
}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read in the driver; tasks get what is made from them with the query."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, U+0100 and on for the others in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts from which merging the token's bytes by rank makes it, or None if it stops before."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts)


@functools.lru_cache(2)
def library_model(data: bytes, pattern: str) -> str:
    """The tokenizers library's description of the model, made once in the driver (about 3 MB for 50,000 ranks)."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = ranks_of(data), alphabet()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    pairs = (last_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
    merges = [(shown[a], shown[b]) for a, b in filter(None, pairs)]
    t = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return t.to_str()


class Surface:
    """The bytes of each id, by the reversed byte table."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        back = {c: b for b, c in enumerate(alphabet())}
        n = max(vocabulary.values(), default=-1) + 1
        tokens: list[bytes | None] = [None] * n
        for shown, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in shown)
        self.known = np.array([t is not None for t in tokens], bool)
        self.flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.size = np.array([len(t or b"") for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lists' bytes in one array, and offsets."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])], at[offsets]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: each non-empty row, and each ASCII white space behind a character that is none."""
    n = len(data)
    at = np.flatnonzero(_ASCII_SPACE[data])
    at = at[at > 0]
    before = data[at - 1]
    at, before = at[~_ASCII_SPACE[before]], before[~_ASCII_SPACE[before]]
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        p = at[wide]
        two = (data[np.maximum(p - 2, 0)].astype(np.int64) << 8) | data[p - 1]
        three = (data[np.maximum(p - 3, 0)].astype(np.int64) << 16) | two
        at = np.delete(at, wide[np.isin(two, _SPACE_2) | np.isin(three, _SPACE_3)])
    begins = np.zeros(n, bool)
    begins[at] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Encoder:
    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.surface = Surface(self.tokenizer.get_vocab(with_added_tokens=False))
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.used = 0
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def learn(self, new: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the new units, their ids in that order in one array, and how many each has."""
        join, alone, texts = [], [], []
        for k, w in enumerate(new):
            texts.append(t := w.decode("utf-8", "replace"))
            # a unit from white space to none can stand behind another such unit
            (join if w[0] in _JOINT and not t[-1].isspace() and len(w) < UNIT else alone).append(k)
        flat, sizes, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(np.array([len(texts[k].encode()) for k in join], np.int64))
        for i, j in chunks(np.diff(ends, prepend=0), UNIT):
            ids = self.library("".join([texts[k] for k in join[i:j]]))
            cuts = np.searchsorted(np.cumsum(self.surface.size[ids]), ends[i:j] - (ends[i - 1] if i else 0)) + 1
            flat.append(ids), sizes.append(np.diff(cuts, prepend=0))
        for k in alone:
            ids = np.concatenate([self.library(t) for t in _cut_long(texts[k])])
            flat.append(ids), sizes.append(np.array([len(ids)]))
        return join + alone, np.concatenate(flat), np.concatenate(sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (rows of UTF-8 bytes) in one array, and offsets."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.used > KEPT_BYTES:
            self.reset()
        start = unit_starts(data, offsets)
        ends = np.concatenate([start, [len(data)]]).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        index, distinct = units.indices.to_numpy(), units.dictionary.to_pylist()
        codes = np.fromiter((self.code.get(w, -1) for w in distinct), np.int64, len(distinct))
        fresh = np.flatnonzero(codes < 0)
        order, flat, size = self.learn([distinct[k] for k in fresh])
        fresh = fresh[order]
        codes[fresh] = len(self.size) + np.arange(len(fresh))
        all_flat, all_size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        begin = np.cumsum(all_size) - all_size
        own = codes[index]
        n = all_size[own]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = all_flat[np.repeat(begin[own] - at[:-1], n) + np.arange(at[-1])]
        # units that came once are mostly never seen again
        stays = np.bincount(index, minlength=len(distinct))[fresh] > 1
        kept = [distinct[k] for k in fresh[stays]]
        self.code.update(zip(kept, range(len(self.size), len(self.size) + len(kept))))
        self.used += sum(map(len, kept)) + (UNIT_BYTES + 8) * len(kept)
        self.flat, self.size = np.concatenate([self.flat, flat[np.repeat(stays, size)]]), np.concatenate([self.size, size[stays]])
        return ids, at[np.searchsorted(start, offsets)]


def _cut_long(text: str) -> Iterator[str]:
    """The text in parts of about UNIT characters, cut where no match of the pattern goes on, if there are such places."""
    i = 0
    while len(text) - i > UNIT:
        m = _LONG_CUT.search(text, i + UNIT)
        if m is None:
            break
        yield text[i : m.end()]
        i = m.end()
    yield text[i:]


def char_spans(ids: np.ndarray, token_at: np.ndarray, data: np.ndarray, offsets: np.ndarray, surface: Surface) -> tuple[np.ndarray, np.ndarray]:
    """For each token the first character that it has a byte of, and the one behind its last, counted from its text's start."""
    size = surface.size[ids]
    end = np.cumsum(size)
    chars = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(token_at))
    before = np.concatenate([[0], chars])[offsets[:-1]][row]
    return (chars[end - size] - 1 - before).astype(np.int32), (chars[end - 1] - before).astype(np.int32)


def _lists(values: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(gone))


def _bytes(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, kind: pa.DataType) -> pa.Array:
    valid = None if not gone.any() else pa.array(~gone).buffers()[1]
    return pa.Array.from_buffers(kind, len(gone), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", results: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """docs with the wanted results: n_tokens; token_ids; token_data (ids as little-endian unsigned 32-bit integers, as token files
    hold them); char_starts and char_ends; decoded and decoded_bytes (from the ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*[c for c in docs.columns if c not in results])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(r, RESULTS[r]) for r in results)])
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast(library_model(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(held.value)
        for batch in parted(batches, at, SLICE):
            gone = np.asarray(batch.column(at).is_null())
            data, offsets = text_bytes(batch.column(at))
            ids, cuts = enc.encode(data, offsets)
            made = {"n_tokens": lambda: pa.array(np.diff(cuts), pa.int64(), mask=gone), "token_ids": lambda: _lists(ids, cuts, gone), "token_data": lambda: _bytes(ids.astype("<u4").view(np.uint8), cuts * 4, gone, pa.binary())}
            if {"char_starts", "char_ends"} & set(results):
                spans = char_spans(ids, cuts, data, offsets, enc.surface)
                made |= {name: lambda x=x: _lists(x, cuts, gone) for name, x in zip(("char_starts", "char_ends"), spans)}
            if {"decoded", "decoded_bytes"} & set(results):
                back, ends = enc.surface.join(ids, cuts)
                made |= {"decoded": lambda: _texts(back, ends, gone), "decoded_bytes": lambda: _bytes(back, ends, gone, pa.binary())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[r]() for r in results)], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)


def _texts(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([None if g else raw[i:j].decode("utf-8", "replace") for i, j, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), gone.tolist())], pa.string())


def decode(tokens: DataFrame, ranks: bytes, pattern: str, ids_col: str = "token_ids", results: tuple[str, ...] = ("decoded",)) -> DataFrame:
    """tokens with decoded and decoded_bytes, as wanted, from ids_col (array<int>)."""
    spark = tokens.sparkSession
    bounded_batches(spark)
    tokens = tokens.select(*[c for c in tokens.columns if c not in results])
    schema = T.StructType([*tokens.schema.fields, *(T.StructField(r, RESULTS[r]) for r in results)])
    at, held = tokens.columns.index(ids_col), spark.sparkContext.broadcast(library_model(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        surface = Surface(Tokenizer.from_str(held.value).get_vocab(with_added_tokens=False))
        for batch in batches:
            col = batch.column(at)
            size = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            offsets, flat = np.concatenate([[0], np.cumsum(size)]), col.flatten()
            ids = np.asarray(flat.fill_null(-1)).astype(np.int64)
            known = (ids >= 0) & (ids < len(surface.known))
            known[known] = surface.known[ids[known]]
            wrong = np.concatenate([[0], np.cumsum(~known)])
            gone = np.asarray(col.is_null()) | (np.diff(wrong[offsets]) > 0)
            back, ends = surface.join(np.where(known, ids, 0), offsets) if len(surface.size) else (np.zeros(0, np.uint8), offsets * 0)
            made = {"decoded": lambda: _texts(back, ends, gone), "decoded_bytes": lambda: _bytes(back, ends, gone, pa.binary())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[r]() for r in results)], schema.fieldNames())

    return tokens.mapInArrow(lean(run), schema)
