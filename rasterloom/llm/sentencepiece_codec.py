"""SentencePiece encoding and decoding with a shared-prefix forward pass.

The distinct marked words (units) of a batch are sorted, which is a depth-first order of their trie. Each prefix has one
forward state, from which all words that share it go on: in numpy, all prefixes of one length at once; states of words longer
than ``SIDE_BY_SIDE`` letters stay on a stack, and the next word goes on from the longest prefix that they share. A state
holds the best score and last piece (unigram), or the one valid last piece (BPE; see piece_model); beside it, the best score of
the vocabulary's unigram reading can be carried. An Aho-Corasick automaton gives the pieces that end at each place.
Each text is then put together from its words' ids with numpy. Words are kept between batches up to a bound.

Decoding joins the pieces' bytes, drops the leading mark that encoding added, and turns each invalid byte into U+FFFD.

Defined results: a null text has null ids and null decoded text; an empty one has none and ''. Result columns replace input
columns of the same name.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, lean, parted
from rasterloom.llm.piece_model import CONTROL, MARK, UNIGRAM, PieceModel
from rasterloom.llm.token_count import SIDE_BY_SIDE, Automaton

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of words that a worker keeps, with what Python adds to each; bits of the number of pairs of pieces that it keeps.
KEPT_BYTES, WORD_BYTES, PAIR_BITS = 16 << 20, 200, 19

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Encoder:
    def __init__(self, model: PieceModel, unigram: PieceModel | None = None) -> None:
        """unigram: the same vocabulary read as a unigram model; its best scores are carried along (``path_score``), in double precision."""
        self.m, self.u = model, unigram
        self.auto = Automaton(model.ids)
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in model.ids if len(p) == 1]] = True
        self.float = np.float64 if model.exact else np.float32
        self.scores = np.array(model.scores, self.float)
        self.u_scores = np.array(unigram.scores, np.float64) if unigram else None
        self.pair_key, self.pair_stays = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.used = 0
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def learn(self, new: list[str]) -> list[str]:
        """Ids of sorted new units; gives the units in the order of their numbers."""
        short, long = [w for w in new if len(w) <= SIDE_BY_SIDE], [w for w in new if len(w) > SIDE_BY_SIDE]
        found = [f(x) for f, x in ((self.side_by_side, short), (self.one_by_one, long)) if x]
        n = len(self.code)
        self.code.update(zip([*short, *long], range(n, n + len(new))))
        for flat, sizes, score in found:
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.score = np.concatenate([self.score, score])
        return [*short, *long]

    def side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, numbers of ids, path scores) of sorted words. All prefixes of one length go a letter on at once; a prefix that several
        words share is one node with one forward state."""
        m, a, u, unigram, n = self.m, self.auto, self.u, self.m.kind == UNIGRAM, len(self.m.scores)
        size = np.array([len(w) for w in words], np.int64)
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        begin = np.cumsum(size) - size
        place = begin + np.arange(len(words))  # a word of k letters has k + 1 nodes
        node = np.zeros(len(char) + len(words), np.int32)  # of each word's prefixes; 0 is the empty one
        most = len(char) + 1
        state, last, back, count = np.zeros(most, np.int32), np.full(most, -1, np.int32), np.zeros(most, np.int32), np.zeros(most, np.int32)
        score, path = np.zeros(most if unigram else 0, self.float), np.zeros(most if u else 0)
        rows, used = np.arange(len(words)), 1
        for e in range(int(size.max(initial=0))):
            rows = rows[size[rows] > e]
            parent, c = node[place[rows] + e], char[begin[rows] + e]
            new = np.ones(len(rows), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
            node[place[rows] + e + 1] = used + np.cumsum(new) - 1
            of, parent, c = place[rows[new]], parent[new], c[new]
            k = len(of)
            own = slice(used, used + k)
            used += k
            state[own] = now = a.walk(state[parent], a.letter[c])
            alone = self.single[c]
            piece, start = np.full(k, -1, np.int32), parent.copy()
            best, top = np.zeros(k, self.float) if unigram else None, np.full(k, -np.inf) if u else None
            at, o = np.arange(k), a.out[now]
            while True:  # pieces that end here, longer ones first
                some = o > 0
                at, o = at[some], o[some]
                if not len(at):
                    break
                s, p = node[of[at] + (e + 1 - a.depth[o])], a.piece[o]
                if u:
                    top[at] = np.maximum(top[at], path[s] + self.u_scores[p])
                if unigram:
                    x = score[s] + self.scores[p]
                    won = (piece[at] < 0) | (x > best[at])
                    best[at[won]] = x[won]
                    piece[at[won]], start[at[won]] = p[won], s[won]
                else:
                    open_ = np.flatnonzero(piece[at] < 0)
                    won = open_[self.stay(last[s[open_]], p[open_])]
                    piece[at[won]], start[at[won]] = p[won], s[won]
                o = a.more[o]
            if unigram:
                x = score[parent] + self.float(m.unk_score)
                lost = ~alone & ((piece < 0) | (x > best))
                best[lost] = x[lost]
                piece[lost], start[lost] = -1, parent[lost]
                score[own] = best
            if u:
                lost = ~alone
                top[lost] = np.maximum(top[lost], path[parent[lost]] + u.unk_score)
                path[own] = top
            no = piece < 0
            width = 1 + (c > 0x7F).astype(np.int32) + (c > 0x7FF) + (c > 0xFFFF) if m.byte_fallback else 1
            last[own], back[own], count[own] = np.where(no, n + c, piece), start, count[start] + np.where(no, width, 1)
        end = node[place + size]
        sizes = count[end].astype(np.int64)
        flat, first = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        at = np.flatnonzero(end)
        end, first = end[at], first[at]
        while len(end):  # from the ends of words to their starts
            x, to = last[end], back[end]
            spot, known = first + count[to], x < n
            flat[spot[known]] = x[known]
            for c in np.unique(x[~known]).tolist():
                same = spot[x == c]
                for i, id_ in enumerate(m.ids_of(chr(c - n), None)):
                    flat[same + i] = id_
            left = to > 0
            end, first = to[left], first[left]
        return flat, sizes, path[node[place + size]] if u else np.zeros(len(words))

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a (-1: the start; from the vocabulary's size on: a character) and b stay as they are side by side."""
        n = len(self.m.scores)
        key = (a.astype(np.int64) + 1) * n + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, miss = self.pair_stays[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            pieces, (distinct, back) = self.m.pieces, np.unique(key[miss], return_inverse=True)
            own = np.fromiter((self.m.stays("" if i < 0 else pieces[i] if i < n else chr(i - n), pieces[j]) for i, j in zip((distinct // n - 1).tolist(), (distinct % n).tolist())), bool, len(distinct))
            out[miss] = own[back]
            # a slot keeps the last of its pairs: key and answer are of the same one
            at = slot[miss]
            self.pair_key[at] = key[miss]
            won = self.pair_key[at] == key[miss]
            self.pair_stays[at[won]] = out[miss][won]
        return out

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """side_by_side for long words, of which few stand beside each other: the forward states of a word's positions stay on a stack."""
        m, a, unigram = self.m, self.auto, self.m.kind == UNIGRAM
        last: list[tuple[int, str, int | None]] = [(0, "", None)]  # per position: start of the last piece, the piece, its id
        score: list[float] = [0.0]
        states = [0]  # per position: the automaton's
        path, own_scores, u = [0.0], [], self.u  # per position: best score of the unigram reading
        u_scores, u_unknown = (u.scores, u.unk_score) if u else ([], 0.0)
        before, flat, sizes = "", [], []
        pair, add, scores = m.pair, m.add, m.scores
        for word in words:
            i, n = 0, min(len(before), len(word))
            while i < n and before[i] == word[i]:
                i += 1
            del last[i + 1 :], score[i + 1 :], states[i + 1 :], path[i + 1 :]  # what the common prefix gave stays
            for i in range(i, len(word)):
                c = word[i]
                state, best, found, top = a.next(states[i], c), None, None, -math.inf
                alone = False
                for size, id_ in a.pieces_at(state):  # longer pieces first
                    s = i + 1 - size
                    alone |= s == i
                    if u and (x := path[s] + u_scores[id_]) > top:
                        top = x
                    if unigram:
                        x = add(score[s], scores[id_])
                        if best is None or x > best:
                            best, found = x, (s, word[s : i + 1], id_)
                    elif found is None and pair(last[s][1], word[s : i + 1]):
                        found = (s, word[s : i + 1], id_)
                if not alone:
                    if unigram:
                        x = add(score[i], m.unk_score)
                        if best is None or x > best:
                            best, found = x, (i, c, None)
                    elif found is None:
                        found = (i, c, None)
                    if u and (x := path[i] + u_unknown) > top:
                        top = x
                last.append(found)
                path.append(top if u else 0.0)
                score.append(best or 0.0)
                states.append(state)
            before = word
            own_scores.append(path[-1])
            at, ids = len(word), []
            while at:
                s, piece, id_ = last[at]
                ids.append(m.ids_of(piece, id_))
                at = s
            own = [x for t in reversed(ids) for x in t]
            flat += own
            sizes.append(len(own))
        return np.array(flat, np.int32), np.array(sizes, np.int64), np.array(own_scores, float)

    def forget(self, known: int, new: list[str], stays: np.ndarray) -> None:
        """Of the words learned last, keep those that came more than once: most others never come again."""
        for w, yes in zip(new, stays.tolist()):
            if not yes:
                del self.code[w]
        own = [w for w, yes in zip(new, stays.tolist()) if yes]
        self.code.update(zip(own, range(known, known + len(own))))
        self.used += sum(map(len, own)) + WORD_BYTES * len(own)
        rows = known + np.flatnonzero(stays)
        size, cut = self.size[rows], int(self.start[known]) if len(self.start) > known else len(self.flat)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[rows] - at[:-1], size) + np.arange(at[-1])]
        self.flat, self.start, self.size = np.concatenate([self.flat[:cut], flat]), np.concatenate([self.start[:known], cut + at[:-1]]), np.concatenate([self.size[:known], size])
        self.score = np.concatenate([self.score[:known], self.score[rows]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and offsets."""
        return self.encode_scored(texts)[:2]

    def encode_scored(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, offsets, and scores of the unigram reading's best paths (words' scores added up)."""
        if self.used > KEPT_BYTES:
            self.reset()
        units, ends = [], [0]
        for t in texts:
            if t:
                units += self.m.units(self.m.normalise(t))
            ends.append(len(units))
        known, new = len(self.code), sorted(set(units) - self.code.keys())
        new = self.learn(new)
        codes = np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))
        size = self.size[codes]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[codes] - at[:-1], size) + np.arange(at[-1])]
        offsets = at[np.array(ends)]
        if not self.m.byte_fallback:  # unknown characters side by side are one piece
            row = np.repeat(np.arange(len(texts)), np.diff(offsets))
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.m.unk) | (ids[:-1] != self.m.unk) | (row[1:] != row[:-1])
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            ids = ids[keep]
        total = np.concatenate([[0.0], np.cumsum(self.score[codes])])[np.array(ends)]
        self.forget(known, new, np.bincount(codes, minlength=len(self.size))[known:] > 1)
        return ids, offsets, np.diff(total)


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        self.flat = np.frombuffer(b"".join(model.surface), np.uint8)
        self.size = np.array([len(x) for x in model.surface], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.marked = np.array([p.startswith(MARK) for p in model.pieces]) & np.array(model.dummy_prefix or model.strip_extra)
        self.control = np.array(model.types) == CONTROL

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        begin, end = at[offsets[:-1]], at[offsets[1:]]
        out = []
        for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            i, j = offsets[k], offsets[k + 1]
            while i < j and self.control[ids[i]]:
                i += 1
            b += int(i < j and bool(self.marked[ids[i]]))
            cuts = [b, e]
            if self.control[ids[i:j]].any():  # control pieces part runs of bytes
                cuts = [b, *(at[i + np.flatnonzero(self.control[ids[i:j]])]).tolist(), e]
            out.append("".join(data[x:y].decode("utf-8", "each_byte") for x, y in zip(cuts, cuts[1:])))
        return out


def read_model(path: str) -> bytes:
    """The model's bytes, read in the driver; tasks get them with the query."""
    with open(path, "rb") as f:
        return f.read()


ADDED = (T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("path_score", T.DoubleType()))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", kind: int | None = None, decoded: bool = False, scored: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """slice_bytes: text that a worker takes at once; less takes less memory and more time.

    docs with token_ids; with the text decoded from them again and with path_score, the score of the best path of the
    vocabulary read as a unigram model (in double precision), if asked."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = [ADDED[0], *ADDED[1:2] * decoded, *ADDED[2:] * scored]
    docs = docs.select(*[c for c in docs.columns if c not in {f.name for f in added}])
    schema = T.StructType([*docs.schema.fields, *added])
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's models go with it: workers outlive tasks, and what they keep adds up
        m = PieceModel(held.value, kind)
        enc, dec = Encoder(m, PieceModel(held.value, UNIGRAM, double=True) if scored else None), Decoder(m)
        for batch in parted(batches, at, slice_bytes):
            col = batch.column(at)
            ids, offsets, score = enc.encode_scored(col.to_pylist())
            gone = np.asarray(col.is_null())
            more = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(gone))]
            if decoded:
                more.append(pa.array(dec.decode(ids, offsets), pa.string(), mask=gone))
            if scored:
                more.append(pa.array(score, pa.float64(), mask=gone))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, model: bytes, ids_col: str = "token_ids") -> DataFrame:
    """tokens with the text ``decoded`` from ids_col (array<int>)."""
    spark = tokens.sparkSession
    bounded_batches(spark)
    tokens = tokens.select(*[c for c in tokens.columns if c != "decoded"])
    schema = T.StructType([*tokens.schema.fields, ADDED[1]])
    at, held = tokens.columns.index(ids_col), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(PieceModel(held.value))
        for batch in batches:
            col = batch.column(at)
            size = np.array([len(x) if x is not None else 0 for x in col.to_pylist()], np.int64)
            text = dec.decode(col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string(), mask=np.asarray(col.is_null()))], schema.fieldNames())

    return tokens.mapInArrow(lean(run), schema)
