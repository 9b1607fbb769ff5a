"""Token counts without tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each position of a word, longest first;
the forward pass carries the best score and the number of pieces (unigram: strictly better scores win, so the earliest
start wins ties; BPE: the one valid last piece, see piece_model). Unknown characters count as their bytes under byte
fallback, or once for each run without it.

The distinct words (units) of a batch go through the automaton side by side: a step takes one character of each, in numpy.
Words longer than ``SIDE_BY_SIDE`` characters, of which few stand beside each other, go one by one by the same rules. Counts of
words that come more than once in a batch are kept for the next ones, up to a bound in bytes.

Defined results: a null text has a null count and score, an empty one 0 and 0.0. Result columns replace input columns of
their names. Repeated rows are counted each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, lean, parted
from rasterloom.llm.piece_model import UNIGRAM, PieceModel

#: Bytes of words that a worker keeps (with what Python adds to each), and longest word that is counted beside others.
KEPT_BYTES, WORD_BYTES, SIDE_BY_SIDE = 16 << 20, 200, 96
#: Pairs of pieces that a worker keeps.
KEPT_PAIRS = 1 << 18
_CHARS = 0x110000


class EdgeTable:
    """Edges (state, letter) -> state in an open hash table that is probed for whole arrays."""

    def __init__(self, key: np.ndarray, to: np.ndarray) -> None:
        self.bits = max(4, int(len(key) * 3).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            s = slot[left]
            free = self.key[s] < 0
            self.key[s[free]] = key[left[free]]  # of several keys for one slot, one wins
            won = self.key[s] == key[left]
            self.to[s[won]] = to[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The state at the end of each edge, or -1."""
        slot = self._slot(key)
        got = self.key[slot]
        out = np.where(got == key, self.to[slot], -1)
        left = np.flatnonzero((got != key) & (got >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.key[slot[left]]
            hit = got == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out


class Automaton:
    """Aho-Corasick over the vocabulary. ``out`` is the nearest state that ends a piece on the way of failures, ``more`` the next."""

    def __init__(self, pieces: dict[str, int]) -> None:
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.full(_CHARS, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.n_letters = max(1, len(letters))
        step: list[dict[str, int]] = [{}]
        piece, depth = [-1], [0]
        for p, i in pieces.items():
            s = 0
            for c in p:
                t = step[s].get(c)
                if t is None:
                    t = step[s][c] = len(step)
                    step.append({}), piece.append(-1), depth.append(depth[s] + 1)
                s = t
            piece[s] = i
        fail, out, more = [0] * len(step), [0] * len(step), [0] * len(step)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            for c, t in step[s].items():
                if s:
                    f = fail[s]
                    while f and c not in step[f]:
                        f = fail[f]
                    fail[t] = step[f].get(c, 0)
                more[t] = out[fail[t]]
                out[t] = t if piece[t] >= 0 else more[t]
                queue.append(t)
        self.step, self.fail, self.out, self.more = step, np.array(fail, np.int32), np.array(out, np.int32), np.array(more, np.int32)
        self.piece, self.depth = np.array(piece, np.int32), np.array(depth, np.int32)
        edges = [(s * self.n_letters + int(self.letter[ord(c)]), t) for s, of in enumerate(step) for c, t in of.items()]
        self.edges = EdgeTable(np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32))

    def walk(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one more letter each."""
        state, out = state.copy(), np.zeros(len(state), np.int32)
        left = np.flatnonzero(letter >= 0)
        while len(left):
            s = state[left]
            to = self.edges.find(s.astype(np.int64) * self.n_letters + letter[left])
            out[left] = np.maximum(to, 0)
            left = left[(to < 0) & (s > 0)]
            state[left] = self.fail[state[left]]
        return out

    def ends(self, word: str) -> Iterator[list[tuple[int, int]]]:
        """For each position of a word the (length, id) of the pieces that end there, longest first."""
        s = 0
        for c in word:
            s = self.next(s, c)
            yield self.pieces_at(s)

    def next(self, s: int, c: str) -> int:
        """The state after one more letter."""
        while s and c not in self.step[s]:
            s = int(self.fail[s])
        return self.step[s].get(c, 0)

    def pieces_at(self, s: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that end at a state, longest first."""
        found, o = [], int(self.out[s])
        while o:
            found.append((int(self.depth[o]), int(self.piece[o])))
            o = int(self.more[o])
        return found


class Rules:
    """The forward pass of one segmentation over words side by side."""

    def __init__(self, model: PieceModel) -> None:
        self.m, self.unigram = model, model.kind == UNIGRAM
        self.float = np.float64 if model.exact else np.float32
        self.scores = np.array(model.scores, self.float)
        self.pairs: dict[int, bool] = {}

    def begin(self, size: int, words: np.ndarray) -> None:
        """size: places of all words together; words: those of their starts."""
        self.score = np.zeros(size, self.float)
        self.count, self.first, self.unknown = np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, bool)
        self.last = np.full(size, -1, np.int32)  # a piece, or len(scores) + character for an unknown one
        self.start = words

    def step(self, at: np.ndarray, matches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], char: np.ndarray, alone: np.ndarray, width: np.ndarray) -> None:
        """Places ``at`` are followed by ``char``; matches: (rows, places where pieces begin, pieces), longest pieces first."""
        k = len(at)
        found, begin, piece = np.zeros(k, bool), at.copy(), np.full(k, -1, np.int32)
        best = np.zeros(k, self.float)
        for rows, s, p in matches:
            if self.unigram:
                x = self.score[s] + self.scores[p]
                won = ~found[rows] | (x > best[rows])
                best[rows[won]] = x[won]
            else:
                open_ = np.flatnonzero(~found[rows])
                rows, s, p = rows[open_], s[open_], p[open_]
                won = self.stay(self.last[s], p)
            rows = rows[won]
            found[rows], begin[rows], piece[rows] = True, s[won], p[won]
        if self.unigram:
            x = self.score[at] + self.float(self.m.unk_score)
            lost = ~alone & (~found | (x > best))
            best[lost] = x[lost]
        else:
            lost = ~alone & ~found
        begin[lost], piece[lost] = at[lost], -1
        no = piece < 0
        to = at + 1
        self.score[to], self.last[to], self.unknown[to] = best, np.where(no, len(self.scores) + char, piece), no
        self.first[to] = np.where(begin == self.start[:k], no, self.first[begin])
        self.count[to] = self.count[begin] + np.where(no, width if self.m.byte_fallback else ~self.unknown[begin], 1)

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay as they are side by side."""
        n = len(self.scores)
        key = (a.astype(np.int64) + 1) * n + b
        distinct, back = np.unique(key, return_inverse=True)
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        pieces, pairs, out = self.m.pieces, self.pairs, []
        for x in distinct.tolist():
            known = pairs.get(x)
            if known is None:
                i, j = divmod(x, n)
                i -= 1
                known = pairs[x] = self.m.stays("" if i < 0 else pieces[i] if i < n else chr(i - n), pieces[j])
            out.append(known)
        return np.array(out, bool)[back]


class Counter:
    """Counts by several segmentations of one vocabulary; the automaton is walked once for all of them."""

    def __init__(self, models: list[PieceModel]) -> None:
        self.models, self.m = models, models[0]
        self.auto, self.rules = Automaton(self.m.ids), [Rules(m) for m in models]
        self.single = np.zeros(_CHARS, bool)
        self.single[[ord(p) for p in self.m.ids if len(p) == 1]] = True
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.used = 0
        none = lambda kind: [np.zeros(0, kind) for _ in self.models]
        self.count, self.first, self.last, self.score = none(np.int32), none(bool), none(bool), none(np.float64)

    def unit(self, word: str, m: PieceModel) -> tuple[int, bool, bool, float]:
        """(pieces, begins with an unknown character, ends with one, score) of one word."""
        unigram, scores, add = m.kind == UNIGRAM, m.scores, m.add
        n = len(word)
        score, count, unknown, first, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1), [""] * (n + 1)
        for e, matches in enumerate(self.auto.ends(word)):
            best, start, id_ = None, -1, None
            for size, i in matches:  # longest first
                s = e + 1 - size
                if unigram:
                    x = add(score[s], scores[i])
                    if best is None or x > best:
                        best, start, id_ = x, s, i
                elif m.pair(last[s], word[s : e + 1]):
                    start, id_ = s, i
                    break
            if not self.single[ord(word[e])]:
                if unigram:
                    x = add(score[e], m.unk_score)
                    if best is None or x > best:
                        best, start, id_ = x, e, None
                elif start < 0:
                    start = e
            k = e + 1
            score[k], last[k], unknown[k] = best or 0.0, word[start:k], id_ is None
            first[k] = unknown[k] if start == 0 else first[start]
            more = 1 if id_ is not None else len(word[e].encode()) if m.byte_fallback else int(not unknown[start])
            count[k] = count[start] + more
        return count[n], first[n], unknown[n], score[n]

    def side_by_side(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(pieces, begins, ends, score) of all words by each segmentation; the longest word comes first."""
        size = np.array([len(w) for w in words], np.int64)
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        width = 1 + (char > 0x7F).astype(np.int32) + (char > 0x7FF) + (char > 0xFFFF)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = begin + np.arange(len(words))  # a word of n letters has n + 1 places
        for r in self.rules:
            r.begin(len(char) + len(words), place)
        a = self.auto
        state = np.zeros(len(words), np.int32)
        for e in range(int(size[0])):
            k = int(np.searchsorted(-size, -e, "left"))  # words that have a letter more
            at = place[:k] + e
            c = char[begin[:k] + e]
            state = a.walk(state[:k], a.letter[c])
            matches, rows, o = [], np.arange(k), a.out[state]
            while True:
                some = o > 0
                rows, o = rows[some], o[some]
                if not len(rows):
                    break
                matches.append((rows, at[rows] + 1 - a.depth[o], a.piece[o]))
                o = a.more[o]
            for r in self.rules:
                r.step(at, matches, c, self.single[c], width[begin[:k] + e])
        end = place + size
        return [(r.count[end], r.first[end], r.unknown[end], r.score[end].astype(np.float64)) for r in self.rules]

    def learn(self, new: list[str]) -> list[str]:
        """Count new words; gives them in the order of their numbers."""
        short, long = [w for w in new if len(w) <= SIDE_BY_SIDE], [w for w in new if len(w) > SIDE_BY_SIDE]
        short.sort(key=len, reverse=True)
        found = self.side_by_side(short) if short else [()] * len(self.models)
        held = (self.count, self.first, self.last, self.score)
        for i, m in enumerate(self.models):
            alone = list(zip(*(self.unit(w, m) for w in long))) or [()] * 4
            for k, (of, x) in enumerate(zip(held, alone)):
                kind = of[i].dtype
                of[i] = np.concatenate([of[i], *([found[i][k].astype(kind)] if short else []), np.array(x, kind)])
        self.code.update(zip([*short, *long], range(len(self.code), len(self.code) + len(new))))
        return [*short, *long]

    def forget(self, known: int, new: list[str], stays: np.ndarray) -> None:
        """Of the words learned last, keep those that came more than once: most others never come again."""
        for w, yes in zip(new, stays.tolist()):
            if not yes:
                del self.code[w]
        own = [w for w, yes in zip(new, stays.tolist()) if yes]
        self.code.update(zip(own, range(known, known + len(own))))
        self.used += sum(map(len, own)) + WORD_BYTES * len(own)
        rows = np.concatenate([np.arange(known), known + np.flatnonzero(stays)])
        for of in (self.count, self.first, self.last, self.score):
            of[:] = [x[rows] for x in of]

    def count_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tokens, score) of all texts by each segmentation."""
        if self.used > KEPT_BYTES:
            self.reset()
        units, ends = [], [0]
        for t in texts:
            if t:
                units += self.m.units(self.m.normalise(t))
            ends.append(len(units))
        known = len(self.code)
        new = self.learn(list(set(units) - self.code.keys()))
        codes = np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))
        at = np.array(ends)
        out = []
        for i, m in enumerate(self.models):
            n = self.count[i][codes].astype(np.int64)
            if not m.byte_fallback and len(n):  # an unknown run that goes on from word to word is one piece
                joined = self.last[i][codes[:-1]] & self.first[i][codes[1:]]
                inner = np.zeros(len(n) + 1, bool)
                inner[at] = True
                n[1:] -= joined & ~inner[1:-1]
            total = np.concatenate([[0], np.cumsum(n)])
            score = np.concatenate([[0.0], np.cumsum(self.score[i][codes])])
            out.append((total[at[1:]] - total[at[:-1]], score[at[1:]] - score[at[:-1]]))
        self.forget(known, new, np.bincount(codes, minlength=len(self.code))[known:] > 1)
        return out


def count_tokens(docs: DataFrame, model: bytes, out: str = "n_tokens", kinds: dict[str, int | None] | None = None, text_col: str = "text", scores: dict[str, str] | None = None, double: bool = False) -> DataFrame:
    """docs with token counts. kinds: result columns and the segmentation that each follows (None: the model's own).

    scores: further result columns with the best path's score of a text, each by the name of its count's column. double: scores add up in
    double precision instead of the library's single one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds, scores = kinds or {out: None}, scores or {}
    docs = docs.select(*[c for c in docs.columns if c not in kinds and c not in scores])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in kinds), *(T.StructField(c, T.DoubleType()) for c in scores)])
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast(model)
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter([PieceModel(held.value, k, double) for k in kinds.values()])  # goes with the task, as workers outlive tasks
        for batch in parted(batches, at):
            col = batch.column(at)
            gone = np.asarray(col.is_null())
            found = counter.count_all(col.to_pylist())
            more = [pa.array(n, pa.int64(), mask=gone) for n, _ in found] + [pa.array(found[names.index(c)][1], pa.float64(), mask=gone) for c in scores.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)
