"""A SentencePiece vocabulary with its own segmentation rules.

Unigram models: the path of the largest score sum (single precision, as the library adds), earlier start winning ties.

BPE models: merges by score, leftmost first. A sequence of pieces is what merging yields exactly if every
piece alone and every neighbouring pair of pieces merges back to itself, since the first merge across a boundary depends
on the two pieces beside it only. So each prefix has one valid last piece, and a forward pass can carry it: a path
search whose steps weigh 0 (the pair holds) or minus infinity.
"""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_F = struct.Struct("f")
#: Pairs of pieces that a model keeps: some 10 MB.
KEPT_PAIRS = 1 << 15


def single(x: float) -> float:
    return _F.unpack(_F.pack(x))[0]


class PieceModel:
    def __init__(self, data: bytes, kind: int | None = None, double: bool = False) -> None:
        """kind: overrides the model's own type (UNIGRAM reads a BPE vocabulary's scores as a unigram model's).

        double: scores add up in double precision instead of the library's single one.
        """
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        self.kind = kind or m.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        if USER in self.types or UNUSED in self.types or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined and unused pieces and suffix marks aren't supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.unk = self.types.index(UNKNOWN)
        self.byte_fallback = m.trainer_spec.byte_fallback
        self.byte_ids = [next(i for i, p in enumerate(self.pieces) if p == f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []
        self.unk_surface = m.trainer_spec.unk_surface
        normal = [self.scores[i] for i in self.ids.values()]
        self.unk_score = single(min(normal, default=0.0) - 10.0)
        exact = all(s == int(s) for s in normal) and max(map(abs, normal), default=0) < 1 << 17
        self.exact = exact = exact or double
        self.add = (lambda a, b: a + b) if exact else (lambda a, b: single(a + b))
        n = m.normalizer_spec
        self.dummy_prefix, self.strip_extra = n.add_dummy_prefix, n.remove_extra_whitespaces
        self.plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces
        self._library = None if self.plain else data
        multi = {c for p in self.ids if len(p) > 1 for c in p}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        inert = "".join(c for c in "\n\r\t" if c not in multi)
        #: Texts fall into units that no piece can cross.
        self.units = re.compile(".+", re.S).findall if crossing else re.compile(f"{MARK}*[^{MARK}{inert}]+|{MARK}+" + (f"|[{inert}]" if inert else "")).findall
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self._traces: dict[str, tuple[tuple, tuple, tuple] | None] = {}
        self.pair = lru_cache(KEPT_PAIRS)(self.stays)

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return (self.unk_surface if self.types[i] == UNKNOWN else self.pieces[i].replace(MARK, " ")).encode()

    def normalise(self, text: str) -> str:
        """Marked text: spaces as marks, with the leading mark if the model adds one."""
        if self.plain:
            return (MARK * self.dummy_prefix + text.replace(" ", MARK)) if text else ""
        if isinstance(self._library, bytes):
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self._library)
        return self._library.normalize(text)

    def trace(self, piece: str) -> tuple[tuple, tuple, tuple] | None:
        """What merging a piece's characters goes through: its first and last part and the score of the next merge at each step;
        None if merging doesn't give the piece."""
        if piece in self._traces:
            return self._traces[piece]
        parts, first, last, score = list(piece), [], [], []
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at, id_ = self.scores[k], i, k
            first.append(parts[0]), last.append(parts[-1]), score.append(best)
            if at < 0:
                break
            parts[at : at + 2] = [self.pieces[id_]]
        if len(self._traces) > KEPT_PAIRS:
            self._traces.clear()
        found = self._traces[piece] = (tuple(first), tuple(last), tuple(score)) if len(parts) == 1 else None
        return found

    def stays(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are side by side; a may be '' for the start.

        Both merge as they do alone until the parts beside the boundary would merge first.
        """
        y = self.trace(b)
        if not a or y is None:
            return y is not None
        x = self.trace(a)
        if x is None:
            return False
        i = j = 0
        while True:
            left, right = x[2][i], y[2][j]
            k = self.ids.get(x[1][i] + y[0][j])
            if k is not None and self.scores[k] > left and self.scores[k] >= right:  # leftmost first among equals
                return False
            if left == right == -math.inf:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def ids_of(self, piece: str, id_: int | None) -> tuple[int, ...]:
        """The ids that a piece of a path gives: its own, or those of an unknown character."""
        if id_ is not None:
            return (id_,)
        return tuple(self.byte_ids[b] for b in piece.encode()) if self.byte_fallback else (self.unk,)
