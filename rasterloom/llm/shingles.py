"""Word shingles of texts as 64-bit hashes: the tokens of near-duplicate detection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rasterloom.llm.common import LOWER, mix64, span_hashes, text_bytes, words

#: Words are runs of other bytes than white space (0x20, 0x09-0x0D), after lower-casing A-Z.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, in one array, and offsets (n + 1).

    A row with fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    start, end, first = words(LOWER[data], offsets, IS_WORD)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = span_hashes(LOWER[data], start, end)
    count = np.diff(first)
    wide = np.concatenate([h, np.zeros(size, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(size):
        total += mix64(wide[k : k + len(h)] + _STEP[k % 8] * np.uint64(k // 8 * 2 + 1)) * _STEP[(k + 3) % 8]
    row = np.repeat(np.arange(n), count)
    within = np.arange(len(h)) - np.repeat(first[:-1], count)
    whole = within <= np.repeat(count - size, count)
    short = np.flatnonzero((count > 0) & (count < size))
    tokens, rows = mix64(total[whole]), row[whole]
    if len(short):
        extra = count[short].astype(np.uint64)
        for k in range(size - 1):
            more = count[short] > k
            extra[more] = mix64(extra[more] * _STEP[0] + h[first[short[more]] + k])
        tokens, rows = np.concatenate([tokens, extra]), np.concatenate([rows, short])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[new], rows[new]
    return tokens, np.searchsorted(rows, np.arange(n + 1))


def of_column(col: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*text_bytes(col), size)
