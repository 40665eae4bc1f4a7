"""Windows of fixed length, gathered around anchors.

Of each window of ``width`` symbols the least hashed gram of ``gram`` symbols
(the leftmost of equals) is its anchor.  Equal windows have their anchor at the
same place, so windows can be compared anchor by anchor: neighbouring windows
with one anchor form a block, a stretch of ``width`` and a few more symbols, and
about two blocks come from each ``width - gram`` symbols.
"""

from __future__ import annotations

import numpy as np

from . import _text as X


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, from prefix and suffix minima of blocks of that size."""
    n = len(key)
    m = -(-n // span) * span
    pad = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = key
    grid = pad.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - span + 1], left[span - 1 : n])


def blocks(rough: np.ndarray, codes: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Of each block: row, lo (symbol in the row), n (windows), at (the anchor, from lo), gram and two block hashes; in order of place.

    ``rough`` are codes of the symbols of all rows for the choice of anchors,
    ``codes`` those that the two hashes are made of, ``offsets`` bounds of rows.
    """
    none = np.zeros(0, np.int64)
    empty = {"row": none, "lo": none, "n": none, "at": none, "g": none.view(np.uint64), "sh": none.view(np.uint64), "v": none.view(np.uint64)}
    if len(rough) < width:
        return empty
    g = X.rough_hashes(rough, gram)
    bits = np.uint64(max(1, int(len(rough)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _least((g & ~low) | np.arange(len(g), dtype=np.uint64), width - gram + 1)
    # Windows inside one row.
    size = np.diff(offsets)
    ok = np.zeros(len(rough) + 1, np.int8)
    long = size >= width
    ok[offsets[:-1][long]] += 1
    np.subtract.at(ok, offsets[1:][long] - width + 1, 1)
    at = np.flatnonzero(np.cumsum(ok)[: len(least)] > 0)
    if not len(at):
        return empty
    anchor = (least[at] & low).astype(np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    n = np.diff(np.concatenate((first, [len(at)])))
    lo = at[first]
    sh, v = (X.range_hash(X.prefix_hash(c, k), lo, lo + n + width - 1, k) for k, c in enumerate(codes))
    return {"row": row[first], "lo": lo - offsets[row[first]], "n": n, "at": anchor[first] - lo, "g": g[anchor[first]], "sh": sh, "v": v}


def word_codes(data: np.ndarray, offsets: np.ndarray, point: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes (1 .. 2**61 - 2) of all words, and the bounds of rows among them."""
    start, end, row = X.words(data, offsets)
    return codes_of(data, start, end, point), np.searchsorted(row, np.arange(len(offsets)))


def codes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, point: int) -> np.ndarray:
    return X.range_hash(X.prefix_hash(data, point), start, end, point) % (X.PRIME - np.uint64(1)) + np.uint64(1) if len(start) else np.zeros(0, np.uint64)
