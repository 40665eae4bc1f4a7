"""Vectorised views of a batch of texts: bytes, words, hashes, windows.

The texts of an Arrow string column lie in one buffer, so numpy can find words
and hash them without a Python object per word.  Words are the runs of bytes
other than space and 0x09-0x0D; these are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Identity of ranges: polynomials over the field of 2**61 - 1 elements, at two random points.
PRIME = np.uint64((1 << 61) - 1)
_rng = np.random.default_rng(20240607)
POINTS = tuple(int(x) for x in _rng.integers(1 << 60, (1 << 61) - 1, 2))
#: Choice of anchors only: a cheap polynomial modulo 2**64, whose clashes do no harm there.
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_29, _32, _61 = (np.uint64(x) for x in (29, 32, 61))
_LOW29, _LOW32 = np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)
#: Bytes of text that the kernels work on at a time; one longer text is a chunk of its own.
CHUNK = 1 << 18
#: Symbols that are summed at a time; products of a byte and half a power then fit 64 bits.
_STEP = 1 << 15
_powers: dict[object, np.ndarray] = {}


def _kept(key: object, n: int, make) -> np.ndarray:  # noqa: ANN001
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = make(max(n, CHUNK + CHUNK // 4))
        if n <= 4 * CHUNK:
            _powers[key] = have
    return have[:n]


def _wrapping_powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""

    def make(size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return _kept(("wrap", int(base)), n, make)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit x."""
    x = (x & PRIME) + (x >> _61)
    return np.minimum(x, x - PRIME)  # a difference below zero wraps to a large value


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a, b < 2**61."""
    ah, al, bh, bl = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    low, mid = al * bl, ah * bl + al * bh
    return _reduce(((ah * bh) << np.uint64(3)) + (mid >> _29) + ((mid & _LOW29) << _32) + (low & PRIME) + (low >> _61))


def _field_powers(base: int, n: int) -> np.ndarray:
    def make(size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = times(out[:take], np.uint64(step))
            done, step = done + take, step * step % int(PRIME)
        return out

    return _kept(("field", base), n, make)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def prefix_hash(codes: np.ndarray, point: int = 0) -> np.ndarray:
    """Prefix sums from which :func:`range_hash` takes the hash of any range.

    ``codes`` are bytes, or values of 1 .. 2**61 - 2.
    """
    n = len(codes)
    power = _field_powers(POINTS[point], n)
    out = np.zeros(n + 1, np.uint64)
    narrow = codes.dtype == np.uint8
    # In steps that stay in the cache.
    for i in range(0, n, _STEP):
        c, p = codes[i : i + _STEP], power[i : i + _STEP]
        if narrow:
            c = c.astype(np.uint64) + np.uint64(1)
            low, high = np.cumsum(c * (p & _LOW32)), np.cumsum(c * (p >> _32))
        else:
            term = times(c, p)
            low, high = np.cumsum(term & _LOW32), np.cumsum(term >> _32)
        out[i + 1 : i + 1 + len(c)] = _reduce((low & PRIME) + (low >> _61) + (high >> _29) + ((high & _LOW29) << _32) + out[i])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, point: int = 0) -> np.ndarray:
    """64-bit hashes of the ranges [start, end).

    Two given ranges of at most n symbols that differ clash with a chance of
    n / 2**61 over the choice of the point, whatever they hold; no code is 0, so
    ranges of different lengths are different polynomials too.
    """
    back = _field_powers(pow(POINTS[point], -1, int(PRIME)), len(prefix))
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _STEP):
        a, b = start[i : i + _STEP], end[i : i + _STEP]
        out[i : i + _STEP] = mix(times(_reduce(prefix[b] + (PRIME - prefix[a])), back[a]))
    return out


def rough_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Cheap hashes of all ranges of ``size`` symbols."""
    prefix = np.zeros(len(codes) + 1, np.uint64)
    power = _wrapping_powers(BASE, len(codes))
    for i in range(0, len(codes), _STEP):
        c = codes[i : i + _STEP]
        prefix[i + 1 : i + 1 + len(c)] = np.cumsum(c * power[i : i + _STEP]) + prefix[i]
    n = len(codes) - size + 1
    back, out = _wrapping_powers(BASE_INV, n), np.empty(n, np.uint64)
    for i in range(0, n, _STEP):
        j = min(n, i + _STEP)
        out[i:j] = mix((prefix[i + size : j + size] - prefix[i:j]) * back[i:j])
    return out


def same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at ``a`` and at ``b`` hold the same bytes."""
    out = np.ones(len(a), bool)
    to = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(to, to[i] + CHUNK, "right")) - 1)
        n, at = size[i:j], to[i : j + 1] - to[i]
        k = np.arange(at[-1]) - np.repeat(at[:-1], n)
        bad = np.concatenate(([0], np.cumsum(raw[np.repeat(a[i:j], n) + k] != raw[np.repeat(b[i:j], n) + k])))
        out[i:j] = bad[at[1:]] == bad[at[:-1]]
        i = j
    return out


def classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each range: equal for equal bytes, and for these only.

    Ranges of one hash are compared with the first of them; should one differ,
    all are numbered by their bytes.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(range_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
    head, size = first[number], end - start
    other = np.flatnonzero(head != np.arange(len(start)))
    if (size[other] == size[head[other]]).all() and same(data, start[other], start[head[other]], size[other]).all():
        return number
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist())], np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows with about ``size`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each."""
    n = len(data)
    inside = ~SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions in any of the ranges [start, end)."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth[: n + 1])[:n] > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
