"""Exact removal of repeated byte strings with suffix arrays.

Blocks around anchors settle most repeats (:mod:`._repeats`).  Where blocks of
one gram differ, the bytes that a block shares with no other are trimmed (they
are in no shared window); what is left goes into a suffix array, and suffixes
that are neighbours there and agree in ``width`` bytes are equal strings.

The array is built by Lyndon grouping in linear time.  Suffixes start in groups
by first symbol.  Groups are taken in descending order; for each suffix of a
group the previous smaller one is found, and the suffixes so pointed at are
split off above the rest of their own groups, those pointed at most often
highest.  In the end a group holds the suffixes with the same Lyndon prefix,
and one pass over the growing result emits the order inside all groups from the
same pointers, without recursion or renaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _text as X
from ._store import Workspace

WIDTH, GRAM = 100, 32
#: Symbols of one suffix array.
ARRAY = 1 << 18


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is smaller than all others and occurs once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of each suffix in ``order``
    group = [0] * n  # start of its group
    size = [0] * n  # of the group that starts here
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    prev = [-1] * n
    hi = n - 1
    while hi >= 0:
        lo = group[order[hi]]
        # Previous smaller suffix of each member, left to right.
        count: dict[int, int] = {}
        for s in sorted(order[lo : hi + 1]) if hi > lo else order[lo : lo + 1]:
            p = s - 1
            while p >= 0 and group[p] > lo:
                p = prev[p]
            if p >= 0 and group[p] == lo:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            # Those pointed at more often are greater; split them off first.
            by: dict[int, list[int]] = {}
            for p, c in count.items():
                by.setdefault(c, []).append(p)
            for c in sorted(by, reverse=True):
                members = by[c]
                for p in members:
                    old = group[p]
                    size[old] -= 1
                    end = old + size[old]
                    other, mine = order[end], place[p]
                    order[mine], place[other] = other, mine
                    order[end], place[p] = p, end
                # A group that is split off whole keeps its start: look all of them up before any is counted.
                for p, new in [(p, group[p] + size[group[p]]) for p in members]:
                    group[p] = new
                    size[new] += 1
        hi = lo - 1
    # Emission: whoever stands before the next suffix in order is next in its own group.
    out, slot = [-1] * n, list(range(n))
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


_CONTEXT = 72  # at least WIDTH - GRAM, in whole words of eight bytes


def _shared(raw: np.ndarray, at: np.ndarray, size: np.ndarray, step: int, gid: np.ndarray) -> np.ndarray:
    """How far each context (``size`` bytes from ``at`` in direction ``step``) agrees with that of any other row of its group."""
    k = np.arange(_CONTEXT)
    inside = k < size[:, None]
    text = np.where(inside, raw[np.where(inside, at[:, None] + step * k, 0)], 0).astype(np.uint8)
    word = text.view(">u8")
    order = np.lexsort([*(word[:, i] for i in range(word.shape[1] - 1, -1, -1)), gid])
    other = text[order][1:] != text[order][:-1]
    lcp = np.where(other.any(axis=1), other.argmax(axis=1), _CONTEXT)
    lcp[gid[order][1:] != gid[order][:-1]] = -1
    most = np.full(len(at), -1)
    most[order[1:]] = lcp
    most[order[:-1]] = np.maximum(most[order[:-1]], lcp)
    return np.minimum(most, size)


def _array_repeats(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset in it) of each window of the rows [start, end) that occurs before, in the order of rows."""
    size = end - start
    to = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.ones(to[-1] + 1, np.int64)
    pick = np.repeat(start - (to[:-1] - np.arange(len(start))), size) + np.arange(size.sum())
    keep = np.ones(to[-1], bool)
    keep[to[1:] - 1] = False
    text[:-1][keep] = raw[pick].astype(np.int64) + 2
    text[-1] = 0
    order = np.array(suffix_array(text.tolist()))
    row = np.searchsorted(to, order, "right") - 1
    ok = (row < len(size)) & (order + WIDTH <= to[np.minimum(row + 1, len(size))] - 1)
    order, row = order[ok], row[ok]
    new = np.ones(len(order), bool)
    new[1:] = ~X.same(text, order[1:], order[:-1], np.full(max(0, len(order) - 1), WIDTH))
    kind = np.cumsum(new) - 1
    first = np.full(kind[-1] + 1 if len(kind) else 0, len(text))
    np.minimum.at(first, kind, order)
    again = order != first[kind]
    return row[again], order[again] - to[row[again]]


def _first_of(raw: np.ndarray, key: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each range the first one with its key and its bytes; ranges of one hash are compared byte by byte."""
    h = X.range_hash(X.prefix_hash(raw), start, end)
    order = np.lexsort((np.arange(len(h)), h, end - start, *key))
    same = np.ones(len(h), bool)
    for x in (h, end - start, *key):
        same[1:] &= x[order][1:] == x[order][:-1]
    same[:1] = False
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
    out = np.empty(len(h), np.int64)
    out[order] = first
    return np.where(X.same(raw, start, start[out], end - start), out, np.arange(len(h)))


def resolve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of repeated bytes among blocks of the same gram."""
    g, doc, tkey, place = (table.column(c).to_numpy() for c in ("g", "doc", "tkey", "place"))
    body = table.column("content").combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    raw, bound = X.buffers(body.cast(pa.large_binary()).view(pa.large_string()))
    lo, at, _ = R.unpack(place)
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    gid = np.cumsum(new) - 1
    anchor = bound[:-1] + at
    out: list[tuple] = []
    live = np.arange(len(g))
    start, end = bound[:-1].copy(), bound[1:].copy()
    while len(live):
        before = len(live), int((end[live] - start[live]).sum())
        left = _shared(raw, anchor[live] - 1, anchor[live] - start[live], -1, gid[live])
        right = _shared(raw, anchor[live] + GRAM, end[live] - anchor[live] - GRAM, 1, gid[live])
        start[live], end[live] = anchor[live] - left, anchor[live] + GRAM + right
        live = live[(left >= 0) & (end[live] - start[live] >= WIDTH)]
        # Equal rests: all but the first are repeats.
        again = _first_of(raw, (anchor[live] - start[live], gid[live]), start[live], end[live]) != np.arange(len(live))
        rows = live[again]
        off = lo[rows] - bound[rows]
        out.append((doc[rows], tkey[rows], off + start[rows], off + end[rows]))
        live = live[~again]
        if (len(live), int((end[live] - start[live]).sum())) == before:
            break
    i = 0
    while i < len(live):
        size = np.cumsum(end[live[i:]] - start[live[i:]] + 1)
        j = i + max(1, int(np.searchsorted(size, ARRAY)))
        while j < len(live) and gid[live[j]] == gid[live[j - 1]]:
            j += 1
        part = live[i:j]
        row, off = _array_repeats(raw, start[part], end[part])
        rows = part[row]
        at = lo[rows] + start[rows] - bound[rows] + off
        out.append((doc[rows], tkey[rows], at, at + WIDTH))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


UNIT = R.Unit(words=False, width=WIDTH, gram=GRAM, strict=False)


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row.

    A byte is removed if a string of WIDTH bytes that covers it also starts
    earlier: in a smaller doc_id, or in the same document.  Null and short texts
    lose nothing.  Rows of one doc_id count as one document: equal texts as one
    row, different ones one after the other in the order of their bytes.  All
    rows with a null doc_id are such a document, and it comes first.
    """
    store = Workspace(docs.sparkSession, "suffix")
    texts = R.keyed(docs, text, store)
    found = R.repeats(texts, UNIT, resolve, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.buffers(batch.column(1))
            row, lo, hi = R.span_arrays(batch.column(2))
            gone = X.cover(offsets[row] + lo, offsets[row] + hi, len(data))
            n_removed = X.per_row(gone, offsets)
            edge = np.zeros(len(data), bool)
            edge[1:] = gone[1:] & ~gone[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            edge[heads] = gone[heads]
            kept, to = data[~gone], offsets - np.concatenate(([0], np.cumsum(n_removed)))
            view = memoryview(np.ascontiguousarray(kept))
            digest = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(X.per_row(edge, offsets)), pa.array(digest, pa.string()), body], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = R.spans_by_document(texts, found).mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.select(R.doc_id(out["doc"]).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
