"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

Blocks around anchors settle most repeats (:mod:`._repeats`).  Where blocks of
one gram differ, those of all earlier documents are indexed as reference blocks:
what follows each of their windows is kept in order, so that the reference that
goes on longest like a given text stands next to it.  Each block is parsed
greedily against all references: from left to right, at each place the longest
factor that any of them holds is taken, and a factor of ``width`` words or more
is a repeat.  The parse goes on inside the factor's last words, so that windows
across the boundary of two factors are looked up as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _text as X
from ._store import Workspace

WIDTH, GRAM = 13, 5


class References:
    """Windows of reference blocks, and what follows each of them, in order of bytes.

    Words have one space after them, so the number of words that two texts
    share from their beginning is the number of spaces in the bytes they share,
    and of sorted texts a neighbour shares most with a given one.
    """

    def __init__(self) -> None:
        self.after: dict[bytes, list[bytes]] = {}

    def add(self, body: bytes, ends: list[int]) -> None:
        for i in range(len(ends) - WIDTH):
            cut = ends[i + WIDTH]
            rests, rest = self.after.setdefault(body[ends[i] : cut], []), body[cut:]
            at = bisect_left(rests, rest)
            if at == len(rests) or rests[at] != rest:
                rests.insert(at, rest)

    def longest(self, body: bytes, ends: list[int], i: int) -> int:
        """Words of the longest factor from word ``i`` that a reference holds; 0 if it is no window."""
        cut = ends[i + WIDTH]
        rests = self.after.get(body[ends[i] : cut])
        if rests is None:
            return 0
        rest = body[cut:]
        at = bisect_left(rests, rest)
        return WIDTH + max(commonprefix([rest, x]).count(b" ") for x in rests[max(0, at - 1) : at + 1])


def _ends(body: bytes) -> list[int]:
    """0, and the end of each word with its space."""
    return [0, *(np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1).tolist()]


def resolve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of repeated words among blocks of the same gram, which come in order of their documents."""
    los = R.unpack(table.column("place").to_numpy())[0].tolist()
    out: list[tuple[int, int, int, int]] = []
    last, known, own = None, References(), []
    for g, doc, tkey, lo, body in zip(*(table.column(c).to_pylist() for c in ("g", "doc", "tkey")), los, table.column("content").to_pylist()):
        if (g, doc) != last:
            # Blocks of one document are no references for each other.
            if last is not None and g == last[0]:
                for x in own:
                    known.add(*x)
            else:
                known = References()
            last, own = (g, doc), []
        ends = _ends(body)
        i = 0
        while i < len(ends) - WIDTH:
            length = known.longest(body, ends, i)
            if length:
                out.append((doc, tkey, lo + i, lo + i + length))
            i += max(1, length - WIDTH + 1)
        own.append((body, ends))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


UNIT = R.Unit(words=True, width=WIDTH, gram=GRAM, strict=True)


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by a space) of each row.

    A word is removed if a window of WIDTH words that covers it also starts in a
    document with a smaller doc_id.  Null texts and texts of fewer words lose
    nothing.  Rows of one doc_id are one document.  A null doc_id comes first.
    """
    store = Workspace(docs.sparkSession, "substring")
    texts = R.keyed(docs, text, store)
    found = R.repeats(texts, UNIT, resolve, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = X.buffers(batch.column(1))
            span_row, span_lo, span_hi = R.span_arrays(batch.column(2))
            for i, j, data, offsets in X.chunks(all_data, all_offsets):
                start, end, row = X.words(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                s = slice(np.searchsorted(span_row, i), np.searchsorted(span_row, j))
                at = first[span_row[s] - i]
                gone = X.cover(at + span_lo[s], at + span_hi[s], len(start))
                n_removed = X.per_row(gone, first)
                # The bytes of the words left, each with a space after it.
                start, end, own = start[~gone], end[~gone], row[~gone]
                size = end - start + 1
                to = np.concatenate(([0], np.cumsum(size)))
                flat = np.full(to[-1], 32, np.uint8)
                keep = np.ones(to[-1], bool)
                keep[to[1:] - 1] = False
                flat[keep] = data[X.cover(start, end, len(data))]
                bound = to[np.searchsorted(own, np.arange(j - i + 1))].tolist()
                kept = [flat[a : max(a, b - 1)].tobytes() for a, b in zip(bound[:-1], bound[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(n_removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    out = R.spans_by_document(texts, found).mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.select(R.doc_id(out["doc"]).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
