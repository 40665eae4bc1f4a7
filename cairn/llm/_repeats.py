"""Stretches of text that also occur earlier in the corpus.

The texts are cut into blocks of windows around anchors (:mod:`._anchors`).

1. ``first_pass``: each task compares the blocks of its own rows and keeps one
   of equal blocks (the others are repeats already), so that a passage in a
   third of all rows leaves one row per FLUSH blocks.  The rest is partitioned
   by gram and block, so that no gram, however common, lies in one task; equal
   blocks give repeats, and the first of each kind is passed on.
2. Kinds are counted by gram with partial sums.  Only kinds whose gram has
   another kind are looked at further.
3. ``contents``: what those blocks hold is fetched with one join by document.
4. A resolver looks for windows that such blocks of one gram share.  Grams with
   more than HOT blocks are broken up: their windows are keyed one by one and
   go through the comparison of the first pass again.
5. ``spans_by_document`` joins what was found with the documents.

Documents are ordered by doc_id.  Rows of one doc_id count as one document: its
distinct texts are numbered in the order of their bytes and taken one after the
other.  Blocks and windows of different tasks are held to be equal if their gram
and two hashes over the field of 2**61 - 1 elements agree; over the choice of the
two points, two given blocks that differ agree with a chance below 2**-106.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _anchors as A
from . import _text as X
from ._store import Workspace

#: Packing of a place: start, anchor from there, number of windows.
BITS = 7
_MASK = (1 << BITS) - 1
#: Blocks that a task compares at a time, and blocks of one gram that a resolver takes.
FLUSH, HOT = 400_000, 5_000
#: Ids or grams that are sent to all executors; beyond that the join shuffles.
BROADCAST = 1_000_000
#: Bytes of contents in one batch.
CONTENTS = 32 << 20
ROWS = "g bigint, sh bigint, v bigint, doc bigint, tkey bigint, place bigint"
FOUND = "doc bigint, tkey bigint, lo bigint, hi bigint, place bigint, kind int, g bigint"
SPANS = "doc bigint, tkey bigint, lo bigint, hi bigint"
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``words`` or bytes, its width and gram; with ``strict`` only other documents are earlier."""

    words: bool
    width: int
    gram: int
    strict: bool

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        if not self.words:
            return A.blocks(X.BYTE_CODE[data], (data, data), offsets, self.width, self.gram)
        start, end, row = X.words(data, offsets)
        codes = tuple(A.codes_of(data, start, end, k) for k in (0, 1))
        return A.blocks(codes[0] * X.M1 | np.uint64(1), codes, np.searchsorted(row, np.arange(len(offsets))), self.width, self.gram)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, where each symbol starts in them (and the end), and the bounds of rows among the symbols; a word has one space after it."""
        if not self.words:
            return data, np.arange(len(data) + 1), offsets
        start, end, row = X.words(data, offsets)
        to = np.concatenate(([0], np.cumsum(end - start + 1)))
        out = np.full(to[-1], 32, np.uint8)
        keep = np.ones(to[-1], bool)
        keep[to[1:] - 1] = False
        out[keep] = data[X.cover(start, end, len(data))]
        return out, to, np.searchsorted(row, np.arange(len(offsets)))


def keyed(docs: DataFrame, text: str, store: Workspace) -> DataFrame:
    """doc, tkey (0, or the number of the text of a repeated doc_id) and text; with repeated ids also copies, the rows of that text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = store.save(rows.groupBy("doc").count().where("count > 1").select("doc"), "again")
    n = again.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("bigint").alias("tkey"), "text")
    if n <= BROADCAST:
        again = F.broadcast(again)
    own = rows.join(again, "doc", "left_semi").groupBy("doc", "text").agg(F.count("*").alias("copies")).orderBy("doc", "text")
    # Ids grow with the partition, and partitions are ranges of (doc, text).
    own = store.save(own.select("doc", (F.monotonically_increasing_id() + 1).alias("tkey"), "copies", "text"), "own")
    once = rows.join(again, "doc", "left_anti").select("doc", F.lit(0).cast("bigint").alias("tkey"), F.lit(1).cast("bigint").alias("copies"), "text")
    return once.unionByName(own)


def pack(lo: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << (2 * BITS)) | (at.astype(np.int64) << BITS) | n.astype(np.int64)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (2 * BITS), (place >> BITS) & _MASK, place & _MASK


def merge(doc: np.ndarray, tkey: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges with overlapping or touching ones of a text joined."""
    if not len(doc):
        return doc, tkey, lo, hi
    order = np.lexsort((hi, lo, tkey, doc))
    doc, tkey, lo, hi = doc[order], tkey[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])
    # Running maximum of the ends within a text: texts are set apart by their number.
    text = np.cumsum(new) - 1
    reach = np.maximum.accumulate(hi + text * (1 << 32)) - text * (1 << 32)
    new[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], tkey[at], lo[at], reach[last]


def local_pass(unit: Unit, g: np.ndarray, sh: np.ndarray, v: np.ndarray, doc: np.ndarray, tkey: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of ROWS for a task's blocks: those that no earlier block of the task equals, and merged ranges (n = 0, end in sh) of the others."""
    order = np.lexsort((place, tkey, doc, sh, g)) if tkey.any() else np.lexsort((place, doc, sh, g))
    g, sh, v, doc, tkey, place = (x[order] for x in (g, sh, v, doc, tkey, place))
    head = np.ones(len(g), bool)
    head[1:] = (g[1:] != g[:-1]) | (sh[1:] != sh[:-1]) | (v[1:] != v[:-1])
    keep = doc == doc[np.flatnonzero(head)][np.cumsum(head) - 1] if unit.strict else head
    lo, _, n = unpack(place[~keep])
    d, t, lo, hi = merge(doc[~keep], tkey[~keep], lo, lo + n + unit.width - 1)
    none = np.zeros(len(lo), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((g[keep].view(np.int64), X.mix(d.view(np.uint64)).view(np.int64)))),
            pa.array(np.concatenate((sh[keep].view(np.int64), hi))),
            pa.array(np.concatenate((v[keep].view(np.int64), none))),
            pa.array(np.concatenate((doc[keep], d))),
            pa.array(np.concatenate((tkey[keep], t))),
            pa.array(np.concatenate((place[keep], pack(lo, none, none)))),
        ],
        names=["g", "sh", "v", "doc", "tkey", "place"],
    )


def _blocks(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            doc, tkey = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, data, offsets in X.chunks(*X.buffers(batch.column(2))):
                b = unit.blocks(data, offsets)
                row = i + b["row"]
                held.append((b["g"], b["sh"], b["v"], doc[row], tkey[row], pack(b["lo"], b["at"], b["n"])))
                count += len(row)
                if count >= FLUSH:
                    yield local_pass(unit, *map(np.concatenate, zip(*held)))
                    held, count = [], 0
        if count:
            yield local_pass(unit, *map(np.concatenate, zip(*held)))

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """The rows (sorted by ``key``) again, in tables that hold whole groups, about ``most`` rows or more each."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            k = table.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _compare(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeats (g null), and the first blocks of each kind, from rows sorted by all columns.

    Of what came before only the last kind and its first document are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, sh, v, doc, tkey, place = (batch.column(i).to_numpy() for i in range(6))
            lo, _, n = unpack(place)
            given = n == 0
            head = np.ones(len(g), bool)
            head[1:] = (g[1:] != g[:-1]) | (sh[1:] != sh[:-1]) | (v[1:] != v[:-1])
            head |= given
            head[1:] |= given[:-1]
            kind = np.cumsum(head)
            first = np.concatenate(([0], doc[head]))
            if last is not None and not given[0] and last[0] == (g[0], sh[0], v[0]):
                head[0], first[1] = False, last[1]
            if not given[-1]:
                last = (g[-1], sh[-1], v[-1]), first[kind[-1]]
            else:
                last = None
            again = given | (doc > first[kind] if unit.strict else ~head)
            hi = np.where(given, sh, lo + n + unit.width - 1)
            d, t, l, h = merge(doc[again], tkey[again], lo[again], hi[again])
            none = np.zeros(len(d), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((d, doc[~again]))),
                    pa.array(np.concatenate((t, tkey[~again]))),
                    pa.array(np.concatenate((l, lo[~again]))),
                    pa.array(np.concatenate((h, hi[~again]))),
                    pa.array(np.concatenate((none, place[~again]))),
                    pa.array(np.concatenate((none, head[~again])).astype(np.int32)),
                    pa.array(np.concatenate((none, g[~again])), mask=np.arange(len(d) + (~again).sum()) < len(d)),
                ],
                names=["doc", "tkey", "lo", "hi", "place", "kind", "g"],
            )

    return run


def compare(rows: DataFrame, unit: Unit) -> DataFrame:
    return rows.repartition("g", "sh").sortWithinPartitions("g", "sh", "v", "doc", "tkey", "place").mapInArrow(_compare(unit), FOUND)


def contents(texts: DataFrame, asked: DataFrame, unit: Unit) -> DataFrame:
    """g, doc, tkey, place and content (bytes; words with a space after each) of the blocks in ``asked``."""
    per_doc = asked.groupBy("doc", "tkey").agg(F.collect_list(F.struct("place", "g")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tkey, refs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            bound = refs.offsets.to_numpy()
            bound, flat = bound - bound[0], refs.flatten()
            place, g = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            lo, _, n = unpack(place)
            row = np.repeat(np.arange(len(doc)), np.diff(bound))
            for i, j, data, offsets in X.chunks(*X.buffers(batch.column(2))):
                raw, symbol, at = unit.flat(data, offsets)
                s = slice(bound[i], bound[j])
                first = at[row[s] - i] + lo[s]
                start, end = symbol[first], symbol[first + n[s] + unit.width - 1]
                total = np.concatenate(([0], np.cumsum(end - start)))
                k = 0
                while k < len(start):
                    m = max(k + 1, int(np.searchsorted(total, total[k] + CONTENTS, "right")) - 1)
                    size, to = (end - start)[k:m], total[k : m + 1] - total[k]
                    pick = np.repeat(start[k:m] - to[:-1], size) + np.arange(to[-1])
                    body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw[pick])])
                    u = slice(bound[i] + k, bound[i] + m)
                    yield pa.RecordBatch.from_arrays([pa.array(g[u]), pa.array(doc[row[u]]), pa.array(tkey[row[u]]), pa.array(place[u]), body], names=["g", "doc", "tkey", "place", "content"])
                    k = m

    joined = texts.join(per_doc, ["doc", "tkey"]).select("doc", "tkey", "text", "asked")
    return joined.mapInArrow(run, "g bigint, doc bigint, tkey bigint, place bigint, content binary")


def _windows(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of hot grams as rows of ROWS, one per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, doc, tkey, place = (batch.column(i).to_numpy() for i in range(4))
            lo, _, n = unpack(place)
            data, offsets = X.buffers(batch.column(4).cast(pa.large_binary()).view(pa.large_string()))
            if unit.words:
                start, end, row = X.words(data, offsets)
                codes = tuple(A.codes_of(data, start, end, k) for k in (0, 1))
                at = np.searchsorted(row, np.arange(len(offsets)))
            else:
                codes, at = (data, data), offsets
            block = np.repeat(np.arange(len(g)), n)
            k = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[block] + k
            sh, v = (X.range_hash(X.prefix_hash(c, p), begin, begin + unit.width, p) for p, c in enumerate(codes))
            one = np.ones(len(block), np.int64)
            yield local_pass(unit, g[block].view(np.uint64), sh, v, doc[block], tkey[block], pack(lo[block] + k, 0 * one, one))

    return run


def repeats(texts: DataFrame, unit: Unit, resolve: Callable[[pa.Table], tuple[np.ndarray, ...]], store: Workspace) -> DataFrame:
    """doc, tkey, lo, hi: ranges of symbols covered by windows that also occur earlier; ``texts`` are :func:`keyed`.

    ``resolve`` takes a table (g, doc, tkey, place, content) of whole groups
    sorted by all but the content, and returns (doc, tkey, lo, hi) arrays.
    """
    found = store.save(compare(texts.select("doc", "tkey", "text").mapInArrow(_blocks(unit), ROWS), unit), "found")
    kinds = found.where("g is not null").groupBy("g").agg(F.sum("kind").alias("kinds"), F.count("*").alias("n"))
    several = store.save(kinds.where("kinds > 1").select("g", (F.col("n") > HOT).alias("hot")), "several")
    many = several.count()
    few = F.broadcast(several) if many <= BROADCAST else several
    asked = found.where("g is not null").join(few, "g", "left_semi").select("doc", "tkey", "place", "g")
    body = store.save(contents(texts, asked, unit), "contents")
    hot = several.where("hot").select("g")
    any_hot = bool(hot.head(1))
    if any_hot and many <= BROADCAST:
        hot = F.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g", 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(*resolve(table))], names=["doc", "tkey", "lo", "hi"])

    calm = body.join(hot, "g", "left_anti") if any_hot else body
    done = store.save(calm.repartition("g").sortWithinPartitions("g", "doc", "tkey", "place").mapInArrow(run, SPANS), "resolved")
    out = found.where("g is null").select("doc", "tkey", "lo", "hi").unionByName(done)
    if any_hot:
        rows = body.join(hot, "g", "left_semi").select("g", "doc", "tkey", "place", "content").mapInArrow(_windows(unit), ROWS)
        out = out.unionByName(store.save(compare(rows, unit).where("g is null").select("doc", "tkey", "lo", "hi"), "windows"))
    out = store.save(out, "spans")
    for table in (found, several, body, done):
        store.drop(table)
    return out


def spans_by_document(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc, text and spans (array of lo, hi; null if none), once for each row that the text came from."""
    per_doc = found.groupBy("doc", "tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(per_doc, ["doc", "tkey"], "left")
    if "copies" in texts.columns:
        joined = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return joined.select("doc", "text", "spans")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of all spans of a column of spans."""
    flat = column.flatten()
    size = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(column)), size), flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def doc_id(column: Column) -> Column:
    return F.when(column != F.lit(NO_ID), column)
