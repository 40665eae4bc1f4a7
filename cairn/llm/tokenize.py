"""Token ids and their binary files.

A file holds the ids of a run of documents in ascending order of doc_id.  Ids
are replaced by their rank of frequency over the whole table, so that frequent
ids are small, and written in groups of four: one control byte with two bits
per value (its bytes less one), apart from the data bytes.  Layout, integers
little-endian::

    8 bytes  magic b"CAIRNTK1"
    3 x u64  documents d, ids n, data bytes b
    d x i64  doc_id
    d x u64  ids of each document
    ceil(n / 4) control bytes
    b        data bytes

``ranks.bin`` in the same folder holds the id of each rank as u32.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace

MAGIC = b"CAIRNTK1"
END = 2
#: Text of one file, and texts encoded at a time.
FILE_BYTES, MOST_BYTES, FILES, PIECE_BYTES = 24 << 20, 256 << 20, 100_000, 6 << 20

# --- the coding -------------------------------------------------------------

_SIZES = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = (size - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    size[len(values) :] = 0
    use = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8), v.view(np.uint8).reshape(-1, 4)[use]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes: sizes come from a table of all control bytes."""
    size = _SIZES[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < size[:, None]] = data
    return out.view("<u4")[:, 0]


# --- the tokenizer ----------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ASCII = np.arange(256) < 128
_BLANK = X.SEP | np.isin(np.arange(256), range(0x1C, 0x20))
_AFTER_LETTER = _ASCII & ~_LETTER
_BEFORE_LETTER = _ASCII & ~_LETTER & ~np.isin(np.arange(256), [0x20, 0x27])
_HARD = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]"
_ALONE = "(?s)^ $|^[\\t-\\r]|^.+[\\t-\\r ]"


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    newline = t.encode("\n", add_special_tokens=False).ids
    if len(newline) != 1:
        raise ValueError("the tokenizer has no id for a newline alone")
    return t, newline[0], [s.content for s in t.get_added_tokens_decoder().values()]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the byte-level pattern always starts a new piece.

    That is before a space after a non-blank; after an ASCII letter before any
    other ASCII byte; and before an ASCII letter after another ASCII byte that
    is neither a space nor an apostrophe, nor the end of a run of blanks (whose
    last one is a piece of its own before a letter, but not at an end).  Starts
    of texts are added.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        letter_a, letter_b = _LETTER[a], _LETTER[b]
        run = np.zeros(len(a), bool)
        run[1:] = _BLANK[a[1:]] & _BLANK[a[:-1]]
        cut[1:-1] = ((b == 32) & ~_BLANK[a]) | (letter_a & _AFTER_LETTER[b]) | (letter_b & _BEFORE_LETTER[a] & ~run)
    cut[offsets] = True
    return np.flatnonzero(cut)


#: A piece that is one word for certain: the model can take it without the pattern.
_PLAIN = "^ ?[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]+$"
#: Pieces whose ids a worker remembers.
CACHE = 300_000
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character for each byte that a byte-level vocabulary shows as another one.
_GLYPH = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_shown))}


class _Pieces:
    """Ids of distinct pieces, each encoded once as long as it is remembered."""

    def __init__(self, path: str):
        self.tok, self.newline, self.special = _tokenizer(path)
        self.code: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids remembered, first, size) with a place per distinct piece."""
        if len(self.code) > CACHE:
            self._forget()
        # By way of numpy, which makes the strings much faster than to_pylist().
        pieces, code = distinct.to_numpy(zero_copy_only=False).tolist(), self.code
        places = [code.get(p, -1) for p in pieces]
        new = [i for i, c in enumerate(places) if c < 0]
        if new:
            fresh = distinct.take(pa.array(new))
            plain = pc.match_substring_regex(fresh, _PLAIN).to_numpy(zero_copy_only=False)
            alone = pc.match_substring_regex(fresh, _ALONE).to_numpy(zero_copy_only=False) & ~plain
            names = [pieces[i] for i in new]
            found: list[list[int]] = [[]] * len(names)
            word = self.tok.model.tokenize
            for i in np.flatnonzero(plain).tolist():
                p = names[i]
                found[i] = [t.id for t in word(p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(_GLYPH))]
            rest = np.flatnonzero(~plain & ~alone).tolist()
            for k in range(0, len(rest), 4000):
                part = rest[k : k + 4000]
                own: list[int] = []
                place = iter(part)
                for x in self.tok.encode("\n".join([names[i] for i in part]), add_special_tokens=False).ids:
                    if x == self.newline:
                        found[next(place)] = own
                        own = []
                    else:
                        own.append(x)
                found[next(place)] = own
            single = np.flatnonzero(alone).tolist()
            for i, e in zip(single, self.tok.encode_batch([names[i] for i in single], add_special_tokens=False)):
                found[i] = e.ids
            size = np.array([len(f) for f in found], np.int64)
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))))
            for i, p in zip(new, names):
                places[i] = code[p] = len(code)
        at = np.array(places, np.int64)
        return self.ids, self.first[at], self.size[at]

    def _forget(self) -> None:
        self.code, self.ids = {}, np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)


@lru_cache(2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number per text.

    Equal to encoding each whole text: texts are cut where pieces always end and
    each distinct piece is encoded once, words by the model itself, others
    joined by newlines, which are tokens of their own between pieces without
    blanks inside.  Texts for which that is not sure (rare blanks, strings of
    special tokens) are encoded whole.
    """
    known = _pieces(path)
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    hard = pc.match_substring_regex(column, _HARD)
    for s in known.special:
        hard = pc.or_(hard, pc.match_substring(column, s))
    whole = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
    easy = pc.if_else(hard, "", column) if len(whole) else column
    data, offsets = X.buffers(easy)
    count = np.zeros(len(column), np.int64)
    ids = np.zeros(0, np.uint32)
    if len(data):
        cuts = _cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        flat, first, size = known.look_up(coded.dictionary)
        n = size[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
        count = np.diff(ends[np.searchsorted(cuts, offsets)])
    if len(whole):
        texts = column.take(pa.array(whole)).to_pylist()
        own = dict(zip(whole.tolist(), (np.array(e.ids, np.uint32) for e in known.tok.encode_batch(texts, add_special_tokens=False))))
        split = np.split(ids, np.cumsum(count)[:-1])
        split = [own.get(i, x) for i, x in enumerate(split)]
        count = np.array([len(x) for x in split], np.int64)
        ids = np.concatenate(split)
    return ids, count


def _with_end(ids: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text."""
    stop = np.cumsum(count + 1) - 1
    out = np.empty(len(ids) + len(count), np.uint32)
    keep = np.ones(len(out), bool)
    keep[stop] = False
    out[stop], out[keep] = end, ids
    return out, count + 1


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(uri: str, parts: list[bytes]) -> None:
    """Write under another name, then rename: a lost or doubled task leaves whole files only."""
    system, path = _open(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for p in parts:
            out.write(p)
    system.move(draft, path)


# --- the operator -----------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", end: int = END) -> DataFrame:
    """Write the token files of ``docs`` to ``folder``; returns (file, n_docs, n_ids, first_id) in order.

    Texts are encoded once: they are range-partitioned by doc_id, and each
    partition's ids go to a table in the shared folder with their counts.  The
    counts, at most one row per id of the vocabulary, give the ranks.  Then one
    task per partition turns its table part into a file.
    """
    spark = docs.sparkSession
    store = Workspace(spark, "tokens")
    rows = docs.select("doc_id", F.col(text).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n_files = max(1, round(total / min(MOST_BYTES, max(FILE_BYTES, total // FILES))))
    raw = f"{store.path}/raw"
    _open(raw)[0].create_dir(_open(raw)[1], recursive=True)
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, docs_n = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(1 << 16, np.int64)
        system, path = _open(f"{raw}/{part:06d}.parquet")
        draft = f"{path}.{uuid.uuid4().hex}"
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        with system.open_output_stream(draft) as sink, pq.ParquetWriter(sink, schema, compression="zstd", use_dictionary=False) as out:
            for batch in batches:
                data, offsets = X.buffers(batch.column(1))
                for i, j, _, _ in X.chunks(data, offsets, PIECE_BYTES):
                    ids, count = _with_end(*encode(batch.column(1).slice(i, j - i), tokenizer), end)
                    if len(ids) and int(ids.max()) >= len(seen):
                        seen = np.concatenate((seen, np.zeros(int(ids.max()) + 1 - len(seen), np.int64)))
                    seen += np.bincount(ids, minlength=len(seen))
                    n, docs_n = n + len(ids), docs_n + len(count)
                    wide = len(seen) > 1 << 16
                    body = pa.py_buffer(ids.astype("<u4" if wide else "<u2").tobytes())
                    place = np.concatenate(([0], np.cumsum(count))) * (4 if wide else 2)
                    out.write_table(pa.table([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(count), pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(place.astype(np.int32)), body])], schema=schema))
        system.move(draft, path)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2, -3]))), pa.array(np.concatenate((seen[at], [n, docs_n, part]))), pa.array(np.full(len(at) + 3, part))], names=["id", "n", "part"])

    ordered = rows.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    counts = store.save(ordered.mapInArrow(tokens, "id bigint, n bigint, part bigint"), "counts")
    ranked = [r["id"] for r in counts.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()]
    order = np.array(ranked, np.uint32)
    _put(f"{folder}/ranks.bin", [order.astype("<u4").tobytes()])
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    known = spark.sparkContext.broadcast(rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                system, path = _open(f"{raw}/{part:06d}.parquet")
                ids, n, control, body, total, rest = [], [], [], [], 0, np.zeros(0, np.uint32)
                with system.open_input_file(path) as f:
                    for piece in pq.ParquetFile(f).iter_batches(2000):
                        own = piece.column(1).to_numpy()
                        raw_bytes = b"".join(piece.column(2).to_pylist())
                        width = len(raw_bytes) // max(1, int(own.sum()))
                        values = np.concatenate((rest, known.value[np.frombuffer(raw_bytes, f"<u{width or 2}")]))
                        use = len(values) // 4 * 4  # groups of four go on across pieces
                        c, d = pack(values[:use])
                        rest = values[use:]
                        ids.append(piece.column(0).fill_null(-(1 << 63)).to_numpy()), n.append(own)
                        control.append(c.tobytes()), body.append(d.tobytes())
                        total += int(own.sum())
                c, d = pack(rest)
                control.append(c.tobytes()), body.append(d.tobytes())
                docs_n = sum(map(len, n))
                name = f"{folder}/{part:06d}.tok"
                head = MAGIC + np.array([docs_n, total, sum(map(len, body))], "<u8").tobytes()
                _put(name, [head, *(x.astype("<i8").tobytes() for x in ids), *(x.astype("<u8").tobytes() for x in n), *control, *body])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([docs_n]), pa.array([total])], names=["file", "part", "n_docs", "n_ids"])

    parts = counts.where("id = -1").select("part").distinct()
    files = store.save(parts.repartition(max(1, n_files), "part").mapInArrow(write, "file string, part bigint, n_docs bigint, n_ids bigint"), "files")
    _open(raw)[0].delete_dir(_open(raw)[1])
    # Starts by two sums: over groups of files, and over the files of a group.
    grouped = files.withColumn("group", F.floor(F.col("part") / 1000))
    sums = grouped.groupBy("group").agg(F.sum("n_ids").alias("ids"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("group", before("ids", Window.orderBy("group")).alias("start"))
    placed = grouped.withColumn("inside", before("n_ids", Window.partitionBy("group").orderBy("part"))).join(F.broadcast(sums), "group")
    return placed.select("file", "n_docs", "n_ids", (F.col("start") + F.col("inside")).alias("first_id"))


def read_file(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, ids per document, ranks) of a token file."""
    system, path = _open(uri)
    with system.open_input_stream(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{uri} is no token file")
    d, n, b = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    ids = np.frombuffer(raw, "<i8", d, at)
    count = np.frombuffer(raw, "<u8", d, at + 8 * d).astype(np.int64)
    at += 16 * d
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    body = np.frombuffer(raw, np.uint8, b, at + len(control))
    # In pieces of whole groups of four, to bound what is expanded at once.
    step = 1 << 22
    size = _SIZES[control].sum(axis=1, dtype=np.int64)
    pieces, place = [], 0
    for i in range(0, len(control), step // 4):
        c = control[i : i + step // 4]
        m = min(n - 4 * i, 4 * len(c))
        width = int(size[i : i + len(c)].sum()) - (4 * len(c) - m)  # a last group's unused values have no bytes
        pieces.append(unpack(c, body[place : place + width], m))
        place += width
    return ids, count, np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)


def read_tokens(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, decoded from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(f"{folder}/ranks.bin")
        with system.open_input_stream(path) as f:
            ids_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, count, ranks = read_file(name)
                ids = ids_of[ranks].astype("<u4")
                stop = np.cumsum(count)
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((stop - count).tolist(), stop.tolist())], np.int64)
                none = pa.array(doc == -(1 << 63))
                yield pa.RecordBatch.from_arrays([pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(doc)), pa.array(first + stop - count), pa.array(count), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("file", "first_id").repartition(n, "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, text: str = "text", end: int = END) -> DataFrame:
    """Write ``docs`` as token files and return what they hold, a row per document.

    Null texts are empty and give only the end id; rows with a null doc_id come
    first; repeated rows and ids are all written, in an order fixed by their
    text.  An empty table gives no file and no row.
    """
    spark = docs.sparkSession
    folder = folder or Workspace(spark, "token-files").path
    return read_tokens(spark, write_tokens(docs, tokenizer, folder, text, end), folder)
