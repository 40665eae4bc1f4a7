"""SimHash near-duplicates: exact Hamming search with vantage-point trees.

A fingerprint has 64 bits; two are linked if at most three differ.  Of the two
halves of a linked pair one differs in at most one bit, so each half has a
vantage-point tree of its own that is searched with radius one in the Hamming
distance of that half:

* the upper tree is built on a bounded sample and sent to all tasks.  A node
  holds a vantage point and a median distance; a fingerprint belongs to the
  child on its side and is looked up in the other one too if the triangle
  inequality allows a neighbour there (the boundary overlap);
* each shard is searched by a tree of its own, with whole fingerprints compared
  in its leaves, so that the pairs are exact.

Equal fingerprints are merged first, so copies cost nothing here.  A shard only
returns a spanning forest of its links; the forests are merged by alternating
large-star and small-star steps whose tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace

RADIUS = 3
#: Fingerprints that the upper trees are built on, 16 a leaf and as many at least and at most, and their most leaves.
SAMPLE, MOST_SAMPLE, MAX_SHARDS = 65_536, 1 << 20, 1 << 16
#: Aim for the size of a shard, and the size from which it is cut into blocks.
SHARD, HOT = 2048, 32_768
#: Leaves within a shard.
LEAF = 512
#: Shingles whose bits are spread at a time.
SPREAD = 1 << 15

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many ranges of one buffer; ranges over 512 bytes go to the library one by one."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(size > 512)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    pick = np.flatnonzero(size <= 512)
    if not len(pick):
        return out
    order = pick[np.argsort(size[pick], kind="stable")]
    at, n = start[order].astype(np.int64), size[order].astype(np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), s + _P5, np.uint64)
        stripes = n // 32
        first = int(np.searchsorted(stripes, 1))  # ranges lie in order of size
        if first < len(at):
            p, k = at[first:], stripes[first:]
            acc = [np.full(len(p), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for j in range(int(k[-1])):
                f = int(np.searchsorted(k, j + 1))
                for lane in range(4):
                    acc[lane][f:] = _round(acc[lane][f:], eight[p[f:] + 32 * j + 8 * lane])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros(1, np.uint64), a)) * _P1 + _P4
            h[first:] = x
        h += n.astype(np.uint64)
        pos, rest = at + 32 * stripes, n - 32 * stripes
        for j in range(3):
            m = np.flatnonzero(rest >= 8 * (j + 1))
            h[m] = _rotl(h[m] ^ _round(np.zeros(1, np.uint64), eight[pos[m] + 8 * j]), 27) * _P1 + _P4
        pos, rest = pos + rest // 8 * 8, rest % 8
        m = np.flatnonzero(rest >= 4)
        h[m] = _rotl(h[m] ^ ((eight[pos[m]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        pos, rest = pos + rest // 4 * 4, rest % 4
        for j in range(3):
            m = np.flatnonzero(rest > j)
            h[m] = _rotl(h[m] ^ (padded[pos[m] + j].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[order] = h ^ (h >> np.uint64(32))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    start, end, row = X.words(data, offsets)
    fp = np.zeros(len(offsets) - 1, np.uint64)
    if not len(start):
        return fp
    # The words again, each followed by one space: a shingle is then a range of bytes.
    size = end - start + 1
    to = np.concatenate(([0], np.cumsum(size)))
    inside = X.cover(start, end, len(data))
    flat = np.full(to[-1], 32, np.uint8)
    keep = np.ones(to[-1], bool)
    keep[to[1:] - 1] = False
    flat[keep] = _LOWER[data[inside]]
    last = np.arange(len(start)) + shingle - 1
    n = np.bincount(row, minlength=len(fp))
    ok = np.zeros(len(start), bool)
    ok[: max(0, len(start) - shingle + 1)] = row[shingle - 1 :] == row[: max(0, len(start) - shingle + 1)]
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    short = (n > 0) & (n < shingle)
    ok[first[short]] = True
    last[first[short]] = first[short] + n[short] - 1
    at = np.flatnonzero(ok)
    owner, count = row[at], np.zeros((len(fp), 64), np.int32)
    # A few shingles at a time: each is 64 bytes once its bits are spread.
    for i in range(0, len(at), SPREAD):
        own, some = owner[i : i + SPREAD], at[i : i + SPREAD]
        h = xxh64(flat, to[some], to[last[some] + 1] - 1)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    total = np.bincount(owner, minlength=len(fp))
    set_bits = 2 * count > total[:, None]
    fp[:] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return fp


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as bigint) of each row; no words give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_fingerprints(d, o, shingle) for _, _, d, o in X.chunks(*X.buffers(batch.column(1)))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class VPTree:
    """Vantage-point tree over 32-bit values, for searches with radius one.

    Nodes are lists: a vantage point, a distance, and the places of the children
    (a child below 0 is the leaf ``-1 - child``).
    """

    def __init__(self, values: np.ndarray, leaf: int, most: int = 1 << 30):
        self.nodes: list[list[int]] = []
        self.leaves = 0
        self._most = most
        self.root = self._build(np.unique(values), leaf, np.random.default_rng(7), most)

    def _build(self, values: np.ndarray, leaf: int, rng: np.random.Generator, most: int) -> int:
        best = None
        if len(values) > leaf and most > 1:
            for vp in values[rng.integers(0, len(values), 6)]:
                d = np.bitwise_count(values ^ vp)
                mu = int(np.median(d))
                for cut in (mu - 1, mu):
                    inner, outer = int((d <= cut + 1).sum()), int((d >= cut).sum())
                    own = int((d <= cut).sum())
                    if 0 < own < len(values) and (best is None or inner + outer + abs(2 * own - len(values)) < best[0]):
                        best = (inner + outer + abs(2 * own - len(values)), vp, cut, d <= cut)
        # No use in a cut that leaves nearly all of them on both sides.
        if best is None or best[0] > 1.9 * len(values):
            self.leaves += 1
            return -self.leaves
        _, vp, cut, side = best
        at = len(self.nodes)
        self.nodes.append([int(vp), cut, 0, 0])
        self.nodes[at][2] = self._build(values[side], leaf, rng, most // 2)
        self.nodes[at][3] = self._build(values[~side], leaf, rng, most - most // 2)
        return at

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of the values that reach it, whether they live there)."""
        stack = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            node, at, home = stack.pop()
            if node < 0:
                yield -1 - node, at, home
                continue
            vp, cut, inner, outer = self.nodes[node]
            d = np.bitwise_count(values[at] ^ np.uint32(vp)).astype(np.int16)
            for child, near, lives in ((inner, d <= cut + 1, d <= cut), (outer, d >= cut, d > cut)):
                if near.any():
                    stack.append((child, at[near], home[near] & lives[near]))


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp >> np.uint64(32 * tree)).astype(np.uint32)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs (a, b) in ``label``, in place."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_shard(fp: np.ndarray, home: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as pairs of fingerprints) of the links of a shard's members with each other and with its visitors."""
    label = np.arange(len(fp))
    half = _half(fp, tree)
    inner = VPTree(half[home], LEAF)
    for _, at, lives in inner.route(half):
        own = at[lives & home[at]]
        if not len(own):
            continue
        for i in range(0, len(own), 256):
            rows = own[i : i + 256]
            for j in range(0, len(at), 16_384):
                cols = at[j : j + 16_384]
                r, c = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :]) <= RADIUS)
                r, c = rows[r], cols[c]
                new = label[r] != label[c]
                if new.any():
                    _roots(label, r[new], c[new])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, store: Workspace) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints such that their graph has the components of all links."""
    spark = fps.sparkSession
    distinct = store.save(fps.select("fp").distinct(), "distinct")
    n = distinct.count()
    shards = int(min(MAX_SHARDS, max(1, n // SHARD)))
    taken = distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(MOST_SAMPLE, max(SAMPLE, 16 * shards))).toArrow()
    sample = taken.column("fp").to_numpy().view(np.uint64)
    trees = spark.sparkContext.broadcast([VPTree(_half(sample, t), max(8, len(sample) // max(1, shards) // 2), shards) for t in (0, 1)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(trees.value):
                found = list(tree.route(_half(fp, t)))
                where = np.zeros(len(fp), np.int64)
                for leaf, at, home in found:
                    where[at[home]] = leaf
                for leaf, at, home in found:
                    # A pair of two shards is looked for in the later one only.
                    use = home | (where[at] < leaf)
                    at, home = at[use], home[use]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf * 2 + t)), pa.array(fp[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    routed = distinct.mapInArrow(route, "shard bigint, fp bigint, home boolean")
    # Shards beyond HOT rows are cut into blocks; every pair of blocks is a cell of its own.  There are at most 2 * MAX_SHARDS.
    sizes = routed.groupBy("shard").agg(F.ceil(F.count("*") / HOT).cast("int").alias("m")).where("m > 1")
    if n > HOT and (sizes := store.save(sizes, "hot")).head(1):
        routed = routed.join(F.broadcast(sizes), "shard", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        routed = routed.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        cell = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: F.least(x, F.col("b")) * F.col("m") + F.greatest(x, F.col("b")))
        routed = routed.select("shard", F.explode(cell).alias("cell"), "fp", "home")
    else:
        routed = routed.select("shard", F.lit(0).alias("cell"), "fp", "home")

    def link(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        u, v = link_shard(fp, table.column("home").to_numpy(zero_copy_only=False).astype(bool), int(table.column("shard")[0].as_py()) % 2)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return routed.groupBy("shard", "cell").applyInArrow(link, "u bigint, v bigint")


def components(edges: DataFrame, store: Workspace) -> DataFrame:
    """node, root (its component's least node) for all nodes of ``edges`` (u, v), by star contraction.

    Each round reads and writes tables of at most as many rows as the edges;
    rounds grow with the logarithm of the longest path.
    """
    now = store.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        small = store.save(small, "small")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(large)
        store.drop(now)
        now = small
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark


def simhash_groups(docs: DataFrame, text: str = "text", shingle: int = 3, also: DataFrame | None = None) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``.

    component_id is the least doc_id that can be reached over links of at most
    RADIUS bits.  Null and empty texts have fingerprint 0 and are linked like
    any other; rows with a null doc_id get a row but name no component.
    Repeated rows and ids each get a row.  An empty table gives no rows.
    ``also`` holds further pairs (u, v) of fingerprints that are linked.
    """
    store = Workspace(docs.sparkSession, "simhash")
    fps = store.save(fingerprints(docs, text, shingle), "fps")
    edges = links(fps, store)
    comp = components(edges if also is None else edges.union(also.select("u", "v")), store)
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    known = per_fp.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = store.save(known.groupBy("root").agg(F.min("rep").alias("component_id")).join(known.select("fp", "root"), "root").select("fp", "component_id"), "least")
    return fps.join(least, "fp").select("doc_id", "fp", "component_id")


#: Ids that are sent to all executors; beyond that the join shuffles.
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 3, also: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id names it.

    Repeated rows of one doc_id with the same text count as one document; an id
    with several texts stays if it names the group of one of them.  Rows without
    doc_id stay.
    """
    groups = Workspace(docs.sparkSession, "simhash-ids").save(simhash_groups(docs, text, shingle, also).where("doc_id is not null"))
    ids = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("named"), F.count("*").alias("n"))
    gone = ids.where("not named").select("doc_id")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if ids.where("n > 1").head(1):
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id", text])
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept
