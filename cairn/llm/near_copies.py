"""Near copies: all pairs of texts whose word shingles have a Jaccard similarity of 4/5 or more.

The join is exact.  Shingles have one order over the corpus, those first that a
sample of texts does not repeat.  Two sets of a and b shingles (a <= b) that are
similar share at least one of the first ``n - ceil(4n/5) + 1`` of each; texts
meet by those shingles only, and the number of them they share bounds the whole
overlap, since either prefix leaves ``ceil(4n/5) - 1`` shingles.  What passes the
bound is compared with whole sets.  The sample only decides how many meet.

Shingles are compared by 64-bit hashes, in lower case as in :mod:`.simhash`; a
text of fewer words is one shingle, and texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _anchors as A
from . import _text as X
from . import simhash
from ._store import Workspace

#: Least similarity, as a fraction, and words of a shingle.
UP, DOWN = 4, 5
SHINGLE = 5
#: Texts that repeated shingles are looked for in, and most of such shingles that are sent to all tasks.
SAMPLE, MOST_HOT = 20_000, 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all rows, in order within a row, and the bounds of rows among them."""
    words, bounds = A.word_codes(simhash._LOWER[data], offsets)
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][row]
    h = X.range_hash(X.prefix_hash(words), start, np.minimum(start + shingle, bounds[1:][row])) if len(row) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(h))))
    return X.mix((total[bounds[1:]] - total[bounds[:-1]]) + np.diff(bounds).astype(np.uint64) * X.M2)


def _lists(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))


def _chunks(column: pa.Array) -> Iterator[tuple]:
    """(first, last, bytes, offsets, hashes, bounds) of runs of rows."""
    for i, j, data, offsets in X.chunks(*X.buffers(column)):
        yield i, j, data, offsets, *shingle_sets(data, offsets)


def similar(docs: DataFrame, store: Workspace, text: str = "text", shingle: int = 3) -> DataFrame:
    """Pairs (u, v) of fingerprints (of ``shingle`` words, as in op1) that link all texts with similar sets.

    Texts with equal sets are linked in a chain, other pairs one by one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = max(1, texts.count() // SAMPLE)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h, _ in _chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    repeated = sample.mapInArrow(members, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(MOST_HOT).toArrow()
    hot_hash = repeated.column("h").to_numpy().view(np.uint64)
    at = np.argsort(hot_hash)
    hot = spark.sparkContext.broadcast((hot_hash[at], repeated.column("n").to_numpy()[at]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = hot.value
        for batch in batches:
            for i, j, data, offsets, h, bounds in _chunks(batch.column(0)):
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[place] == h, times[place], 0)
                order = np.lexsort((h, rank, row))
                size = np.where(n > 0, n - -(-UP * n // DOWN) + 1, 0)
                first = np.arange(len(h)) - bounds[:-1][row] < size[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array(_signatures(h, bounds).view(np.int64)), pa.array(n), pa.array(simhash._fingerprints(data, offsets, shingle).view(np.int64)), _lists(h[order][first], np.concatenate(([0], np.cumsum(size))))],
                    names=["at", "sig", "n", "fp", "first"],
                )

    texts = texts.withColumn("at", F.xxhash64("text"))
    heads = store.save(texts.select("text", "at").mapInArrow(prefixes, "at bigint, sig bigint, n bigint, fp bigint, first array<bigint>"), "heads")
    fps = heads.groupBy("sig").agg(F.min("fp").alias("low"))
    equal = heads.select("sig", "fp").distinct().join(fps, "sig").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    # Texts that meet by the same shingles meet once, with their number.
    meet = heads.select(F.struct("n", "sig").alias("x"), F.explode("first").alias("g")).groupBy("g").agg(F.array_sort(F.collect_set("x")).alias("xs")).where(F.size("xs") > 1)
    meet = meet.groupBy("xs").agg(F.count("*").alias("k"))
    a, b = F.col("a"), F.col("b")
    pairs = meet.select("k", "xs", F.posexplode("xs").alias("i", "a")).select("k", "a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b")).where(DOWN * a["n"] >= UP * b["n"])
    pairs = pairs.groupBy("a", "b").agg(F.sum("k").alias("k"))
    # overlap >= UP (a + b) / (UP + DOWN), and at most k of it lies in both prefixes.
    pairs = pairs.where((F.col("k") + F.ceil(UP * b["n"] / F.lit(DOWN)) - 1) * (UP + DOWN) >= UP * (a["n"] + b["n"]))
    pairs = store.save(pairs.select(a["sig"].alias("sa"), b["sig"].alias("sb")), "pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h, bounds in _chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_signatures(h, bounds).view(np.int64)), _lists(h, bounds)], names=["sig", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * DOWN >= UP * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.col("sa").alias("sig")).union(pairs.select("sb")).distinct()
    places = heads.select("sig", "at").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("at").alias("at"))
    chosen = texts.join(places.select("at").distinct(), "at", "left_semi").select("text").distinct()
    whole = store.save(chosen.mapInArrow(sets, "sig bigint, h array<bigint>").join(wanted, "sig", "left_semi").dropDuplicates(["sig"]), "sets")
    both = pairs.join(whole.select(F.col("sig").alias("sa"), F.col("h").alias("ha")), "sa").join(whole.select(F.col("sig").alias("sb"), F.col("h").alias("hb")), "sb")
    good = both.select("sa", "sb", "ha", "hb").mapInArrow(verify, "sa bigint, sb bigint")
    near = good.join(fps.select(F.col("sig").alias("sa"), F.col("low").alias("u")), "sa").join(fps.select(F.col("sig").alias("sb"), F.col("low").alias("v")), "sb").where("u <> v")
    return store.save(near.select("u", "v").union(equal), "near")
