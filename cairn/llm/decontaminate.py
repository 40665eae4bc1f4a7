"""Benchmark decontamination by spaced-seed hashing.

Tokens are the runs of letters and digits of the lower-cased text, as 64-bit
hashes.  A seed is a window of SPAN tokens of which a fixed mask ignores some;
the masks differ, so that a few substituted tokens leave some seed whole.
Hashes of the benchmark's seeds are joined with those of all positions of all
documents.  Around a hit both texts are aligned and compared token by token: a
document is contaminated by an item if at least NEED tokens (or four fifths of
a shorter item) agree within PAD tokens of the seed, whatever stands at the
other places.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 12
#: Of the alignments that the rule accepts (24 tokens, 13 alike), these find 0.97 at 30 % random substitutions and 0.91
#: at 35 % (passages of 40 tokens), and 0.98 with 3 of 15 tokens substituted; simulated.
MASKS = ((0, 2, 4, 7, 9, 11), (0, 1, 5, 7, 8, 9), (0, 1, 2, 5, 10, 11), (0, 3, 4, 5, 6, 11))
PAD, NEED, SHARE = 6, 13, 0.8
#: Default of ``least``: items with fewer tokens name nothing in particular and are left out.
LEAST = 5
#: Seeds that are sent to all executors with the tokens around them, and hashes of seeds that are sent without.
BROADCAST_SEEDS, BROADCAST_HASHES = 400_000, 4_000_000
#: Ids that are sent to all executors; beyond that the join shuffles.
BROADCAST_IDS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens.  The lambda runs once per text; all that runs per position is compiled."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), ""), lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, masks: list[tuple[int, tuple[int, ...], int]]) -> DataFrame:
    """``rows`` (with t) exploded to at and h: a row per position and mask; masks are (tag, places, span)."""
    least = min(span for _, _, span in masks)
    # No filter on the size: it would split every text a second time.
    at = rows.withColumn("at", F.explode(F.when(F.size("t") >= least, F.sequence(F.lit(0), F.size("t") - least))))
    seed = lambda tag, mask: F.xxhash64(F.lit(tag), *(F.get("t", F.col("at") + o) for o in mask))
    hashes = [F.when(F.col("at") + span <= F.size("t"), seed(tag, m)) if span > least else seed(tag, m) for tag, m, span in masks]
    return at.withColumn("h", F.explode(F.array(*hashes)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_hits) for each document that holds a passage of an item.

    n_hits counts the seeds that were verified.  Items of fewer than ``least``
    tokens are left out; those of fewer than SPAN are one seed and must occur
    whole.  Null, empty and very short texts match nothing; rows of the same
    doc_id count together; repeated items each count.  Either table may be
    empty.  Other columns are ignored.

    Few seeds are sent to all executors with the tokens around them.  Of more,
    their hashes are sent, in blocks of BROADCAST_HASHES with a pass over the
    documents each; only the tokens around a hit are shuffled to meet the seeds.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") >= least)
    sizes = items.agg(F.sum(F.size("t")).alias("n"), F.collect_set(F.when(F.size("t") < SPAN, F.size("t"))).alias("short")).first()
    # An item shorter than a mask is a seed as a whole; lengths least .. SPAN - 1.
    short = [(100 + n, tuple(range(n)), n) for n in sorted(sizes["short"])]
    masks = [(i, m, SPAN) for i, m in enumerate(MASKS)]
    seeds = _seeds(items, masks)
    for s in short:
        seeds = seeds.unionByName(_seeds(items.where(F.size("t") == s[2]), [s]))
    # The tokens around each seed as columns: all code per position must stay within what the JVM compiles.
    places = range(-PAD, SPAN + PAD)
    around = lambda letter: [F.get("t", F.col("at") + k).alias(f"{letter}{k + PAD}") for k in places]
    seeds = seeds.select("h", "item_id", *around("w"), F.least(F.lit(NEED), F.ceil(F.size("t") * SHARE)).alias("need"))
    positions = _seeds(docs.select("doc_id", tokens(F.col(text)).alias("t")), masks + short)
    # Written out place by place: a lambda would end code generation and copy whole texts per position.
    matched = F.lit(0)
    if (sizes["n"] or 0) * len(masks) <= BROADCAST_SEEDS:
        for k in places:
            matched = matched + F.when(F.col(f"w{k + PAD}") == F.get("t", F.col("at") + k), 1).otherwise(0)
        hits = positions.join(F.broadcast(seeds), "h")
    else:
        for k in places:
            matched = matched + F.when(F.col(f"w{k + PAD}") == F.col(f"d{k + PAD}"), 1).otherwise(0)
        seeds = seeds.where("h is not null")
        blocks = -(-(sizes["n"] or 0) * len(masks) // BROADCAST_HASHES)
        own = seeds.select("h").distinct()
        near = None
        for i in range(blocks):
            block = F.broadcast(own.where(F.pmod(F.col("h"), F.lit(blocks)) == i))
            part = positions.join(block, "h", "left_semi").select("doc_id", "h", *around("d"))
            near = part if near is None else near.unionByName(part)
        hits = near.join(seeds, "h")
    return hits.where(matched >= F.col("need")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that :func:`contaminated` does not name; rows without doc_id stay."""
    from ._store import Workspace

    bad = Workspace(docs.sparkSession, "leaks").save(contaminated(docs, benchmark, text, least).where("doc_id is not null").select("doc_id").distinct())
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti")


def _sql_tokens(table: str, key: str) -> str:
    return f"select {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from {table}"


def _sql_seeds(source: str, key: str) -> str:
    parts = [f"select {key}, t, pos, {i} as m, concat_ws(' ', {', '.join(f't[pos + {o + 1}]' for o in mask)}) as h from (select {key}, t, unnest(range(len(t) - {SPAN} + 1)) as pos from {source} where len(t) >= {SPAN})" for i, mask in enumerate(MASKS)]
    return " union all ".join(parts)


#: For a benchmark whose items all have SPAN tokens or more.
SQL = f"""
with d as ({_sql_tokens("documents", "doc_id")}), b as ({_sql_tokens("benchmark", "item_id")}),
ds as ({_sql_seeds("d", "doc_id")}), bs as ({_sql_seeds("b", "item_id")}),
hits as (select doc_id, item_id, d.t as t, b.t as it, d.pos as dp, b.pos as bt,
  greatest(0, b.pos - {PAD}, b.pos - d.pos) as lo, least(len(b.t), b.pos + {SPAN + PAD}, b.pos - d.pos + len(d.t)) as hi
  from ds d join bs b on d.h = b.h and d.m = b.m),
v as (select doc_id, item_id, len(list_filter(range(lo, hi), lambda k: it[k + 1] = t[k - bt + dp + 1])) as matched, least({NEED}, ceil(len(it) * {SHARE})) as need from hits)
select doc_id, item_id, count(*) as n_hits from v where matched >= need group by 1, 2
"""
