"""Mixing of sources by temperature.

A source with T tokens gets a weight in proportion to T**e.  The exponent e,
between 0 (all sources alike) and 1 (as they are), is found by bisection: the
least that keeps every source's repetition within a limit, or the greatest that
reaches a target entropy.  Weights times the budget are the quotas in tokens.

A quota is filled in epochs.  In each, the blocks of BLOCK neighbouring ids of
a source come in an order of their own, fixed by a hash; inside a block the
documents come by a hash too.  The last epoch stops where the quota ends.
Running sums are taken in three steps (ranges of the hash, blocks, documents),
so no window holds a whole source.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace

BLOCK = 1024
#: The exponent is a multiple of 1 / GRID; WAYS of them are tried in one job.
GRID, WAYS = 1 << 20, 32
TOKENS = "[^\\x20\\x09-\\x0D]+"


def lengths(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, text_key, source ('' for null) and n_tokens (words) of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.md5(t).alias("text_key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.regexp_count(t, F.lit(TOKENS)).cast("bigint").alias("n_tokens"))


def exponent(sources: DataFrame, budget: int | None = None, repeats: float | None = None, entropy: float | None = None) -> int:
    """The exponent in units of 1 / GRID, from (source, tokens) rows.

    With ``repeats``: the least at which no source is repeated more often than
    that.  Without a budget, repetition is counted relative to the least
    repeated source, which is then taken once.  With ``entropy``: the greatest
    at which the entropy of the weights, as a share of that of equal weights,
    is at least that.
    """
    if (repeats is None) == (entropy is None):
        raise ValueError("give repeats or entropy")
    live = sources.where("tokens > 0").withColumn("t", F.col("tokens").cast("double"))
    lo, hi = 0, GRID
    while lo < hi:
        step = max(1, (hi - lo) // WAYS)
        tried = sorted({*range(lo, hi, step)})
        grid = live.withColumn("k", F.explode(F.array(*(F.lit(k) for k in tried)))).withColumn("e", F.col("k") / F.lit(float(GRID)))
        x = F.pow("t", "e")
        rows = grid.groupBy("k").agg(F.sum(x).alias("z"), F.max(F.pow("t", F.col("e") - 1)).alias("most"), F.min(F.pow("t", F.col("e") - 1)).alias("least"), F.sum(x * F.log(x)).alias("xlx"), F.count("*").alias("n")).collect()
        by = {r["k"]: r for r in rows}
        if not by:
            return GRID
        if repeats is not None:
            # Repetition falls as the exponent grows: the least that is good.
            good = [k for k in tried if (by[k]["most"] / by[k]["z"] * budget if budget else by[k]["most"] / by[k]["least"]) <= repeats]
            hi_new = good[0] if good else hi
            lo = max([k + 1 for k in tried if k < hi_new], default=lo)
            hi = hi_new
        else:
            # Entropy falls as the exponent grows: the greatest that is good, found as the least that is bad.
            from math import log

            bad = [k for k in tried if by[k]["n"] > 1 and (log(by[k]["z"]) - by[k]["xlx"] / by[k]["z"]) / log(by[k]["n"]) < entropy]
            hi_new = bad[0] if bad else hi
            lo = max([k + 1 for k in tried if k < hi_new], default=lo)
            hi = hi_new
    return lo if repeats is not None else max(0, lo - 1)


def quotas(lens: DataFrame, budget: int | None, repeats: float | None, entropy: float | None) -> DataFrame:
    """(source, tokens, docs, quota) of each source, at the exponent found.

    ``budget`` None: the least budget at which every source is taken once.
    """
    sources = lens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    e = exponent(sources, budget, repeats, entropy) / GRID
    x = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(e))).otherwise(0.0)
    whole = sources.agg(F.sum(x).alias("z"), F.min(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(e - 1)))).alias("least")).first()
    if not whole["z"]:
        return sources.withColumn("quota", F.lit(0).cast("bigint"))
    total = budget if budget is not None else whole["z"] / whole["least"]
    quota = F.round(x / F.lit(whole["z"]) * F.lit(float(total))).cast("bigint")
    return sources.withColumn("quota", quota if budget is not None else F.greatest(quota, "tokens"))


def mixture(lens: DataFrame, per_source: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, text_key, source, epoch, n_tokens, before): each document taken, with the tokens of its source before it.

    Documents without tokens come once, in epoch 0, if their source has a quota
    or no tokens at all.
    """
    n = lens.count()
    hexes = 0
    while 16**hexes * BLOCK * BLOCK < n:
        hexes += 1
    small = per_source.count() <= 100_000
    known = per_source.select("source", "tokens", "quota")
    rows = lens.join(F.broadcast(known) if small else known, "source")
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens")).cast("int")).otherwise(1)
    rows = rows.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.where("n_tokens > 0 or epoch = 0").withColumn("block", F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-1)).cast("bigint"))
    rows = rows.withColumn("block_key", F.md5(F.concat_ws(":", F.lit(seed), "source", "epoch", "block")))
    rows = rows.withColumn("doc_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "epoch"))).withColumn("range", F.substring("block_key", 1, hexes))
    blocks = rows.groupBy("source", "epoch", "range", "block_key").agg(F.sum("n_tokens").alias("block_tokens"))
    ranges = blocks.groupBy("source", "epoch", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    before = lambda *keys: Window.partitionBy("source", "epoch", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "epoch", "range", F.coalesce(F.sum("range_tokens").over(before("range")), F.lit(0)).alias("range_before"))
    blocks = blocks.withColumn("block_before", F.coalesce(F.sum("block_tokens").over(before("range", "block_key")), F.lit(0))).join(ranges, ["source", "epoch", "range"]).select("source", "epoch", "block_key", (F.col("range_before") + F.col("block_before")).alias("block_before"))
    inside = Window.partitionBy("source", "epoch", "block_key").orderBy("doc_key", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(blocks, ["source", "epoch", "block_key"])
    rows = rows.withColumn("before", F.col("epoch") * F.col("tokens") + F.col("block_before") + F.col("inside"))
    return rows.where((F.col("before") + F.col("n_tokens") <= F.col("quota")) | (F.col("tokens") == 0)).select("doc_id", "text_key", "source", "epoch", "n_tokens", "before")


def mix_sources(docs: DataFrame, budget_share: float | None = 1.0, repeats: float | None = 4.0, entropy: float | None = None, text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The documents of the mixture, see :func:`mixture`; the budget is a share of all tokens.

    A null source is '' and a null or empty text has no tokens; a null doc_id is
    in a block of its own; repeated rows are each taken; an empty table gives no
    rows.  Each source ends less than one document below its quota.
    """
    lens = Workspace(docs.sparkSession, "mix").save(lengths(docs, text, source))
    total = lens.agg(F.sum("n_tokens")).first()[0] or 0
    return mixture(lens, quotas(lens, None if budget_share is None else round(total * budget_share), repeats, entropy), seed)


def mixed_documents(docs: DataFrame, budget_share: float | None = None, repeats: float | None = 2.0, entropy: float | None = None, text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; its columns are unchanged."""
    taken = mix_sources(docs, budget_share, repeats, entropy, text, source, seed).groupBy("doc_id", "text_key").agg(F.count("*").alias("__copies"))
    key = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__copies"]
    rows = docs.withColumn("__key2", F.md5(F.coalesce(F.col(text), F.lit(""))))
    same = Window.partitionBy("doc_id", "__key2")
    rows = rows.withColumn("__nth", F.row_number().over(same.orderBy(F.lit(0)))).withColumn("__of", F.count("*").over(same))
    rows = rows.join(taken.select(*key), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key")))
    times = F.floor(F.col("__copies") / F.col("__of")) + F.when(F.col("__nth") <= F.col("__copies") % F.col("__of"), 1).otherwise(0)
    return rows.withColumn("__time", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)


#: The query op7 in SQL: budget all tokens, at most four repetitions, seed "mix".
SQL = f"""
with recursive l as (select doc_id, md5(coalesce(text, '')) as text_key, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '{TOKENS}')) as bigint) as n_tokens from documents),
s as (select source, cast(sum(n_tokens) as bigint) as tokens from l group by 1),
b as (select cast(sum(tokens) as double) as budget from s),
search as (select 0 as lo, {GRID} as hi
  union all
  select case when ok then lo else mid + 1 end, case when ok then mid else hi end
  from (select lo, hi, (lo + hi) // 2 as mid, (select max(pow(cast(tokens as double), ((lo + hi) // 2) / {GRID}.0 - 1)) / sum(pow(cast(tokens as double), ((lo + hi) // 2) / {GRID}.0)) from s where tokens > 0) * (select budget from b) <= 4 as ok from search where lo < hi)),
e as (select lo / {GRID}.0 as e from search where lo = hi),
q as (select source, tokens, cast(round(pow(cast(tokens as double), e) / (select sum(pow(cast(tokens as double), e)) from s, e where tokens > 0) * budget) as bigint) as quota from s, b, e where tokens > 0),
r as (select l.*, tokens, quota, cast(unnest(range(cast(ceil(quota / tokens) as bigint))) as int) as epoch, doc_id // {BLOCK} as block from l join q using (source)),
k as (select *, md5(concat_ws(':', 'mix', source, epoch, block)) as block_key, md5(concat_ws(':', 'mix', doc_id, epoch)) as doc_key from r where n_tokens > 0 or epoch = 0),
w as (select *, epoch * tokens + coalesce(sum(n_tokens) over (partition by source, epoch order by block_key, doc_key, text_key rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, source, epoch, n_tokens, cast(before as bigint) as before from w where before + n_tokens <= quota
"""
