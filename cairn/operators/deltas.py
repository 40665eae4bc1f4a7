"""Comparison of two generations of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, status: added, removed, changed (any of ``compare`` differs) or same.

    One shuffle of each side on the key.  A null is a value like any other.
    """
    mark = lambda df, name: df.select(key, F.struct(*compare).alias(name), F.lit(True).alias(f"{name}_in"))
    both = mark(old, "a").join(mark(new, "b"), key, "full_outer")
    status = F.when(F.col("a_in").isNull(), "added").when(F.col("b_in").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return both.select(key, status.alias("status"))


def delta_ids(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Keys that only one side has or that differ."""
    return delta(old, new, key, compare).where("status <> 'same'").select(key)


def pair_by_occurrence(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Multiset difference of (identity, id) records.

    Equal ids of an identity pair first; the rest pair by rank; what is left is
    resolved or new.  ``occurrence`` numbers the rows of an identity: pairs,
    then resolved, then new.
    """
    b, c = (x.dropDuplicates(["identity", "id"]) for x in (base, candidate))
    same = b.join(c, ["identity", "id"]).select("identity", F.col("id").alias("b_id"), F.col("id").alias("c_id"))
    by_id = Window.partitionBy("identity").orderBy("id")
    rest = lambda x, y, name: x.join(y, ["identity", "id"], "left_anti").withColumn("rn", F.row_number().over(by_id)).withColumnRenamed("id", name)
    paired = rest(b, c, "b_id").join(rest(c, b, "c_id"), ["identity", "rn"], "full_outer").select("identity", "b_id", "c_id")
    status = F.when(F.col("b_id").isNull(), "new").when(F.col("c_id").isNull(), "resolved").otherwise("unchanged")
    rows = same.unionByName(paired).withColumn("status", status)
    order = Window.partitionBy("identity").orderBy(F.when(F.col("status") == "unchanged", 0).when(F.col("status") == "resolved", 1).otherwise(2), F.col("b_id").asc_nulls_last(), F.col("c_id").asc_nulls_last())
    return rows.withColumn("occurrence", F.row_number().over(order).cast("bigint"))


def instance_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pattern, instance, status) for patterns that both sides have (J6); rows are (pattern, instance).

    One shuffle by pattern and one sort; both windows follow it.  A null instance has no equal on the other side.
    """
    side = lambda df, n: df.where("pattern is not null").select("pattern", "instance", F.lit(n).alias("side"))
    both = side(old, 1).unionByName(side(new, 2)).repartition("pattern")
    same = Window.partitionBy("pattern", "instance", F.when(F.col("instance").isNull(), F.col("side"))).orderBy("side")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    pattern = Window.partitionBy("pattern")
    sides = both.select("*", F.row_number().over(same).alias("rn"), F.max("side").over(same.rowsBetween(*whole)).alias("most"))
    shared = sides.withColumn("all_least", F.min("side").over(pattern)).withColumn("all_most", F.max("side").over(pattern))
    return shared.where("rn = 1 and side = most and all_least < all_most").select("pattern", "instance", F.when(F.col("side") == 2, "added").otherwise("removed").alias("status"))


def cache_plan(old: DataFrame, new: DataFrame, impact: DataFrame, key: str) -> DataFrame:
    """key, plan: hit, miss or evicted."""
    now, hot = new.select(key).distinct(), impact.select(key).distinct()
    hit = now.join(hot, key, "left_anti").withColumn("plan", F.lit("hit"))
    miss = now.join(hot, key, "left_semi").withColumn("plan", F.lit("miss"))
    gone = old.select(key).distinct().join(now, key, "left_anti").withColumn("plan", F.lit("evicted"))
    return hit.unionByName(miss).unionByName(gone)
