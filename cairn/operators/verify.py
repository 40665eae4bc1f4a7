"""Constraints as tables of violations, which must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unsorted(df: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Rows whose key is below that of the row before in the order of ``ordinal``, which may have gaps (V7).

    Rows are compared in blocks of 1024 ordinals; the first of a block with the
    last key of the nearest block before it that has rows.  That one is found
    among the blocks of the same 1024, else among the last blocks of those, so
    the only window without a partition has a row per million ordinals.
    """
    block = df.withColumn("b", F.floor(F.col(ordinal) / 1024))
    inner = block.withColumn("before", F.lag(key).over(Window.partitionBy("b").orderBy(ordinal)))
    ends = block.groupBy("b").agg(F.max_by(key, ordinal).alias("last")).withColumn("g", F.floor(F.col("b") / 1024))
    near = ends.select("b", "g", F.lag("last").over(Window.partitionBy("g").orderBy("b")).alias("near"))
    far = ends.groupBy("g").agg(F.max_by("last", "b").alias("last")).select("g", F.lag("last").over(Window.orderBy("g")).alias("far"))
    ahead = near.join(far, "g").select("b", F.coalesce("near", "far").alias("last"))
    return inner.join(ahead, "b", "left").where(F.col(key) < F.coalesce("before", "last")).select(ordinal, key)


def digest_mismatch(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """Paths whose digest or length differs from the manifest, or that one side lacks (V2, V9)."""
    both = manifest.select("path", "sha256", "bytes").join(content.select("path", F.col("sha256").alias("s"), F.col("bytes").alias("b")), "path", "full_outer")
    return both.where("sha256 is null or s is null or sha256 <> s or bytes <> b").select("path")


def portable(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Ids of rows that hold a forbidden pattern; the value itself is not returned."""
    return df.where(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)))


def wrong_id(df: DataFrame, prefix: str, id_column: str, *parts: str) -> DataFrame:
    """Rows whose id is not the hash of their parts."""
    return df.where(F.col(id_column) != T.content_id(prefix, *(F.col(p) for p in parts))).select(id_column)


def nonconforming(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: the rules that a row breaks; a rule that is null is broken (V4, V8)."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def not_canonical(df: DataFrame, key: str, line: str, columns: list[str]) -> DataFrame:
    """Keys of rows whose stored line is not the canonical encoding of their columns (V3)."""
    return df.where(~F.col(line).eqNullSafe(T.canonical_json(*columns))).select(key)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``a`` with n, by how many more ``a`` has than ``b``; below zero: fewer."""
    both = a.withColumn("n", F.lit(1)).unionByName(b.select(*a.columns).withColumn("n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("n").alias("n")).where("n <> 0")


def wrong_instance_count(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """id, declared, found of findings whose instance_count is not their number of instances (finding); without instances it is one or null."""
    n = instances.groupBy(F.col("finding").alias("id")).agg(F.count("*").alias("found"))
    rows = findings.select("id", F.col("instance_count").alias("declared")).join(n, "id", "left")
    bad = F.when(F.col("found").isNull(), F.coalesce("declared", F.lit(1)) != 1).otherwise(~F.col("declared").eqNullSafe(F.col("found")))
    return rows.where(bad).select("id", "declared", F.coalesce("found", F.lit(0)).alias("found"))


def wrong_metadata(stored: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose stored columns differ from those computed again, or that one side lacks."""
    pair = stored.select(key, F.struct(*columns).alias("a")).join(computed.select(key, F.struct(*columns).alias("b")), key, "full_outer")
    return pair.where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def wrong_counts(declared: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """kind, declared, found of tables whose size is not the declared one (kind, n)."""
    found = None
    for kind, df in tables.items():
        one = df.agg(F.count("*").alias("found")).withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return declared.join(found, "kind", "full_outer").where(~F.col("n").eqNullSafe(F.col("found"))).select("kind", F.col("n").alias("declared"), "found")


def compatibility(old: DataFrame, new: DataFrame, fields: dict[str, str]) -> DataFrame:
    """reason: the codes of the fields in which two runs (a row each) differ (V18, V19); without a row on a side every code."""
    named = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(code).alias("reason"), F.to_json(F.struct(F.col(c))).alias("v")) for c, code in fields.items()))))
    pair = named(old).join(named(new).withColumnRenamed("v", "w"), "reason", "full_outer")
    return pair.where(~F.col("v").eqNullSafe(F.col("w"))).select("reason").distinct()


def wrong_health(stored: DataFrame, findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules whose stored health (rule_id, n, state) is not that of the findings."""
    from .aggregates import rule_health

    return wrong_metadata(stored, rule_health(catalog, findings), "rule_id", ["n", "state"])
