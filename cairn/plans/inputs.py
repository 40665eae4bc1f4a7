"""The driver's tables as records: files, edges, findings, generations, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        kind = F.when(F.col("source").isin("src0", "src1"), "test").when(F.col("source").isin("src2", "src3"), "configuration").otherwise("source")
        path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.documents.select(F.concat(F.lit("file_"), F.col("doc_id").cast("string")).alias("id"), path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), kind.alias("kind"), F.col("lang").alias("language"))

    def _relations(self, once: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """src, dst, type; ``once`` is applied to the keys of the tables in which a relation may repeat."""
        name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
        edge = lambda df, a, p, b, q, t: df.select(name(a, p).alias("src"), name(b, q).alias("dst"), F.lit(t).alias("type"))
        keys = lambda df, a, b: once(df.select(a, b))
        parts = [
            edge(keys(self.orders, "o_custkey", "o_orderkey"), "o_custkey", "c", "o_orderkey", "o", "places"),
            edge(keys(self.lineitem, "l_orderkey", "l_partkey"), "l_orderkey", "o", "l_partkey", "p", "contains"),
            edge(keys(self.lineitem, "l_partkey", "l_suppkey"), "l_partkey", "p", "l_suppkey", "s", "supplied_by"),
            edge(self.supplier, "s_suppkey", "s", "s_nationkey", "n", "located_in"),
            edge(self.nation, "n_nationkey", "n", "n_regionkey", "r", "part_of"),
        ]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    @property
    def edges(self) -> DataFrame:
        """Each edge once; repeats go while the keys are numbers, which take less than names."""
        return self._relations(DataFrame.distinct)

    @property
    def arcs(self) -> DataFrame:
        """The edges with repeats, for operators that take them as a set: nothing is shuffled to make them."""
        return self._relations(lambda keys: keys)

    @property
    def findings(self) -> DataFrame:
        v = F.col("value")
        severity = F.when(v >= 75, "high").when(v >= 50, "medium").when(v >= 25, "low").otherwise("info")
        confidence = F.when(F.col("user_id") % 3 == 0, "high").when(F.col("user_id") % 3 == 1, "medium").otherwise("low")
        return self.events.where("value is not null").select(F.concat(F.lit("finding:"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("rule_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), severity.alias("severity"), confidence.alias("confidence"), F.floor(v).cast("bigint").alias("instance_count"), F.col("props").alias("pattern_key"))

    @property
    def old(self) -> DataFrame:
        return self.orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("identity"), F.col("o_orderstatus").alias("val"))

    @property
    def new(self) -> DataFrame:
        return self.orders.where("o_orderkey % 10 <> 4").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("identity"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("val"))


SQL = {
    "files": "files as (select concat('file_', cast(doc_id as varchar)) as id, concat(source, '/', lang, '/', cast(doc_id as varchar), '.txt') as path, sha256(text) as sha256, cast(strlen(text) as bigint) as bytes, case when source in ('src0', 'src1') then 'test' when source in ('src2', 'src3') then 'configuration' else 'source' end as kind, lang as language from documents)",
    "edges": "edges as (select distinct concat('c', o_custkey) as src, concat('o', o_orderkey) as dst, 'places' as type from orders union all select distinct concat('o', l_orderkey), concat('p', l_partkey), 'contains' from lineitem union all select distinct concat('p', l_partkey), concat('s', l_suppkey), 'supplied_by' from lineitem union all select concat('s', s_suppkey), concat('n', s_nationkey), 'located_in' from supplier union all select concat('n', n_nationkey), concat('r', n_regionkey), 'part_of' from nation)",
    "findings": "findings as (select concat('finding:', event_id) as id, event_type as rule_id, concat('u', user_id) as path, case when value >= 75 then 'high' when value >= 50 then 'medium' when value >= 25 then 'low' else 'info' end as severity, case user_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, cast(floor(value) as bigint) as instance_count, props as pattern_key from events where value is not null)",
    "old": "old as (select o_orderkey as key, o_custkey as identity, o_orderstatus as val from orders where o_orderkey % 10 <> 3)",
    "new": "new as (select o_orderkey as key, o_custkey as identity, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as val from orders where o_orderkey % 10 <> 4)",
}


def sql(body: str, *names: str, recursive: bool = False, ctes: str = "") -> str:
    """A query over the named inputs; ``ctes`` are further ones of its own."""
    parts = [SQL[n] for n in names] + ([ctes] if ctes else [])
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
