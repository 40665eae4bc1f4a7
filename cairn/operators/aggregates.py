"""Aggregations, window-like operators and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CONFIDENCE, SEVERITY, rank, value
from .graph import cut


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """(A1, A2)"""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_by_severity(df: DataFrame, key: str) -> DataFrame:
    """Total and one column per severity (A3, A4); zeros are kept."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY))


def pattern_groups(findings: DataFrame) -> DataFrame:
    """Findings (rule_id, pattern_key, id, path, severity, confidence) rolled up by pattern.

    Severity is the highest, confidence the lowest, the primary the first by
    path and id.  A single finding keeps its id, a group gets one from the ids.
    """
    w = F.struct("path", "id")
    by = findings.groupBy("rule_id", "pattern_key").agg(
        F.count("*").alias("instance_count"),
        F.max(rank(F.col("severity"), SEVERITY)).alias("s"),
        F.min(rank(F.col("confidence"), CONFIDENCE)).alias("c"),
        F.min(w).alias("primary"),
        F.array_join(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["id"]), ",").alias("ids"),
    )
    made = T.content_id("finding", F.col("rule_id"), F.col("pattern_key"), F.col("ids"))
    return by.select("rule_id", "pattern_key", "instance_count", value(F.col("s"), SEVERITY).alias("severity"), value(F.col("c"), CONFIDENCE).alias("confidence"), F.col("primary.path").alias("path"), F.when(F.col("instance_count") == 1, F.col("primary.id")).otherwise(made).alias("id"))


def sole_or(column: str, many: str = "mixed", none: str = "unknown") -> Column:
    """The only value of a group, else ``many``; ``none`` if a row has none."""
    return F.when(F.count(column) < F.count(F.lit(1)), none).when(F.min(column) == F.max(column), F.min(column)).otherwise(many)


def capped_severity(severity: Column, ceiling: Column) -> Column:
    """Severity no higher than the ceiling; never upgraded (A10)."""
    return value(F.least(rank(severity, SEVERITY), rank(ceiling, SEVERITY)), SEVERITY)


def ceiling(lifecycle: Column, reachability: Column, scope: Column, gate: Column) -> Column:
    """The static ceiling: mothballed and unreachable low, tests low, ungated production high, else medium (A10)."""
    return F.when((lifecycle == "mothballed") | (reachability == "unreachable") | (scope == "test"), "low").when((reachability == "reachable") & (scope == "production") & (gate == "not-observed"), "high").otherwise("medium")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Groups of files with equal bytes and digest."""
    return files.groupBy("bytes", "sha256").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.count_distinct("language").alias("languages")).where("n >= 2")


def repeated_over_paths(fragments: DataFrame, key: str) -> DataFrame:
    """Keys with at least two rows on at least two paths."""
    return fragments.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths")).where("n >= 2 and paths >= 2")


def drifting(facts: DataFrame, field: str, signature: str) -> DataFrame:
    """Fields with at least two different signatures."""
    return facts.groupBy(field).agg(F.count("*").alias("n"), F.count_distinct(signature).alias("signatures")).where("n >= 2 and signatures >= 2")


def set_signature(column: str) -> Column:
    """Hash of a group's sorted distinct values."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ","), 256)


def first_values(df: DataFrame, key: str, column: str, most: int, name: str) -> DataFrame:
    """``key``, the first ``most`` distinct values in order (joined), and how many more there are.

    Ranks are limited before the shuffle, so no task gets all values of a key.
    """
    values = df.select(key, column).distinct()
    rn = F.row_number().over(Window.partitionBy(key).orderBy(column))
    first = values.withColumn("rn", rn).where(F.col("rn") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", column))), lambda x: x[column].cast("string")), ",").alias(name))
    return first.join(values.groupBy(key).agg(F.greatest(F.count("*") - most, F.lit(0)).cast("bigint").alias("more")), key)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in a total order: ranges of the order are numbered each by itself and set off by their sizes.

    The ranges are checkpointed, since their bounds come from a sample.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    start = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__rn", inside).join(F.broadcast(start), "__range").withColumn(name, (F.col("__start") + F.col("__rn")).cast("bigint")).drop("__range", "__rn", "__start")


def packets(files: DataFrame, batch: int) -> DataFrame:
    """packet_no, files and token estimate of batches in path order."""
    files, rn = ranked(files, [F.col("path")], "rn"), F.col("rn")
    return files.withColumn("packet_no", F.floor((rn - 1) / batch).cast("bigint")).groupBy("packet_no").agg(F.count("*").alias("files"), F.ceil(F.sum("bytes") / 4).cast("bigint").alias("tokens"))


def running_flag(lines: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Whether the flag was set on this line or an earlier one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("running", F.max(F.col(flag).cast("int")).over(w) == 1)


def broken_chain(attempts: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Attempts that follow one that was not failed."""
    w = Window.partitionBy(key).orderBy(order)
    return attempts.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != "failed"))


def review_order(findings: DataFrame) -> DataFrame:
    """Findings with their place in review order: severity, impact, confidence, instances, identity, id (O2)."""
    return ranked(findings, [F.col("severity_rank"), F.col("impact_rank"), F.col("confidence_rank"), F.desc("instance_count"), F.col("identity"), F.col("id")], "place")


def mode(key: str, column: str, counts: DataFrame) -> DataFrame:
    """The most frequent value per key, the least of equals."""
    n = counts.groupBy(key, column).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max("n").alias("top"), F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between clusters with counts (A26); they are counted by source cluster and target before the targets are looked up."""
    side = lambda n: clusters.select(F.col("node").alias(n), F.col("cluster").alias(f"{n}_cluster"))
    counts = edges.join(side("src"), "src").groupBy("src_cluster", "dst", "type").agg(F.count("*").alias("n"))
    return counts.join(side("dst"), "dst").groupBy("src_cluster", "dst_cluster", "type").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """column, n for every value of a fixed domain, zeros included (A4)."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return F.broadcast(values).join(counts_by(df, column), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rule_health(catalog: DataFrame, findings: DataFrame) -> DataFrame:
    """rule_id, n, state of each rule of the catalog (rule_id, least, most): missing, noisy or ok."""
    n = F.coalesce("n", F.lit(0))
    rows = catalog.join(counts_by(findings, "rule_id"), "rule_id", "left").withColumn("n", n)
    return rows.select("rule_id", "n", F.when(F.col("n") < F.col("least"), "missing").when(F.col("n") > F.col("most"), "noisy").otherwise("ok").alias("state"))


def suppressed_by_rule(findings: DataFrame, states: DataFrame) -> DataFrame:
    """rule_id, instances of the findings that dispositions suppress."""
    gone = findings.join(states.where("state = 'suppressed'").select("id"), "id", "left_semi")
    return gone.groupBy("rule_id").agg(F.sum(F.coalesce("instance_count", F.lit(1))).alias("instances"))


def merged_contexts(rows: DataFrame, key: list[str], column: str, most: int = 64) -> DataFrame:
    """key, contexts, more: the first ``most`` distinct contexts of each anchor and how many are left."""
    wide = rows.withColumn("__key", F.struct(*key))
    return first_values(wide, "__key", column, most, "contexts").select(*(F.col(f"__key.{k}").alias(k) for k in key), "contexts", "more")


def queue_groups(findings: DataFrame, key: list[str], most: int = 4) -> DataFrame:
    """key, findings, instances, anchors, best: groups of the work queue.

    Anchors are distinct paths, at most ``most`` of each finding (its array
    ``paths``); the best finding is the first by severity and id.
    """
    anchors = findings.select(*key, F.explode(F.slice("paths", 1, most)).alias("path")).distinct().groupBy(*key).agg(F.count("*").alias("anchors"))
    sums = findings.groupBy(*key).agg(F.count("*").alias("findings"), F.sum(F.coalesce("instance_count", F.lit(1))).alias("instances"), F.min_by("id", F.struct(-rank(F.col("severity"), SEVERITY), F.col("id"))).alias("best"))
    return sums.join(anchors, key)


def subjects(differences: DataFrame, key: list[str], column: str) -> DataFrame:
    """key and the dimensions in which a subject differs (A28); there are a few dimensions."""
    return differences.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("dimensions"))


def over_limit(files: DataFrame, column: str, most: int) -> DataFrame:
    """total, if the sum of a column is beyond a limit."""
    return files.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total")).where(F.col("total") > most)


def occurrence_with_omitted(visible: DataFrame, omitted: DataFrame, identity: str = "identity", order: str = "id") -> DataFrame:
    """Visible rows with their review_id; suppressed rows of the same identity are counted too."""
    from .matching import occurrence_keys

    rows = visible.withColumn("__seen", F.lit(True)).unionByName(omitted.withColumn("__seen", F.lit(False)))
    return occurrence_keys(rows, identity, order).where("__seen").drop("__seen")


def clusters_with_tail(edges: DataFrame, clusters: DataFrame, most: int) -> DataFrame:
    """Edges between clusters with counts; all but the ``most`` largest clusters are 'other' (A26)."""
    top = clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(most).select("cluster", F.lit(True).alias("keep"))
    named = clusters.join(F.broadcast(top), "cluster", "left").select("node", F.when(F.col("keep"), F.col("cluster")).otherwise("other").alias("cluster"))
    return cluster_edges(edges, named)
