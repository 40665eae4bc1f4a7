"""Lexical search over record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lexical(query: str, k: int, files: DataFrame, relationships: DataFrame | None = None, findings: DataFrame | None = None, diagnostics: DataFrame | None = None) -> DataFrame:
    """kind, id, score, label of the best ``k`` (1 to 500) records (Q1).

    Each table has id and label; a file whose path is the query gets 200 more,
    a finding with any hit 10 more.  Scores are compiled expressions, so the
    tables are scanned once and only the top k leave each task.
    """
    words = T.terms(query)
    parts = [files.select(F.lit("file").alias("kind"), "id", "label", (T.score(F.col("label"), words) + F.when(F.lower("path") == query.lower(), 200).otherwise(0)).alias("score"))]
    for kind, df, bonus in (("relationship", relationships, 0), ("finding", findings, 10), ("diagnostic", diagnostics, 0)):
        if df is not None:
            s = T.score(F.col("label"), words)
            parts.append(df.select(F.lit(kind).alias("kind"), "id", "label", F.when(s > 0, s + bonus).otherwise(0).alias("score")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("score > 0").orderBy(F.desc("score"), "id").limit(max(1, min(k, 500)))


def weighted(query: str, fields: DataFrame, weights: dict[str, int], k: int) -> DataFrame:
    """id, score: rows (id, field, value) score weight per term held, five times it if equal; best per field, then summed (Q2)."""
    words, low = T.terms(query), F.lower("value")
    weight = F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(w))))[F.col("field")]
    hits = F.lit(0)
    for t in words:
        hits = hits + F.when(low == t, 5).when(F.contains(low, F.lit(t)), 1).otherwise(0)
    best = fields.withColumn("s", hits * weight).where("s > 0").groupBy("id", "field").agg(F.max("s").alias("s"))
    return best.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(max(1, min(k, 100)))
