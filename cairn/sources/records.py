"""Readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import matches_any
from ..operators.matching import first_match

LANGUAGES = [("dotenv-template", r"(?i)(^|/)\.env(\..+)?\.(example|template)$"), ("javascript-jsx", r"(?i)\.jsx$"), ("javascript", r"(?i)\.[mc]?js$"), ("typescript-tsx", r"(?i)\.tsx$"), ("typescript", r"(?i)\.[mc]?ts$"), ("json", r"(?i)\.json$"), ("markdown", r"(?i)\.mdx?$"), ("yaml", r"(?i)\.ya?ml$"), ("html", r"(?i)\.html$"), ("stylesheet", r"(?i)\.(css|scss|less)$"), ("sql", r"(?i)\.sql$"), ("python", r"(?i)\.py$"), ("shell", r"(?i)\.(sh|ps1)$")]
KINDS = [("test", r"(?i)(^|/)(test|tests|__tests__|e2e)(/|$)|(^|[./])(spec|test)\.[^./]+$"), ("source", r"(?i)\.([mc]?[jt]s|[jt]sx)$"), ("documentation", r"(?i)\.mdx?$"), ("configuration", r"(?i)\.(json|ya?ml)$|(^|/)(dockerfile|tsconfig|jsconfig|package\.json)|\.env(\..+)?\.(example|template)$")]


def language(path: Column) -> Column:
    """Language by name (S4); an unknown extension is its own name."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.coalesce(F.nullif(first_match(path, LANGUAGES, ""), F.lit("")), F.nullif(extension, F.lit("")), F.lit("unknown"))


def kind(path: Column) -> Column:
    """Kind by path, first match wins."""
    return first_match(path, KINDS, "other")


def census(spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int = 8 << 20) -> DataFrame:
    """path, sha256, bytes, binary, too_large, language, kind of the files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:(//)?", "")
    relative = F.expr("substring(p, length(b) + 2)")
    rows = files.withColumn("p", F.regexp_replace("path", "^file:(//)?", "")).withColumn("b", base).withColumn("path", relative)
    if exclude:
        rows = rows.where(~matches_any(F.col("path"), exclude))
    large = F.col("length") > max_bytes
    return rows.select("path", F.when(~large, F.sha2("content", 256)).alias("sha256"), F.col("length").alias("bytes"), F.contains(F.substring("content", 1, 8192), F.lit(b"\x00")).alias("binary"), large.alias("too_large"), language(F.col("path")).alias("language"), kind(F.col("path")).alias("kind"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON with a fixed schema; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Rows as JSON with sorted keys, sorted by ``order`` over all files; never replaces."""
    rows = df.orderBy(order).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = hadoop(path), hadoop(f"{path}._{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    rows.write.text(draft.toString())
    if not fs.rename(draft, target):
        raise OSError(f"cannot publish {path}")


def index_records(raw: DataFrame) -> DataFrame:
    """mode, oid, stage, path of ``mode oid stage<TAB>path`` records (column value)."""
    part = lambda i: F.regexp_extract("value", r"^(\d{6}) ([0-9a-f]{40,64}) ([0-3])\t(?s)(.*)$", i)
    return raw.select(part(1).alias("mode"), part(2).alias("oid"), part(3).cast("int").alias("stage"), part(4).alias("path")).where("mode <> ''")


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, href of all links of the pages."""
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
