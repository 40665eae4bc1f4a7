"""From documents to token files: filter, deduplicate, decontaminate, mix, encode.

Each stage takes all rows of its predecessor, with whatever columns they have
besides doc_id, text, lang and source, and returns rows with the same columns,
but for the last.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, mixing, near_copies, quality, simhash, tokenize
from cairn.llm._store import Workspace, clear, made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules keep.

    A null or empty text has no words and goes; a null language is a stratum of
    its own; rows without doc_id are judged but never labelled; repeated rows
    are each judged.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: linked by fingerprints, or four fifths of five-word shingles alike.

    The document whose doc_id is the least of its group stays; repeated rows of
    one doc_id and text count as one; texts without words are alike; rows
    without doc_id stay.
    """
    return simhash.keep_one(docs, also=near_copies.similar(docs, Workspace(spark, "near-copies")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none; all rows of a doc_id go with one of them;
    rows without doc_id stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice, by temperature.

    A null source is one of its own; documents without words come once;
    repeated rows are each taken.
    """
    return mixing.mixed_documents(docs, budget_share=None, repeats=2.0)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a row for each document in them.

    A null text is empty and gives the end id only; rows without doc_id come
    first; repeated rows are all written.
    """
    import public_tokenizers

    return tokenize.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Encoding has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    store = Workspace(spark, "pipeline")
    others = made()  # results of other calls may still be read
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir))
        clear(spark, keep=others)
    return STAGES[-1][1](spark, docs, sf_dir)
