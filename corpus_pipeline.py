"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a
DataFrame; run() writes it as Parquet in the shared folder and reads it again for the next one. All
but the last return the columns of documents. SQL can't express the stages (iterated components,
edit distance, a tokenizer), so there is no ORACLE_SQL; tests/llm compares the documents that are
left with a plain-Python pipeline over a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, lines, packing, quality, simhash
from lodestone.llm.common import materialize

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs come from the labels of documents still here. Null and
    empty texts go, repeated rows share a verdict; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first one stays; a document of which nothing is left goes, so of
    rows repeated as a whole one stays. Null texts stay as they are; an empty table stays empty."""
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (null first, ties by a hash of
    the text) stays. Texts without a word, null ones included, all stay; an empty table stays empty."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, all of equal ones. Null and empty texts hold none;
    null items are left out, and an empty benchmark or table changes nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of tokens. Null and empty texts are their end id, repeated rows are packed
    each; an empty table gives no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
