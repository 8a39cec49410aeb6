"""Sharding by jump consistent hash (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit key. Needs no table; one more bucket takes 1/(buckets + 1)
    of the keys into itself and moves no other."""
    state = keys.astype(np.uint64).copy()
    bucket = np.full(len(state), -1, np.int64)
    reach = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = reach[live]
            state[live] = state[live] * _MULTIPLIER + np.uint64(1)
            scale = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            reach[live] = ((bucket[live] + 1).astype(np.float64) * scale).astype(np.int64)
            live = live[reach[live] < buckets]
    return bucket


def assign_shards(df: DataFrame, key: Column, n: int, grown: int | None = None) -> DataFrame:
    """Add shard (int) and, if ``grown`` is given, the shard under that count as grown_shard.

    The key's hash and the count alone decide. A null key hashes as a null (one shard for all);
    equal keys share a shard. Runs row by row, without a shuffle."""
    counts = [n] + [grown] * (grown is not None)
    names = ["shard", "grown_shard"][: len(counts)]
    taken = [c for c in df.columns if c not in (*names, "__key")]
    source = df.select(*(F.col(f"`{c}`") for c in taken), F.xxhash64(key).alias("__key"))
    schema = source.drop("__key").schema
    for name in names:
        schema = schema.add(name, "integer", False)

    def run(batches):
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            shards = [pa.array(jump(keys, c), pa.int32()) for c in counts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *shards], names=[*taken, *names])

    return source.mapInArrow(run, schema)


def number_rows(df: DataFrame, shard: str, order: list[str], per_bucket: int = 200_000) -> DataFrame:
    """Add slot: 0, 1, 2, ... within each shard, with no gap.

    A shard is cut into buckets by the hash of the order columns; rows are numbered in each bucket,
    and the buckets' bases are prefix sums of their counts. No task holds a whole shard."""
    rows = df.count()
    shards = max(1, df.select(shard).distinct().count())
    buckets = max(1, -(-rows // (shards * per_bucket)))
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ahead = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(shard, "__bucket").orderBy(*order)
    return (
        cut.withColumn("__row", F.row_number().over(within) - 1)
        .join(bases, [shard, "__bucket"])
        .withColumn("slot", (F.col("__base") + F.col("__row")).cast("long"))
        .drop("__bucket", "__row", "__base")
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of Parquet files per shard; hot shards get several files."""
    df.write.partitionBy(shard).parquet(path)


def op5_jump_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` shards under the law ``key``. Null text counts 16 bytes and crc32
    of nothing; an empty table gives no rows; repeated rows share a shard and get slots of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed, _ = materialize(assign_shards(sized, F.col("doc_id"), shards, shards + 1), "shards")
    return number_rows(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
