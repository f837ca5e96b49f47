"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard is a function of the key and the number of shards alone: no ring table, and one more shard takes rows only
into itself, 1/(n+1) of them. Null keys hash like any other value (one fixed hash), so rows without a key share a shard.
Texts are only measured, never moved. Repeated rows keep their own slots; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, repeated, table


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards, 0 to shards-1, of 64-bit keys."""
    key, bucket, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump = (bucket[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        ahead[live] = np.minimum(jump, 2.0**62).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a hashed (long) key, as an int column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def sharded(df: DataFrame, keys: list[str], shards: int, out: str = "shard") -> DataFrame:
    """df with the shard of each row's key columns; a column named ``out`` is replaced."""
    return df.withColumn(out, shard_of(F.xxhash64(*keys), shards))


def write_shards(df: DataFrame, keys: list[str], shards: int, path: str, parts: int = 1) -> None:
    """Writes one folder a shard, rows of a shard spread over ``parts`` files by their whole content."""
    placed = sharded(df, keys, shards)
    placed.repartition(shards * parts, "shard", F.pmod(F.xxhash64(*df.columns), F.lit(parts))).write.partitionBy("shard").parquet(path)


def op1_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents by law ``key``. Equal digest rows are counted before the shuffle and expanded after numbering."""
    digest = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    counted = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumns({"shard": shard_of(F.xxhash64("doc_id"), shards), "grown_shard": shard_of(F.xxhash64("doc_id"), shards + 1)})
    slots = repeated(numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "_first", "_n"), "_n", "_i")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).alias("slot"), "grown_shard")
