"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; with one more shard, keys move only into it."""
    key, at = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
    ahead, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(open_):
        at[open_] = ahead[open_]
        key[open_] = key[open_] * _STEP + np.uint64(1)
        far = (at[open_] + 1).astype(np.float64) * (2147483648.0 / ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        ahead[open_] = np.minimum(far, 2.0**62).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return at


def assign(df: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add ``out``, the shard that the key alone (hashed by XXH64) and ``shards`` decide.

    A null key is a key like any other. No shuffle and no ring table; other
    columns are untouched, and a column named ``out`` is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def of(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return df.withColumn(out, F.pandas_udf(of, "int")(F.xxhash64(F.col(key))))


def with_slots(df: DataFrame, shards: int, shard: str = "shard", key: str = "doc_id", rows_per_part: int = 50_000, out: str = "slot") -> DataFrame:
    """Add ``out``, a gapless number from 0 within each shard.

    A shard is numbered in parts by a hash of key and row, each part behind
    the counts of those before it, so no task sorts a whole shard. Only the
    table of part sizes is summed over a shard. Repeated rows get slots in
    any order. ``__part``, ``__local`` and ``__start`` are this function's own
    columns: a table that has them loses them.
    """
    rows = df.count()
    parts = max(1, -(-rows // (shards * rows_per_part)))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(parts)), F.lit(parts)).cast("int")
    df = df.withColumn("__part", spread)
    sizes = df.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(shard, "__part").orderBy(key))
    return df.withColumn("__local", local).join(sizes, [shard, "__part"]).withColumn(out, F.col("__start") + F.col("__local") - 1).drop("__part", "__local", "__start")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write all rows below ``path``, a folder for each shard."""
    assign(df, shards, key).write.partitionBy("shard").parquet(path)


def op5_sharding(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, slot, and shard with one more shard of every document, by the law ``key``; a null text has size 16."""
    thin = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    both = assign(assign(thin, shards), shards + 1, out="grown_shard")
    return with_slots(both, shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
