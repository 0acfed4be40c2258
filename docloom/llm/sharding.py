"""Sharding: jump consistent hashing of stable keys (Lamping & Veach, 2014), without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key. Appending a shard moves 1/(shards+1) of the keys, all into the new one."""
    key = keys.astype(np.uint64)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            live = live[j[live] < shards]
    return b.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    """``key`` (any stable value) -> its shard, as an Arrow-batched function. Null is a key like any other."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return shard(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 100_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    The shard depends on the id and the shard count alone. Slots are numbered without gaps from 0 in each shard:
    rows are numbered within hashed parts of about ``part_rows`` rows of every shard, and the offset of each part comes from the
    counts of the parts, so no task gets a whole shard. The counts are a row for each part; Spark broadcasts them if they are small.

    Nulls: a null id is a key of its own; a null text counts as no text (size 16, checksum 0). Rows that repeat an
    id share a shard and get slots of their own. Other columns of ``docs``, whatever their names, are not read. An empty
    table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        "doc_id",
        (F.octet_length("_t") + F.lit(16)).cast("long").alias("size"),
        F.crc32("_t").alias("text_crc32"),
    )
    from pyspark.sql import Window

    parts = max(256, -(-docs.count() // (shards * part_rows)))
    placed = base.withColumns({
        "shard": shard_column(F.col("doc_id"), shards),
        "grown_shard": shard_column(F.col("doc_id"), shards + 1),
        "_part": F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text_crc32"), F.lit(parts)).cast("int"),
    })
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.col("shard").alias("_s"), F.col("_part").alias("_p"),
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    numbered = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_rn") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet in one folder per shard, with all its columns."""
    name = next(c for c in ("shard", "_shard", "_docloom_shard") if c not in docs.columns)
    docs.withColumn(name, shard_column(F.col(id_col), shards)).write.partitionBy(name).parquet(path)
