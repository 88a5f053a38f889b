"""Sharding by jump consistent hashing.

The key alone gives the shard, with no table of a ring; one more shard takes only rows into itself.
Rows are numbered inside their shard without gathering a shard in a task: each input task counts
its own rows per shard, and the counts of the tasks before it are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut


def mix64(keys: np.ndarray) -> np.ndarray:
    """Spread integer keys over 64 bits (the finalizer of splitmix64)."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key: the last of its jumps that stays under ``shards``."""
    key = mix64(keys)
    here, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = ahead < shards
    while moving.any():
        here[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[moving] = np.minimum((here[moving] + 1) * step, float(1 << 62)).astype(np.int64)
        moving = ahead < shards
    return here.astype(np.int32)


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    A null text has size 1 and the checksum of nothing; a null key goes with key 0; rows with equal
    keys share a shard and have slots of their own; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            local += seen[shard]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(shard), pa.array(local), pa.array(grown), pa.array(np.full(len(shard), part, np.int32))],
                names=["doc_id", "size", "text_crc32", "shard", "local", "grown_shard", "part"],
            )

    rows = cut(slim.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, local long, grown_shard int, part int"), "shard-rows")
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shard-starts")
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("local")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` as Parquet in one folder per shard, with all their columns but one
    called ``shard``, which the folders replace. A null key goes with key 0; an empty table writes none."""

    def shard_of(keys):
        import pandas as pd

        return pd.Series(jump_hash(keys.fillna(0).to_numpy(np.int64), shards))

    docs.withColumn("shard", F.pandas_udf(shard_of, "int", F.PandasUDFType.SCALAR)(F.col(key).cast("long"))).write.partitionBy("shard").parquet(path)
