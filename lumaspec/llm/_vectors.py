"""Vectors that can be compared, with equal ones as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut


def comparable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of rows that are not null, not zero and all finite, of any length. Floats stay
    floats, which halves what is moved; tasks compute in doubles."""
    plain = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    x = F.col("v")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if plain else "array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    )


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """``cid, v, copies, ids``: equal vectors are one class, named by its least id, with its ``ids``
    least ones. Each task passes on few rows of a vector, however often that is there."""
    least = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= ids)
    kept = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    count = rows.groupBy("v").agg(F.count("*").alias("copies"))
    return cut(kept.join(count, "v").select(F.element_at("ids", 1).alias("cid"), "v", "copies", "ids"), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of at most ``width`` values as rows of doubles with zeros after them, and their lengths."""
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, length
