"""Cubes as DataFrames: one row per pixel, ``scene_id, pixel_id, y, x, spectrum`` and any others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Track:
    """What a detector may know of the target."""

    name: str
    exact_target: bool
    family: bool
    description: str


TRACKS = (
    Track("exact", True, True, "the target's own spectrum is given"),
    Track("family", False, True, "a family of plausible spectra is given"),
    Track("blind", False, False, "nothing of the target is given"),
)


def pixels_from_vectors(vectors: DataFrame, width: int = 25, scene: str = "scene") -> DataFrame:
    """Rows of (vec_id, embedding, label) as pixels in row-major order of ``width`` columns."""
    return vectors.select(
        F.lit(scene).alias("scene_id"),
        F.col("vec_id").alias("pixel_id"),
        F.expr(f"cast(vec_id div {width} as int)").alias("y"),
        F.expr(f"cast(vec_id % {width} as int)").alias("x"),
        F.col("embedding").cast("array<double>").alias("spectrum"),
        F.col("label"),
    )


def nodata(spectrum: str = "spectrum", sentinel: float = 0.0):
    """Whether every band holds the sentinel (which may be NaN)."""
    return F.forall(spectrum, lambda v: F.isnan(v) if sentinel != sentinel else v == sentinel)


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """Rows of ``df``; the job fails at the first one for which the condition is false or null."""
    return df.where(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def increasing(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose array column isn't strictly increasing."""
    bad = F.exists(F.arrays_zip(F.slice(value, 1, F.greatest(F.size(value) - 1, F.lit(0))).alias("a"), F.slice(value, 2, F.greatest(F.size(value) - 1, F.lit(0))).alias("b")), lambda p: p["a"] >= p["b"])
    return df.where(bad).select(key)
