"""Frozen models over streams: calibrated offline, applied to each micro-batch without state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import dot


@dataclass(frozen=True)
class FrozenFilter:
    """Weights, offset and threshold of a linear detector."""

    weights: tuple[float, ...]
    offset: float
    threshold: float

    def apply(self, pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
        scored = pixels.withColumn("score", dot(spectrum, self.weights) + F.lit(self.offset))
        return scored.withColumn("detected", F.col("score") > F.lit(self.threshold))


    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row under ``path``, in any store Spark knows."""
        spark.createDataFrame([(list(self.weights), self.offset, self.threshold)], _MODEL).coalesce(1).write.json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FrozenFilter:
        row = spark.read.schema(_MODEL).json(path).first()
        return FrozenFilter(tuple(row["weights"]), row["offset"], row["threshold"])


_MODEL = "weights array<double>, offset double, threshold double"


def read_pixels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def write_scores(scored: DataFrame, path: str, checkpoint: str):
    """A query that writes what there is and stops."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, ts: str, key: str, value: str, threshold: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of values above a threshold by window and key; late rows beyond the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg((F.col(value) > threshold).cast("double")).alias("rate")).select(F.col("w.start").alias("start"), key, "n", "rate")
