"""What learned detectors over per-pixel features need before and after training (:mod:`nets`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import average_ranks, match


def standardised(df: DataFrame, features: list[str], keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Each feature less its mean, over its population deviation plus ``eps``, within keys."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    out = match(df, df.groupBy(*keys).agg(*aggs), keys)
    out = out.withColumns({f: (F.col(f) - F.col(f"m_{f}")) / (F.col(f"s_{f}") + eps) for f in features})
    return out.drop(*[f"{p}_{f}" for f in features for p in "ms"])


def ensemble(df: DataFrame, keys: list[str], logit: str, eps: float = 1e-7) -> DataFrame:
    """``keys, logit`` of the mean of members' probabilities."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.avg(1 / (1 + F.exp(-F.col(logit))))))
    return df.groupBy(*keys).agg(p.alias("p")).select(*keys, F.ln(F.col("p") / (1 - F.col("p"))).alias("logit"))


def empirical_quantile(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds rank / (n + 1) with shared ranks."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n_"))
    ranked = match(average_ranks(df, keys, value, "rank_"), n, keys)
    return ranked.withColumn(name, F.col("rank_") / (F.col("n_") + 1)).drop("rank_", "n_")
