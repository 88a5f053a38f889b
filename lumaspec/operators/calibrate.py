"""Calibration of scores, abundances and detection limits. Models are a few numbers, fitted by
sums over rows and applied as expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectral import clip
from .metrics import match, quantiles, running


def finite_quantile(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """``keys, quantile``: the ceil((n+1)(1-alpha))-th smallest value, at most the largest."""
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("cnt_"))
    by = keys or ["k_"]
    below = running(counts if keys else counts.withColumn("k_", F.lit(0)), by, [F.col("v")], ["cnt_"])
    below = match(below, below.groupBy(*by).agg(F.sum("cnt_").alias("n")), by)
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha))))
    return below.where((F.col("before_cnt_") < rank) & (F.col("before_cnt_") + F.col("cnt_") >= rank)).select(*keys, F.col("v").alias("quantile"))


@dataclass(frozen=True)
class Affine:
    slope: float
    intercept: float

    def apply(self, raw: Column) -> Column:
        return clip(raw * F.lit(self.slope) + F.lit(self.intercept), 0.0, 1.0)


def affine_sums(df: DataFrame, case: str, raw: str, truth: str) -> DataFrame:
    """``slope, intercept`` of the least-squares line in which every case weighs the same. A negative
    slope becomes 0 with the mean as intercept; a constant predictor takes the least-norm line."""
    by_case = df.groupBy(case).agg(F.avg(raw).alias("x"), F.avg(truth).alias("y"), F.avg(F.col(raw) * F.col(raw)).alias("xx"), F.avg(F.col(raw) * F.col(truth)).alias("xy"))
    s = by_case.agg(*[F.avg(c).alias(c) for c in ("x", "y", "xx", "xy")])
    spread = F.col("xx") - F.col("x") * F.col("x")
    flat = spread <= 1e-15 * F.greatest(F.lit(1.0), F.col("xx"))
    line = F.when(flat, F.col("x") * F.col("y") / (F.col("x") * F.col("x") + 1)).otherwise((F.col("xy") - F.col("x") * F.col("y")) / F.when(flat, 1.0).otherwise(spread))
    s = s.withColumn("line", line)
    base = F.when(flat, F.col("y") / (F.col("x") * F.col("x") + 1)).otherwise(F.col("y") - F.col("line") * F.col("x"))
    return s.select(F.greatest("line", F.lit(0.0)).alias("slope"), F.when(F.col("line") < 0, F.col("y")).otherwise(base).alias("intercept"))


def fit_affine(df: DataFrame, case: str, raw: str, truth: str) -> Affine:
    row = affine_sums(df, case, raw, truth).first()
    return Affine(row["slope"], row["intercept"])


def conformal_radius(df: DataFrame, case: str, residual: str, alpha: float) -> DataFrame:
    """``radius``: the finite-sample quantile over cases of each case's quantile of residuals."""
    return finite_quantile(finite_quantile(df, [case], residual, alpha), [], "quantile", alpha).select(F.col("quantile").alias("radius"))


@dataclass(frozen=True)
class Logistic:
    """``1 / (1 + exp(-(slope * score + bias)))``."""

    slope: float
    bias: float

    def apply(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(score * F.lit(self.slope) + F.lit(self.bias))))


def fit_platt(df: DataFrame, score: str, label: str, rounds: int = 25, slope: float | None = None) -> Logistic:
    """Logistic fit by damped Newton steps on the standardized score; each step is one sum over
    rows. On separable labels the slope stops growing where the step no longer helps. With a given
    ``slope`` only the bias is fitted."""
    mean, std = df.agg(F.avg(score), F.stddev_pop(score)).first()
    std = std if std and std > 1e-12 else 1.0
    y, z = F.col(label).cast("double"), (F.col(score) - F.lit(mean)) / F.lit(std)
    a, b = 0.0 if slope is None else slope * std, 0.0

    def sums(a: float, b: float):
        m = z * F.lit(a) + F.lit(b)
        p = 1 / (1 + F.exp(-m))
        loss = F.greatest(m, F.lit(0.0)) - m * y + F.log1p(F.exp(-F.abs(m)))
        g, h = p - y, p * (1 - p)
        return df.agg(F.avg(loss), F.avg(g * z), F.avg(g), F.avg(h * z * z), F.avg(h * z), F.avg(h)).first()

    now = sums(a, b)
    for _ in range(rounds):
        loss, ga, gb, haa, hab, hbb = now
        if slope is None:
            da, db = np.linalg.solve(np.array([[haa, hab], [hab, hbb]]) + 1e-9 * np.eye(2), [ga, gb])
        else:
            da, db = 0.0, gb / (hbb + 1e-9)
        scale = min(1.0, 4.0 / max(abs(da), abs(db), 1e-12))
        new = sums(a - scale * da, b - scale * db)
        if new[0] > loss - 1e-12:
            break
        a, b, now = a - scale * da, b - scale * db, new
    return Logistic(a / std, b - a * mean / std)


def fit_temperature(df: DataFrame, logit: str, label: str) -> Logistic:
    """As Platt's, with a positive slope of at least exp(-10) and at most exp(10); where that bound
    holds the slope, the bias is fitted to the bound."""
    found = fit_platt(df, logit, label)
    held = min(max(found.slope, math.exp(-10)), math.exp(10))
    return found if held == found.slope else fit_platt(df, logit, label, slope=held)


def robust_standardise(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """Adds (x - median) / max(1.4826 MAD, 1e-12) within keys."""
    middle = quantiles(df, keys, value, [0.5]).withColumnRenamed("q0", "m_")
    near = match(df, middle, keys)
    wide = quantiles(near.select(*keys, F.abs(F.col(value) - F.col("m_")).alias("far_")), keys, "far_", [0.5]).withColumnRenamed("q0", "d_")
    return match(near, wide, keys).withColumn(name, (F.col(value) - F.col("m_")) / F.greatest(F.lit(1.4826) * F.col("d_"), F.lit(1e-12))).drop("m_", "d_")


def detection_limit(curve: DataFrame, keys: list[str], level: str, pd: str, target: float = 0.9) -> DataFrame:
    """``keys, limit``: the first level at which and above all of which ``pd`` reaches the target; null if none."""
    onward = Window.partitionBy(*keys).orderBy(level).rowsBetween(0, Window.unboundedFollowing)
    return curve.withColumn("worst", F.min(pd).over(onward)).groupBy(*keys).agg(F.min(F.when(F.col("worst") >= target, F.col(level))).alias("limit"))
