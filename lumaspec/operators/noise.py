"""Noise that is a function of its keys: alike wherever and whenever it is made, and in any SQL engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibrate, metrics, scenes

_DIGITS = 13


def _share(digest: Column, at: int) -> Column:
    """Thirteen hexadecimal digits as a number between 0 and 1."""
    return (F.conv(F.substring(digest, at, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def normal(*keys: Column) -> Column:
    """A standard normal number from the MD5 of the keys, by Box and Muller's rule; null keys count as
    left out."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary"))
    return F.sqrt(F.lit(-2.0) * F.ln(_share(digest, 1))) * F.cos(F.lit(2 * math.pi) * _share(digest, 1 + _DIGITS))


def noise_spectrum(bands: Column, *keys: Column) -> Column:
    """An array of standard normal numbers, one per band, from the keys and the band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: normal(*keys, b))


def noisy_variants(pixels: DataFrame, settings: DataFrame, seeds: dict[str, list[int]], levels: list[float]) -> DataFrame:
    """Every pixel once per setting (sensor, target, noise_std), seed and level of abundance: those of
    ``seeds["calibrate"]`` at level 0, those of ``seeds["evaluate"]`` at 0 and all ``levels``.

    The noise of a pixel is that of its sensor, seed and number, made once and shared by all its
    levels. ``gt`` marks where the target is mixed in; ``part`` tells the two kinds of seeds apart and
    scene_id all variants."""
    uses = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(s).cast("long").alias("seed")) for part, some in seeds.items() for s in some])
    each = pixels.crossJoin(F.broadcast(settings)).select("*", F.explode(uses).alias("u")).select("*", "u.part", "u.seed").drop("u")
    each = each.withColumn("noise", F.transform(noise_spectrum(F.size("spectrum"), F.col("sensor"), F.col("seed"), F.col("pixel_id")), lambda v: v * F.col("noise_std")))
    wanted = F.when(F.col("part") == "calibrate", F.array(F.lit(0.0))).otherwise(F.array(*[F.lit(float(v)) for v in [0.0, *levels]]))
    out = each.withColumn("level", F.explode(wanted))
    mixed = F.zip_with("spectrum", "target", lambda c, t: c + F.when(F.col("gt"), F.col("level")).otherwise(0.0) * (t - c))
    out = out.withColumn("spectrum", F.zip_with(mixed, "noise", lambda c, n: c + n))
    return out.withColumn("scene_id", F.concat_ws("|", "scene_id", "sensor", "part", "seed", "level"))


def detection_runs(variants: DataFrame, targets: DataFrame, fars: list[float], sigma: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Runs (sensor, level, far, seed, pd, auc, positives) and realized rates (sensor, far, seed, realized_far)
    of the smoothed filter over its robust spread.

    The threshold of a sensor and budget is the largest of its calibration scenes' own. ``targets`` has
    scene_id, target ("sensor"), member and spectrum."""
    method = scenes.Method("score", "matched_filter", "sensor", sigma=sigma)
    keep = ["pixel_id", "y", "x", "gt", "sensor", "part", "seed", "level"]
    scored = scenes.cut(calibrate.robust_standardise(scenes.score_methods(variants, targets, [method], keep), ["scene_id"], "score"), "limit-scores")
    scored = scored.withColumn("z", F.round("z", 9))
    each = scored.where("part = 'calibrate'")
    limits = None
    for far in fars:
        one = metrics.far_thresholds(each, ["sensor", "seed"], far, "z").groupBy("sensor").agg(F.max("threshold").alias("threshold")).withColumn("far", F.lit(far))
        limits = one if limits is None else limits.unionByName(one)
    held = scored.where("part = 'evaluate'")
    over = metrics.match(held, F.broadcast(scenes.cut(limits, "limits")), ["sensor"]).withColumn("over", (F.col("z") > F.col("threshold")).cast("double"))  # a row a sensor and budget
    real = over.where("level = 0").groupBy("sensor", "far", "seed").agg(F.avg("over").alias("realized_far"))
    rates = over.where("level > 0 and gt").groupBy("sensor", "level", "far", "seed").agg(F.avg("over").alias("pd"), F.count("*").alias("positives"))
    auc = metrics.roc_auc(held.where("level > 0"), ["sensor", "level", "seed"], "z", "gt").select("sensor", "level", "seed", "auc")
    return metrics.match(rates, auc, ["sensor", "level", "seed"]).select("sensor", "level", "far", "seed", "pd", "auc", "positives"), real
