"""Queries whose models no SQL states: learned detectors and clustering over the cube."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import detect, learn, nets, spatial, stats, unmix
from ..store import cut
from .cubes import _target, cube

_NAMES = ["mf", "ace", "mf_s", "mf_w", "ace_s"]


def _five(px):
    bg, t = stats.background(px), _target(px)
    base = out = cut(px.select("scene_id", "pixel_id", "y", "x", "gt", detect.matched_filter(bg, t).alias("mf"), detect.ace(bg, t).alias("ace")), "features")
    for name, of, sigma in (("mf_s", "mf", 1.0), ("mf_w", "mf", 2.5), ("ace_s", "ace", 1.5)):
        out = out.join(spatial.gaussian_periodic(base.select("scene_id", "y", "x", of), sigma, of).withColumnRenamed(of, name), ["scene_id", "y", "x"])
    return cut(learn.standardised(out, _NAMES, ["scene_id"]), "features")


def pixel_features(spark, d):
    return _five(cube(spark, d)).select(F.col("pixel_id").alias("vec_id"), *[F.round(n, 6).alias(n) for n in _NAMES])


def _detector(px):
    return nets.fit_classifier(px, _NAMES, "gt", "pixel_id")


def _values(px):
    return px.withColumn("values", F.array(*_NAMES))


def mlp_detector(spark, d):
    px = _five(cube(spark, d))
    return px.select(F.col("pixel_id").alias("vec_id"), F.round(nets.probability(_detector(px)), 6).alias("probability"))


def mc_dropout_uncertainty(spark, d):
    px = _five(cube(spark, d))
    mean, std = nets.passes(_detector(px), "values", "pixel_id")
    return _values(px).select(F.col("pixel_id").alias("vec_id"), F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"))


def cluster_unmix(spark, d):
    px = cube(spark, d)
    low = float(px.agg(F.min(F.array_min("spectrum"))).first()[0])
    moved = px.withColumn("spectrum", F.transform("spectrum", lambda v: v - F.lit(low)))
    out = unmix.cluster_unmix(moved, np.asarray(_target(px)) - low)
    return out.select(F.col("pixel_id").alias("vec_id"), F.round("score", 6).alias("score"))


def mlp_logits(spark, d):
    px = _five(cube(spark, d))
    return px.select(F.col("pixel_id").alias("vec_id"), F.round(nets.logit(_detector(px)), 6).alias("logit"))


def abundance_regression(spark, d):
    """Abundances of an implanted target from the features of the mixed pixels."""
    px = cube(spark, d).withColumn("a", (F.col("pixel_id") * 37 % 101) / F.lit(200.0))
    mixed = px.withColumn("spectrum", S.implant(F.col("spectrum"), S.literal(_target(px)), F.col("a")))
    rows = _five(mixed).join(px.select("pixel_id", "a"), "pixel_id")
    net = nets.fit_regressor(rows, _NAMES, "a", "pixel_id")
    guess = nets.outputs(net, "values")[0]
    return _values(rows).select(F.col("pixel_id").alias("vec_id"), F.round(S.clip(guess, 0.0, 1.0), 6).alias("abundance"))


def _odd(px):
    """How badly a network trained on the scene alone makes a pixel anew."""
    return nets.reconstruction_error(nets.fit_autoencoder(px, *stats.robust_bands(px)))


def autoencoder_error(spark, d):
    px = cube(spark, d)
    return px.select(F.col("pixel_id").alias("vec_id"), F.round(_odd(px), 6).alias("error"))


def _gated(px):
    scored = cut(px.select("scene_id", "pixel_id", "y", "x", detect.matched_filter(stats.background(px), _target(px)).alias("score"), _odd(px).alias("odd")), "features")
    q = learn.empirical_quantile(learn.empirical_quantile(scored, ["scene_id"], "score", "q"), ["scene_id"], "odd", "p")
    return q.withColumn("score", F.col("q") * (0.5 + 0.5 * F.col("p")))


def autoencoder_gated_score(spark, d):
    """The filter's quantile, damped by that of the autoencoder's error."""
    return _gated(cube(spark, d)).select(F.col("pixel_id").alias("vec_id"), F.round("score", 6).alias("score"))


def autoencoder_smoothed_score(spark, d):
    out = spatial.gaussian_reflect(_gated(cube(spark, d)).select("scene_id", "y", "x", "score"), 1.5)
    return out.select((F.col("y").cast("long") * 25 + F.col("x")).alias("vec_id"), F.round("score", 6).alias("score"))


def smoothed_gated_score(spark, d):
    """The filter's quantile, damped by that of the reconstruction error, smoothed over the scene."""
    px = cube(spark, d)
    bg = stats.background(px)
    both = cut(px.select("scene_id", "pixel_id", "y", "x", detect.matched_filter(bg, _target(px)).alias("score"), detect.pca_error(bg, 10).alias("odd")), "features")
    q = learn.empirical_quantile(learn.empirical_quantile(both, ["scene_id"], "score", "q"), ["scene_id"], "odd", "p")
    gated = q.select("scene_id", "y", "x", (F.col("q") * (0.5 + 0.5 * F.col("p"))).alias("score"))
    out = spatial.gaussian_reflect(gated, 1.5)
    return out.select((F.col("y").cast("long") * 25 + F.col("x")).alias("vec_id"), F.round("score", 6).alias("score"))


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (pixel_features, mlp_detector, mc_dropout_uncertainty, cluster_unmix, mlp_logits, abundance_regression, smoothed_gated_score, autoencoder_error, autoencoder_gated_score, autoencoder_smoothed_score)}
