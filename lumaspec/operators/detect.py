"""Detectors: statistics of the background, a little linear algebra, one projection per pixel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import dot, literal, norm
from .stats import Background, background, robust_bands, spectra

EPS = 1e-12


def _udf(fn: Callable[[np.ndarray], np.ndarray], spectrum: str) -> Column:
    """A score per spectrum from a function of rows of doubles; null spectra have none."""

    def run(column: pa.Array) -> pa.Array:
        x, there = spectra(column)
        out = np.full(len(column), np.nan)
        if len(there):
            out[there] = fn(x)
        return pa.array(out, mask=~np.isin(np.arange(len(column)), there, assume_unique=True))

    return F.arrow_udf(run, "double")(F.col(spectrum))


def matched_filter(bg: Background, target, spectrum: str = "spectrum") -> Column:
    """Linear filter with unit response to the target: one fixed weight per band."""
    t = np.asarray(target, float) - bg.mean
    w = bg.inverse @ t
    w = w / (t @ w + EPS)
    return dot(spectrum, w) - F.lit(float(w @ bg.mean))


def mahalanobis(bg: Background, spectrum: str = "spectrum") -> Column:
    """Squared distance from the background (the anomaly score)."""
    inverse, mean = bg.inverse, bg.mean
    return _udf(lambda x: np.einsum("ij,ij->i", (x - mean) @ inverse, x - mean), spectrum)


def ace(bg: Background, target, spectrum: str = "spectrum") -> Column:
    """Squared cosine of pixel and target in the whitened space."""
    t = np.asarray(target, float) - bg.mean
    w = bg.inverse @ t
    top = dot(spectrum, w) - F.lit(float(w @ bg.mean))
    return top * top / ((F.lit(float(t @ w)) + EPS) * (mahalanobis(bg, spectrum) + EPS))


def subspace(bg: Background, targets, rank: int | None = None, spectrum: str = "spectrum") -> Column:
    """Share of a whitened pixel's energy in the span of the whitened targets."""
    white, mean = bg.whitener(), bg.mean
    family = np.atleast_2d(np.asarray(targets, float)) - mean
    basis, values, _ = np.linalg.svd((family @ white).T, full_matrices=False)
    keep = int((values > max(family.shape) * np.finfo(float).eps * values[0]).sum())
    basis = basis[:, : min(keep, rank or keep)]

    def score(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ white
        return ((z @ basis) ** 2).sum(1) / ((z * z).sum(1) + EPS)

    return _udf(score, spectrum)


def spectral_angle(target, spectrum: str = "spectrum") -> Column:
    """Cosine of pixel and target as they are."""
    t = np.asarray(target, float)
    return dot(spectrum, t) / ((norm(F.col(spectrum)) + EPS) * (F.lit(float(np.linalg.norm(t))) + EPS))


def diagonal_distance(pixels: DataFrame, spectrum: str = "spectrum") -> Column:
    """Distance from the band medians in robust band widths, per pixel."""
    middle, wide = robust_bands(pixels, spectrum)
    z = F.zip_with(F.zip_with(spectrum, literal(middle), lambda v, m: v - m), literal(np.maximum(wide, EPS)), lambda v, s: v / s)
    return F.aggregate(z, F.lit(0.0), lambda a, e: a + e * e)


def pca_error(bg: Background, components: int, spectrum: str = "spectrum") -> Column:
    """Reconstruction error after projecting on the background's leading components; this linear
    model stands where a background autoencoder could."""
    values, vectors = np.linalg.eigh(bg.covariance)
    basis, mean = vectors[:, np.argsort(-values)[:components]], bg.mean

    def score(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return ((z - z @ basis @ basis.T) ** 2).mean(1)

    return _udf(score, spectrum)


def band_weights(bg: Background, target) -> list[tuple[int, float]]:
    """Bands by falling absolute filter weight."""
    w = np.abs(np.linalg.solve(bg.covariance, np.asarray(target, float) - bg.mean))
    return [(int(k), float(w[k])) for k in np.lexsort((np.arange(len(w)), -w))]


REGISTRY: dict[str, Callable[[DataFrame, np.ndarray], Column]] = {
    "matched_filter": lambda pixels, target: matched_filter(background(pixels), target),
    "ace": lambda pixels, target: ace(background(pixels), target),
    "rx": lambda pixels, target: mahalanobis(background(pixels, floor=1e-12, pseudo=True)),
    "sam": lambda pixels, target: spectral_angle(target),
}
