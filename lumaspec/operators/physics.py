"""Spectra of materials and what a sensor makes of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import apply_atmosphere, between, clip, dot_columns, interpolate, interpolate_at, literal, neighbours, srf_weights, transmittance, wavelengths
from .experiment import grid


def _bell(x: float, centre: float, width: float) -> float:
    return math.exp(-(((x - centre) / width) ** 2))


def _unit(v: float) -> float:
    return min(1.0, max(0.0, v))


# Fixed values. Reflectance of four surfaces over t, the band's place from 0 to 1:
#   vegetation      0.04 + 0.16 bell(t, 0.25, 0.06) + 0.55 logistic((t - 0.52) / 0.03)
#   soil            0.15 + 0.45 t^0.8
#   dry_vegetation  0.10 + 0.38 t + 0.06 bell(t, 0.28, 0.08)
#   water           0.02 + 0.25 exp(-3 t)
SURFACES = {
    "vegetation": lambda t: 0.04 + 0.16 * _bell(t, 0.25, 0.06) + 0.55 / (1.0 + math.exp(-(t - 0.52) / 0.03)),
    "soil": lambda t: 0.15 + 0.45 * t**0.8,
    "dry_vegetation": lambda t: 0.10 + 0.38 * t + 0.06 * _bell(t, 0.28, 0.08),
    "water": lambda t: 0.02 + 0.25 * math.exp(-3.0 * t),
}
# Absorption bands (centre nm, width nm, depth) of one stylized and two known reporters.
STYLIZED = ((790.0, 12.0, 0.35),)
REPORTERS = {"bacteriochlorophyll_a": ((600.0, 20.0, 0.18), (770.0, 16.0, 0.38)), "biliverdin_ixalpha": ((670.0, 45.0, 0.34), (400.0, 25.0, 0.15))}


def endmembers(bands: int) -> dict[str, list[float]]:
    """Stylized reflectance of four surfaces between 400 and 1000 nm."""
    return {name: [_unit(f(k / (bands - 1))) for k in range(bands)] for name, f in SURFACES.items()}


def reporter(bands: int, dips=STYLIZED, baseline: float = 0.45) -> list[float]:
    """A flat spectrum less its absorption bands."""
    return [_unit(baseline - sum(d * _bell(w, c, s) for c, s, d in dips)) for w in wavelengths(bands)]


def synthetic_target(bands: int, centre: float = 0.62, width: float = 0.025) -> list[float]:
    """One narrow feature with a peak of 1; places are shares of the bands."""
    raw = [_bell(k, centre * (bands - 1), max(width * bands, 1.0)) for k in range(bands)]
    return [v / (max(raw) or 1.0) for v in raw]


def reflectance(absorbance: Column, baseline: float = 0.45) -> Column:
    """Beer-Lambert: baseline times 10 to the minus absorbance."""
    return F.transform(absorbance, lambda a: F.lit(baseline) * F.pow(F.lit(10.0), -a))


def without_baseline(absorbance: Column, q: float = 0.05) -> Column:
    """Values less their q-quantile (linear interpolation), not below 0."""
    s = F.sort_array(absorbance)
    at = (F.size(absorbance) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    low, high = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(absorbance)))
    base = low + (high - low) * (at - lo)
    return F.transform(absorbance, lambda a: F.greatest(a - base, F.lit(0.0)))


def measured_endmembers(table: DataFrame, to: Column) -> DataFrame:
    """``name, spectrum``: measured reflectances (name, wavelengths, spectrum) at other wavelengths, held in 0 to 1."""
    at = F.transform(to, lambda x: interpolate(x, F.col("wavelengths"), F.col("spectrum")))
    return table.select("name", F.transform(at, lambda v: clip(v, 0.0, 1.0)).alias("spectrum"))


def measured_absorbances(table: DataFrame, to: Column) -> DataFrame:
    """``name, absorbance``: measured absorbances at other wavelengths, less their baselines."""
    at = F.transform(to, lambda x: interpolate(x, F.col("wavelengths"), F.col("spectrum")))
    return table.select("name", without_baseline(at).alias("absorbance"))


def canonical(absorbances: DataFrame, name: str, members: list[str]) -> DataFrame:
    """``name, absorbance``: the mean over members (hosts of one reporter), wavelength by wavelength."""
    each = absorbances.where(F.col("name").isin(members)).select(F.posexplode("absorbance").alias("k", "a"))
    mean = each.groupBy("k").agg(F.avg("a").alias("a"))
    return mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "a"))), lambda p: p["a"]).alias("absorbance")).select(F.lit(name).alias("name"), "absorbance")  # as many as wavelengths


def reporter_library(absorbances: DataFrame, baseline: float = 0.45) -> DataFrame:
    """``name, spectrum``: absorbances seen on a flat background."""
    return absorbances.select("name", reflectance(F.col("absorbance"), baseline).alias("spectrum"))


def transfer(spectrum: str, native: Sequence[float], centres: Sequence[float], *, fwhm: float, shift_nm: float = 0.0, strength: float = 0.0, path: float = 0.0, gain: float = 1.0) -> Column:
    """A laboratory spectrum as a sensor sees it: shift, response, atmosphere, gain, in that order."""
    if centres[0] < native[0] - 1e-9 or centres[-1] > native[-1] + 1e-9:
        raise ValueError("the sensor reaches beyond the spectrum")
    moved = interpolate_at(F.col(spectrum), native, [x - shift_nm for x in native]) if shift_nm else F.col(spectrum)
    rows = F.array(*[literal(r) for r in srf_weights(native, centres, fwhm)])
    # the outer transform holds the moved spectrum, which is so computed once a row
    seen = F.transform(F.array(moved), lambda m: F.transform(rows, lambda row: dot_columns(row, m)))[0]
    return F.transform(apply_atmosphere(seen, transmittance(centres, strength), path), lambda v: v * F.lit(gain))


_SETTINGS = "fwhm double, strength double, shift_nm double, low_ array<int>, high_ array<int>, past_ array<double>, width_ array<double>, rows_ array<array<double>>, tau_ array<double>"


def transfer_family(df: DataFrame, spectrum: str, native: Sequence[float], centres: Sequence[float], fwhms, strengths, shifts, path: float = 0.0) -> DataFrame:
    """Every row under every setting: ``fwhm, strength, shift_nm, observed``. Settings are a table whose
    rows hold what they do (shift, response, atmosphere), joined to every spectrum."""
    if centres[0] < native[0] - 1e-9 or centres[-1] > native[-1] + 1e-9:
        raise ValueError("the sensor reaches beyond the spectrum")
    made = [
        (float(f), float(a), float(s), *neighbours(native, [x - s for x in native]), srf_weights(native, centres, f), transmittance(centres, a))
        for f in fwhms for a in strengths for s in shifts
    ]
    each = grid(df, df.sparkSession.createDataFrame(made, _SETTINGS))
    moved = between(F.col(spectrum), len(native), F.col("low_"), F.col("high_"), F.col("past_"), F.col("width_"))
    seen = F.transform(F.array(moved), lambda m: F.transform("rows_", lambda row: dot_columns(row, m)))[0]
    observed = F.zip_with(seen, "tau_", lambda v, t: v * t + F.lit(path) * (F.lit(1.0) - t))
    return each.withColumn("observed", observed).drop("low_", "high_", "past_", "width_", "rows_", "tau_")


def abundance(bumps, top: float = 1.0) -> Column:
    """The sum of round bumps (y, x, radius, height) at a pixel, at most ``top``."""
    terms = [F.lit(a) * F.exp(-((F.col("y") - F.lit(cy)) ** 2 + (F.col("x") - F.lit(cx)) ** 2) / F.lit(2 * r * r)) for cy, cx, r, a in bumps]
    return F.least(F.lit(top), sum(terms[1:], terms[0]) if terms else F.lit(0.0))


def noise_sigma(signal_rms: Column, snr_db: float) -> Column:
    """Noise for a ratio of target contribution to noise; none for an infinite ratio."""
    if snr_db != snr_db or snr_db == float("-inf"):
        raise ValueError("the ratio must be a number above minus infinity")
    return F.lit(0.0) if snr_db == float("inf") else signal_rms / F.lit(10 ** (snr_db / 20))


