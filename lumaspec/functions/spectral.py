"""Column expressions over spectra; all run inside the JVM."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant array; long ones go to the JVM as one text, which the optimizer folds."""
    if len(values) <= 32:
        return F.array(*[F.lit(float(v)) for v in values])
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def dot(spectrum: str, weights: Sequence[float]) -> Column:
    """Inner product with fixed weights; written out band by band while that fits one method."""
    if len(weights) <= 128:
        return F.expr(" + ".join(f"{spectrum}[{k}] * {float(w)!r}D" for k, w in enumerate(weights)))
    return dot_columns(F.col(spectrum), literal(weights))


def dot_columns(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + e * e))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + e) / F.size(a)


def clip(value: Column, low: float, high: float) -> Column:
    """Value held in a range; null and NaN stay what they are."""
    return F.when(value < low, F.lit(low)).when((value > high) & ~F.isnan(value), F.lit(high)).otherwise(value)


def interpolate(x: Column, grid: Column, values: Column) -> Column:
    """Linear interpolation of ``values`` over an increasing grid, constant beyond its ends."""
    below = F.size(F.filter(grid, lambda g: g <= x))
    n = F.size(grid)
    at = F.least(F.greatest(below, F.lit(1)), n - 1)
    g0, g1 = F.element_at(grid, at), F.element_at(grid, at + 1)
    v0, v1 = F.element_at(values, at), F.element_at(values, at + 1)
    return F.when((below < 1) | (n < 2), F.element_at(values, 1)).when(below >= n, F.element_at(values, n)).otherwise(v0 + (v1 - v0) * (x - g0) / (g1 - g0))


def resample(spectrum: Column, grid: Column, to: Column) -> Column:
    """The spectrum at other wavelengths, constant beyond its ends."""
    return F.transform(to, lambda x: interpolate(x, grid, spectrum))


def resample_within(spectrum: Column, grid: Column, to: Column, tolerance: float = 1e-9) -> Column:
    """The spectrum at other wavelengths; fails where these reach beyond its own."""
    inside = (F.array_min(to) >= F.array_min(grid) - tolerance) & (F.array_max(to) <= F.array_max(grid) + tolerance)
    held = F.when(F.coalesce(inside, F.lit(True)), to).otherwise(F.raise_error("the wanted wavelengths reach beyond the spectrum").cast("array<double>"))
    return resample(spectrum, grid, held)


def neighbours(grid: Sequence[float], places: Sequence[float]) -> tuple[list[int], list[int], list[float], list[float]]:
    """For each place the numbers (from 1) of the grid points around it, how far it lies past the
    first, and how far they are apart; beyond the ends both are the end."""
    low, high, past, width = [], [], [], []
    for x in places:
        below = bisect.bisect_right(grid, x)
        inside = 0 < below < len(grid)
        low.append(max(below, 1))
        high.append(below + 1 if inside else max(below, 1))
        past.append(x - grid[below - 1] if inside else 0.0)
        width.append(grid[below] - grid[below - 1] if inside else 1.0)
    return low, high, past, width


def between(values: Column, count: int, low: Column, high: Column, past: Column, width: Column) -> Column:
    """Values at ``count`` places given by :func:`neighbours`, as columns."""

    def one(i: Column) -> Column:
        first = F.element_at(values, F.element_at(low, i))
        return first + (F.element_at(values, F.element_at(high, i)) - first) * F.element_at(past, i) / F.element_at(width, i)

    return F.transform(F.sequence(F.lit(1), F.lit(count)), one)


def interpolate_at(values: Column, grid: Sequence[float], places: Sequence[float]) -> Column:
    """:func:`interpolate` at fixed places of a fixed grid: their neighbours are found beforehand."""
    low, high, past, width = neighbours(grid, places)
    return between(values, len(places), literal(low).cast("array<int>"), literal(high).cast("array<int>"), literal(past), literal(width))


def shift_bands(spectrum: Column, bands: int, fraction: float) -> Column:
    """Spectrum moved by a fraction of its band range, its ends extended."""
    move = fraction * (bands - 1)
    return interpolate_at(spectrum, [float(i) for i in range(bands)], [i - move for i in range(bands)])


def wavelengths(bands: int, low: float = 400.0, high: float = 1000.0) -> list[float]:
    return [low + k * ((high - low) / (bands - 1)) for k in range(bands)]


FWHM_TO_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


def srf_weights(native: Sequence[float], centres: Sequence[float], fwhm: float) -> list[list[float]]:
    """Rows of Gaussian sensor responses, each with sum one."""
    if fwhm <= 0 or any(b <= a for a, b in zip(native, native[1:], strict=False)):
        raise ValueError("a positive width and increasing wavelengths are needed")
    sigma, rows = fwhm / FWHM_TO_SIGMA, []
    for c in centres:
        row = [math.exp(-0.5 * ((w - c) / sigma) ** 2) for w in native]
        total = sum(row)
        rows.append([v / total for v in row])
    return rows


def apply_srf(spectrum: str, weights: Sequence[Sequence[float]]) -> Column:
    return F.array(*[dot_columns(F.col(spectrum), literal(row)) for row in weights])


def smooth_bands(spectrum: Column, bands: int, fwhm_bands: float) -> Column:
    """The spectrum under a Gaussian response of a width in bands, out to three deviations, ends
    repeated; no width leaves it as it is."""
    if fwhm_bands <= 0:
        return spectrum
    sigma = fwhm_bands / 2.3548  # fixed value: full width at half maximum over deviation, as rounded in use
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / sum(raw)).alias("w")) for o, w in zip(range(-radius, radius + 1), raw, strict=True)])

    def at(i: Column) -> Column:
        return F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["w"] * F.element_at(spectrum, F.least(F.greatest(i + t["o"], F.lit(0)), F.lit(bands - 1)) + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), at)


def scaled_to(spectrum: Column, level: Column, absolute: bool = False) -> Column:
    """The spectrum with its peak at ``level``; a peak of 0 counts as 1. With ``absolute`` the peak
    is the largest absolute value."""
    peak = F.array_max(F.transform(spectrum, lambda v: F.abs(v))) if absolute else F.array_max(spectrum)
    return F.transform(spectrum, lambda v: v / F.when(peak == 0, 1.0).otherwise(peak) * level)


def shifted_and_tilted(spectrum: Column, bands: int, shifts=(-1, 0, 1), tilts=(-0.03, 0.0, 0.03)) -> Column:
    """An array of ``shift, tilt, spectrum``: moved by whole bands, ends repeated, times a line through
    1 at the middle that rises by the tilt to the last band; not below 0."""
    last = F.lit(bands - 1)

    def made(shift: int, tilt: float) -> Column:
        def at(i: Column) -> Column:
            value = F.element_at(spectrum, F.least(F.greatest(i - shift, F.lit(0)), last) + 1)
            return F.greatest(value * (1 + tilt * (i * (2.0 / (bands - 1)) - 1)), F.lit(0.0))

        return F.struct(F.lit(shift).alias("shift"), F.lit(tilt).alias("tilt"), F.transform(F.sequence(F.lit(0), last), at).alias("spectrum"))

    return F.array(*[made(shift, tilt) for shift in shifts for tilt in tilts])


#: Centre, width and depth of the absorption bands of oxygen and water vapour, in nm.
AIR_BANDS = ((720.0, 12.0, 0.15), (760.0, 6.0, 0.35), (820.0, 15.0, 0.20), (940.0, 25.0, 0.55))


def transmittance(wl: Sequence[float], strength: float = 1.0, bands=AIR_BANDS) -> list[float]:
    if strength < 0:
        raise ValueError("the strength must not be negative")
    return [min(1.0, max(0.05, 1.0 - sum(strength * d * math.exp(-(((w - c) / s) ** 2)) for c, s, d in bands))) for w in wl]


def apply_atmosphere(spectrum: Column, tau: Sequence[float], path: float = 0.0) -> Column:
    return F.zip_with(spectrum, literal(tau), lambda v, t: v * t + F.lit(path) * (F.lit(1.0) - t))


def moving_average(spectrum: Column, bands: int, window: int) -> Column:
    """Mean over an odd window of bands, ends repeated."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    terms = lambda i: F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.element_at(spectrum, F.least(F.greatest(i + o, F.lit(0)), F.lit(bands - 1)) + 1))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.aggregate(terms(i), F.lit(0.0), lambda s, e: s + e) / F.lit(float(window)))


def implant(spectrum: Column, target: Column, abundance: Column, gamma: float = 0.0) -> Column:
    """Pixel mixed with the target; ``gamma`` adds the product term of bilinear mixing."""
    return F.zip_with(spectrum, target, lambda c, t: c + abundance * (t - c) + F.lit(gamma) * abundance * (F.lit(1.0) - abundance) * c * t)
