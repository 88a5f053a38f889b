"""Smoothing of score maps over the pixel grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import small


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return [(0, 1.0)]
    radius = int(truncate * sigma + 0.5)
    raw = [(o, math.exp(-0.5 * (o / sigma) ** 2)) for o in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(o, w / total) for o, w in raw]


def _sized(scores: DataFrame, *values: str) -> DataFrame:
    """``scene_id, y, x``, the values, and the scene's height, width and whether a value is missing. Sizes are sent to all tasks while they are few."""
    slim = scores.select("scene_id", "y", "x", *[F.col(v).cast("double").alias(v) for v in values])
    bad = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(v)
    sizes = slim.groupBy(F.col("scene_id").alias("scene_")).agg((F.max("y").cast("long") + 1).alias("h_"), (F.max("x").cast("long") + 1).alias("w_"), F.max(bad).alias("bad_"))
    return slim.join(small(sizes), F.col("scene_id").eqNullSafe(F.col("scene_"))).drop("scene_")


def gaussian_reflect(scores: DataFrame, sigma: float, value: str = "score", tile: int = 256) -> DataFrame:
    """``scene_id, y, x`` and the smoothed value; edges reflect with the edge pixel repeated."""
    return gaussian_maps(scores, {value: (value, sigma)}, tile)


def gaussian_maps(scores: DataFrame, maps: dict[str, tuple[str, float]], tile: int = 256) -> DataFrame:
    """``scene_id, y, x`` and a smoothed column per entry of ``maps`` (name to value and sigma), in one pass.

    A pixel that isn't there (a last row need not be full) is 0 in either direction; one that is null or
    NaN makes what it reaches null. Scenes are dealt into square tiles, each with the pixels that its edge needs from its
    neighbours, and a tile is smoothed along y and then x; no task holds a whole scene.
    """
    taps = {name: gaussian_taps(sigma) for name, (_, sigma) in maps.items()}
    radius = max(t[-1][0] for t in taps.values())
    values = sorted({of for of, _ in maps.values()})
    side = max(tile, 4 * radius)  # a scene narrower than the radius, which reflects many times, is one tile

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        place = {}
        for axis, size, t in (("y", "h_", key[1]), ("x", "w_", key[2])):
            n, at = int(frame[size].iloc[0]), int(t) * side
            place[axis] = n, at, min(n, at + side), max(0, at - radius), min(n, at + side + radius)
        (h, top, bottom, y0, y1), (w, left, right, x0, x1) = place["y"], place["x"]
        own = frame[frame["y"].between(top, bottom - 1) & frame["x"].between(left, right - 1)]
        out_rows = own[["scene_id", "y", "x"]].copy()
        there = np.zeros((y1 - y0, x1 - x0), bool)
        there[frame["y"] - y0, frame["x"] - x0] = True
        for name, (of, _) in maps.items():
            image = np.zeros(there.shape)
            image[frame["y"] - y0, frame["x"] - x0] = frame[of]
            for axis, size, first, last, start in ((0, h, top, bottom, y0), (1, w, left, right, x0)):
                out = 0.0
                for o, weight in taps[name]:
                    at = np.mod(np.arange(first, last) + o, 2 * size)
                    at = np.where(at >= size, 2 * size - 1 - at, at)
                    out = out + weight * np.take(image, at - start, axis)
                image = out if axis else np.where(there[top - y0 : bottom - y0], out, 0.0)
            out_rows[name] = image[own["y"] - top, own["x"] - left]
        return out_rows

    sized = _sized(scores, *values)

    def tiles(axis: str, size: str):
        at = F.col(axis).cast("long")
        return F.explode(F.sequence(F.floor(F.greatest(at - radius, F.lit(0)) / side), F.floor(F.least(at + radius, F.col(size) - 1) / side)))

    dealt = sized.withColumn("ty_", tiles("y", "h_")).withColumn("tx_", tiles("x", "w_"))
    schema = scores.select("scene_id", "y", "x", *[F.lit(None).cast("double").alias(name) for name in maps]).schema
    return dealt.groupBy("scene_id", "ty_", "tx_").applyInPandas(run, schema)


def _line_pass(df: DataFrame, axis: str, sigma: float, value: str, all_pixels: bool, longest: int) -> DataFrame:
    """Lines along one axis through the transfer function, in bands of lines of about ``longest`` pixels."""
    size, across = ("h_", "x") if axis == "y" else ("w_", "y")
    other = "w_" if axis == "y" else "h_"
    names = ["scene_id", "y", "x", value, "own_", "bad_", "h_", "w_"]

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        n, m = int(frame[size].iloc[0]), int(frame[other].iloc[0])
        lines = max(1, longest // n)
        start = int(key[1]) * lines
        at, line = frame[axis].to_numpy(), frame[across].to_numpy() - start
        image, own = np.zeros((n, min(lines, m - start))), np.zeros((n, min(lines, m - start)), bool)
        image[at, line], own[at, line] = frame[value], frame["own_"]
        image = np.fft.ifft(np.fft.fft(image, axis=0) * _transfer(np.fft.fftfreq(n), sigma)[:, None], axis=0).real
        i, j = np.indices(image.shape).reshape(2, -1) if all_pixels else np.nonzero(own)
        out = pd.DataFrame({axis: i, across: j + start, value: image[i, j], "own_": own[i, j]})
        return out.assign(**{c: frame[c].iloc[0] for c in ("scene_id", "bad_", "h_", "w_")})[names]

    band = F.floor(F.col(across) / F.greatest(F.lit(1), F.floor(F.lit(longest) / F.col(size)))).alias("band_")
    return df.select(*names).groupBy("scene_id", band).applyInPandas(run, df.select(*names).schema)


def _transfer(f, sigma: float):
    return np.exp(-2 * np.pi**2 * sigma**2 * f**2)


def _fft(df: DataFrame) -> DataFrame:
    """``scene_id, line, i, n, m, re, im`` with m a power of two: the transform of length m over i of
    each line, by Cooley and Tukey's two steps; each group has about the root of m rows."""

    columns = df.columns

    def halves(m: int) -> tuple[int, int]:
        one = 1 << ((m.bit_length() - 1) // 2)
        return one, m // one

    def step(second: bool):
        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            m, fixed = int(frame["m"].iloc[0]), int(key[2])
            m1, m2 = halves(m)
            z = np.zeros(m2 if second else m1, complex)
            z[frame["i"].to_numpy() // m1 if second else frame["i"].to_numpy() // m2] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
            z, k = np.fft.fft(z), np.arange(len(z))
            if not second:
                z = z * np.exp(-2j * np.pi * (fixed * k) / m)
            out = pd.DataFrame({"i": fixed + m1 * k if second else k + m1 * fixed, "re": z.real, "im": z.imag})
            return out.assign(**{c: frame[c].iloc[0] for c in ("scene_id", "line", "n", "m")})[columns]

        return run

    one = F.pow(F.lit(2.0), F.floor(F.round(F.log2("m")) / 2)).cast("long")
    first = df.groupBy("scene_id", "line", (F.col("i") % (F.col("m") / one).cast("long")).alias("f_")).applyInPandas(step(False), df.schema)
    return first.groupBy("scene_id", "line", (F.col("i") % one).alias("f_")).applyInPandas(step(True), df.schema)


def _times(re, im, re2, im2):
    return (re * re2 - im * im2), (re * im2 + im * re2)


def _dft(df: DataFrame) -> DataFrame:
    """``scene_id, line, i, n, m, re, im``: the transform of any length n over i of each line, by Bluestein's chirps."""
    i, n, m, re, im = (F.col(c) for c in ("i", "n", "m", "re", "im"))
    angle = F.lit(math.pi) * ((i * i) % (2 * n)) / n
    keys = ["scene_id", "line", "i", "n", "m"]

    def put(frame: DataFrame, pair) -> DataFrame:
        return frame.select(*keys, pair[0].alias("re"), pair[1].alias("im"))

    chirped = _fft(put(df, _times(re, im, F.cos(angle), -F.sin(angle))))
    sizes = df.groupBy("scene_id", "n", "m").agg(F.lit(0).cast("long").alias("line"))
    ends = sizes.select("scene_id", "line", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 65536))).alias("c"))
    chirp = ends.select("scene_id", "line", "n", "m", F.explode(F.sequence(F.col("c") * 65536, F.least(F.col("c") * 65536 + 65535, n - 1))).alias("i"))
    chirp = chirp.select(*keys, F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    chirp = chirp.unionByName(chirp.where("i > 0").withColumn("i", m - i))
    chirp = _fft(chirp.select(*df.columns)).select(F.col("scene_id").alias("s_"), F.col("i").alias("i_"), F.col("re").alias("re_"), F.col("im").alias("im_"))
    both = chirped.join(chirp, F.col("scene_id").eqNullSafe(F.col("s_")) & (i == F.col("i_")))
    a, b = _times(re, im, F.col("re_"), F.col("im_"))
    back = _fft(put(both, (a, -b))).where(i < n)  # the inverse, as the conjugate of the conjugate's transform
    return put(back, _times(re / m, -im / m, F.cos(angle), -F.sin(angle)))


def _long_pass(df: DataFrame, axis: str, sigma: float, value: str, all_pixels: bool) -> DataFrame:
    """As :func:`_line_pass`, for lines too long for one task."""
    size, across = ("h_", "x") if axis == "y" else ("w_", "y")
    n = F.col(size)
    wide = F.pow(F.lit(2.0), F.ceil(F.log2(2 * n))).cast("long")
    z = df.select("scene_id", F.col(across).cast("long").alias("line"), F.col(axis).cast("long").alias("i"), n.alias("n"), wide.alias("m"), F.col(value).alias("re"), F.lit(0.0).alias("im"))
    f = F.least("i", F.col("n") - F.col("i")) / F.col("n")
    gain = F.exp(F.lit(-2 * math.pi**2 * sigma**2) * f * f)
    z = _dft(_dft(z).withColumns({"re": F.col("re") * gain, "im": -F.col("im") * gain}))
    out = z.select(F.col("scene_id").alias("s_"), F.col("i").cast("int").alias("a_"), F.col("line").cast("int").alias("b_"), (F.col("re") / F.col("n")).alias("v_"))
    found = out.join(df, F.col("scene_id").eqNullSafe(F.col("s_")) & (F.col(axis) == F.col("a_")) & (F.col(across) == F.col("b_")), "left" if all_pixels else "inner")
    if not all_pixels:
        return found.where("own_").select("scene_id", "y", "x", F.col("v_").alias(value), "own_", "bad_", "h_", "w_")
    sizes = small(df.groupBy(F.col("scene_id").alias("t_")).agg(F.max("bad_").alias("bad_"), F.max("h_").alias("h_"), F.max("w_").alias("w_")))
    found = found.select("s_", F.col("a_").alias(axis), F.col("b_").alias(across), F.col("v_").alias(value), F.coalesce("own_", F.lit(False)).alias("own_"))
    return found.join(sizes, F.col("s_").eqNullSafe(F.col("t_"))).select(F.col("s_").alias("scene_id"), "y", "x", value, "own_", "bad_", "h_", "w_")


def gaussian_periodic(scores: DataFrame, sigma: float, value: str = "score", longest: int = 1 << 20, carried: bool = True) -> DataFrame:
    """As :func:`gaussian_reflect`, with edges that meet, by the transfer function in frequency.

    The function ends at the highest frequency, so that the kernel falls with the square of the
    distance only and can't be cut: lines are transformed whole, along x and then y. Tasks take
    bands of lines of about ``longest`` pixels; a line longer than that is transformed in two steps
    over groups of about its root. A missing pixel is 0; one that is null or NaN makes its scene null.
    What the first pass gives to a missing pixel goes into the second one unless ``carried`` is false:
    then it is 0 again, and y comes first.
    """
    sized = _sized(scores, value)
    most = scores.agg(F.max("y").cast("long") + 1, F.max("x").cast("long") + 1).first()
    df = sized.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.when(F.col("bad_"), 0.0).otherwise(F.col(value)).alias(value), F.lit(True).alias("own_"), "bad_", "h_", "w_")
    x, y = ("x", "w_", most[1]), ("y", "h_", most[0])
    for axis, size, top, rest in ((*x, True), (*y, False)) if carried else ((*y, False), (*x, False)):
        short = _line_pass(df.where(F.col(size) <= longest), axis, sigma, value, rest, longest)
        df = short.unionByName(_long_pass(df.where(F.col(size) > longest), axis, sigma, value, rest)) if (top or 0) > longest else short
    kinds = dict(scores.dtypes)
    return df.select("scene_id", *[F.col(c).cast(kinds[c]).alias(c) for c in ("y", "x")], F.when(~F.col("bad_"), F.col(value)).alias(value))


def lattice(pixels: DataFrame, height: int | None = None, width: int | None = None, most: int = 96) -> DataFrame:
    """Every s-th pixel both ways, so that neither side keeps more than ``most``; the scene's own size
    where none is given."""
    if height is None or width is None:
        height, width = (int(v or 0) + 1 for v in pixels.agg(F.max("y"), F.max("x")).first())
    s = max(1, -(-max(height, width) // most))
    return pixels.where((F.col("y") % s == 0) & (F.col("x") % s == 0))


def roi_means(scores: DataFrame, boxes: DataFrame, value: str = "score") -> DataFrame:
    """``roi, value, n`` over half-open boxes (roi, y0, x0, y1, x1), null and NaN values left out."""
    from .relate import in_boxes

    found = in_boxes(scores.where(~F.isnan(value)).select("y", "x", value), boxes)
    return found.groupBy("roi").agg(F.avg(value).alias(value), F.count("*").alias("n"))
