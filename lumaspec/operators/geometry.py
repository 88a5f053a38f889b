"""Places in a scene and in its turned crop, and colours for looking at it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import match, quantiles


@dataclass(frozen=True)
class TurnedCrop:
    """A crop of ``height`` by ``width`` pixels whose first is (``top``, ``left``), turned about its
    middle by ``degrees``."""

    height: int
    width: int
    top: float
    left: float
    degrees: float

    def _turned(self, y: Column, x: Column, turn: float) -> tuple[Column, Column]:
        c, s = math.cos(turn), math.sin(turn)
        return y * F.lit(c) + x * F.lit(s), x * F.lit(c) - y * F.lit(s)

    def to_scene(self, y: Column, x: Column) -> tuple[Column, Column]:
        """Scene coordinates of a pixel of the turned crop."""
        my, mx = (self.height - 1) / 2, (self.width - 1) / 2
        v, u = self._turned(y - my, x - mx, math.radians(self.degrees))
        return v + F.lit(my + self.top), u + F.lit(mx + self.left)

    def from_scene(self, y: Column, x: Column) -> tuple[Column, Column]:
        """The pixel of the turned crop at scene coordinates."""
        my, mx = (self.height - 1) / 2, (self.width - 1) / 2
        v, u = self._turned(y - (my + self.top), x - (mx + self.left), -math.radians(self.degrees))
        return v + F.lit(my), u + F.lit(mx)

    def polygon(self, boxes: DataFrame) -> DataFrame:
        """``roi, corner, y, x``: scene coordinates of the four corner pixels of half-open boxes (roi,
        y0, x0, y1, x1), in turn from the first."""
        corners = [("y0", "x0", 0, 0), ("y0", "x1", 0, 1), ("y1", "x1", 1, 1), ("y1", "x0", 1, 0)]
        points = F.array(*[F.struct(F.lit(k).alias("corner"), (F.col(a) - i).cast("double").alias("y"), (F.col(b) - j).cast("double").alias("x")) for k, (a, b, i, j) in enumerate(corners)])
        each = boxes.select("roi", F.explode(points).alias("p")).select("roi", "p.*")
        y, x = self.to_scene(F.col("y"), F.col("x"))
        return each.select("roi", "corner", y.alias("y"), x.alias("x"))


def nearest_band(bands: DataFrame, wanted: float, band: str = "band", wavelength: str = "wavelength") -> DataFrame:
    """One row: the band whose wavelength is nearest to the wanted one, the first if several are."""
    return bands.agg(F.min_by(band, F.struct(F.abs(F.col(wavelength) - wanted), F.col(band))).alias(band))


def composite(pixels: DataFrame, bands: dict[str, int], masked: Column, low: float = 0.01, high: float = 0.99, gamma: float = 0.8, spectrum: str = "spectrum") -> DataFrame:
    """``pixels`` with a column per name of ``bands``: the band stretched between two quantiles of the
    pixels that aren't masked, held in 0 to 1, to the power ``gamma``; 0 where masked."""
    out = pixels.withColumn("masked__", masked)
    for name, k in bands.items():
        out = out.withColumn(name, F.element_at(spectrum, k + 1))
        ends = quantiles(out.where("not masked__"), [], name, [low, high])
        out = match(out, ends, [])
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(name) - F.col("q0")) / F.greatest(F.col("q1") - F.col("q0"), F.lit(1e-9))))
        out = out.withColumn(name, F.when(F.col("masked__"), 0.0).otherwise(F.pow(share, F.lit(gamma)))).drop("q0", "q1")
    return out.drop("masked__")


def turned_crop(pixels: DataFrame, crop: TurnedCrop, value: str = "score", tile: int = 256) -> DataFrame:
    """``scene_id, y, x, value`` for every place of the crop in every scene of ``pixels`` (scene_id, y, x and
    ``value``, a number or an array of numbers): bilinear between the four pixels around it.

    A place is null if a pixel that weighs in is not there, null or NaN; an element of an array is NaN
    then if only that element is. Source pixels know by their own turned place which square tiles of
    the crop need them, so a task meets one tile's pixels and no more. Scenes without pixels are not
    there; a pixel that is there twice counts once, either one."""
    many = pixels.schema[value].dataType.typeName() == "array"
    place = [F.col("y").cast("double"), F.col("x").cast("double")]
    v, u = crop.from_scene(*place)
    reach = 1.5  # more than the diagonal of a pixel
    last = ((crop.height - 1) // tile, (crop.width - 1) // tile)

    def spans(at: Column, most: int) -> Column:
        low, high = F.floor((at - reach) / tile), F.floor((at + reach) / tile)
        return F.when((high >= 0) & (low <= most), F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(most))))

    slim = pixels.select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("array<double>" if many else "double").alias("value"), v.alias("v"), u.alias("u"))
    needed = slim.withColumn("ty", F.explode(spans(F.col("v"), last[0]))).withColumn("tx", F.explode(spans(F.col("u"), last[1]))).select("scene_id", "ty", "tx", "y", "x", "value")
    tiles = pixels.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last[0]).cast("long"))).alias("ty"))
    tiles = tiles.select(F.col("scene_id").alias("of"), F.col("ty").alias("oy"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last[1]).cast("long"))).alias("ox"))
    turn = math.radians(crop.degrees)
    c, s = math.cos(turn), math.sin(turn)
    middle = (crop.height - 1) / 2, (crop.width - 1) / 2

    def gather(left, right):
        scene, ty, tx = (right.column(n)[0].as_py() for n in ("of", "oy", "ox"))
        rows, columns = (np.arange(t * tile, min((t + 1) * tile, n)) for t, n in ((ty, crop.height), (tx, crop.width)))
        vv, uu = (g.ravel() for g in np.meshgrid(rows, columns, indexing="ij"))
        dv, du = vv - middle[0], uu - middle[1]
        fy, fx = dv * c + du * s + (middle[0] + crop.top), du * c - dv * s + (middle[1] + crop.left)
        y0, x0 = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)
        wy, wx = fy - y0, fx - x0
        low_y, low_x = y0.min(), x0.min()
        if left.num_rows:
            valid = left.column("value").combine_chunks()
            dense = valid.drop_null()
            data = dense.flatten().to_numpy(zero_copy_only=False).reshape(len(dense), -1) if many else dense.to_numpy(zero_copy_only=False)[:, None]
            there = np.flatnonzero(np.asarray(valid.is_valid()))
            py, px = left.column("y").to_numpy()[there] - low_y, left.column("x").to_numpy()[there] - low_x
        else:
            data, py, px = np.empty((0, 1)), np.empty(0, np.int64), np.empty(0, np.int64)
        shape = y0.max() - low_y + 2, x0.max() - low_x + 2
        inside = (py >= 0) & (py < shape[0]) & (px >= 0) & (px < shape[1])
        image = np.full((*shape, data.shape[1]), np.nan)
        has = np.zeros(shape, bool)
        image[py[inside], px[inside]], has[py[inside], px[inside]] = data[inside], True
        out, known = np.zeros((len(vv), data.shape[1])), np.ones(len(vv), bool)
        for i, a in ((0, 1 - wy), (1, wy)):
            for j, b in ((0, 1 - wx), (1, wx)):
                w, at = a * b, (y0 - low_y + i, x0 - low_x + j)
                known &= (w == 0) | has[at]
                out += np.where((w == 0)[:, None], 0.0, w[:, None] * image[at])
        if not many:
            known &= ~np.isnan(out[:, 0])
            values = pa.array(out[:, 0], mask=~known)
        else:
            ends = np.concatenate(([0], np.cumsum(known * out.shape[1]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(out[known].ravel()), mask=pa.array(~known))
        return pa.table({"scene_id": pa.array([scene] * len(vv), pa.string()), "y": pa.array(vv, pa.int32()), "x": pa.array(uu, pa.int32()), value: values})

    kind = "array<double>" if many else "double"
    return needed.groupBy("scene_id", "ty", "tx").cogroup(tiles.groupBy("of", "oy", "ox")).applyInArrow(gather, f"scene_id string, y int, x int, `{value}` {kind}")


#: Weights of red, green and blue in luminance (Rec. 709), and what muted grey keeps of it.
LUMINANCE = (0.2126, 0.7152, 0.0722)
MUTED = 0.42


def at_least_luminance(red: Column, green: Column, blue: Column, threshold: float) -> Column:
    """Whether the luminance of colours from 0 to 255 reaches a threshold from 0 to 100."""
    return (red * LUMINANCE[0] + green * LUMINANCE[1] + blue * LUMINANCE[2]) / 255.0 * 100.0 >= threshold


def luminance_view(red: Column, green: Column, blue: Column, threshold: float) -> Column:
    """``bright, strength, level`` of colours from 0 to 255: whether the luminance reaches the
    threshold (0 to 100), how far beyond it lies from 0 to 1, and the muted grey of the rest."""
    light = red * LUMINANCE[0] + green * LUMINANCE[1] + blue * LUMINANCE[2]
    cut = threshold * 2.55
    bright = light >= cut
    return F.struct(
        bright.alias("bright"),
        F.when(bright, F.least(F.lit(1.0), (light - cut) / F.lit(max(1.0, 255 - cut)))).alias("strength"),
        F.when(~bright, F.floor(light * MUTED + 0.5).cast("int")).alias("level"),
    )
