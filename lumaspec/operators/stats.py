"""Background statistics: one pass over pixels, merged pairwise, then small matrices on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = "scene_id string, part int, n double, mean array<double>, m2 array<double>"


def _merge(parts):
    n, mean, m2 = 0.0, None, None
    for n2, mean2, s2 in parts:
        mean2, s2 = np.asarray(mean2, float), np.asarray(s2, float).reshape(len(mean2), len(mean2))
        if mean is None:
            n, mean, m2 = n2, mean2, s2
            continue
        d, total = mean2 - mean, n + n2
        m2 = m2 + s2 + np.outer(d, d) * (n * n2 / total)
        mean, n = mean + d * (n2 / total), total
    return n, mean, m2


def spectra(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of an Arrow column as rows of doubles, and which rows of the column they are: those
    that are not null. A null value in a spectrum is NaN; lengths must agree."""
    at = np.flatnonzero(np.asarray(column.is_valid()))
    dense = column.drop_null()
    length = np.diff(dense.offsets.to_numpy())
    if len(length) and (length != length[0]).any():
        raise ValueError("spectra of one scene must have as many bands")
    flat = dense.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(dense), -1) if len(dense) else np.empty((0, 0)), at


def moments(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """``scene_id, n, mean, m2`` per scene: sums of centred products, merged over tasks in two steps
    so that no task or driver meets more than a few dozen parts of one scene. Null spectra count
    nowhere; a null value makes its scene's sums NaN."""

    def run(batches):
        state: dict[str, tuple] = {}
        for batch in batches:
            x, there = spectra(batch.column(1))
            scenes = batch.column(0).take(pa.array(there)).to_pandas()
            for scene, at in scenes.groupby(scenes, dropna=False).indices.items():
                part = x[at]
                mu = part.mean(0)
                here = (float(len(part)), mu, (part - mu).T @ (part - mu))
                state[scene] = _merge([state[scene], here]) if scene in state else here
        task = TaskContext.get().partitionId() // 32
        for scene, (n, mean, m2) in state.items():
            yield pa.RecordBatch.from_pydict({"scene_id": pa.array([None if scene != scene else scene], pa.string()), "part": pa.array([task], pa.int32()), "n": [n], "mean": [mean.tolist()], "m2": [np.ravel(m2).tolist()]})

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", kind="stable")
        n, mean, m2 = _merge(zip(frame["n"], frame["mean"], frame["m2"], strict=True))
        return pd.DataFrame({"scene_id": [frame["scene_id"].iloc[0]], "part": [0], "n": [n], "mean": [mean], "m2": [np.ravel(m2)]})

    parts = pixels.select("scene_id", spectrum).mapInArrow(run, _PART)
    return parts.groupBy("scene_id", "part").applyInPandas(combine, _PART).groupBy("scene_id").applyInPandas(combine, _PART).drop("part")


@dataclass(frozen=True)
class Background:
    """Mean, population covariance with its ridge, and the inverse of that."""

    n: float
    mean: np.ndarray
    covariance: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def of(n: float, mean, m2, ridge: float = 1e-6, floor: float | None = None, pseudo: bool = False) -> Background:
        mean = np.asarray(mean, float)
        c = np.asarray(m2, float).reshape(len(mean), len(mean)) / n
        amount = ridge * np.trace(c) / len(mean)
        c = c + np.eye(len(mean)) * (amount if floor is None else max(floor, amount))
        return Background(n, mean, c, np.linalg.pinv(c, hermitian=True) if pseudo else np.linalg.inv(c))

    def whitener(self) -> np.ndarray:
        values, vectors = np.linalg.eigh(self.covariance)
        return (vectors / np.sqrt(np.maximum(values, 1e-30))) @ vectors.T


def background(pixels: DataFrame, **options) -> Background:
    """Statistics of the one scene in ``pixels``."""
    rows = moments(pixels).collect()
    if len(rows) != 1:
        raise ValueError(f"one scene is needed, {len(rows)} found")
    return Background.of(rows[0]["n"], rows[0]["mean"], rows[0]["m2"], **options)


def mean_spectrum(pixels: DataFrame, where) -> np.ndarray:
    """Band means of the rows for which a condition holds, each band's null and NaN values as in :func:`moments`."""

    def run(batches):
        n, total = 0, 0.0
        for batch in batches:
            x, _ = spectra(batch.column(0))
            if len(x):
                n, total = n + len(x), total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": pa.array([total], pa.list_(pa.float64()))})

    parts = pixels.where(where).select("spectrum").mapInArrow(run, "n long, total array<double>")
    rows = parts.select("n", F.posexplode("total").alias("band", "v")).groupBy("band").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("band").collect()
    return np.array([r["v"] / r["n"] for r in rows])


def background_and_targets(pixels: DataFrame, labels: list[int], label: str = "label", **options) -> tuple[Background, list[np.ndarray]]:
    """Statistics of the one scene in ``pixels`` and the mean spectrum of each of the labels, in one pass:
    the sums of the labels' pixels and of all others are merged."""
    group = F.when(F.col(label).isin(labels), F.col(label)).cast("string")
    rows = moments(pixels.select(F.to_json(F.struct(F.col("scene_id").alias("s"), group.alias("g"))).alias("scene_id"), "spectrum")).collect()
    cells = [(json.loads(r["scene_id"]), r) for r in rows]
    if len({c.get("s") for c, _ in cells}) != 1:
        raise ValueError(f"one scene is needed, {len({c.get('s') for c, _ in cells})} found")
    order = sorted(cells, key=lambda c: c[0].get("g") or "")
    n, mean, m2 = _merge((r["n"], r["mean"], r["m2"]) for _, r in order)
    means = {c.get("g"): np.array(r["mean"]) for c, r in cells}
    return Background.of(n, mean, m2, **options), [means.get(str(k), np.empty(0)) for k in labels]


_FEW = 4096


def _ordered(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def band_quantiles(pixels: DataFrame, points: list[float], spectrum: str = "spectrum") -> np.ndarray:
    """Exact quantiles of every band, one row per point, between the two nearest ranks; null and NaN
    values count nowhere, and a band without others has NaN.

    Values are counted by the first 16 bits of their order, then, where a wanted rank lies, by the next
    16, until few enough are left there to be gathered. Values are neither shuffled nor sorted, and
    what is gathered doesn't grow with the pixels."""

    def counted(level: int, wanted: list[tuple[int, int]] | None, values: bool):
        def run(batches):
            seen: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                x, _ = spectra(batch.column(0))
                if not x.size:
                    continue
                keys, fine = _ordered(np.ascontiguousarray(x)), ~np.isnan(x)
                for band, prefix in wanted or [(b, 0) for b in range(x.shape[1])]:
                    mine = keys[fine[:, band], band]
                    if level:
                        mine = mine[mine >> np.uint64(64 - 16 * level) == prefix]
                    if not values:
                        mine = (mine >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF)
                    for v, n in zip(*np.unique(mine, return_counts=True), strict=True):
                        at = band, prefix, int(v)
                        seen[at] = seen.get(at, 0) + int(n)
            if seen:
                band, prefix, bucket = (np.array(c, np.uint64) for c in zip(*seen, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(prefix.view(np.int64)), pa.array(bucket.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["band", "prefix", "bucket", "n"])

        rows = pixels.select(spectrum).mapInArrow(run, "band int, prefix long, bucket long, n long").groupBy("band", "prefix", "bucket").agg(F.sum("n").alias("n")).collect()
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in rows:
            found.setdefault((r["band"], r["prefix"] % (1 << 64)), {})[r["bucket"] % (1 << 64)] = r["n"]
        return {k: sorted(v.items()) for k, v in found.items()}

    level, where, whole = 0, None, {}
    while True:
        found = counted(level, sorted({(b, p) for (b, _), (p, _, _) in where.items()}) if where else None, where is not None and (level == 4 or max(n for _, _, n in where.values()) <= _FEW))
        if where is None:
            whole = {b: sum(n for _, n in v) for (b, _), v in found.items()}
            where = {(b, r): (0, r, n) for b, n in whole.items() for p in points for r in {int(np.floor((n - 1) * p)), int(np.ceil((n - 1) * p))}}
            done = False
        else:
            done = level == 4 or max(n for _, _, n in where.values()) <= _FEW
        if not where:
            return np.empty((len(points), 0))
        for (band, rank), (prefix, left, _) in where.items():
            for bucket, n in found[band, prefix]:
                if left < n:
                    break
                left -= n
            where[band, rank] = (bucket if done else (prefix << 16) | bucket, left, n)
        if done:
            break
        level += 1
    out = np.full((len(points), max(whole) + 1), np.nan)
    value = lambda key: np.array([key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)], np.uint64).view(float)[0]
    for band, n in whole.items():
        for k, p in enumerate(points):
            place = (n - 1) * p
            low, high = (value(where[band, int(f(place))][0]) for f in (np.floor, np.ceil))
            out[k, band] = low if low == high else (np.ceil(place) - place) * low + (place - np.floor(place)) * high
    return out


def robust_bands(pixels: DataFrame, spectrum: str = "spectrum") -> tuple[np.ndarray, np.ndarray]:
    """Median of every band, and 1.4826 times the median distance from it."""
    middle = band_quantiles(pixels, [0.5], spectrum)[0]
    far = pixels.select(F.zip_with(spectrum, F.lit(middle.tolist()), lambda v, m: F.abs(v - m)).alias(spectrum))
    return middle, 1.4826 * band_quantiles(far, [0.5], spectrum)[0]
