"""Unmixing: abundances by unconstrained least squares, and endmembers found by clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import dot, dot_columns, literal, norm, scaled_to
from ..store import cut, new_path
from .stats import moments, spectra


def least_squares(endmembers, spectrum: str = "spectrum") -> Column:
    """One abundance per endmember (rows), by the pseudo-inverse."""
    return F.array(*[dot(spectrum, row) for row in np.linalg.pinv(np.asarray(endmembers, float).T)])


def peak_normalised(pixels: DataFrame) -> DataFrame:
    """Pixels with all bands finite and a peak other than 0, divided by it."""
    fine = F.forall("spectrum", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = pixels.where(fine).withColumn("peak_", F.array_max("spectrum")).where("peak_ <> 0")
    return kept.withColumn("spectrum", F.transform("spectrum", lambda v: v / F.col("peak_"))).drop("peak_")


def _merge(means: np.ndarray, distance: float) -> np.ndarray:
    """Average-linkage merging by cosine distance of about a thousand rows at most. The distance of a
    merged pair to any other is the mean of theirs, weighted by their sizes."""
    groups = [[k] for k in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, np.inf)
    while len(groups) > 1:
        i, j = sorted(divmod(int(far.argmin()), len(groups)))
        if far[i, j] >= distance:
            break
        a, b = len(groups[i]), len(groups[j])
        far[i] = far[:, i] = (a * far[i] + b * far[j]) / (a + b)
        far[i, i] = np.inf
        far = np.delete(np.delete(far, j, 0), j, 1)
        groups[i] += groups.pop(j)
    return np.stack([means[g].mean(0) for g in groups])


def ahead_of_others(endmembers: DataFrame, reference) -> DataFrame:
    """``id, ahead``: of every endmember (id, spectrum) the largest cosine with the reference of the
    difference from it to another, both over their peaks; null where there is no other. Endmembers are
    a table of a few thousand rows at most; pairs are made over it alone."""
    over = endmembers.select("id", scaled_to(F.col("spectrum"), F.lit(1.0)).alias("e"))
    other = F.broadcast(over.select(F.col("id").alias("other"), F.col("e").alias("o")))
    step = over.join(other, F.col("id") != F.col("other"), "left").select("id", F.zip_with("o", "e", lambda a, b: a - b).alias("step"))
    size = norm(F.col("step")) * F.lit(float(np.linalg.norm(reference)))
    cosine = F.when(size > 0, dot_columns(F.col("step"), literal(reference)) / size)
    return step.groupBy("id").agg(F.max(cosine).alias("ahead"))


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and the squared distance."""
    far = (centres * centres).sum(1) - 2 * x @ centres.T
    near = far.argmin(1)
    return near, np.maximum(far[np.arange(len(x)), near] + (x * x).sum(1), 0)


def _cluster_sums(rows: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """``start, centre, n, far, total``: rows nearest to each centre of each start, the sum of their squared
    distances and of themselves."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            x, _ = spectra(batch.column(0))
            for s, c in enumerate(sent.value if len(x) else []):
                near, far = _assigned(x, c)
                kinds, at = np.unique(near, return_inverse=True)
                total = np.zeros((len(kinds), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), s, np.int32)), pa.array(kinds.astype(np.int32)), pa.array(np.bincount(at)), pa.array(np.bincount(at, far)), pa.array(list(total), pa.list_(pa.float64()))], names=["start", "centre", "n", "far", "total"])

    parts = rows.select("z").mapInArrow(run, "start int, centre int, n long, far double, total array<double>")
    width = len(centres[0][0])
    sums = [F.sum(F.col("total")[k]) for k in range(width)]
    return parts.groupBy("start", "centre").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.array(*sums).alias("total"))


def _spread(x: np.ndarray, clusters: int, seed: list[int]) -> np.ndarray:
    """Rows to start from: one at random, each next one with a chance that grows with the squared
    distance from those before; any once all rows lie on one."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(clusters, len(x)):
        upto = np.cumsum(far)
        at = int(np.searchsorted(upto, rng.random() * upto[-1], "right")) if upto[-1] > 0 else len(chosen)
        chosen.append(min(at, len(x) - 1))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].astype(float)


def minibatch_centres(rows: DataFrame, clusters: int, starts: int = 3, batches: int = 4, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centres of ``rows`` (key, z) by mini-batches, the best of several starts by the sum of squared
    distances over all rows.

    Rows are dealt into batches by a hash of their key and written by batch. The starts spread over a
    sample of 16 rows a cluster, those of the least hashes; a batch moves each centre to the mean of all that it was given so far. All
    starts go through a batch at once; only sums by centre are gathered. Reruns agree up to rounding."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "clusters")
    rows.select("key", "z", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(batches)).alias("batch_")).write.partitionBy("batch_").parquet(path)
    dealt = spark.read.parquet(path)
    centres, counts = [], []
    sample = np.array([r["z"] for r in dealt.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(16 * clusters).select("z").collect()], float)
    for s in range(starts):
        centres.append(_spread(sample, clusters, [seed, s]))
        counts.append(np.zeros(len(centres[-1])))
    for turn in range(rounds * batches):
        for r in _cluster_sums(dealt.where(F.col("batch_") == turn % batches), centres).collect():
            s, c = r["start"], r["centre"]
            centres[s][c] = (centres[s][c] * counts[s][c] + np.array(r["total"])) / (counts[s][c] + r["n"])
            counts[s][c] += r["n"]
    far = [0.0] * starts
    for r in _cluster_sums(dealt, centres).select("start", "far").collect():
        far[r["start"]] += r["far"]
    return centres[int(np.argmin(far))]


def cluster_unmix(pixels: DataFrame, reference, clusters: int = 1000, components: int = 3, similar: float = 0.9, distance: float = 0.005, seed: int = 1, key: str = "pixel_id") -> DataFrame:
    """Adds ``score``: the abundance of the (negated) reference beside the clusters' mean spectra, not
    below 0; null for pixels that :func:`peak_normalised` leaves out. More clusters than pixels are
    refused unless there are 1000; at most ``clusters`` means are gathered, pixels never are."""
    ref = np.asarray(reference, float)
    valid = cut(peak_normalised(pixels).select(F.xxhash64(*[F.col(c) for c in ("scene_id", key) if c in pixels.columns]).alias("key"), "spectrum"), "unmix-pixels")
    whole = moments(valid.withColumn("scene_id", F.lit("all"))).collect()
    if not whole:
        return pixels.withColumn("score", F.lit(None).cast("double"))
    n, mean = int(whole[0]["n"]), np.array(whole[0]["mean"])
    if len(mean) != len(ref) or clusters > n and clusters != 1000:
        raise ValueError("the reference must have the pixels' bands, and there must be as many pixels as clusters")
    values, vectors = np.linalg.eigh(np.array(whole[0]["m2"]).reshape(len(mean), -1))
    axes = vectors[:, np.argsort(-values, kind="stable")[:components]].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    z = F.array(*[dot("spectrum", a) - F.lit(float(a @ mean)) for a in axes])
    rows = cut(valid.select("key", z.alias("z"), "spectrum"), "unmix-rows")
    centres = minibatch_centres(rows.select("key", "z"), min(clusters, n), seed=seed)

    def means(batches):
        for batch in batches:
            near = _assigned(spectra(batch.column(0))[0], centres)[0]
            x, _ = spectra(batch.column(1))
            kinds, at = np.unique(near, return_inverse=True)
            total = np.zeros((len(kinds), x.shape[1]))
            np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(np.bincount(at)), pa.array(list(total), pa.list_(pa.float64()))], names=["centre", "n", "total"])

    parts = rows.select("z", "spectrum").mapInArrow(means, "centre int, n long, total array<double>")
    bands = parts.select("centre", "n", F.posexplode("total").alias("band", "v")).groupBy("centre", "band").agg((F.sum("v") / F.sum("n")).alias("v"))
    found = bands.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("m")).orderBy("centre").collect()
    ends = np.array([r["m"] for r in found])
    table = pixels.sparkSession.createDataFrame(list(enumerate(ends.tolist())), "id long, spectrum array<double>")
    gone = {r["id"] for r in ahead_of_others(table, ref).where(F.col("ahead") > similar).collect()}
    keep = np.array([k not in gone for k in range(len(ends))])
    ends = _merge(ends[keep] if keep.any() else ends, distance)
    first = np.linalg.pinv(np.vstack([-ref, ends]).T)[0]
    fine = F.forall("spectrum", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.array_max("spectrum") != 0)
    return pixels.withColumn("score", F.when(fine, F.greatest(dot("spectrum", first) / F.array_max("spectrum"), F.lit(0.0))))


def nearest_endmember(endmembers: dict[str, list[float]], spectrum: str = "spectrum") -> Column:
    """Name of the endmember with the least squared distance."""
    far = [F.struct(F.aggregate(F.zip_with(spectrum, literal(v), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e).alias("d"), F.lit(n).alias("name")) for n, v in endmembers.items()]
    return F.array_min(F.array(*far))["name"]
