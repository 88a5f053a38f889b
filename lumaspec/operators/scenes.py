"""Many scenes and many methods in two passes over the pixels.

The first pass takes the statistics of every scene (:func:`stats.moments`). Tasks turn each scene's
statistics and targets into one matrix that holds the weights of all methods, so neither the driver
nor a task meets more than one scene's matrices at a time. The second pass multiplies the spectra of
a batch by their scene's matrix once and reads every method's score off the product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut
from . import metrics
from .spatial import gaussian_maps
from .stats import Background, moments, spectra

EPS = 1e-12
KINDS = ("matched_filter", "ace", "rx", "subspace", "angle")


@dataclass(frozen=True)
class Method:
    """``kind`` is one of ``KINDS``. ``target`` names the spectra that it may know (``rx`` needs none):
    a filter takes their mean, a subspace all of them up to ``rank``. ``sigma`` smooths the scores
    over the scene, edges reflected; 0 leaves them."""

    name: str
    kind: str
    target: str | None = None
    rank: int | None = None
    sigma: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.target is None) != (self.kind == "rx") or self.sigma < 0:
            raise ValueError(f"{self.name}: a known kind, a target where one is needed and no negative sigma are needed")


_PLAN = "scene_id string, matrix array<double>, offset array<double>, sizes array<int>"


def scene_weights(statistics: DataFrame, targets: DataFrame | dict[str, list], methods: list[Method]) -> DataFrame:
    """``scene_id, matrix, offset, sizes``: one row per scene of ``statistics`` (scene_id, n, mean, m2), with
    the rows of its weights: the whitening of the covariance with its plain ridge, that with the
    floored ridge unless they are equal, and each method's own rows, ``sizes`` of them in turn.
    ``targets`` has scene_id, target, member, spectrum, or is a dict of every scene's target spectra; a
    method whose target a scene lacks has no rows there, and null scores."""
    if isinstance(targets, dict):
        rows = [(t, k, [float(v) for v in s]) for t, family in targets.items() for k, s in enumerate(family)]
        known = statistics.sparkSession.createDataFrame(rows, "target string, member int, spectrum array<double>")
        targets = statistics.select(F.col("scene_id").alias("of_")).crossJoin(F.broadcast(known))
    else:
        targets = targets.withColumnRenamed("scene_id", "of_")

    def build(left, right):
        if not left.num_rows:
            return pa.table({"scene_id": pa.array([], pa.string()), "matrix": pa.array([], pa.list_(pa.float64())), "offset": pa.array([], pa.list_(pa.float64())), "sizes": pa.array([], pa.list_(pa.int32()))})
        n, mean, m2 = left.column("n")[0].as_py(), np.array(left.column("mean")[0].as_py()), left.column("m2")[0].as_py()
        plain, floored = Background.of(n, mean, m2), Background.of(n, mean, m2, floor=EPS)
        known: dict[str, list] = {}
        for r in sorted(right.to_pylist(), key=lambda r: r["member"]):
            known.setdefault(r["target"], []).append(r["spectrum"])
        white = floored.whitener()
        blocks, centred = [plain.whitener()], [True]
        blocks.append(np.empty((0, len(mean))) if np.array_equal(plain.covariance, floored.covariance) else white)
        centred.append(True)
        for m in methods:
            rows, about = np.empty((0, len(mean))), True
            if m.target in known:
                family = np.array(known[m.target], float)
                t = family.mean(0) - mean
                w = plain.inverse @ t
                if m.kind == "matched_filter":
                    rows = (w / (t @ w + EPS))[None]
                elif m.kind == "ace":
                    rows = (w / np.sqrt(t @ w + EPS))[None]
                elif m.kind == "angle":
                    rows, about = (family.mean(0) / (np.linalg.norm(family.mean(0)) + EPS))[None], False
                else:
                    basis, values, _ = np.linalg.svd(((family - mean) @ white).T, full_matrices=False)
                    keep = int((values > max(family.shape) * np.finfo(float).eps * values[0]).sum())
                    rows = basis[:, : min(keep, m.rank or keep)].T @ white
            blocks.append(rows)
            centred.append(about)
        offset = np.concatenate([b @ mean if c else np.zeros(len(b)) for b, c in zip(blocks, centred, strict=True)])
        return pa.table({
            "scene_id": left.column("scene_id").take([0]), "matrix": pa.array([np.concatenate(blocks).ravel()], pa.list_(pa.float64())),
            "offset": pa.array([offset], pa.list_(pa.float64())), "sizes": pa.array([[len(b) for b in blocks]], pa.list_(pa.int32())),
        })

    return statistics.groupBy("scene_id").cogroup(targets.groupBy("of_")).applyInArrow(build, _PLAN)


def _product(x: np.ndarray, plan: tuple, methods: list[Method]) -> list[np.ndarray | None]:
    """All methods' scores of rows of spectra; None where the scene has no weights for one."""
    matrix, offset, sizes = plan
    y = x @ matrix.reshape(len(offset), -1).T - offset
    ends = np.cumsum(sizes)
    parts = [y[:, e - s : e] for e, s in zip(ends, sizes, strict=True)]
    plain = (parts[0] ** 2).sum(1)
    floored = (parts[1] ** 2).sum(1) if sizes[1] else plain
    out = []
    for m, own in zip(methods, parts[2:], strict=True):
        if m.kind == "rx":
            out.append(floored)
        elif not own.shape[1]:
            out.append(None)
        elif m.kind == "matched_filter":
            out.append(own[:, 0])
        elif m.kind == "ace":
            out.append(own[:, 0] ** 2 / (plain + EPS))
        elif m.kind == "subspace":
            out.append((own**2).sum(1) / (floored + EPS))
        else:
            out.append(own[:, 0] / (np.linalg.norm(x, axis=1) + EPS))
    return out


def score_methods(pixels: DataFrame, targets: DataFrame | dict[str, list], methods: list[Method], keep: list[str], most_bytes: int = 1 << 26, part_rows: int = 1 << 16) -> DataFrame:
    """``scene_id``, the columns ``keep`` and a column of scores per method.

    The scenes' weights go to all tasks while they have at most ``most_bytes``; beyond that pixels meet
    them by scene, ``part_rows`` or so in a task. Null spectra have null scores; a scene that has a
    null or NaN value in a spectrum has NaN scores of all methods that know its statistics; an empty
    table gives no rows. Smoothing needs ``y`` and ``x`` among ``keep``.
    """
    weights = cut(scene_weights(cut(moments(pixels), "scene-moments"), targets, methods), "scene-weights")
    names = ["scene_id", *keep]
    slim = pixels.select(*names, "spectrum")
    schema = ", ".join([*[f"`{c}` {t}" for c, t in slim.drop("spectrum").dtypes], *[f"`{m.name}` double" for m in methods]])

    def scored(columns: list, spectrum: pa.Array, scenes: list, plans: dict) -> pa.RecordBatch:
        x, there = spectra(spectrum)
        out = np.full((len(methods), len(spectrum)), np.nan)
        known = np.zeros((len(methods), len(spectrum)), bool)
        of = np.array([scenes[i] for i in there], object)
        for scene in dict.fromkeys(of):
            at = np.array([s == scene for s in of])
            if scene in plans:
                for k, score in enumerate(_product(x[at], plans[scene], methods)):
                    if score is not None:
                        out[k, there[at]], known[k, there[at]] = score, True
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(o, mask=~k) for o, k in zip(out, known, strict=True)]], names=[*names, *[m.name for m in methods]])

    size = weights.agg(F.sum(8 * (F.size("matrix") + F.size("offset")))).first()[0] or 0
    if size <= most_bytes:
        plans = {r["scene_id"]: (np.array(r["matrix"]), np.array(r["offset"]), np.array(r["sizes"])) for r in weights.collect()}
        sent = pixels.sparkSession.sparkContext.broadcast(plans)

        def run(batches):
            for batch in batches:
                yield scored(batch.columns[:-1], batch.column(batch.num_columns - 1), batch.column(0).to_pylist(), sent.value)

        out = slim.mapInArrow(run, schema)
    else:
        counted = slim.groupBy("scene_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts_"))
        parts = cut(metrics.match(weights, counted, ["scene_id"]).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))), "scene-parts")
        dealt = metrics.match(slim, parts.groupBy("scene_id").agg(F.max("parts_").alias("parts_")), ["scene_id"])
        dealt = dealt.withColumn("part_", F.pmod(F.xxhash64(*keep), F.col("parts_")).cast("int")).drop("parts_")

        def meet(left, right):
            plan = right.to_pylist()[0]
            left = left.combine_chunks()
            columns = [left.column(c).chunk(0) if left.num_rows else left.column(c).combine_chunks() for c in names]
            plans = {plan["scene_id"]: (np.array(plan["matrix"]), np.array(plan["offset"]), np.array(plan["sizes"]))}
            spectrum = left.column("spectrum").chunk(0) if left.num_rows else left.column("spectrum").combine_chunks()
            return pa.Table.from_batches([scored(columns, spectrum, columns[0].to_pylist(), plans)])

        out = dealt.groupBy("scene_id", "part_").cogroup(parts.groupBy("scene_id", "part_")).applyInArrow(meet, schema)
    smooth = [m for m in methods if m.sigma]
    if not smooth:
        return out
    out = cut(out, "scene-scores")
    maps = gaussian_maps(out, {f"{m.name}__": (m.name, m.sigma) for m in smooth})
    out = metrics.match(out, maps, ["scene_id", "y", "x"])
    return out.withColumns({m.name: F.col(f"{m.name}__") for m in smooth}).drop(*[f"{m.name}__" for m in smooth])


def scene_rates(scores: DataFrame, methods: list[Method], keys: list[str], label: str = "gt", far: float = 0.05, digits: int = 9) -> DataFrame:
    """``keys, method, auc, pd, positives, negatives``: rank metrics of every scene and method, scores rounded to ``digits``; a missing class has an AUC of 0.5 and a null rate. Null scores and labels
    count nowhere."""
    pairs = F.array(*[F.struct(F.lit(m.name).alias("method"), F.round(m.name, digits).alias("score")) for m in methods])
    long = scores.select(*keys, F.col(label).alias("label"), F.explode(pairs).alias("p")).select(*keys, "label", "p.*")
    long = cut(long.where(F.col("score").isNotNull() & F.col("label").isNotNull()), "scene-long")
    keys = [*keys, "method"]
    auc = metrics.roc_auc(long, keys, "score", "label")
    pd = metrics.pd_at_far(long, keys, far, "score", "label").drop("threshold")
    return metrics.match(auc, pd, keys, "left").select(*keys, "auc", "pd", "positives", "negatives")


def implanted(pixels: DataFrame, target: Column, levels: list[float], gammas: list[float], where: Column) -> DataFrame:
    """Every pixel once per level and mixing: ``level``, ``gamma`` and ``gt`` are added, scene_id tells the
    variants apart, and where the condition holds the target is mixed in by its level (``gamma`` as in
    :func:`functions.spectral.implant`)."""
    variants = F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(float(g)).alias("gamma")) for v in levels for g in gammas])
    out = pixels.withColumn("v_", F.explode(variants)).withColumns({"level": F.col("v_.level"), "gamma": F.col("v_.gamma"), "gt": where}).drop("v_")
    mixed = F.zip_with("spectrum", target, lambda c, t: c + F.col("level") * (t - c) + F.col("gamma") * F.col("level") * (F.lit(1.0) - F.col("level")) * c * t)
    return out.withColumn("spectrum", F.when(F.col("gt"), mixed).otherwise(F.col("spectrum"))).withColumn("scene_id", F.concat_ws("|", "scene_id", "level", "gamma"))
