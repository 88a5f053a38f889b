"""Many scenes and methods at once against one scene and one detector at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.operators import detect, scenes, spatial, stats
from lumaspec.operators.scenes import Method
from lumaspec.plans import scenes as plans

METHODS = [
    Method("mf", "matched_filter", "t"), Method("wide", "matched_filter", "family", sigma=1.0), Method("a", "ace", "t"), Method("odd", "rx"), Method("odd_s", "rx", sigma=2.0),
    Method("sub", "subspace", "family", rank=2), Method("all", "subspace", "family"), Method("cos", "angle", "t"),
]


@pytest.fixture(scope="module")
def grid(spark):
    """Three scenes of 6 by 8 pixels and 5 bands, with a target and a family of each its own."""
    rng = np.random.default_rng(41)
    rows, known, cubes = [], [], {}
    for scene in ("a", "b", None):
        x, family = rng.normal(size=(48, 5)) + rng.normal(size=5), rng.normal(size=(3, 5))
        cubes[scene] = x, family
        rows += [(scene, k, k // 8, k % 8, v.tolist(), k % 7 == 0) for k, v in enumerate(x)]
        known += [(scene, "t", 0, family[0].tolist())] + [(scene, "family", k, f.tolist()) for k, f in enumerate(family)]
    px = spark.createDataFrame(rows, "scene_id string, pixel_id long, y int, x int, spectrum array<double>, gt boolean").repartition(4)
    return px, spark.createDataFrame(known, "scene_id string, target string, member int, spectrum array<double>"), cubes


def _rows(df, names):
    return {(r["scene_id"], r["pixel_id"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"most_bytes": 0, "part_rows": 10}])
def test_all_scenes_score_as_each_alone(spark, grid, options):
    px, targets, cubes = grid
    names = [m.name for m in METHODS]
    got = _rows(scenes.score_methods(px, targets, METHODS, ["pixel_id", "y", "x", "gt"], **options), names)
    assert len(got) == 144
    for scene, (_, family) in cubes.items():
        one = px.where(F.col("scene_id").eqNullSafe(scene))
        bg, floored = stats.background(one), stats.background(one, floor=1e-12, pseudo=True)
        columns = {"mf": detect.matched_filter(bg, family[0]), "wide": detect.matched_filter(bg, family.mean(0)), "a": detect.ace(bg, family[0]), "odd": detect.mahalanobis(floored), "odd_s": detect.mahalanobis(floored), "sub": detect.subspace(floored, family, 2), "all": detect.subspace(floored, family), "cos": detect.spectral_angle(family[0])}
        scored = one.select("scene_id", "pixel_id", "y", "x", *[c.alias(n) for n, c in columns.items()])
        maps = spatial.gaussian_maps(scored, {"w_": ("wide", 1.0), "o_": ("odd_s", 2.0)}).withColumnRenamed("scene_id", "s_")
        scored = scored.drop("wide", "odd_s").join(maps.drop("s_"), ["y", "x"]).withColumnsRenamed({"w_": "wide", "o_": "odd_s"})
        want = _rows(scored, names)
        for key, row in want.items():
            assert np.allclose(got[key], row, atol=1e-8), (key, dict(zip(names, zip(got[key], row))))


def test_what_a_scene_lacks_is_null(spark, grid):
    px, targets, _ = grid
    some = px.withColumn("spectrum", F.when(F.col("pixel_id") != 3, F.col("spectrum")))
    methods = [Method("mf", "matched_filter", "t"), Method("odd", "rx")]
    for options in ({}, {"most_bytes": 0}):
        out = scenes.score_methods(some, targets.where("scene_id <> 'a'"), methods, ["pixel_id"], **options).collect()
        assert len(out) == 144 and all((r["odd"] is None) == (r["pixel_id"] == 3) for r in out)
        assert all((r["mf"] is None) == (r["pixel_id"] == 3 or r["scene_id"] != "b") for r in out if r["scene_id"] is not None)
        assert scenes.score_methods(px.where("false"), targets, methods, ["pixel_id"], **options).count() == 0
    same = scenes.score_methods(px, {"t": [[1.0, 2.0, 3.0, 4.0, 5.0]]}, methods, ["pixel_id"])
    assert same.where("mf is null").count() == 0
    with pytest.raises(ValueError):
        Method("x", "rx", "t")


def test_rates_of_every_scene_and_method(spark, grid):
    px, targets, _ = grid
    methods = METHODS[:1] + METHODS[3:4]
    scored = scenes.score_methods(px, targets, methods, ["pixel_id", "gt"])
    rates = {(r["scene_id"], r["method"]): r for r in scenes.scene_rates(scored, methods, ["scene_id"], far=0.1).collect()}
    assert len(rates) == 6
    for (scene, method), r in rates.items():
        rows = scored.where(F.col("scene_id").eqNullSafe(scene)).collect()
        pos, neg = ([round(x[method], 9) for x in rows if x["gt"] is label] for label in (True, False))
        auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
        limit = sorted(neg, reverse=True)[int(0.1 * len(neg))]
        assert (r["positives"], r["negatives"]) == (7, 41) and np.isclose(r["auc"], auc) and np.isclose(r["pd"], np.mean(np.array(pos) > limit))


def test_transfer_tracks_against_plain_detectors(spark, tmp_path):
    """The query whose family has a rank that no SQL states."""
    rng = np.random.default_rng(42)
    v = rng.normal(size=(450, 64)).astype(np.float32) * 0.1
    spark.createDataFrame([(k, x.tolist(), k % 10) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    targets = plans.transfer_targets()
    got = {(r["scene"], r["level"], r["method"]): (r["auc"], r["pd"]) for r in plans.transfer_tracks(spark, str(tmp_path)).collect()}
    assert len(got) == 3 * 2 * 4
    t = np.array(targets["sensor"][0])
    taps = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    ids = np.arange(450)
    for scene in range(3):
        mine = ids[ids // 25 % 3 == scene]
        gt = mine * 37 % 11 == 0
        for level in (0.1, 0.3):
            x = v[mine].astype(float)
            x[gt] = x[gt] + level * (t - x[gt]) + 0.5 * level * (1 - level) * x[gt] * t
            mu = x.mean(0)
            c = np.cov(x.T, bias=True)
            c += 1e-6 * np.trace(c) / 64 * np.eye(64)
            values, vectors = np.linalg.eigh(c)
            white = vectors / np.sqrt(values) @ vectors.T
            z = (x - mu) @ white
            basis = np.linalg.svd(((np.array(targets["family"]) - mu) @ white).T, full_matrices=False)[0][:, :4]
            maps = {"family_spatial": ((z @ basis) ** 2).sum(1) / (z * z).sum(1)}
            for name, of in (("laboratory_spatial", "laboratory"), ("nominal_spatial", "nominal"), ("oracle_spatial", "sensor")):
                w = np.linalg.solve(c, np.array(targets[of][0]) - mu)
                maps[name] = (x - mu) @ w / ((np.array(targets[of][0]) - mu) @ w)
            for name, s in maps.items():
                image = s.reshape(6, 25)
                for axis, n in ((0, 6), (1, 25)):
                    at = lambda k, n=n: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
                    image = sum(w * np.take(image, [at(k + o) for k in range(n)], axis) for o, w in zip(range(-6, 7), taps / taps.sum(), strict=True))
                s = np.round(image.ravel(), 9)
                pos, neg = s[gt], np.sort(s[~gt])[::-1]
                auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
                assert np.allclose(got[f"s{scene}", level, name], (auc, (pos > neg[int(0.05 * len(neg))]).mean()), atol=2e-6), (scene, level, name)
