"""Joins by order and place, turned crops, keyed noise, and settings beyond what is broadcast."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.operators import evaluate, experiment, geometry, noise, relate, spatial
from lumaspec.plans import places


def test_last_and_next_against_looking_at_all(spark):
    rng = np.random.default_rng(51)
    left = [(int(k), None if k % 9 == 0 else int(rng.integers(0, 3)), float(rng.integers(0, 40)) / 2) for k in range(300)] + [(900, 1, None), (901, 7, 1.0), (902, 1, float("nan"))]
    left += [(1000 + k, 2, 5.0) for k in range(400)]  # one place many times
    right = [(None if k % 8 == 0 else int(rng.integers(0, 3)), float(rng.integers(0, 15)), int(k)) for k in range(60)] + [(1, None, 5), (2, 5.0, None)]
    a = spark.createDataFrame(left, "id long, k int, t double").repartition(3)
    b = spark.createDataFrame(right, "k int, t double, v int").repartition(3)
    got = {r["id"]: r for r in relate.as_of(a, b, ["k"], "t", ["v"]).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        mine = sorted(((r[1], -1 if r[2] is None else r[2]) for r in right if r[0] == k and r[1] is not None))
        before = [m for m in mine if t is not None and (t != t or m[0] <= t)][-1:]
        after = [m for m in mine if t is not None and t == t and m[0] > t]
        after = [max(m for m in after if m[0] == after[0][0])] if after else []
        for name, want in (("before", before), ("after", after)):
            found = got[i][name]
            if name == "after" and found is not None:
                assert found["t"] == want[0][0]
            else:
                assert (None if found is None else (found["t"], -1 if found["v"] is None else found["v"])) == (want[0] if want else None), (i, name)
    assert relate.as_of(a, b.where("false"), ["k"], "t", ["v"]).where("before is null and after is null").count() == len(left)
    assert relate.as_of(a.where("false"), b, ["k"], "t", ["v"]).count() == 0


def test_between_known_values(spark):
    known = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 2.0, 5.0)], "k string, x double, y double")
    asked = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 1.5, 3.0, 9.0)] + [("b", 0.0), ("c", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["y"] for r in relate.bracketed(asked, known, ["k"], "x", "y").collect()}
    assert got == {("a", 0.0): 10.0, ("a", 1.0): 10.0, ("a", 1.5): 15.0, ("a", 3.0): 30.0, ("a", 9.0): 30.0, ("b", 0.0): 5.0, ("c", 1.0): None}


@pytest.mark.parametrize("crop", [None, geometry.TurnedCrop(20, 30, 5.0, 3.0, 25.0)])
def test_boxes_hold_what_all_pairs_say(spark, crop):
    rng = np.random.default_rng(52)
    points = [(int(k), float(y), float(x)) for k, (y, x) in enumerate(rng.integers(-5, 40, (300, 2)))] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    boxes = [(int(k), *map(float, (y, x, y + h, x + w))) for k, (y, x, h, w) in enumerate(zip(*rng.integers(-9, 30, (2, 80)), *rng.integers(0, 33, (2, 80)), strict=True))]
    boxes += [(900, 0.25, 0.25, 0.5, 0.75), (901, None, 0.0, 1.0, 1.0), (902, -1e6, -1e6, 1e6, 1e6)]
    p = spark.createDataFrame(points, "id long, y double, x double")
    out = relate.in_boxes(p, spark.createDataFrame(boxes, "roi long, y0 double, x0 double, y1 double, x1 double"), crop=crop)
    assert out.columns == ["id", "y", "x", "roi"]
    got = sorted((r["id"], r["roi"]) for r in out.collect())
    want = []
    for i, y, x in points[:300]:
        if crop:
            a, (my, mx) = math.radians(-25.0), ((20 - 1) / 2, (30 - 1) / 2)
            dy, dx = y - my - 5.0, x - mx - 3.0
            y, x = dy * math.cos(a) + dx * math.sin(a) + my, dx * math.cos(a) - dy * math.sin(a) + mx
        want += [(i, b[0]) for b in boxes if None not in b and b[1] <= y < b[3] and b[2] <= x < b[4]]
    assert got == sorted(want)


def test_many_boxes_meet_by_tiles(spark):
    side = spark.range(100_000).select(F.col("id").alias("roi"), (F.col("id") % 500).alias("y0"), (F.col("id") % 300).alias("x0"), (F.col("id") % 500 + 3).alias("y1"), (F.col("id") % 300 + 2).alias("x1"))
    px = spark.range(150_000).select((F.col("id") / 300).cast("int").alias("y"), (F.col("id") % 300).alias("x"))
    out = relate.in_boxes(px, side)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    whole = side.select(F.expr("sum((least(y1, 500) - y0) * (least(x1, 300) - x0))")).first()[0]
    assert out.count() == whole
    assert relate.in_boxes(px, side.where("false")).count() == 0


def _plain_crop(image, crop, y, x):
    a, my, mx = math.radians(crop.degrees), (crop.height - 1) / 2, (crop.width - 1) / 2
    fy, fx = (y - my) * math.cos(a) + (x - mx) * math.sin(a) + my + crop.top, (x - mx) * math.cos(a) - (y - my) * math.sin(a) + mx + crop.left
    total, y0, x0 = 0.0, math.floor(fy), math.floor(fx)
    for i, wy in ((0, 1 - fy + y0), (1, fy - y0)):
        for j, wx in ((0, 1 - fx + x0), (1, fx - x0)):
            if wy * wx:
                if not (0 <= y0 + i < image.shape[0] and 0 <= x0 + j < image.shape[1]) or np.isnan(image[y0 + i, x0 + j]).all():
                    return None
                total = total + wy * wx * image[y0 + i, x0 + j]
    return total


@pytest.mark.parametrize("crop", [geometry.TurnedCrop(9, 13, 4.0, 2.0, 33.0), geometry.TurnedCrop(7, 5, 0.0, 0.0, 0.0), geometry.TurnedCrop(30, 30, -5.0, -5.0, -100.0), geometry.TurnedCrop(4, 4, 500.0, 0.0, 10.0)])
def test_turned_crops_in_tiles(spark, crop):
    rng = np.random.default_rng(53)
    image = rng.normal(size=(20, 17))
    image[3, 4] = np.nan
    rows = [("s", y, x, None if np.isnan(image[y, x]) else float(image[y, x]), [float(image[y, x]), 2.0 * y]) for y in range(20) for x in range(17)]
    px = spark.createDataFrame(rows, "scene_id string, y int, x int, score double, spectrum array<double>").repartition(3)
    for tile in (256, 4):
        got = {(r["y"], r["x"]): r["score"] for r in geometry.turned_crop(px, crop, "score", tile).collect()}
        assert len(got) == crop.height * crop.width
        for (y, x), v in got.items():
            want = _plain_crop(image, crop, y, x)
            assert (v is None and want is None) or np.isclose(v, want), (y, x)
    both = {(r["y"], r["x"]): r["spectrum"] for r in geometry.turned_crop(px, crop, "spectrum", 4).collect()}
    deep = np.stack([image, np.repeat(2.0 * np.arange(20)[:, None], 17, 1)], 2)
    for (y, x), v in both.items():
        want = _plain_crop(deep, crop, y, x)
        assert (v is None and want is None) or np.allclose(v, want, equal_nan=True)
    if not crop.degrees:
        flat = geometry.turned_crop(px, crop, "score").where("score is not null")
        assert flat.count() == 34 and flat.join(px.withColumnRenamed("score", "was"), ["y", "x"]).where("score <> was").count() == 0
    assert geometry.turned_crop(px.where("false"), crop, "score").count() == 0


def test_noise_is_that_of_its_keys(spark):
    n = spark.range(20_000).select(noise.normal(F.lit("a"), F.col("id")).alias("u"), noise.normal(F.lit("b"), F.col("id")).alias("v"))
    m, s, k, r = n.agg(F.avg("u"), F.stddev_pop("u"), F.kurtosis("u"), F.corr("u", "v")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03 and abs(k) < 0.15 and abs(r) < 0.03
    one, other = (spark.range(5).repartition(p).select("id", noise.noise_spectrum(F.lit(4), F.lit("x"), F.col("id")).alias("e")).orderBy("id").collect() for p in (1, 3))
    assert one == other and len({v for r in one for v in r["e"]}) == 20


def test_levels_share_their_noise(spark):
    px = spark.createDataFrame([("s", k, [0.0, 1.0], k == 0) for k in range(6)], "scene_id string, pixel_id long, spectrum array<double>, gt boolean")
    settings = spark.createDataFrame([("a", [1.0, 3.0], 0.1), ("b", [2.0, 2.0], 0.0)], "sensor string, target array<double>, noise_std double")
    out = noise.noisy_variants(px, settings, {"calibrate": [9], "evaluate": [1, 2]}, [0.5]).collect()
    assert len(out) == 2 * 6 * (1 + 2 * 2)
    for r in out:
        t = [1.0, 3.0] if r["sensor"] == "a" else [2.0, 2.0]
        clean = np.array([0.0, 1.0]) + (r["level"] if r["gt"] else 0) * (np.array(t) - [0.0, 1.0])
        assert np.allclose(np.array(r["spectrum"]) - clean, r["noise"]) and (r["sensor"] == "a" or not any(r["noise"]))
    by = {(r["sensor"], r["seed"], r["pixel_id"]): set() for r in out}
    for r in out:
        by[r["sensor"], r["seed"], r["pixel_id"]].add(tuple(r["noise"]))
    assert all(len(v) == 1 for v in by.values())


def test_settings_beyond_what_is_sent(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(40).withColumnRenamed("id", "b")
    pairs = lambda few: sorted(map(tuple, experiment.grid(a, b, few=few).collect()))
    assert pairs(10_000) == pairs(3) == [(i, j) for i in range(7) for j in range(40)]
    assert spatial.lattice(spark.createDataFrame([(y, x) for y in range(10) for x in range(3)], "y int, x int"), most=5).count() == 10


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(54)
    rows = []
    for g, (slope, bias) in {"a": (1.5, 0.3), "b": (0.4, -1.0), "c": (-2.0, 0.0), None: (1.0, 1.0)}.items():
        z = rng.normal(size=150)
        rows += [(g, float(v), bool(rng.random() < 1 / (1 + math.exp(-slope * v - bias)))) for v in z]
    return rows, spark.createDataFrame(rows, "g string, z double, y boolean").repartition(3)


@pytest.mark.parametrize("few", [10_000, 1])
def test_groups_are_fitted_as_each_alone(spark, graded, few):
    rows, df = graded
    got = {r["g"]: (r["slope"], r["bias"]) for r in evaluate.fit_platt_groups(df, ["g"], "z", "y", few=few).collect()}
    for g, (slope, bias) in got.items():
        z, y = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
        p = 1 / (1 + np.exp(-(slope * z + bias)))
        assert abs(((p - y) * z).mean()) < 1e-6 and abs((p - y).mean()) < 1e-6


def test_temperatures_stay_within_their_bounds(graded):
    rows, df = graded
    got = {r["g"]: (r["slope"], r["bias"]) for r in evaluate.fit_temperature_groups(df, ["g"], "z", "y").collect()}
    platt = {r["g"]: (r["slope"], r["bias"]) for r in evaluate.fit_platt_groups(df, ["g"], "z", "y").collect()}
    assert platt["c"][0] < 0 and math.isclose(got["c"][0], math.exp(-10), rel_tol=1e-9) and all(np.allclose(got[g], platt[g]) for g in ("a", "b", None))
    z, y = (np.array([r[k] for r in rows if r[0] == "c"], float) for k in (1, 2))
    assert abs((1 / (1 + np.exp(-(got["c"][0] * z + got["c"][1]))) - y).mean()) < 1e-6


def test_temperatures_by_source(spark, tmp_path):
    """The query against a plain Newton fit of each source's split."""
    rng = np.random.default_rng(55)
    chars = rng.integers(1, 9000, 300)
    good = rng.random(300) < 1 / (1 + np.exp(-(chars - 3000) / 2500))
    spark.createDataFrame([(k, "ab"[k % 2], int(n)) for k, n in enumerate(chars)], "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    p, ids = chars / (chars + 1000), np.arange(300)
    logit, y = np.log(p / (1 - p)), good.astype(float)
    for r in places.temperature_by_source(spark, str(tmp_path)).collect():
        mine = ids % 2 == "ab".index(r["source"])
        fit, held, w = mine & (ids % 3 == 0), mine & (ids % 3 != 0), np.array([1.0, 0.0])
        for _ in range(80):
            q = 1 / (1 + np.exp(-(w[0] * logit[fit] + w[1])))
            x = np.stack([logit[fit], np.ones(fit.sum())], 1)
            w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-12 * np.eye(2), x.T @ (q - y[fit]))
        assert w[0] > 0
        q = np.clip(1 / (1 + np.exp(-(w[0] * logit[held] + w[1]))), 1e-12, 1 - 1e-12)
        assert np.allclose((r["nll"], r["brier"]), (-np.mean(y[held] * np.log(q) + (1 - y[held]) * np.log1p(-q)), np.mean((q - y[held]) ** 2)), atol=3e-5)
