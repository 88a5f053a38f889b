"""Golden values and identities of the library over small DataFrames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.functions import spectral as S
from lumaspec.model import increasing, nodata, require
from lumaspec.operators import calibrate, detect, evaluate, experiment, geometry, learn, metrics, physics, spatial, stats, unmix
from lumaspec.sources import files, protocol
from lumaspec.sources.envi import EnviSource, binary_of, load_normalised, parse_header
from lumaspec.streaming.score import FrozenFilter, read_pixels, write_scores


def _pixels(spark, cube, scene="s"):
    h, w, b = cube.shape
    rows = [(scene, y * w + x, y, x, [float(v) for v in cube[y, x]]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "scene_id string, pixel_id long, y int, x int, spectrum array<double>")


def _column(df, expr):
    return np.array([r[0] for r in df.orderBy("pixel_id").select(expr.alias("v")).collect()])


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).normal(0.3, 0.1, (9, 8, 6))


def test_statistics_and_detectors_match_numpy(spark, cube):
    px, flat = _pixels(spark, cube).repartition(5), cube.reshape(-1, 6)
    bg = stats.background(px)
    mu, c = flat.mean(0), np.cov(flat.T, bias=True)
    assert np.allclose(bg.mean, mu, atol=1e-14)
    assert np.allclose(bg.covariance, c + 1e-6 * np.trace(c) / 6 * np.eye(6), atol=1e-15)
    t = flat[5] + 0.2
    inv, z = np.linalg.inv(bg.covariance), flat - mu
    want = z @ inv @ (t - mu) / ((t - mu) @ inv @ (t - mu) + 1e-12)
    assert np.allclose(_column(px, detect.matched_filter(bg, t)), want, atol=1e-12)
    rx = np.einsum("ij,jk,ik->i", z, inv, z)
    assert np.allclose(_column(px, detect.mahalanobis(bg)), rx, atol=1e-10)
    one = _column(px, detect.subspace(bg, t, 1))
    assert np.allclose(one, _column(px, detect.ace(bg, t)), rtol=1e-5)


def test_anomaly_is_ranked_first(spark):
    x = np.random.default_rng(0).normal(0, 0.05, (18, 18, 12))
    x[7, 9] += 3
    px = _pixels(spark, x)
    best = px.withColumn("r", detect.mahalanobis(stats.background(px, floor=1e-12))).orderBy(F.desc("r")).first()
    assert (best["y"], best["x"]) == (7, 9)


def test_smoothing_reflects_and_identity(spark, cube):
    px = _pixels(spark, cube).withColumn("score", F.col("spectrum")[0])
    same = {(r["y"], r["x"]): r["score"] for r in spatial.gaussian_reflect(px, 0.0).collect()}
    assert all(math.isclose(same[y, x], cube[y, x, 0]) for y in range(9) for x in range(8))
    flat = spatial.gaussian_reflect(px.withColumn("score", F.lit(2.0)), 1.5).collect()
    assert all(math.isclose(r["score"], 2.0) for r in flat)
    with pytest.raises(ValueError):
        spatial.gaussian_taps(-1)


def test_metric_goldens(spark):
    p = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.8, 1), (0.9, 1)], "p double, y int")
    got = p.agg(metrics.nll("p", "y").alias("nll"), metrics.brier("p", "y").alias("brier")).first()
    assert math.isclose(got["nll"], -np.mean(np.log([0.9, 0.6, 0.8, 0.9])))
    assert math.isclose(got["brier"], np.mean([0.01, 0.16, 0.04, 0.01]))
    assert math.isclose(metrics.calibration_error(metrics.reliability(p, "p", "y", 2)).first()["ece"], 0.2)
    q = spark.createDataFrame([(0.0, 0), (0.2, 1), (0.8, 1), (1.0, 1)], "p double, y int")
    curve = metrics.reliability(q, "p", "y", 5).orderBy("bin").collect()
    assert [r["count"] for r in curve] == [1, 1, 0, 0, 2] and curve[2]["event_rate"] is None
    neg = [(float(v), False) for v in np.linspace(0, 0.999, 1000)]
    rows = spark.createDataFrame([("s", *r) for r in neg + [(v, True) for v in (0.5, 1.1, 1.2, 1.3)]], "k string, score double, label boolean")
    assert metrics.pd_at_far(rows, ["k"], 1e-3).first()["pd"] == 0.75
    one = spark.createDataFrame([("s", 1.0, True), ("s", 2.0, True)], "k string, score double, label boolean")
    assert metrics.roc_auc(one, ["k"]).first()["auc"] == 0.5
    tied = spark.createDataFrame([("s", 1.0, True), ("s", 1.0, False), ("s", 0.0, False)], "k string, score double, label boolean")
    assert metrics.roc_auc(tied, ["k"]).first()["auc"] == 0.75


def test_calibration_goldens(spark):
    truth = np.linspace(0.02, 0.2, 50)
    rows = spark.createDataFrame([(c, float((t - 0.03) / 1.8), float(t)) for c in range(5) for t in truth], "c int, raw double, truth double")
    fit = calibrate.fit_affine(rows, "c", "raw", "truth")
    assert math.isclose(fit.slope, 1.8, rel_tol=1e-9) and math.isclose(fit.intercept, 0.03, rel_tol=1e-9)
    flat = spark.createDataFrame([(0, 0.0, 0.0)] * 100 + [(1, 0.0, 1.0)], "c int, raw double, truth double")
    assert math.isclose(calibrate.fit_affine(flat, "c", "raw", "truth").intercept, 0.5)
    ten = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert [calibrate.finite_quantile(ten, [], "v", a).first()["quantile"] for a in (0.2, 0.1)] == [9.0, 10.0]
    cases = spark.createDataFrame([(c, 0.01 * (c + 1)) for c in range(5) for _ in range(20)], "c int, r double")
    assert math.isclose(calibrate.conformal_radius(cases, "c", "r", 0.2).first()["radius"], 0.05)
    curve = spark.createDataFrame([("a", x, p) for x, p in zip((0.01, 0.02, 0.05, 0.1), (0.2, 0.85, 0.7, 0.95))] + [("b", 0.01, 0.4), ("b", 0.02, 0.7)], "s string, level double, pd double")
    assert {r["s"]: r["limit"] for r in calibrate.detection_limit(curve, ["s"], "level", "pd", 0.8).collect()} == {"a": 0.1, "b": None}
    sep = spark.createDataFrame([(float(s), bool(s > 0.8)) for s in np.linspace(-3, 3, 200)], "s double, y boolean")
    model = calibrate.fit_platt(sep, "s", "y")
    assert model.slope > 0 and sep.agg(F.avg(F.abs(model.apply(F.col("s")) - F.col("y").cast("double")))).first()[0] < 0.1


def test_spectra(spark):
    w = np.array(S.srf_weights(S.wavelengths(601), [405.0 + 10 * k for k in range(60)], 10.0))
    assert np.allclose(w.sum(1), 1)
    assert np.allclose(S.transmittance(S.wavelengths(60), 0.0), 1) and min(S.transmittance(S.wavelengths(601))) >= 0.05
    df = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0, 4.0])], "pixel_id int, s array<double>")
    assert np.allclose(_column(df, S.moving_average(F.col("s"), 5, 3))[0], [1 / 3, 1, 2, 3, 11 / 3])
    x = [-1.0, 0.5, 1.75, 9.0]
    assert np.allclose(_column(df, S.resample(S.literal([1, 4, 9]), S.literal([0, 1, 2]), S.literal(x)))[0], np.interp(x, [0, 1, 2], [1, 4, 9]))
    grid, at = [0.0, 1.0, 2.5, 4.0], [-1.0, 0.0, 0.25, 2.5, 3.9, 4.0, 9.0]
    spectrum = spark.createDataFrame([(0, [3.0, 1.0, 4.0, 2.0])], "pixel_id int, s array<double>")
    assert np.allclose(_column(spectrum, S.interpolate_at(F.col("s"), grid, at))[0], np.interp(at, grid, [3, 1, 4, 2]))
    values = [0.1 * k - 3 for k in range(50)] + [1e-300, -0.0]
    assert _column(spectrum, S.literal(values))[0].tolist() == values
    dip = physics.reporter(601, ((700.0, 12.0, 0.3),))
    seen = spark.createDataFrame([(0, dip)], "pixel_id int, s array<double>")
    moved = _column(seen, physics.transfer("s", S.wavelengths(601), S.wavelengths(601), fwhm=2.0, shift_nm=8.0))[0]
    assert abs(S.wavelengths(601)[int(np.argmin(moved))] - 708) <= 1
    with pytest.raises(ValueError):
        physics.transfer("s", [450.0, 900.0], [400.0, 1000.0], fwhm=5.0)
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0])], "pixel_id int, spectrum array<double>")
    assert _column(zero, nodata()).tolist() == [True, False]


def test_target_in_a_noisy_scene_is_found(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0.1, 0.6, (40, 40, 1)) * np.array(physics.endmembers(30)["soil"]) + rng.normal(0, 0.003, (40, 40, 30))
    t = np.array(physics.reporter(30))
    x[:3, :5] += 0.15 * (t - x[:3, :5])
    px = _pixels(spark, x)
    scored = px.withColumn("score", detect.matched_filter(stats.background(px), t)).withColumn("label", (F.col("y") < 3) & (F.col("x") < 5))
    assert metrics.roc_auc(scored, ["scene_id"]).first()["auc"] > 0.85
    assert px.select(physics.noise_sigma(F.lit(1.0), 20.0).alias("s")).first()["s"] == 0.1
    with pytest.raises(ValueError):
        physics.noise_sigma(F.lit(1.0), float("nan"))


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_round_trip(spark, tmp_path, interleave):
    cube = np.arange(60, dtype="<f4").reshape(5, 4, 3)
    order = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
    (tmp_path / "c.img").write_bytes(b"\0" * 64 + cube.transpose(order).tobytes())
    (tmp_path / "c.hdr").write_text(f"ENVI\n; made = here\nsamples = 4\nlines = 5\nbands = 3\nheader offset = 64\ndata type = 4\ninterleave = {interleave}\nbyte order = 0\nwavelength = {{400,\n 500, 600}}\n")
    spark.dataSource.register(EnviSource)
    rows = spark.read.format("envi").option("partitions", "2").load(str(tmp_path / "c.hdr")).orderBy("pixel_id").collect()
    assert np.allclose([r["spectrum"] for r in rows], cube.reshape(-1, 3))
    head = parse_header((tmp_path / "c.hdr").read_text())
    assert head.wavelengths == [400, 500, 600] and head.comments == {"made": "here"}
    with pytest.raises(ValueError):
        parse_header("ENVI\nsamples = 4\n")
    whole = load_normalised(spark, str(tmp_path / "c.hdr")).orderBy("pixel_id").collect()
    assert whole[0]["spectrum"][0] == 0.0 and whole[-1]["spectrum"][-1] == 1.0
    described = (tmp_path / "c.hdr").read_text() + "description = { a cube }\n"
    assert parse_header(described).fields["description"] == "a cube"
    (tmp_path / "c.img").write_bytes((tmp_path / "c.img").read_bytes() + b"\1" * 32)
    with pytest.raises(Exception, match="should have"):
        spark.read.format("envi").load(str(tmp_path / "c.hdr")).count()
    loose = spark.read.format("envi").option("strict", "false").load(str(tmp_path / "c.hdr")).orderBy("pixel_id").collect()
    assert np.allclose([r["spectrum"] for r in loose], cube.reshape(-1, 3))
    (tmp_path / "c.dat").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        binary_of(str(tmp_path / "c.hdr"))


def test_manifest_states(spark):
    have = files.checksums(spark.createDataFrame([("a", "x"), ("b", "y")], "n string, c string"), "n", "c")
    want = have.union(spark.createDataFrame([("c", 1, "", "")], have.schema)).withColumn("sha256", F.when(F.col("name") == "b", "0").otherwise(F.col("sha256")))
    assert {r["name"]: r["state"] for r in files.verify(have, want).collect()} == {"a": "ok", "b": "checksum", "c": "missing"}
    assert files.unsafe_paths(spark.createDataFrame([("a/b",), ("../c",), ("/d",)], "p string"), "p").count() == 2


def test_stream_equals_batch(spark, cube, tmp_path):
    px = _pixels(spark, cube)
    px.write.parquet(str(tmp_path / "in"))
    model = FrozenFilter(tuple([0.5] * 6), -0.2, 0.7)
    schema = "scene_id string, pixel_id long, y int, x int, spectrum array<double>"
    write_scores(model.apply(read_pixels(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(model.apply(px)).count() == 0 and got.count() == 72


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "matched_filter" in e.queries()


def _smoothed(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r["score"] is None else r["score"]
    return out


def test_smoothing_in_pieces_is_that_of_the_whole(spark):
    image = np.random.default_rng(4).normal(size=(21, 6))
    cells = [("s", y, x, float(image[y, x])) for y in range(21) for x in range(6)]
    df = spark.createDataFrame(cells, "scene_id string, y int, x int, score double").repartition(3)
    at, want = lambda k, n: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n), image
    for axis, n in ((0, 21), (1, 6)):
        want = sum(g * np.take(want, [at(k + o, n) for k in range(n)], axis) for o, g in spatial.gaussian_taps(0.8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tiled = spatial.gaussian_reflect(df, 0.8, tile=8)
    assert tiled.rdd.glom().map(len).filter(bool).count() > 1  # not one task
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose(_smoothed(tiled, 21, 6), want, atol=1e-13)
    fy, fx = np.fft.fftfreq(21)[:, None], np.fft.fftfreq(6)[None, :]
    image[5, 3] = 0
    want = np.fft.ifft2(np.fft.fft2(image) * np.exp(-2 * np.pi**2 * (fy**2 + fx**2))).real
    want[5, 3] = np.nan
    for longest in (1 << 20, 30, 10):  # whole, bands of lines, long columns
        gaps = spatial.gaussian_periodic(df.where("not (y = 5 and x = 3)"), 1.0, longest=longest)
        assert np.allclose(_smoothed(gaps, 21, 6), want, atol=1e-12, equal_nan=True), longest
    turned = spatial.gaussian_periodic(df.where("not (y = 5 and x = 3)").selectExpr("scene_id", "x as y", "y as x", "score"), 1.0, longest=10)
    assert np.allclose(_smoothed(turned, 6, 21), want.T, atol=1e-12, equal_nan=True)  # long rows


def _passes_with_gaps(image, there, axes, kernel):
    """Smoothed along the axes in turn, a missing pixel being 0 in either."""
    out = np.where(there, image, 0.0)
    for axis in axes:
        out = np.where(there, np.moveaxis(np.tensordot(kernel(image.shape[axis]), out, (1, axis)), 0, axis), 0.0)
    return np.where(there, out, np.nan)


def _reflecting(n, sigma):
    k = np.zeros((n, n))
    for row in range(n):
        for o, w in spatial.gaussian_taps(sigma):
            at = (row + o) % (2 * n)
            k[row, at if at < n else 2 * n - 1 - at] += w
    return k


def test_a_last_row_that_is_not_full_is_smoothed(spark):
    image = np.random.default_rng(6).normal(size=(21, 6))
    there = np.ones((21, 6), bool)
    there[20, 2:] = there[7, 4] = False
    cells = [("s", y, x, float(image[y, x])) for y, x in np.argwhere(there).tolist()]
    df = spark.createDataFrame(cells, "scene_id string, y int, x int, score double").withColumn("scene_id", F.lit("s"))
    df = df.withColumn("score", F.coalesce("score", F.lit(0.0)))  # neither column may be null, as with a cube's scores
    want = _passes_with_gaps(image, there, (0, 1), lambda n: _reflecting(n, 0.8))
    for tile in (8, 256):
        assert np.allclose(_smoothed(spatial.gaussian_reflect(df, 0.8, tile=tile), 21, 6), want, atol=1e-13, equal_nan=True), tile
    holed = df.withColumn("score", F.when((F.col("y") > 0) | (F.col("x") > 0), F.col("score")))
    got = _smoothed(spatial.gaussian_reflect(holed, 0.8), 21, 6)
    assert np.isnan(got[0, 0]) and np.allclose(got[8:], want[8:], atol=1e-13, equal_nan=True)


def test_luminance_tells_the_strength_and_the_grey(spark):
    lit = spark.createDataFrame([(255, 255, 255), (100, 100, 100), (0, 0, 0), (None, 0, 0)], "r int, g int, b int")
    got = [r["v"] for r in lit.select(geometry.luminance_view(F.col("r"), F.col("g"), F.col("b"), 20.0).alias("v")).collect()]
    assert [v["bright"] for v in got] == [True, True, False, None]
    assert math.isclose(got[0]["strength"], 1.0) and math.isclose(got[1]["strength"], 49 / 204) and got[0]["level"] is None
    assert got[2]["strength"] is None and got[2]["level"] == 0
    import __spark_entry__ as e

    assert e.queries()["luminance_threshold"](spark, "/root/testdata/sf0.001").columns == ["vec_id", "bright", "strength", "level"]


def test_edges_that_no_double_states(spark):
    rows = spark.createDataFrame([(0.6, 1), (0.59, 0), (0.8, 1), (1.0, 0), (0.2, 1)], "p double, y int")
    got = {r["bin"]: r["count"] for r in metrics.reliability(rows, "p", "y", 5, index=metrics.scaled_index).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}


def test_missing_pixels_carry_nothing_between_passes(spark):
    image = np.random.default_rng(7).normal(size=(21, 6))
    there = np.ones((21, 6), bool)
    there[20, 2:] = there[7, 4] = False
    df = spark.createDataFrame([("s", y, x, float(image[y, x])) for y, x in np.argwhere(there).tolist()], "scene_id string, y int, x int, score double")
    kernel = lambda n: np.fft.ifft(np.fft.fft(np.eye(n), axis=0) * np.exp(-2 * np.pi**2 * np.fft.fftfreq(n)[:, None] ** 2), axis=0).real
    want = _passes_with_gaps(image, there, (0, 1), kernel)
    for longest in (1 << 20, 10):
        assert np.allclose(_smoothed(spatial.gaussian_periodic(df, 1.0, longest=longest, carried=False), 21, 6), want, atol=1e-12, equal_nan=True), longest


def test_medians_hold_no_group_in_one_buffer(spark):
    x = np.random.default_rng(5).integers(0, 40, 301) / 7
    df = spark.createDataFrame([("a" if k < 250 else "b", float(v)) for k, v in enumerate(x)] + [("a", None)], "g string, v double").repartition(3)
    z = calibrate.robust_standardise(df, ["g"], "v")
    assert "median" not in z._jdf.queryExecution().toString() and "percentile" not in z._jdf.queryExecution().toString()
    got = sorted(r["z"] for r in z.where("g = 'a' and v is not null").collect())
    a, m = x[:250], np.median(x[:250])
    assert np.allclose(got, np.sort((a - m) / (1.4826 * np.median(np.abs(a - m)))), atol=1e-12)
    assert np.allclose(list(metrics.quantiles(df, [], "v", [0.02, 0.98]).first()), np.quantile(x, [0.02, 0.98]), atol=1e-12)


def test_areas_of_many_scores_are_right_and_repeat(spark):
    n = 120_000
    df = spark.range(n, numPartitions=7).selectExpr("id", "cast(id % 3 as int) as k", "cast(conv(substr(md5(cast(id as string)), 1, 8), 16, 10) as double) as score", "id % 5 = 0 as label")
    df = df.unionByName(spark.createDataFrame([(n, None, 1.0, True), (n + 1, None, 0.0, False), (n + 2, None, 2.0, False)], df.schema))
    rows = df.toPandas()
    want = {}
    for k, g in rows.groupby(rows["k"].fillna(-1).astype(int)):
        ranks, y = g["score"].rank().to_numpy(), g["label"].to_numpy(bool)
        want[k] = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    for _ in range(2):  # the parts are cut by a sample; results must not be
        got = {-1 if r["k"] is None else r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    curve = metrics.roc_curve(df, ["k"], "id").where("k is null").orderBy("id").collect()
    assert [(r["fpr"], r["tpr"]) for r in curve] == [(0.5, 1.0), (1.0, 1.0), (0.5, 0.0)]
    assert metrics.pd_at_far(df, ["k"], 0.0).where("k is null").first()["pd"] == 0.0
    ranked = metrics.average_ranks(df.where("id < 1000"), ["k"], "score", "r", few=5)  # by a join
    few = rows[rows["id"] < 1000].copy()
    few["r"] = few.groupby("k")["score"].rank()
    assert {r["id"]: r["r"] for r in ranked.collect()} == dict(zip(few["id"], few["r"], strict=True))


def test_probabilities_outside_and_missing(spark):
    rows = spark.createDataFrame([(None, 1), (float("nan"), 0), (-0.5, 0), (1.5, 1), (0.3, None)], "p double, y int")
    got = metrics.reliability(rows, "p", "y", 2).orderBy("bin").collect()
    assert [(r["count"], r["event_rate"]) for r in got] == [(1, 0.0), (1, 1.0)]
    assert metrics.reliability(rows.withColumn("k", F.lit("a")), "p", "y", 2, ["k"]).count() == 2


def test_temperature_at_its_bound_has_the_bias_of_the_bound(spark):
    rows = spark.createDataFrame([(float(s), bool(s < 0)) for s in np.linspace(-3, 3, 61)] * 2 + [(0.5, True)] * 40, "s double, y boolean")
    fit = calibrate.fit_temperature(rows, "s", "y")
    assert math.isclose(fit.slope, math.exp(-10))
    share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    assert abs(rows.agg(F.avg(fit.apply(F.col("s")))).first()[0] - share) < 1e-9


def test_group_fits_are_those_of_each_group(spark):
    rng = np.random.default_rng(12)
    rows = [(g, float(s), bool(rng.random() < 1 / (1 + math.exp(-(m * s + 0.3))))) for g, m in (("a", 0.8), ("b", -1.5), (None, 0.1)) for s in rng.normal(2, 3, 400)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    for r in evaluate.fit_platt_groups(df, ["g"], "s", "y").collect():
        one = calibrate.fit_platt(df.where(F.col("g").eqNullSafe(F.lit(r["g"]))), "s", "y")
        assert math.isclose(r["slope"], one.slope, rel_tol=1e-4) and math.isclose(r["bias"], one.bias, rel_tol=1e-4, abs_tol=1e-4)


def test_verdicts_limits_and_splits(spark):
    v = spark.createDataFrame([(-1.0, -1.0, 0.95), (-1.0, 1.0, 0.95), (1.0, -1.0, 0.95), (-1.0, -1.0, 0.5), (None, 1.0, 0.9)], "e double, w double, c double")
    assert [r[0] for r in v.select(evaluate.abundance_verdict(F.col("e"), F.col("w"), [F.col("c")])).collect()] == ["point_and_interval", "point_only", "interval_only", "point_only", "no_advantage"]
    curve = spark.createDataFrame([("a", 0.1, level, pd, pd - 0.1) for level, pd in ((1, 0.5), (2, 0.95), (3, 0.99), (4, 1.0))] + [("b", 0.1, 1, 1.0, 1.0)], "s string, far double, level int, pd double, pd_low double")
    real = spark.createDataFrame([("a", 0.1, 0.05), ("a", 0.1, 0.14), ("b", 0.1, 0.2)], "s string, far double, realized_far double")
    got = {r["s"]: tuple(r)[2:] for r in evaluate.limit_summary(curve, real, ["s", "far"], "level", "far").collect()}
    assert got == {"a": (True, 2, 4, 2, 4), "b": (False, 1, 1, None, None)}
    rows = spark.createDataFrame([(c, evaluate.SPLITS[c % 3]) for c in range(9)] + [(4, "fit")], "c int, split string")
    assert [tuple(r) for r in evaluate.in_several(rows, "c").collect()] == [(4, 2)]
    means = spark.createDataFrame([("a", 3, 0.8), ("a", 5, 0.896), ("a", 60, 0.9)], "m string, k int, v double")
    assert evaluate.smallest_sufficient(means, ["m"], "k", "v").first()["smallest"] == 5
    assert [r[0] for r in spark.createDataFrame([(0.01, 0.99), (0.02, 1.0), (None, 1.0)], "m double, r double").select(evaluate.reproduced(F.col("m"), F.col("r"))).collect()] == [True, False, False]


def test_levels_of_a_bootstrap(spark):
    cases = [("x", 0, 1.0), ("x", 0, 1.0), ("x", 1, 3.0), ("y", 0, 5.0), ("y", 1, 7.0)]
    df = spark.createDataFrame([(s, t, v, k) for k, (s, t, v) in enumerate(cases)], "s string, t int, v double, k int")
    means = [r["mean"] for r in evaluate.hierarchical_bootstrap(df, "s", "t", "v", "k", 300).orderBy("replicate").collect()]
    # two scenes are drawn: both x, one of each, or both y; strata keep their sizes
    assert len(means) == 300 and {round(m, 9) for m in means} == {round(5 / 3, 9), 3.4, 6.0}
    assert evaluate.hierarchical_bootstrap(df.where("false"), "s", "t", "v", "k", 5).count() == 0


def test_turned_crops_and_colours(spark):
    crop = geometry.TurnedCrop(9, 5, 100.0, 40.0, 90.0)
    p = spark.createDataFrame([(4.0, 2.0), (0.0, 2.0)], "y double, x double")
    y, x = crop.to_scene(F.col("y"), F.col("x"))
    assert np.allclose([tuple(r) for r in p.select(y, x).collect()], [(104, 42), (104, 46)])
    back = crop.from_scene(y, x)
    assert np.allclose([tuple(r) for r in p.select(*back).collect()], [(4, 2), (0, 2)])
    flat = geometry.TurnedCrop(9, 5, 100.0, 40.0, 0.0).polygon(spark.createDataFrame([(1, 0, 0, 9, 5)], "roi int, y0 int, x0 int, y1 int, x1 int")).orderBy("corner").collect()
    assert [(r["y"], r["x"]) for r in flat] == [(100, 40), (100, 44), (108, 44), (108, 40)]
    bands = spark.createDataFrame([(0, 440.0), (1, 460.0), (2, 650.0)], "band int, wavelength double")
    assert geometry.nearest_band(bands, 450.0).first()[0] == 0
    lit = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (None, 0, 0)], "r int, g int, b int").select(geometry.at_least_luminance(F.col("r"), F.col("g"), F.col("b"), 50.0)).collect()
    assert [r[0] for r in lit] == [True, False, None]
    cube = _pixels(spark, np.arange(1, 13, dtype=float).reshape(2, 2, 3))
    seen = geometry.composite(cube, {"r": 0}, F.col("pixel_id") == 3, 0.0, 1.0, 1.0).orderBy("pixel_id").collect()
    assert [round(r["r"], 9) for r in seen] == [0.0, 0.5, 1.0, 0.0]


def test_more_spectra(spark):
    one = spark.createDataFrame([(0, [0.2, 0.4, 0.8, 0.4])], "pixel_id int, s array<double>")
    value = lambda c: np.array(one.select(c.alias("v")).first()["v"])
    assert np.allclose(value(S.smooth_bands(F.col("s"), 4, 0.0)), [0.2, 0.4, 0.8, 0.4])
    k = np.exp(-0.5 * (np.arange(-2, 3) / (1.5 / 2.3548)) ** 2)
    assert np.allclose(value(S.smooth_bands(F.col("s"), 4, 1.5)), np.convolve(np.pad([0.2, 0.4, 0.8, 0.4], 2, mode="edge"), k / k.sum(), mode="valid"))
    assert np.allclose(value(S.scaled_to(F.col("s"), F.lit(2.0))), [0.5, 1, 2, 1]) and np.allclose(value(S.scaled_to(F.transform("s", lambda v: v * 0.0), F.lit(2.0))), 0)
    family = one.select(F.explode(S.shifted_and_tilted(F.col("s"), 4)).alias("f")).select("f.*").collect()
    assert len(family) == 9 and np.allclose(family[4]["spectrum"], [0.2, 0.4, 0.8, 0.4])
    assert np.allclose(next(f["spectrum"] for f in family if (f["shift"], f["tilt"]) == (1, 0.03)), np.array([0.2, 0.2, 0.4, 0.8]) * (1 + 0.03 * np.linspace(-1, 1, 4)))
    with pytest.raises(Exception, match="reach beyond"):
        one.select(S.resample_within(F.col("s"), S.literal([0, 1, 2, 3]), S.literal([0.5, 3.5]))).collect()
    assert np.allclose(value(physics.without_baseline(F.col("s"))), np.maximum(np.array([0.2, 0.4, 0.8, 0.4]) - np.quantile([0.2, 0.4, 0.8, 0.4], 0.05), 0))
    target = physics.synthetic_target(60)
    assert max(target) == 1 and int(np.argmax(target)) == round(0.62 * 59)
    assert np.allclose(value(physics.reflectance(F.col("s"), 0.5)), 0.5 * 10 ** -np.array([0.2, 0.4, 0.8, 0.4]))


def test_null_and_ragged_spectra(spark):
    px = spark.createDataFrame([("s", 0, [1.0, 2.0]), ("s", 1, None), ("s", 2, [3.0, 4.5])], "scene_id string, pixel_id long, spectrum array<double>")
    bg = stats.background(px)
    assert bg.n == 2 and np.allclose(bg.mean, [2, 3.25])
    scores = [r[0] for r in px.orderBy("pixel_id").select(detect.mahalanobis(bg)).collect()]
    assert scores[1] is None and scores[0] >= 0
    with pytest.raises(Exception, match="as many bands"):
        stats.background(px.unionByName(spark.createDataFrame([("s", 3, [1.0])], px.schema)).coalesce(1))


def test_endmembers_ahead_along_the_reference_go(spark):
    ref = np.array([0.0, 1.0, 0.0])
    ends = np.array([[1.0, 0.2, 0.5], [1.0, 0.9, 0.5], [0.2, 0.3, 1.0]])
    table = spark.createDataFrame(list(enumerate(ends.tolist())), "id long, spectrum array<double>")
    ahead = {r["id"]: r["ahead"] for r in unmix.ahead_of_others(table, ref).collect()}
    e = ends / ends.max(1, keepdims=True)
    assert math.isclose(ahead[0], 1.0) and all(math.isclose(ahead[k], max((e[j] - e[k]) @ ref / np.linalg.norm(e[j] - e[k]) for j in range(3) if j != k)) for k in range(3))
    assert unmix.ahead_of_others(table.where("id = 1"), ref).first()["ahead"] is None
    merged = unmix._merge(np.array([[1.0, 0.0], [0.999, 0.01], [0.0, 1.0]]), 0.005)
    assert len(merged) == 2 and np.allclose(merged[0], [0.9995, 0.005])


def test_protocols_listings_and_measured_spectra(spark, tmp_path):
    import json

    roi = lambda k, y0, y1, c: {"index": k, "top_left_yx": [y0, 0], "bottom_right_yx": [y1, 2], "concentration_um": c, "published_classification_score": 0.5}
    whole = {"schema_version": 1, "sources": {"a": 1}, "primary_analysis": {"sample_name": "s", "crop_yx": [[10, 20], [5, 9]], "rotation_degrees": 3.5, "positive_threshold_um": 5, "rois": [roi(0, 0, 4, 1.0), roi(1, 4, 10, 9.0)]}}
    def read(doc):
        path = tmp_path / f"p{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(doc, indent=1))
        return protocol.read_protocol(spark, str(path)).orderBy("roi").collect()
    got = read(whole)
    assert [(r["height"], r["width"], r["top"], r["left"], r["y1"], r["positive"]) for r in got] == [(10, 4, 10, 5, 4, False), (10, 4, 10, 5, 10, True)]
    for fault in ({"schema_version": 2}, {"primary_analysis": whole["primary_analysis"] | {"rois": [roi(1, 0, 4, 1.0)]}}, {"primary_analysis": whole["primary_analysis"] | {"rois": [roi(0, 0, 11, 1.0)]}}):
        with pytest.raises(Exception):
            read(whole | fault)
    (tmp_path / "m.json").write_text(json.dumps({"files": {"b.zip": {"size": 3, "checksum": "md5:1", "download_url": "u", "role": "x"}, "a.zip": {"size": 4}}}))
    assert [(r["name"], r["size"]) for r in protocol.read_listing(spark, str(tmp_path / "m.json")).collect()] == [("a.zip", 4), ("b.zip", 3)]
    (tmp_path / "a.csv").write_text("wavelength_nm,absorbance\n400,0.1\n402,0.3\n410,0.2\n")
    curve = protocol.absorbance_at(spark, str(tmp_path / "a.csv"), S.literal([390.0, 401.0, 406.0, 500.0])).first()["absorbance"]
    assert np.allclose(curve, [0.1, 0.2, 0.25, 0.2])
    grid = spark.createDataFrame([(k, 0.4 + 0.0015 * k) for k in range(5)], "row int, value double")
    values = spark.createDataFrame([("leaf", k, v) for k, v in enumerate((0.1, 0.2, -1.23e34, 0.4, 0.5))], "name string, row int, value double")
    long = protocol.long_spectra([(grid, values)])
    out = [(r["wavelength_nm"], round(r["leaf"], 9)) for r in protocol.wide_spectra(long, ["leaf"]).collect()]
    assert [w for w, _ in out] == [400, 401, 402, 403, 404, 405, 406] and np.allclose([v for _, v in out], np.interp(np.arange(400, 407), [400, 401.5, 404.5, 406], [0.1, 0.2, 0.4, 0.5]))


def test_archives_tables_and_sinks(spark, tmp_path):
    import struct
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "abc")
        z.writestr("d/b.txt", "")
    found = files.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))).orderBy("member").collect()
    assert [(r["member"], r["size"], r["corrupt"]) for r in found] == [("a.txt", 3, False), ("d/b.txt", 0, False)]
    (tmp_path / "s.csv").write_text("wavelength_nm,leaf,soil\n500,0.5,\n400,0.25,0.1\n")
    table = {r["name"]: (r["wavelengths"], r["spectrum"]) for r in files.spectral_table(spark, str(tmp_path / "s.csv")).collect()}
    assert table == {"leaf": ([400.0, 500.0], [0.25, 0.5]), "soil": ([400.0], [0.1])}
    cube = np.arange(24, dtype="<f8").reshape(2, 3, 4)
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    array = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<iii", 2, 3, 4)) + element(1, b"cube") + element(9, cube.tobytes(order="F"))
    (tmp_path / "c.mat").write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49) + element(14, array))
    got = files.mat_cube(spark, str(tmp_path / "c.mat"), "cube").orderBy("pixel_id").collect()
    assert np.allclose([r["spectrum"] for r in got], cube.reshape(-1, 4)) and [(r["y"], r["x"]) for r in got][:4] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    rows = spark.createDataFrame([("a", 1 / 3), ("b", float("nan"))], "k string, v double")
    files.write_csv(rows.where("k = 'a'"), str(tmp_path / "csv"))
    assert "a,0.333333" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    files.write_json(rows, str(tmp_path / "json"))
    assert {r["k"]: r["v"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"a": 1 / 3, "b": None}
    assert experiment.markdown(spark.createDataFrame([(2, "y"), (1, None)], "a int, b string"), "a").first()["report"] == "| a | b |\n|---|---|\n| 1 |  |\n| 2 | y |"
    bad = files.json_rows(spark.createDataFrame([(1, '{"k": 2}'), (2, "{k"), (3, None)], "i int, j string"), "i", "j", "k long").orderBy("i").collect()
    assert [(r["readable"], r["record"] and r["record"]["k"]) for r in bad] == [(True, 2), (False, None), (False, None)]


def test_rates_by_window(spark):
    from lumaspec.streaming.score import windowed_rates

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 3.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    got = windowed_rates(rows, "t", "k", "v", 2.0).orderBy("start").collect()
    assert [(r["k"], r["n"], r["rate"]) for r in got] == [("a", 2, 0.5), ("a", 1, 1.0)]


def test_measured_libraries_models_and_bars(spark, tmp_path):
    table = spark.createDataFrame([("host a", [400.0, 410.0], [0.2, 1.4]), ("host b", [400.0, 410.0], [0.4, 0.0])], "name string, wavelengths array<double>, spectrum array<double>")
    to = S.literal([390.0, 405.0, 410.0])
    assert {r["name"]: [round(v, 9) for v in r["spectrum"]] for r in physics.measured_endmembers(table, to).collect()} == {"host a": [0.2, 0.8, 1.0], "host b": [0.4, 0.2, 0.0]}
    absorbed = physics.measured_absorbances(table, to)
    low = np.quantile([0.2, 0.8, 1.4], 0.05), np.quantile([0.4, 0.2, 0.0], 0.05)
    want = np.mean([np.maximum(np.array([0.2, 0.8, 1.4]) - low[0], 0), np.maximum(np.array([0.4, 0.2, 0.0]) - low[1], 0)], 0)
    mean = physics.canonical(absorbed, "reporter", ["host a", "host b"])
    assert np.allclose(mean.first()["absorbance"], want)
    assert np.allclose(physics.reporter_library(mean).first()["spectrum"], 0.45 * 10**-want)
    model = FrozenFilter((0.5, -1.0), 0.25, 0.7)
    model.save(spark, str(tmp_path / "model"))
    assert FrozenFilter.load(spark, str(tmp_path / "model")) == model
    svg = files.svg_bars(spark.createDataFrame([("a<b", 0.5, 0.4, 0.6), ("c", 0.9, 0.8, 1.0)], "m string, v double, l double, h double"), "m", "v", "l", "h").first()["svg"]
    assert svg.startswith("<svg") and svg.endswith("</svg>") and svg.index(">c<") < svg.index("a&lt;b") and 'width="360.0"' in svg and "M320.0 0H400.0" in svg


def test_rows_that_must_hold(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], "k int, w array<double>")
    assert require(df, F.col("k") > 0, "positive").count() == 2 and [r["k"] for r in increasing(df, "k", "w").collect()] == [2]
    with pytest.raises(Exception, match="below two"):
        require(df, F.col("k") < 2, "below two").collect()
    lo, hi = experiment.oriented(F.lit(1.0), F.lit(2.0), False)
    assert tuple(spark.range(1).select(lo, hi).first()) == (-2.0, -1.0)


def test_shared_tables_and_their_end(spark, tmp_path):
    from lumaspec import store

    kept = store.cut(spark.range(3), "t")
    assert kept.count() == 3 and store.discard_all(spark) >= 1 and store.discard_all(spark) == 0
