"""Networks: gradients, training and passes against plain NumPy, saved versions, batch and stream."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.operators import learn, nets, stats
from lumaspec.operators.nets import Net, Training
from lumaspec.plans import learned


def _plain_loss(net, kind, x, y, keys, step, positive):
    h = x
    for n, (w, b) in enumerate(net.layers):
        z = h @ w.T + b
        if n + 1 == len(net.layers):
            break
        h = np.maximum(z, 0) if net.hidden == "relu" else z * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        if net.dropout:
            h = h * nets.kept_units(keys, step, n, h.shape[1], net.dropout, net.seed)
    if kind == "squared":
        return ((z - y) ** 2).mean(1).sum()
    p = 1 / (1 + np.exp(-z))
    return -(positive * y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


@pytest.mark.parametrize("kind, hidden, dropout, out", [("logistic", "relu", 0.25, 1), ("squared", "gelu", 0.0, 3), ("squared", "relu", 0.2, 1)])
def test_gradients_are_the_slopes_of_the_loss(kind, hidden, dropout, out):
    rng = np.random.default_rng(5)
    net = Net.start([4, 6, 5, out], 3, hidden=hidden, dropout=dropout)
    x, keys = rng.normal(size=(30, 4)), rng.integers(0, 1 << 40, 30)
    y = (rng.random((30, out)) < 0.3).astype(float) if kind == "logistic" else rng.normal(size=(30, out))
    loss, slope = nets.gradient(net, kind, x, y, keys, 7, 4.0)
    assert math.isclose(loss, _plain_loss(net, kind, x, y, keys, 7, 4.0), rel_tol=1e-9)
    flat, e = net.flat(), 1e-6
    for k in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[k] += e
        down[k] -= e
        rise = (_plain_loss(net.with_flat(up), kind, x, y, keys, 7, 4.0) - _plain_loss(net.with_flat(down), kind, x, y, keys, 7, 4.0)) / (2 * e)
        assert math.isclose(slope[k], rise, rel_tol=2e-4, abs_tol=2e-5)


def test_units_drop_out_at_their_rate_whatever_the_order():
    keys = np.arange(-2000, 2000)
    kept = nets.kept_units(keys, 3, 1, 40, 0.25, 9)
    assert set(np.unique(kept)) == {0.0, 1 / 0.75} and abs((kept == 0).mean() - 0.25) < 0.01
    turned = nets.kept_units(keys[::-1], 3, 1, 40, 0.25, 9)
    assert (turned[::-1] == kept).all() and (nets.kept_units(keys, 4, 1, 40, 0.25, 9) != kept).any()


def _adam(net, kind, x, y, keys, how, positive, batch):
    """Training as it would be with all rows in one array."""
    flat, m, v, t = net.flat(), 0.0, 0.0, 0
    for step in range(how.steps):
        at = batch == step % how.batches
        t += 1
        g = nets.gradient(net.with_flat(flat), kind, x[at], y[at], keys[at], step, positive)[1] / at.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - how.rate * how.decay * flat - how.rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net.with_flat(flat)


def test_training_over_partitions_is_training(spark, monkeypatch):
    monkeypatch.setattr(nets, "_TREE", 2)  # sums of sums of sums
    rng = np.random.default_rng(6)
    x, y, keys = rng.normal(size=(400, 3)), (rng.random((400, 1)) < 0.2).astype(float), np.arange(400)
    rows = [(int(k), a.tolist(), b.tolist()) for k, a, b in zip(keys, x, y, strict=True)] + [(900, None, [1.0]), (None, [1.0] * 3, [1.0]), (901, [1.0, None, 1.0], [0.0]), (902, [1.0] * 3, None)]
    df = spark.createDataFrame(rows, "key long, x array<double>, y array<double>").repartition(7)
    how, net = Training(steps=12, batches=3, decay=1e-3), Net.start([3, 8, 1], 2, dropout=0.3)
    batch = np.array([r["b"] for r in df.where("key < 400").orderBy("key").select(F.pmod(F.xxhash64("key"), F.lit(3)).alias("b")).collect()])
    got, seen = nets.train(df, net, "logistic", how, 4.0)
    want = _adam(net, "logistic", x, y, keys, how, 4.0, batch)
    assert np.allclose(got.flat(), want.flat(), atol=1e-9) and len(seen) == 12
    again, _ = nets.train(df.repartition(3), net, "logistic", how, 4.0)
    assert np.allclose(got.flat(), again.flat(), atol=1e-9)
    same, none = nets.train(df.where("false"), net, "logistic", how)
    assert none == [] and (same.flat() == net.flat()).all()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, d = np.random.default_rng(31), str(tmp_path_factory.mktemp("tables"))
    v, label = rng.normal(size=(150, 64)).astype(np.float32), np.arange(150) % 10
    v[label == 3] += np.linspace(0, 0.8, 64, dtype=np.float32)
    spark.createDataFrame([(k, x.tolist(), int(c)) for k, (x, c) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, v.astype(float), label


def _in_order(df, column):
    return np.array([r[column] for r in df.orderBy("vec_id").collect()])


def _autoencoder(x):
    middle = np.median(x, 0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - middle), 0), 1e-4)
    z = np.clip((x - middle) / scale, -8, 8)
    net = Net.start([64, 10, 64], 1, hidden="gelu")
    net = _adam(net, "squared", z, z, np.arange(len(x)), Training(decay=1e-5), 1.0, np.zeros(len(x)))
    return ((nets.forward(net, z)[0] - z) ** 2).mean(1), ((nets.forward(Net.start([64, 10, 64], 1, hidden="gelu"), z)[0] - z) ** 2).mean(1)


def test_autoencoder_and_gated_scores(spark, small):
    d, x, label = small
    want, before = _autoencoder(x)
    assert np.allclose(_in_order(learned.autoencoder_error(spark, d), "error"), want, atol=2e-6) and want.mean() < before.mean()
    mu = x.mean(0)
    c = np.cov(x.T, bias=True)
    c += 1e-6 * np.trace(c) / 64 * np.eye(64)
    score = (x - mu) @ np.linalg.solve(c, x[label == 3].mean(0) - mu)
    rank = lambda s: (np.argsort(np.argsort(s)) + 1) / (len(s) + 1)
    gated = rank(score) * (0.5 + 0.5 * rank(want))
    assert np.allclose(_in_order(learned.autoencoder_gated_score(spark, d), "score"), gated, atol=2e-6)
    taps, image = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2), gated.reshape(6, 25)
    for axis, n in ((0, 6), (1, 25)):
        at = lambda k, n=n: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
        image = sum(w * np.take(image, [at(k + o) for k in range(n)], axis) for o, w in zip(range(-6, 7), taps / taps.sum(), strict=True))
    assert np.allclose(_in_order(learned.autoencoder_smoothed_score(spark, d), "score"), image.ravel(), atol=2e-6)


def test_learned_queries_against_plain_training(spark, small):
    d, x, label = small
    names = ["mf", "ace", "mf_s", "mf_w", "ace_s"]
    rows = learned._five(learned.cube(spark, d)).orderBy("pixel_id").select("pixel_id", "gt", *names).collect()
    f, y = np.array([[r[n] for n in names] for r in rows]), np.array([[float(r["gt"])] for r in rows])
    z, keys = (f - f.mean(0)) / (f.std(0) + 1e-6), np.arange(150)
    net = _adam(Net.start([5, 128, 128, 1], 1, dropout=0.25), "logistic", z, y, keys, Training(), (150 - y.sum()) / y.sum(), np.zeros(150))
    logit = nets.forward(net, z)[0][:, 0]
    assert np.allclose(_in_order(learned.mlp_logits(spark, d), "logit"), logit, atol=1e-4)
    assert np.allclose(_in_order(learned.mlp_detector(spark, d), "probability"), 1 / (1 + np.exp(-logit)), atol=1e-4) and logit[label == 3].min() > np.median(logit)
    p = np.stack([1 / (1 + np.exp(-nets.forward(net, z, keys, t)[0][:, 0])) for t in range(20)])
    both = learned.mc_dropout_uncertainty(spark, d)
    assert np.allclose(_in_order(both, "mean"), p.mean(0), atol=1e-4) and np.allclose(_in_order(both, "std"), p.std(0), atol=1e-4)
    a, truth = _in_order(learned.abundance_regression(spark, d), "abundance"), np.arange(150) * 37 % 101 / 200
    assert np.corrcoef(a, truth)[0, 1] > 0.5 and ((a >= 0) & (a <= 1)).all()


def test_members_of_an_ensemble(spark):
    members = spark.createDataFrame([("x", -1.0), ("x", 2.0), ("y", 0.0)], "k string, logit double")
    mean = (1 / (1 + math.e) + 1 / (1 + math.exp(-2))) / 2
    assert {r["k"]: round(r["logit"], 9) for r in learn.ensemble(members, ["k"], "logit").collect()} == {"x": round(math.log(mean / (1 - mean)), 9), "y": 0.0}


def test_versions_of_a_network_side_by_side_in_batch_and_stream(spark, tmp_path):
    path, rng = str(tmp_path / "models"), np.random.default_rng(7)
    one = replace(Net.start([2, 4, 1], 1, dropout=0.1, features=("a", "b c")), centre=np.array([1.0, 2.0]), scale=np.array([2.0, 0.5]))
    two = Net.start([2, 3, 3, 1], 2, hidden="gelu", features=("a", "b c"), limit=3.0)
    nets.save(spark, path, "detector", 1, one)
    nets.save(spark, path, "detector", 2, two)
    nets.save(spark, path, "other", 9, two)
    with pytest.raises(ValueError):
        nets.save(spark, path, "detector", 2, one)
    with pytest.raises(ValueError):
        nets.load(spark, path, "detector", 5)
    schema = "id long, a double, `b c` double"
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(rng.normal(size=(50, 2)))], schema)
    first, last = nets.load(spark, path, "detector", 1), nets.load(spark, path, "detector")
    assert first.dropout == 0.1 and last.hidden == "gelu" and last.limit == 3.0
    score = lambda rows, a, b: rows.select("id", nets.probability(a).alias("p1"), nets.logit(b).alias("z2"))
    batch = sorted(map(tuple, score(df, first, last).collect()))
    assert batch == sorted(map(tuple, score(df, one, two).collect())) and len({r[1] for r in batch}) == 50
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = score(stream, first, last).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scored").collect())) == batch


def test_quantiles_of_bands_without_sorting(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(9000, 3)) * [1, 1e-9, 1e9], 12)
    x[:6000, 0] = 1.25  # more of one value than are gathered
    x[:20, 2] = np.nan
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([None, 1.0, 2.0],)], "spectrum array<double>")
    full = np.vstack([x, [np.nan, 1.0, 2.0]])
    points = [0.0, 0.013, 0.5, 0.99, 1.0]
    assert np.array_equal(stats.band_quantiles(df, points), np.nanquantile(full, points, axis=0)) or np.allclose(stats.band_quantiles(df, points), np.nanquantile(full, points, axis=0), rtol=1e-14, atol=0)
    middle, wide = stats.robust_bands(df)
    assert np.allclose(wide, 1.4826 * np.nanmedian(np.abs(full - np.nanmedian(full, 0)), 0), rtol=1e-12)
    assert stats.band_quantiles(df.where("false"), [0.5]).shape == (1, 0)
    one = stats.band_quantiles(spark.createDataFrame([([-0.0, float("inf")],), ([0.0, float("-inf")],)], "spectrum array<double>"), [0.0, 1.0])
    assert one[:, 0].tolist() == [0, 0] and one[:, 1].tolist() == [-math.inf, math.inf]


def test_every_step_is_shared_by_the_tasks(spark, monkeypatch):
    """Rows that lie in one file are dealt over the cluster, and reruns give the same network."""
    seen, plain = [], nets._summed

    def spy(rows, tasks, *rest):
        seen.append(tasks)
        return plain(rows, tasks, *rest)

    monkeypatch.setattr(nets, "_summed", spy)
    rows = spark.range(2000).coalesce(1).select(F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("x"), F.array((F.sin("id") > 0).cast("double")).alias("y"))
    nets_ = [nets.train(rows, Net.start([2, 4, 1], 1, dropout=0.25), "logistic", Training(steps=4, batches=2))[0] for _ in range(2)]
    assert min(seen) >= spark.sparkContext.defaultParallelism > 1
    assert np.allclose(nets_[0].flat(), nets_[1].flat(), rtol=0, atol=1e-12)
