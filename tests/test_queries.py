"""Queries that no SQL states, against plain versions over small tables."""

import math

import numpy as np
import pytest

from lumaspec.plans import evaluation, learned, tables
from lumaspec.plans.cubes import gated_pca_score


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with the tables, and their rows in NumPy."""
    rng, d = np.random.default_rng(31), str(tmp_path_factory.mktemp("tables"))
    v, label = rng.normal(size=(150, 64)).astype(np.float32), np.arange(150) % 10
    v[label == 3] += np.linspace(0, 0.8, 64, dtype=np.float32)
    spark.createDataFrame([(k, x.tolist(), int(c)) for k, (x, c) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    chars = rng.integers(1, 9000, 400)
    good = rng.random(400) < 1 / (1 + np.exp(-(chars - 3000) / 2500))
    spark.createDataFrame([(k, "ab"[k % 2], int(n)) for k, n in enumerate(chars)], "doc_id long, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d, v.astype(float), label, chars.astype(float), good


def _statistics(x):
    mu, c = x.mean(0), np.cov(x.T, bias=True)
    return mu, c + 1e-6 * np.trace(c) / 64 * np.eye(64)


def _filter(x, label):
    mu, c = _statistics(x)
    t = x[label == 3].mean(0) - mu
    w = np.linalg.solve(c, t)
    return (x - mu) @ w / (t @ w + 1e-12), ((x - mu) @ w) ** 2 / ((t @ w + 1e-12) * (np.einsum("ij,ij->i", (x - mu) @ np.linalg.inv(c), x - mu) + 1e-12))


def _quantile(s):
    return (np.argsort(np.argsort(s)) + 1) / (len(s) + 1)


def _gated(x, label):
    mu, c = _statistics(x)
    values, vectors = np.linalg.eigh(c)
    basis = vectors[:, np.argsort(-values)[:10]]
    z = x - mu
    odd = ((z - z @ basis @ basis.T) ** 2).mean(1)
    return _quantile(_filter(x, label)[0]) * (0.5 + 0.5 * _quantile(odd))


def _in_order(df, column):
    return np.array([r[column] for r in df.orderBy("vec_id").collect()])


def test_gated_scores(spark, small):
    d, x, label, _, _ = small
    want = _gated(x, label)
    assert np.allclose(_in_order(gated_pca_score(spark, d), "score"), want, atol=2e-6)
    image, taps = want.reshape(6, 25), np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    for axis, n in ((0, 6), (1, 25)):
        at = lambda k, n=n: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
        image = sum(w * np.take(image, [at(k + o) for k in range(n)], axis) for o, w in zip(range(-6, 7), taps / taps.sum(), strict=True))
    assert np.allclose(_in_order(learned.smoothed_gated_score(spark, d), "score"), image.ravel(), atol=2e-6)


def test_features_of_pixels(spark, small):
    d, x, label, _, _ = small
    mf, ace = _filter(x, label)
    fy, fx = np.fft.fftfreq(6)[:, None], np.fft.fftfreq(25)[None, :]
    blur = lambda s, sigma: np.fft.ifft2(np.fft.fft2(s.reshape(6, 25)) * np.exp(-2 * np.pi**2 * sigma**2 * (fy**2 + fx**2))).real.ravel()
    got = learned.pixel_features(spark, d)
    for name, s in (("mf", mf), ("ace", ace), ("mf_s", blur(mf, 1.0)), ("mf_w", blur(mf, 2.5)), ("ace_s", blur(ace, 1.5))):
        assert np.allclose(_in_order(got, name), (s - s.mean()) / (s.std() + 1e-6), atol=3e-6), name


def _newton(s, y):
    m, sd = s.mean(), s.std()
    z, w = np.stack(((s - m) / sd, np.ones(len(s))), 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-12 * np.eye(2), z.T @ (p - y))
    return 1 / (1 + np.exp(-z @ w)), lambda t: 1 / (1 + np.exp(-(w[0] * (t - m) / sd + w[1])))


def _scores(q, y):
    q = np.clip(q, 1e-12, 1 - 1e-12)
    return -np.mean(y * np.log(q) + (1 - y) * np.log1p(-q)), np.mean((q - y) ** 2)


def test_calibrations(spark, small):
    d, _, _, chars, good = small
    y, p = good.astype(float), chars / (chars + 1000)
    for query, s in ((tables.platt_scaling_metrics, chars), (tables.temperature_scaling_metrics, np.log(p / (1 - p)))):
        got = query(spark, d).first()
        assert np.allclose((got["nll"], got["brier"]), _scores(_newton(s, y)[0], y), atol=2e-6)
    ids = np.arange(400)
    for r in evaluation.calibration_by_source(spark, d).collect():
        mine = ids % 2 == "ab".index(r["source"])
        fit, held = mine & (ids % 3 == 0), mine & (ids % 3 != 0)
        q = _newton(chars[fit], y[fit])[1](chars[held])
        ranks = np.array([(chars[held] < c).sum() + ((chars[held] == c).sum() + 1) / 2 for c in chars[held]])
        n = y[held].sum()
        auc = (ranks[good[held]].sum() - n * (n + 1) / 2) / (n * (held.sum() - n))
        assert np.allclose((r["nll"], r["brier"], r["auc"]), (*_scores(q, y[held]), auc), atol=3e-6)


def test_clusters_keep_their_bounds(spark, small):
    d, *_ = small
    scores = learned.cluster_unmix(spark, d).collect()
    assert len(scores) == 150 and all(r["score"] >= 0 and math.isfinite(r["score"]) for r in scores)
