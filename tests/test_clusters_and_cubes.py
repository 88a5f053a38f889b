"""Mini-batch clustering with its abundances, and cubes of which only what is asked for is read."""

import builtins

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from lumaspec.operators import unmix
from lumaspec.sources import envi


def _cube(spark):
    rng = np.random.default_rng(7)
    prototypes = np.array([[0.9, 0.7, 0.5, 0.4, 0.3], [0.3, 0.4, 0.6, 0.8, 0.9], [0.7, 0.3, 0.8, 0.4, 0.6], [0.4, 0.8, 0.3, 0.7, 0.5]])
    x = prototypes[np.arange(64) % 4] + rng.normal(0, 0.005, (64, 5))
    x[0] = 0
    rows = [("s", k, k // 8, k % 8, v.tolist()) for k, v in enumerate(x)] + [("s", 64, 8, 0, None), ("s", 65, 8, 1, [1.0, float("nan"), 1.0, 1.0, 1.0])]
    return x, spark.createDataFrame(rows, "scene_id string, pixel_id long, y int, x int, spectrum array<double>").repartition(3)


def test_centres_by_batches_against_plain_ones(spark):
    rng = np.random.default_rng(9)
    z = np.round(rng.normal(size=(300, 2)) + 6 * rng.integers(0, 4, (300, 1)), 6)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], "key long, z array<double>")
    m = df.orderBy("key").select(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)).alias("b"), F.xxhash64("key", F.lit(1)).alias("h")).toPandas()
    sample = z[np.argsort(m["h"].to_numpy(), kind="stable")[:96]]
    best = None
    for s in range(3):
        c = unmix._spread(sample, 6, [1, s])
        seen = np.zeros(6)
        for turn in range(12):
            some = z[m["b"].to_numpy() == turn % 4]
            near = ((some[:, None] - c) ** 2).sum(2).argmin(1)
            for k in range(6):
                mine = some[near == k]
                if len(mine):
                    c[k] = (c[k] * seen[k] + mine.sum(0)) / (seen[k] + len(mine))
                    seen[k] += len(mine)
        far = ((z[:, None] - c) ** 2).sum(2).min(1).sum()
        best = (far, c) if best is None or far < best[0] else best
    assert np.allclose(unmix.minibatch_centres(df.repartition(5), 6), best[1], atol=1e-9)


def test_abundances_of_prototypes(spark):
    x, px = _cube(spark)
    ref = np.array([-0.1, 0.2, 0.7, 0.2, -0.1])
    options = {"clusters": 4, "similar": 1.0, "distance": 1e-6}
    first, second = ({r["pixel_id"]: r["score"] for r in unmix.cluster_unmix(p, ref, **options).collect()} for p in (px, px.repartition(5)))
    assert len(first) == 66 and {k for k, v in first.items() if v is None} == {0, 64, 65}
    assert all(v is None or v >= 0 for v in first.values()) and all((v is None) == (second[k] is None) and (v is None or np.isclose(v, second[k])) for k, v in first.items())
    over = x[1:] / x[1:].max(1, keepdims=True)
    ends = np.stack([over[(np.arange(1, 64) % 4) == k].mean(0) for k in range(4)])
    want = np.maximum(over @ np.linalg.pinv(np.vstack([-ref, ends]).T)[0], 0)
    assert np.allclose([first[k] for k in range(1, 64)], want, atol=1e-9)
    with pytest.raises(ValueError):
        unmix.cluster_unmix(px, ref[:2], **options)
    with pytest.raises(ValueError):
        unmix.cluster_unmix(px, ref, clusters=999)
    assert unmix.cluster_unmix(px.where("pixel_id in (0, 64)"), ref, clusters=2).where("score is null").count() == 2


@pytest.fixture(scope="module")
def cube(tmp_path_factory):
    """The same cube in each order, 12 lines by 7 samples by 5 bands, big-endian shorts after 16 bytes."""
    d, x = tmp_path_factory.mktemp("cubes"), np.arange(12 * 7 * 5).reshape(12, 7, 5)
    for order, axes in (("bsq", (2, 0, 1)), ("bil", (0, 2, 1)), ("bip", (0, 1, 2))):
        (d / f"{order}.img").write_bytes(b"\0" * 16 + x.transpose(axes).astype(">i2").tobytes())
        (d / f"{order}.hdr").write_text(f"ENVI\nsamples = 7\nlines = 12\nbands = 5\nheader offset = 16\ndata type = 2\ninterleave = {order}\nbyte order = 1\n")
    return d, x


class _Counted:
    def __init__(self, file):
        self.file, self.bytes = file, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        self.bytes += n
        return self.file.read(n)


@pytest.mark.parametrize("order", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("filters, lines, samples", [([], (0, 12), (0, 7)), ([GreaterThanOrEqual(("y",), 3), LessThan(("y",), 5)], (3, 5), (0, 7)), ([EqualTo(("y",), 4), GreaterThan(("x",), 1), LessThanOrEqual(("x",), 4.5)], (4, 5), (2, 5)), ([In(("y",), (2, 6)), EqualTo(("pixel_id",), 3)], (2, 7), (0, 7)), ([GreaterThan(("y",), 40)], (0, 0), (0, 7))])
def test_filters_read_their_lines_and_samples_alone(cube, monkeypatch, order, filters, lines, samples):
    d, x = cube
    reader = envi.PruningEnviReader({"path": str(d / f"{order}.hdr"), "partitions": "3", "bands": "1,3"})
    assert list(reader.pushFilters(filters)) == filters  # Spark holds rows against them all the same
    files, plain = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda *a, **k: files.append(_Counted(plain(*a, **k))) or files[-1])
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    monkeypatch.undo()
    want = {(y, c): x[y, c, [1, 3]].tolist() for y in range(*lines) for c in range(*samples)}
    assert {(r["y"], r["x"]): r["spectrum"] for r in rows} == want and all(r["pixel_id"] == r["y"] * 7 + r["x"] for r in rows)
    assert sum(f.bytes for f in files) == len(want) * 2 * (5 if order == "bip" else 2)


def test_filters_reach_the_source(spark, cube):
    d, x = cube
    assert envi.load_cube(spark, str(d / "bil.hdr"), partitions=12).where("y >= 10 and x = 6").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = envi.load_cube(spark, str(d / "bil.hdr"), partitions=12).where("y >= 10 and x = 6")
        assert df.rdd.getNumPartitions() == 2 and [r["spectrum"] for r in df.orderBy("y").collect()] == x[10:, 6].tolist()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception):
        envi.load_cube(spark, str(d / "bil.hdr"), bands="9").count()
