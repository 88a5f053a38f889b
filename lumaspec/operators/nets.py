"""Small dense networks, trained data-parallel: every step sends the weights once, tasks return the
sums of their rows' gradients, and the driver takes one step of Adam.

Rows are written once, dealt by a hash of their key into batches that are folders of their own, so a
step reads its batch alone, and into files for at least 32 tasks. A row's dropout depends on its key, the step, the layer and the unit by
a counter hash: the forward and the backward pass agree and reruns do, wherever rows lie.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import clip, literal
from ..store import new_path
from .stats import spectra

_TREE = 64
_PARTS = 32


@dataclass(frozen=True)
class Net:
    """``layers``: weights (out, in) and biases from the input on. ``hidden``: what follows every layer
    but the last, "relu" or "gelu". ``centre``, ``scale`` and ``limit`` prepare the input: (x - centre) /
    scale, held within plus and minus the limit. ``dropout``: share of hidden units left out in training."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    hidden: str = "relu"
    dropout: float = 0.0
    seed: int = 0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    limit: float = math.inf
    features: tuple[str, ...] = field(default=())

    @staticmethod
    def start(sizes: list[int], seed: int = 0, **options) -> Net:
        """Weights and biases uniform within one over the root of the layer's inputs, by the seed."""
        rng = np.random.default_rng(seed)
        layers = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            r = 1 / math.sqrt(a)
            layers.append((rng.uniform(-r, r, (b, a)), rng.uniform(-r, r, b)))
        return Net(tuple(layers), seed=seed, **options)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        z = x if self.centre is None else (x - self.centre) / self.scale
        return np.clip(z, -self.limit, self.limit) if math.isfinite(self.limit) else z

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    def with_flat(self, flat: np.ndarray) -> Net:
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return replace(self, layers=tuple(layers))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


def _activate(kind: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What follows a layer, and its slope."""
    if kind == "relu":
        return np.maximum(z, 0), (z > 0).astype(float)
    if kind == "gelu":
        below = (1 + _erf(z / math.sqrt(2))) / 2
        return z * below, below + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    raise ValueError(f"unknown activation {kind}")


def kept_units(keys: np.ndarray, step: int, layer: int, units: int, rate: float, seed: int) -> np.ndarray:
    """One over the share kept where a unit stays, else 0, for each key and unit."""
    counter = (step * 1_000_003 + layer * 7919 + seed * 0x2545F4914F6CDD1D) & ((1 << 64) - 1)
    z = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(units, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(counter)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) / (1 << 53) >= rate) / (1 - rate)


def forward(net: Net, x: np.ndarray, keys: np.ndarray | None = None, step: int = 0) -> tuple[np.ndarray, list]:
    """Outputs of prepared rows, and what the backward pass needs; with ``keys``, units drop out."""
    h, trace = x, []
    for n, (w, b) in enumerate(net.layers):
        z = h @ w.T + b
        if n == len(net.layers) - 1:
            trace.append((h, None))
            return z, trace
        a, slope = _activate(net.hidden, z)
        if keys is not None and net.dropout:
            kept = kept_units(keys, step, n, a.shape[1], net.dropout, net.seed)
            a, slope = a * kept, slope * kept
        trace.append((h, slope))
        h = a
    raise ValueError("a network needs a layer")


def losses(kind: str, out: np.ndarray, y: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's loss and its slope by the outputs. "logistic": of the log-odds, a true row counting
    ``positive`` times. "squared": mean over the outputs."""
    if kind == "logistic":
        w = 1 + (positive - 1) * y
        p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
        loss = positive * y * np.logaddexp(0, -out) + (1 - y) * np.logaddexp(0, out)
        return loss.sum(1), w * (p - y)
    if kind == "squared":
        return ((out - y) ** 2).mean(1), 2 * (out - y) / out.shape[1]
    raise ValueError(f"unknown loss {kind}")


def gradient(net: Net, kind: str, x: np.ndarray, y: np.ndarray, keys: np.ndarray, step: int, positive: float = 1.0) -> tuple[float, np.ndarray]:
    """Sums of the losses and their gradients over prepared rows."""
    out, trace = forward(net, x, keys, step)
    loss, back = losses(kind, out, y, positive)
    parts = []
    for (w, _), (h, _), below in zip(net.layers[::-1], trace[::-1], [*trace[-2::-1], None], strict=True):
        parts += [back.sum(0), (back.T @ h).ravel()]
        if below is not None:
            back = (back @ w) * below[1]
    return float(loss.sum()), np.concatenate(parts[::-1])


@dataclass(frozen=True)
class Training:
    """``batches``: into which rows are dealt; a step takes the next one. ``decay``: of the weights, apart
    from the gradient."""

    steps: int = 60
    rate: float = 1e-2
    batches: int = 1
    decay: float = 0.0


def _summed(rows: DataFrame, tasks: int, net: Net, kind: str, step: int, positive: float) -> tuple[float, float, np.ndarray]:
    """Rows, loss and gradient of a batch: a sum per task, then sums of up to 64 of those until one
    is left."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        n, loss, total = 0, 0.0, 0.0
        for batch in batches:
            x, y = (spectra(batch.column(c))[0] for c in (1, 2))
            if len(x):
                some, slope = gradient(sent.value, kind, x, y, batch.column(0).to_numpy(), step, positive)
                n, loss, total = n + len(x), loss + some, total + slope
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [float(n)], "loss": [loss], "slope": pa.array([total], pa.list_(pa.float64()))})

    def merge(key, table):
        table = table.sort_by("part")
        slope = np.stack(table.column("slope").to_pylist()).sum(0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [sum(table.column("n").to_pylist())], "loss": [sum(table.column("loss").to_pylist())], "slope": pa.array([slope], pa.list_(pa.float64()))})

    schema = "part int, n double, loss double, slope array<double>"
    parts = rows.mapInArrow(run, schema)
    while tasks > _TREE:
        parts = parts.groupBy(F.expr(f"cast(part div {_TREE} as int)").alias("part_")).applyInArrow(merge, schema)
        tasks = -(-tasks // _TREE)
    found = sorted(parts.collect(), key=lambda r: r["part"])
    sent.unpersist()
    return sum(r["n"] for r in found), sum(r["loss"] for r in found), sum(np.array(r["slope"]) for r in found)


def train(rows: DataFrame, net: Net, kind: str, how: Training = Training(), positive: float = 1.0) -> tuple[Net, list[float]]:
    """The network after ``how.steps`` steps of Adam, and each step's mean loss before it. ``rows`` has key
    (a long that tells rows apart), x and y (arrays; both prepared). Rows with a null in any of the
    three are left out; no rows leave the network as it is."""
    spark = rows.sparkSession
    path = new_path(spark, "net-rows")
    fit = rows.select(F.col("key").cast("long").alias("key"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    none = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull())
    fit = fit.where(F.col("key").isNotNull() & none("x") & none("y")).withColumn("batch_", F.pmod(F.xxhash64("key"), F.lit(how.batches)))
    # a table of few numbers a row is one small file else, and every step one task
    dealt = fit.repartition(max(_PARTS, spark.sparkContext.defaultParallelism), "key").sortWithinPartitions("batch_", "key")
    dealt.write.partitionBy("batch_").parquet(path)
    if spark.read.schema(fit.schema).parquet(path).isEmpty():
        return net, []
    batches = [spark.read.schema(fit.schema).parquet(path).where(F.col("batch_") == b).select("key", "x", "y") for b in range(how.batches)]
    batches = [(b, b.rdd.getNumPartitions()) for b in batches]
    flat, first, second, seen = net.flat(), 0.0, 0.0, []
    for step in range(how.steps):
        n, loss, slope = _summed(*batches[step % how.batches], net, kind, step, positive)
        if not n:
            continue
        slope = slope / n
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        t = len(seen) + 1
        flat = flat * (1 - how.rate * how.decay) - how.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        net = net.with_flat(flat)
        seen.append(loss / n)
    return net, seen


def outputs(net: Net, values: str) -> Column:
    """The outputs of an array column as an array; null for null arrays."""

    def run(column: pa.Array) -> pa.Array:
        x, there = spectra(column)
        out = forward(net, net.prepared(x))[0] if len(there) else np.empty((0, 1))
        ends = np.concatenate(([0], np.cumsum(np.asarray(column.is_valid()) * out.shape[1]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~np.asarray(column.is_valid())))

    return F.arrow_udf(run, "array<double>")(F.col(values))


def passes(net: Net, values: str, key: str, times: int = 20) -> tuple[Column, Column]:
    """Mean and deviation of the probability over ``times`` passes in which units drop out by the row's
    key; null for null arrays."""

    def run(column: pa.Array, keys: pa.Array) -> pa.Array:
        x, there = spectra(column)
        mask = pa.array(~np.asarray(column.is_valid()))
        out = np.zeros((2, len(column)))
        if len(there):
            z, k = net.prepared(x), keys.to_numpy(zero_copy_only=False)[there].astype(np.int64)
            p = np.stack([1 / (1 + np.exp(-forward(net, z, k, t)[0][:, 0])) for t in range(times)])
            out[:, there] = p.mean(0), p.std(0)
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["mean", "std"], mask=mask)

    both = F.arrow_udf(run, "struct<mean:double,std:double>")(F.col(values), F.col(key))
    return both["mean"], both["std"]


def reconstruction_error(net: Net, spectrum: str = "spectrum") -> Column:
    """Mean squared difference of a prepared spectrum and what the network makes of it; null for null."""

    def run(column: pa.Array) -> pa.Array:
        x, there = spectra(column)
        out = np.full(len(column), np.nan)
        if len(there):
            z = net.prepared(x)
            out[there] = ((forward(net, z)[0] - z) ** 2).mean(1)
        return pa.array(out, mask=~np.asarray(column.is_valid()))

    return F.arrow_udf(run, "double")(F.col(spectrum))


def fit_classifier(df: DataFrame, features: list[str], label: str, key: str, hidden: tuple[int, ...] = (128, 128), dropout: float = 0.25, seed: int = 1, how: Training = Training()) -> Net:
    """A network of the features' log-odds, in which the true rows weigh as much as the others."""
    stats = df.agg(F.count_if(F.col(label)), F.count_if(~F.col(label)), *[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    k = len(features)
    centre, scale = (np.array([v or 0.0 for v in stats[at : at + k]]) for at in (2, 2 + k))
    net = replace(Net.start([k, *hidden, 1], seed, hidden="relu", dropout=dropout, features=tuple(features)), centre=centre, scale=scale + 1e-6)
    x = F.array(*[(F.col(f) - F.lit(float(c))) / F.lit(float(s)) for f, c, s in zip(features, net.centre, net.scale, strict=True)])
    rows = df.select(F.col(key).alias("key"), x.alias("x"), F.array(F.col(label).cast("double")).alias("y"))
    return train(rows, net, "logistic", how, stats[1] / max(stats[0], 1))[0]


def fit_regressor(df: DataFrame, features: list[str], truth: str, key: str, hidden: tuple[int, ...] = (128, 128), dropout: float = 0.2, seed: int = 1, how: Training = Training(steps=200)) -> Net:
    """A network of the features' best guess of a number, by squared error."""
    stats = df.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    k = len(features)
    centre, scale = (np.array([v or 0.0 for v in stats[at : at + k]]) for at in (0, k))
    net = replace(Net.start([k, *hidden, 1], seed, hidden="relu", dropout=dropout, features=tuple(features)), centre=centre, scale=scale + 1e-6)
    x = F.array(*[(F.col(f) - F.lit(float(c))) / F.lit(float(s)) for f, c, s in zip(features, net.centre, net.scale, strict=True)])
    return train(df.select(F.col(key).alias("key"), x.alias("x"), F.array(F.col(truth).cast("double")).alias("y")), net, "squared", how)[0]


def bottleneck(bands: int) -> int:
    return max(4, min(32, bands // 6))


def fit_autoencoder(pixels: DataFrame, centre: np.ndarray, scale: np.ndarray, key: str = "pixel_id", latent: int | None = None, seed: int = 1, how: Training = Training(decay=1e-5)) -> Net:
    """A network that makes spectra anew through a narrow layer. Spectra are taken by their bands'
    ``centre`` and ``scale`` (medians and robust widths) and held within eight of them; it knows no target."""
    bands = len(centre)
    net = replace(Net.start([bands, latent or bottleneck(bands), bands], seed, hidden="gelu"), centre=np.asarray(centre, float), scale=np.maximum(scale, 1e-4), limit=8.0)
    z = F.zip_with(F.zip_with("spectrum", literal(net.centre), lambda v, c: v - c), literal(net.scale), lambda v, w: clip(v / w, -8.0, 8.0))
    return train(pixels.select(F.col(key).alias("key"), z.alias("x"), z.alias("y")), net, "squared", how)[0]


_SAVED = "name string, version long, facts string, weights array<double>"


def save(spark: SparkSession, path: str, name: str, version: int, net: Net) -> None:
    """Add a version of a named network to the table at ``path``: a row with its shape, its preparation
    and features as JSON, and its weights. Versions are never overwritten; a known one is refused."""
    try:
        if not spark.read.schema(_SAVED).parquet(path).where((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"version {version} of {name} is there already")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    facts = {"sizes": [net.layers[0][0].shape[1], *[len(b) for _, b in net.layers]], "hidden": net.hidden, "dropout": net.dropout, "seed": net.seed, "limit": net.limit, "features": list(net.features)}
    facts |= {k: None if v is None else v.tolist() for k, v in (("centre", net.centre), ("scale", net.scale))}
    spark.createDataFrame([(name, version, json.dumps(facts), net.flat().tolist())], _SAVED).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> Net:
    """A saved version of a network, the last if none is named."""
    rows = spark.read.schema(_SAVED).parquet(path).where(F.col("name") == name)
    rows = rows if version is None else rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    if not found:
        raise ValueError(f"no such version of {name}")
    facts = json.loads(found[0]["facts"])
    net = Net.start(facts["sizes"], facts["seed"], hidden=facts["hidden"], dropout=facts["dropout"], limit=facts["limit"], features=tuple(facts["features"]))
    net = replace(net, **{k: None if facts[k] is None else np.array(facts[k]) for k in ("centre", "scale")})
    return net.with_flat(np.array(found[0]["weights"]))


def probability(net: Net) -> Column:
    """The probability of a row by its feature columns, in batch and stream alike."""
    return _odds(net, lambda z: 1 / (1 + np.exp(-z)))


def logit(net: Net) -> Column:
    return _odds(net, lambda z: z)


def _odds(net: Net, of) -> Column:
    def run(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
        return pa.array(of(forward(net, net.prepared(x))[0][:, 0]), from_pandas=True)

    return F.arrow_udf(run, "double")(*[F.col(f) for f in net.features])
