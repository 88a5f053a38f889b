"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and fast Hadamard transforms turn a unit vector pseudo-randomly; its
hash is the nearest signed axis. Several such tables are kept; a query looks into the buckets of its
nearest axes in each table, as many as an audit against brute force asks for, and candidates are
ranked by their exact inner product. A bucket is met in blocks, so neither a full bucket nor a
crowd of queries falls to one task. A query whose buckets hold fewer candidates than it asks for
looks into all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut
from ._vectors import comparable, distinct_vectors, matrix, padded


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalized Walsh-Hadamard transform of each row; a power of two of columns."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class CrossPolytope:
    """Hash of unit vectors: ``tables`` pseudo-rotations to ``2 * dims`` signed axes, times the
    axes of a second rotation's first ``second`` dimensions if buckets would hold too many."""

    dims: int
    longest: float
    lift: bool
    tables: int = 4
    second: int = 0
    seed: int = 5

    @property
    def buckets(self) -> int:
        return 2 * self.dims * max(1, 2 * self.second)

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors among which cosine orders as inner product does."""
        out = np.zeros((len(x), self.dims))
        if self.lift and not query:
            out[:, : x.shape[1]] = x / self.longest
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (out[:, : x.shape[1]] ** 2).sum(1)))
        else:
            out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def axes(self, u: np.ndarray, table: int) -> np.ndarray:
        """How near each bucket of a table is to each row."""

        def turned(stream: int) -> np.ndarray:
            signs = np.random.default_rng([self.seed, table, stream]).choice([-1.0, 1.0], (3, self.dims))
            r = u
            for s in signs:
                r = hadamard(r * s)
            return r

        r = turned(0)
        near = np.concatenate((r, -r), 1)
        if self.second:
            s = turned(1)[:, : self.second]
            other = np.concatenate((s, -s), 1)
            near = (near[:, :, None] + other[:, None, :]).reshape(len(u), -1)
        return near


def _rows(near: np.ndarray, probes: int) -> np.ndarray:
    if probes >= near.shape[1]:
        return np.tile(np.arange(near.shape[1]), (len(near), 1))
    return np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes > 1 else near.argmax(1)[:, None]


def _hashed(rows: DataFrame, how: CrossPolytope, width: int, probes: int, query: bool) -> DataFrame:
    """A row per table and bucket that the vector lies in or looks into. Vectors of one length meet."""
    kind = dict(rows.dtypes)["v"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, length = padded(part.column(1), width)
                unit = how.unit(x, query)
                for t in range(how.tables):
                    b = _rows(how.axes(unit, t), probes)
                    take = pa.array(np.repeat(np.arange(len(b)), b.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.size, t, np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(np.repeat(length, b.shape[1]).astype(np.int32)), part.column(0).take(take), part.column(1).take(take)],
                        names=["t", "bucket", "d", "cid", "v"],
                    )

    return rows.select("cid", "v").mapInArrow(run, f"t int, bucket int, d int, cid long, v {kind}")


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k nearest rows, ties to smaller ids, with scores that no blocking changes."""
    rough, n = q @ x.T, len(x)
    k = min(k, n)
    m = min(k + 8, n)
    top = np.argpartition(-rough, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(m), (len(q), 1))

    def ordered(r: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = (x[some] * q[r][:, None, :]).sum(2)
        names = ids[some]
        order = np.lexsort((names, -exact), axis=1)[:, :k]
        return np.take_along_axis(names, order, 1), np.take_along_axis(exact, order, 1)

    names, score = ordered(np.arange(len(q)), top)
    if m < n:  # where more rows than these may tie with the last, all that may are ordered
        slack = 1e-15 * (8 + x.shape[1]) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        last = np.partition(rough, n - k, axis=1)[:, n - k] - slack
        for r in np.flatnonzero((rough >= last[:, None]).sum(1) > m):
            names[r], score[r] = (a[0] for a in ordered(np.array([r]), np.flatnonzero(rough[r] >= last[r])[None]))
    return names, score


def _audit(classes: DataFrame, queries: DataFrame, how: CrossPolytope, width: int, k: int, recall: float, sample: int) -> tuple[int, float]:
    """Probes that reach ``recall`` of the true neighbours of sampled queries, by a scan of all rows."""
    some = queries.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("cid", "v").collect()
    q, q_length = padded(pa.array([r["v"] for r in some], pa.list_(pa.float64())), width)
    own = np.array([r["cid"] for r in some])
    kind = dict(classes.dtypes)["v"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, (x, length) = part.column(0).to_numpy(), padded(part.column(1), width)
                for d in np.unique(length):
                    asks, rows = np.flatnonzero(q_length == d), np.flatnonzero(length == d)
                    if len(asks):
                        best, score = _best(q[asks], x[rows], np.arange(len(rows))[np.argsort(np.argsort(ids[rows], kind="stable"), kind="stable")], k + 1)
                        take = rows[np.argsort(ids[rows], kind="stable")][best].ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, best.shape[1]).astype(np.int32)), pa.array(ids[take]), pa.array(score.ravel()), part.column(1).take(pa.array(take))], names=["q", "cid", "score", "v"])

    true = classes.select("cid", "v").mapInArrow(run, f"q int, cid long, score double, v {kind}")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    true = true.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("q", "cid", "v").collect()
    true = [r for r in true if r["cid"] != own[r["q"]]]
    if not true:
        return 1, 1.0
    at = np.array([r["q"] for r in true])
    unit, uq = how.unit(padded(pa.array([r["v"] for r in true], pa.list_(pa.float64())), width)[0], False), how.unit(q, True)
    ranks = []
    for t in range(how.tables):
        near, home = how.axes(uq, t), how.axes(unit, t).argmax(1)
        ranks.append((near[at] > near[at, home][:, None]).sum(1))
    rank = np.min(ranks, 0)
    probes = 1
    while (rank < probes).mean() < recall and probes < how.buckets:
        probes = min(how.buckets, max(probes + 1, probes * 9 // 8))
    return probes, float((rank < probes).mean())


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 4, recall: float = 0.95, audit: int = 64, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every row for which
    ``is_query`` (an expression over vec_id) holds, against all rows but itself.

    Vectors that are null, zero, or that hold null or non-finite values take no part; vectors of
    one length are each other's candidates, and equal ones are, too; ties go to the smaller id; rows
    that repeat a vec_id with one vector count once; an empty table gives no rows.
    """
    rows = cut(comparable(vectors).distinct(), "ann-rows")
    classes = distinct_vectors(rows, k + 1)
    asked = cut(rows.where(is_query).join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid", "v"), "ann-asked")
    queries = cut(asked.groupBy("cid", F.size("v").alias("d")).agg(F.first("v").alias("v")).select("cid", "v"), "ann-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    n, low, high, length = classes.agg(F.count("*"), F.min(norm), F.max(norm), F.max(F.size("v"))).first()
    if not n or queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lift = low < high * 0.999
    dims = 1 << (length + lift - 1).bit_length()
    second = 0
    while n / (2 * dims * max(1, 2 * second)) > block and second < dims:
        second = max(2, 2 * second)
    how = CrossPolytope(dims, float(high), lift, tables, second)
    probes, _ = _audit(classes, queries, how, length, k, recall, audit)
    key = ["t", "bucket", "d"]
    index = cut(_hashed(classes, how, length, 1, False), "ann-index")
    size = cut(index.groupBy(*key).agg(F.count("*").alias("n")), "ann-size")

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            best = score = np.empty((0, 1))
        else:
            x, ids, q = matrix(left.column("v")), left.column("cid").to_numpy(), matrix(right.column("v"))
            found = [_best(q[at : at + 512], x, ids, k + 1) for at in range(0, len(q), 512)]
            best, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        ends = pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1])
        return pa.table({
            "qid": right.column("cid") if len(best) else pa.array([], pa.int64()), "d": right.column("d") if len(best) else pa.array([], pa.int32()),
            "ids": pa.ListArray.from_arrays(ends, pa.array(best.ravel().astype(np.int64))), "scores": pa.ListArray.from_arrays(ends, pa.array(score.ravel().astype(float))),
        })

    def merge(key, table):
        ids, at = np.unique(table.column("ids").combine_chunks().flatten().to_numpy(), return_index=True)
        score = table.column("scores").combine_chunks().flatten().to_numpy()[at]
        order = np.lexsort((ids, -score))[: k + 1]
        return pa.table({"qid": pa.array([key[0].as_py()] * len(order), pa.int64()), "d": pa.array([key[1].as_py()] * len(order), pa.int32()), "near": ids[order], "score": score[order]})

    def answers(asked: DataFrame, looks: DataFrame) -> DataFrame:
        """The k best of what the buckets looked into hold, for each of ``asked``."""
        ask = looks.groupBy(*key).agg(F.count("*").alias("m"))
        parts = cut(size.join(ask, key).select(*key, F.ceil(F.col("n") / block).cast("int").alias("n"), F.ceil(F.col("m") / block).cast("int").alias("m")), "ann-parts")

        def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
            return side.join(parts, key).select(
                *key, F.pmod(F.xxhash64("cid"), F.col(mine)).cast("int").alias(f"{mine}_"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_"), "cid", "v"
            ).select(*key, "n_", "m_", "cid", "v")

        cell = [*key, "n_", "m_"]
        met = dealt(index, "n", "m").groupBy(*cell).cogroup(dealt(looks, "m", "n").groupBy(*cell)).applyInArrow(meet, "qid long, d int, ids array<long>, scores array<double>")
        best = met.groupBy("qid", "d").applyInArrow(merge, "qid long, d int, near long, score double")
        named = best.join(classes.select(F.col("cid").alias("near"), F.size("v").alias("d"), "ids"), ["near", "d"]).select("qid", "d", "score", F.explode("ids").alias("vec_id"))
        # the k + 1 first of a class of queries serve all of it
        nth = F.row_number().over(Window.partitionBy("qid", "d").orderBy(F.desc("score"), "vec_id"))
        named = named.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
        out = asked.select("query_id", F.col("cid").alias("qid"), F.size("v").alias("d")).join(named, ["qid", "d"]).where("query_id <> vec_id")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return out.withColumn("rank", turn.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = cut(answers(asked, cut(_hashed(queries, how, length, probes, True), "ann-looks")), "ann-out")
    # one row per length of a vector, so no more than the longest has values
    lengths = F.broadcast(rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("of")))
    got = out.groupBy("query_id").agg(F.count("*").alias("got"))
    few = asked.withColumn("d", F.size("v")).join(lengths, "d").join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("of") - 1))
    few = cut(few.select("query_id", "cid", "v"), "ann-few")
    if few.isEmpty():
        return out
    every = few.groupBy("cid", F.size("v").alias("d")).agg(F.first("v").alias("v"))
    every = every.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(how.buckets - 1))).alias("bucket"), "d", "cid", "v")
    return out.join(few.select("query_id").distinct(), "query_id", "left_anti").unionByName(answers(few, cut(every, "ann-all")))
