"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a pair of codewords is a cell, and every
vector lies in one. For a query and a codeword the score of any half that lies there is at most
q c + |q| r, with r the largest distance of such halves from the codeword. A query visits cells by
falling sums of its two bounds, which a heap merges from the two sorted lists, and stops once no
window that it asks about can change: each either has its first rows, all of them above the bound
of the next cell, or begins above it. What a visit finds is computed exactly, in whole numbers, so
results are those of a comparison with all rows.

Visits go in waves of more and more cells; in each, queries meet the rows of the cells that they
visit, both in blocks, as a Spark cogroup. Only the codebooks and the occupied cells (at most the
square of ``most_codes``, for each length of vectors) are with all tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut
from ._vectors import matrix

_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Codes:
    """The index of vectors of one length: codewords and radii of both halves, and its cells in the
    order of their numbers ``i * len(second) + j``."""

    first: np.ndarray
    second: np.ndarray
    radius: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        out = []
        for part, codes, radius in ((q[:h], self.first, self.radius[0]), (q[h:], self.second, self.radius[1])):
            size = float(np.linalg.norm(part))
            worst = np.linalg.norm(codes, axis=1) + radius
            out.append(codes @ part + size * radius + 1e-9 * (1 + size * worst))
        return out[0], out[1]

    def visits(self, q: np.ndarray):
        """Occupied cells with their bounds, the largest first: a heap over the two sorted lists, from
        which a cell goes in once both of its neighbours with larger bounds have come out."""
        a, b = self.bounds(q)
        left, right = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        occupied = set(self.cells.tolist())
        heap, out = [(-(a[left[0]] + b[right[0]]), 0, 0)], np.zeros(len(left), np.int64)
        while heap:
            bound, i, j = heapq.heappop(heap)
            out[i] = j + 1
            cell = int(left[i]) * len(right) + int(right[j])
            if cell in occupied:
                yield cell, -bound
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(left) and y < len(right) and (y == 0 or out[x] == y) and (x == 0 or out[x - 1] > y):
                    heapq.heappush(heap, (-(a[left[x]] + b[right[y]]), x, y))


def _codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """K-means from different rows, evenly taken."""
    different = np.sort(np.unique(x, axis=0, return_index=True)[1])
    codes = x[different[np.unique(np.linspace(0, len(different) - 1, k).astype(int))]]
    for _ in range(rounds):
        near = _nearest(x, codes)
        n = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((codes * codes).sum(1) - 2 * x @ codes.T).argmin(1)


def _by_length(batch: pa.RecordBatch, column: int):
    """Positions and rows of the vectors of each length."""
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, matrix(batch.column(column).take(pa.array(at)))


@dataclass(frozen=True)
class MultiIndex:
    """``rows``: key, label, v, ids, d, cell of all classes; ``codes``: by length of vectors."""

    rows: DataFrame
    codes: dict[int, Codes]


def build(classes: DataFrame, sample: int = 16_384, cell_rows: int = 512, most_codes: int = 512) -> MultiIndex:
    """Index all rows of ``classes`` (key, label, v, ids). Codebooks are fitted on about ``sample`` of
    them, by the hash of key; a codebook has as many codewords as give cells about ``cell_rows`` rows,
    8 at least and ``most_codes`` at most. Radii are those of all rows. Vectors of a length that the
    sample doesn't have are in one cell."""
    n = classes.count()
    keep = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(n, 1))))
    k = int(np.clip(round((n / cell_rows) ** 0.5), 8, most_codes))
    some = classes.where(keep).orderBy("key").select("v").toArrow().combine_chunks()
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in some.to_batches():
        for d, _, x in _by_length(part, 0):
            books[d] = (_codebook(x[:, : d // 2], k), _codebook(x[:, d // 2 :], k))

    def book(d: int):
        return books.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))

    def run(batches):
        for batch in batches:
            for d, at, x in _by_length(batch, 2):
                halves, codes = (x[:, : d // 2], x[:, d // 2 :]), book(d)
                near = [_nearest(h, c) for h, c in zip(halves, codes, strict=True)]
                far = [np.sqrt(((h - c[i]) ** 2).sum(1)) for h, c, i in zip(halves, codes, near, strict=True)]
                columns = [c.take(pa.array(at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(at), d, np.int32)), pa.array((near[0] * len(codes[1]) + near[1]).astype(np.int32)), *[pa.array(f) for f in far]],
                    names=["key", "label", "v", "ids", "d", "cell", "r1", "r2"],
                )

    rows = cut(classes.select("key", "label", "v", "ids").mapInArrow(run, "key string, label long, v array<double>, ids array<long>, d int, cell int, r1 double, r2 double"), "mi-rows")
    found: dict[int, list] = {}
    for r in rows.groupBy("d", "cell").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("d", "cell").collect():  # one row a cell
        found.setdefault(r["d"], []).append((r["cell"], r["r1"], r["r2"]))
    codes = {}
    for d, cells in found.items():
        first, second = book(d)
        at, r1, r2 = (np.array(c) for c in zip(*cells, strict=True))
        radius = np.zeros(len(first)), np.zeros(len(second))
        np.maximum.at(radius[0], at // len(second), r1)
        np.maximum.at(radius[1], at % len(second), r2)
        codes[d] = Codes(first, second, radius, at)
    return MultiIndex(rows, codes)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers; beyond their range, its ends."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    wide = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(wide, _LEAST, _MOST).astype(np.int64)


def search(index: MultiIndex, asks: DataFrame, k: int, same: bool, first: int = 8, growth: int = 8, block: int = 4096) -> DataFrame:
    """``key, lo, hi, vec_id, score, nth``: for each of ``asks`` (key, label, v, windows) and each window (lo, hi)
    of it the first ``k`` rows by falling score, then rising vec_id, whose score lies in the window and
    whose label is the same or, if not ``same``, another."""
    codes = index.codes
    asks = asks.withColumn("d", F.size("v"))
    sizes = cut(index.rows.groupBy("d", "cell").agg(F.count("*").alias("n")), "mi-sizes")
    window = "array<struct<lo:long,hi:long,least:long>>"
    found, done, step = None, 0, first

    def wave(skip: int, take: int):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    if row["d"] not in codes:
                        continue
                    need = min((max(w["lo"], w["least"]) for w in row["windows"]), default=None)
                    for n, (cell, bound) in enumerate(codes[row["d"]].visits(np.array(row["v"]))):
                        if n >= skip + take or need is None or bound < need:
                            break
                        if n >= skip:
                            yield pa.RecordBatch.from_pydict({"key": pa.array([row["key"]]), "d": pa.array([row["d"]], pa.int32()), "cell": pa.array([cell], pa.int32())})

        return run

    def meet(left, right):
        out = []
        if left.num_rows and right.num_rows:
            x, ids, label = matrix(left.column("v")), left.column("ids").to_pylist(), left.column("label").to_numpy()
            order = np.argsort([i[0] for i in ids], kind="stable")
            x, ids, label = x[order], [ids[i] for i in order], label[order]
            for at in range(0, right.num_rows, 512):
                some = right.slice(at, 512)
                score = products(matrix(some.column("v")), x)
                for row, mine, windows, s in zip(some.column("key").to_pylist(), some.column("label").to_pylist(), some.column("windows").to_pylist(), score, strict=True):
                    fits = (label == mine) if same else (label != mine)
                    for w in windows:
                        ok = np.flatnonzero(fits & (s >= max(w["lo"], w["least"])) & (s <= w["hi"]))
                        if len(ok) > k:  # rows of equal score are in the order of their least id
                            ok = ok[np.argsort(-s[ok], kind="stable")[:k]]
                        out += [(row, w["lo"], w["hi"], i, int(s[c])) for c in ok for i in ids[c][:k]]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["key", "lo", "hi", "vec_id", "score"])

    def firsts(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("key", "lo", "hi").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("nth", nth).where(F.col("nth") <= k)

    while True:
        if found is None:
            state = asks.withColumn("windows", F.transform("windows", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), w["lo"].alias("least"))))
        else:  # a window with k rows asks for those that may come before its last
            full = found.where(F.col("nth") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("lo", "hi"), "score"))).alias("kth"))
            state = asks.join(full, "key", "left")
            kth = lambda w: F.coalesce(F.try_element_at("kth", F.struct(w["lo"], w["hi"])), w["lo"])
            state = state.withColumn("windows", F.transform("windows", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), kth(w).alias("least")))).drop("kth")
        state = cut(state.select("key", "label", "d", "v", F.col("windows").cast(window).alias("windows")), "mi-asks")
        visits = cut(state.mapInArrow(wave(done, step), "key string, d int, cell int"), "mi-visits")
        asked = visits.groupBy("d", "cell").agg(F.count("*").alias("m"))
        cells = cut(sizes.join(asked, ["d", "cell"]).select("d", "cell", F.ceil(F.col("n") / block).cast("int").alias("n"), F.ceil(F.col("m") / block).cast("int").alias("m")), "mi-cells")
        if cells.isEmpty():
            break
        block_of = ["d", "cell", "n_", "m_"]

        def dealt(side: DataFrame, mine: str, other: str, name: str, cells: DataFrame = cells) -> DataFrame:
            both = side.join(cells, ["d", "cell"])
            return both.withColumn(f"{mine}_", F.pmod(F.xxhash64(name), F.col(mine)).cast("int")).withColumn(f"{other}_", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        rows = dealt(index.rows, "n", "m", "key").select(*block_of, "label", "v", "ids")
        looks = dealt(visits, "m", "n", "key").join(state.drop("d"), "key").select(*block_of, "key", "label", "v", "windows")
        met = rows.groupBy(*block_of).cogroup(looks.groupBy(*block_of)).applyInArrow(meet, "key string, lo long, hi long, vec_id long, score long")
        met = met if found is None else met.unionByName(found.drop("nth"))
        found, done, step = cut(firsts(met), "mi-found"), done + step, step * growth
    return found if found is not None else asks.sparkSession.createDataFrame([], "key string, lo long, hi long, vec_id long, score long, nth int")


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **options) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor (an
    expression over vec_id) and each of its first ``positives`` other rows of the same label the first
    ``negatives`` rows of another label whose score is ``low`` to ``high`` per cent of the positive's.

    ``vectors`` has vec_id, label and an embedding of whole numbers; the score is the inner product,
    higher first, then by smaller vec_id. Rows with a null id, label or vector or any null or
    non-finite component take no part; a zero vector does. Vectors meet those of their length. Rows
    alike in id, label and vector count once; rows alike in label and vector are one class, so a
    vector that is there any number of times is compared once. An empty table gives no rows.
    """
    x, none = F.col("v"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = cut(rows.where(fit).distinct().withColumn("key", F.md5(F.to_json(F.struct("label", "v")).cast("binary"))), "mi-vectors")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= max(positives + 1, negatives))  # each task passes on few rows of a class
    classes = cut(few.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "mi-classes")
    anchors = cut(rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "key"), "mi-anchors")
    queries = cut(classes.join(anchors, "key", "left_semi").select("key", "label", "v"), "mi-queries")
    if queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], none)
    index = build(classes)
    whole = F.array(F.struct(F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi")))
    near = search(index, queries.withColumn("windows", whole), positives + 1, True, **options)
    wide = F.col("score").cast("decimal(20,0)")
    near = near.select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(wide * low / 100).cast("long").alias("lo"), F.floor(wide * high / 100).cast("long").alias("hi"))
    near = cut(near, "mi-near")
    windows = near.where("lo <= hi").groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))  # at most one a positive
    far = search(index, queries.join(windows, "key"), negatives, False, **options)
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    first = anchors.join(near, "key").where("positive_id <> anchor_id").withColumn("turn", turn).where(F.col("turn") <= positives)
    far = far.select("key", "lo", "hi", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.join(far, ["key", "lo", "hi"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
