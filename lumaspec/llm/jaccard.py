"""Grouped prefix join: documents whose sets of word shingles have a Jaccard similarity of at least
a percentage.

Shingles are ordered rarest first, by a sketch of the counts over all documents; two similar sets
share a shingle among their first few. Documents equal in size and prefix are one group; groups
meet through the shingles of their prefixes; lengths and positions rule most meetings out; what is
left is expanded to members and verified on whole texts. Shingles are told apart by 64-bit hashes.

So that a large group of near copies never becomes all its pairs, a shingle's groups are first
compared with one of them, the one of the commonest shingles (copies with edits hold rare ones).
Verified links give components; then only groups of different components are compared, all of
those that lengths and positions allow. No candidate of the exact join is left out but those whose
two ends are linked already.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._memory import handled
from ._store import cut

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_CHUNK_BITS = 16
_POWERS = np.ones(1, np.uint64)


@dataclass(frozen=True)
class Jaccard:
    """Words of a shingle and the least similarity in per cent."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: Column, m: Column) -> Column:
        """The least number of shared shingles of similar sets of these sizes."""
        return F.ceil((n + m) * F.lit(self.percent) / F.lit(100.0 + self.percent) - F.lit(1e-9)).cast("long")

    def prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate((_POWERS, _POWERS * step))
    return _POWERS


def _block_words(a: np.ndarray) -> np.ndarray:
    a = np.where((a >= 65) & (a <= 90), a + 32, a)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~((a == 32) | ((a >= 9) & (a <= 13)))
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = a[inside[1:-1] == 1].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    terms = letters * _powers(int(lengths.max()))[place]
    return _mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of a UTF-8 text, A-Z in lower case; long texts in blocks that end at white space."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= _BLOCK:
        return _block_words(a)
    found, at = [], 0
    while at < len(a):
        end = min(at + _BLOCK, len(a))
        while end < len(a):
            space = np.flatnonzero((a[at:end] == 32) | ((a[at:end] >= 9) & (a[at:end] <= 13)))
            if len(space):
                end = at + int(space[-1]) + 1
                break
            end = min(end + _BLOCK, len(a))
        found.append(_block_words(a[at:end]))
        at = end
    return np.concatenate(found)


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD1342543DE82EF95) + w[j : len(w) - k + 1 + j]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def _texts(batch: pa.RecordBatch, column: int):
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _merged(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << _CHUNK_BITS, np.int64)
    for width, data in zip(table.column("width"), table.column("counts"), strict=True):
        total += np.frombuffer(zlib.decompress(data.as_py()), f"<u{width}")
    return total


def _packed(counts: np.ndarray) -> tuple[int, bytes]:
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << (8 * w))
    return width, zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _tally(batches, bits: int, words: int):
    """``chunk, counts`` of the chunks in which cells of ``bits`` bits have shingles of the batches' texts.
    A cell has a byte; what goes over it, whole 256s, is kept apart: one row for 256 shingles at most."""
    shift, cells = np.uint64(64 - bits), np.zeros(1 << bits, np.uint8)
    over = [(np.empty(0, np.int32), np.empty(0, np.int64))]

    def count(batch):
        waiting, held = [], 0
        for data in [*_texts(batch, 0), None]:
            if data is not None:
                waiting.append((shingles(data, words) >> shift).astype(np.int32))
                held += len(waiting[-1])
            if held > 1 << 18 or (data is None and held):
                cell, n = np.unique(np.concatenate(waiting), return_counts=True)
                n += cells[cell]
                cells[cell] = n & 255
                full = n > 255
                over.append((cell[full], n[full] >> 8))
                waiting, held = [], 0
        return ()

    for _ in handled(batches, count):
        pass
    where, more = map(np.concatenate, zip(*over, strict=True))
    order = np.argsort(where, kind="stable")
    where, more = where[order], more[order]
    ends = np.searchsorted(where, np.arange((1 << (bits - _CHUNK_BITS)) + 1) << _CHUNK_BITS)
    for c, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = cells[c << _CHUNK_BITS : (c + 1) << _CHUNK_BITS]
        if high > low or part.any():
            part = part.astype(np.int64)
            np.add.at(part, where[low:high] & ((1 << _CHUNK_BITS) - 1), more[low:high] << 8)
            yield c, part


def rarity(docs: DataFrame, spec: Jaccard) -> np.ndarray:
    """How common the shingles of each hash cell are over all documents, as twice the logarithm.

    The number of cells follows the text's bytes, up to 2**24 (16 MB, which is the bound of what is
    broadcast); cells only order shingles, so collisions cost time and never a link.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(size / 50 + 1)), _CHUNK_BITS, 24))
    k = spec.words

    def count(batches):
        task = TaskContext.get().partitionId()
        for c, part in _tally(batches, bits, k):
            width, data = _packed(part)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([task // 32], pa.int32()), pa.array([width], pa.int32()), pa.array([data])], names=["chunk", "part", "width", "counts"])

    def some(key, table):
        width, data = _packed(_merged(table))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "counts": pa.array([data], pa.binary())})

    def last(key, table):
        level = (2 * np.log2(_merged(table) + 1)).astype(np.uint8).tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level], pa.binary())})

    tasks = docs.select("text").mapInArrow(count, "chunk int, part int, width int, counts binary")
    sums = tasks.groupBy("chunk", "part").applyInArrow(some, "chunk int, width int, counts binary").groupBy("chunk").applyInArrow(last, "chunk int, level binary")
    levels = np.zeros(1 << bits, np.uint8)
    for row in sums.toLocalIterator():
        levels[row["chunk"] << _CHUNK_BITS : (row["chunk"] + 1) << _CHUNK_BITS] = np.frombuffer(row["level"], np.uint8)
    return levels


SETS = "doc_id long, n long, fa long, fb long, pa long, pb long, common long, prefix array<long>"


def document_sets(docs: DataFrame, spec: Jaccard) -> DataFrame:
    """Per row: size and fingerprint of its set, its prefix and that one's fingerprint."""
    levels = docs.sparkSession.sparkContext.broadcast(rarity(docs, spec))
    k, prefix_of = spec.words, spec.prefix

    def run(batches):
        table = levels.value
        shift = np.uint64(64 - int(np.log2(len(table))))

        def work(batch):
            for at in range(0, batch.num_rows, 1024):
                part, rows, prefixes = batch.slice(at, 1024), [], []
                for data in _texts(part, 1):
                    u = shingles(data, k)
                    n = len(u)
                    if not n:
                        rows.append((0, 0, 0, 0, 0, 0))
                        prefixes.append(np.empty(0, np.int64))
                        continue
                    level = table[(u >> shift).astype(np.int64)]
                    p = u[np.argsort(level, kind="stable")[: prefix_of(n)]]  # ties by hash, as u is sorted
                    m, q = _mix(u ^ np.uint64(0xA0761D6478BD642F)), _mix(p ^ np.uint64(0xE7037ED1A0B428DB))
                    rows.append((n, m.sum().view(np.int64), np.bitwise_xor.reduce(_mix(u + np.uint64(0x632BE59BD9B4E019))).view(np.int64), q.sum().view(np.int64), np.bitwise_xor.reduce(_mix(q)).view(np.int64), int(1000 * level.mean())))
                    prefixes.append(p.view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                cols = [pa.array(np.asarray(c, np.int64)) for c in zip(*rows, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, lists], names=["doc_id", "n", "fa", "fb", "pa", "pb", "common", "prefix"])

        return handled(batches, work)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SETS)


def _marks(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A bitmap of hashed ids, as rows ``part, bits`` of 4096 bytes, and its places. It has eight places
    for every id, from 2**20 to 2**28 (32 MB, which is the bound of what is broadcast)."""
    places = 1 << int(np.clip(np.ceil(np.log2(8 * ids.count() + 1)), 20, 28))
    marks = ids.select(_place(column, places).alias("p")).select((F.col("p") / 32768).cast("int").alias("part"), F.pmod("p", F.lit(32768)).alias("bit"))
    return marks.groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), places


def _place(column: str, places: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(places))


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ids, found by a bitmap of hashed ids, so that few other texts move."""
    marks, places = _marks(ids, "id")
    bits = bytearray(places // 8)
    for row in marks.toLocalIterator():
        bits[row["part"] * 4096 : (row["part"] + 1) * 4096] = row["bits"]
    known = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches):
        table = np.frombuffer(known.value, np.uint8)

        def work(batch):
            p = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

        return handled(batches, work)

    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("p", _place("id", places))
    return slim.mapInArrow(run, "id long, text string")


_MEET = 4096


def verified(pairs: DataFrame, docs: DataFrame, spec: Jaccard) -> DataFrame:
    """The pairs (a, b) whose texts are similar indeed."""
    texts = cut(_rows_of(docs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()), "jaccard-texts")
    k, percent = spec.words, spec.percent

    def run(batches):
        last, known = None, None

        def work(batch):
            nonlocal last, known
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hits = []
            for i, (ta, tb) in enumerate(zip(_texts(batch, 2), _texts(batch, 3), strict=True)):
                if tb != last:
                    last, known = tb, shingles(tb, k)
                u = shingles(ta, k)
                both = len(np.intersect1d(u, known, assume_unique=True))
                if 100 * both >= percent * (len(u) + len(known) - both):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(b[hits])], names=["a", "b"])

        return handled(batches, work)

    # a document that stands in many pairs is met in parts of them
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / _MEET).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(crowd, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    two = two.join(crowd, "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    joined = dealt.join(one, "a").join(two, ["b", "part"]).select("a", "b", "ta", "tb")
    return cut(joined.mapInArrow(run, "a long, b long"), "jaccard-links")


def similar_documents(docs: DataFrame, spec: Jaccard | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (doc_id, text, any others).

    Texts that are null or without words have no shingles and link with nothing. Rows that share a
    doc_id are one document: what each links with, all do. A null doc_id has a null component and
    links with nothing. An empty table gives no rows.
    """
    spec = spec or Jaccard()
    docs = docs.select("doc_id", "text")
    sets = cut(document_sets(docs, spec), "jaccard-sets")
    live = sets.where("n > 0 and doc_id is not null")

    # equal sets are one class, named by its least document; classes equal in size and prefix are one group
    keys = ["n", "fa", "fb"]
    classes = cut(live.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("common").alias("common")), "jaccard-classes")
    groups = cut(classes.groupBy("n", "pa", "pb").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), "jaccard-groups")
    classed = cut(classes.join(groups, ["n", "pa", "pb"]).select(*keys, "rep", "gid", "members", "common"), "jaccard-classed")
    heads = classed.where("rep = gid").select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("gid"), "members", "common")
    carriers = live.join(heads, [F.col("doc_id") == F.col("gid"), *[F.col(c) == F.col(f"{c}_") for c in keys]]).select("gid", "n", "pa", "pb", "members", heads["common"], "prefix")
    posts = carriers.dropDuplicates(["gid", "n", "pa", "pb"]).select("gid", "n", "members", "common", F.posexplode("prefix").alias("pos", "token"))
    shared = cut(posts.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token"), "jaccard-shared")
    posts = cut(posts.join(shared, "token"), "jaccard-posts")

    def may(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        least = spec.overlap(n1, n2)
        return (F.least(n1, n2) >= least) & (F.least(n1 - p1, n2 - p2) >= least)

    best = F.max_by(F.struct("gid", "n", "pos"), F.struct("common", "n", -F.col("gid")))
    pivots = cut(posts.groupBy("token").agg(best.alias("p")).select("token", F.col("p.gid").alias("b"), F.col("p.n").alias("n2"), F.col("p.pos").alias("p2")), "jaccard-pivots")
    met = posts.join(pivots, "token").where((F.col("gid") != F.col("b")) & may(F.col("n"), F.col("pos"), F.col("n2"), F.col("p2"))).select("gid", "b")
    own = classed.where("rep <> gid").select(F.col("gid").alias("own"), "rep")
    met = cut(met.distinct(), "jaccard-met")
    tried = cut(
        met.select(F.col("gid").alias("a"), "b").unionAll(met.join(own, F.col("gid") == F.col("own")).select(F.col("rep").alias("a"), "b")).unionAll(own.select(F.col("rep").alias("a"), F.col("own").alias("b"))),
        "jaccard-tried",
    )
    links = verified(tried, docs, spec)

    # rows of one doc_id in several classes
    rows = cut(sets.select("doc_id", *keys).join(classed.select(*keys, "rep"), keys, "left"), "jaccard-rows")
    several = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").select("doc_id", "b")
    links = links.unionAll(rows.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    links = cut(links, "jaccard-links")
    found = cut(components(links), "jaccard-found")

    # what is not linked yet: all pairs of different components that lengths and positions allow
    named = classed.join(found, F.col("rep") == F.col("node"), "left").select("gid", "rep", F.coalesce("component", "rep").alias("comp"))
    each = cut(posts.join(named, "gid").select("token", "rep", "comp", "n", "pos", "common"), "jaccard-each")
    split = each.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max_by("comp", F.struct("common", "n", -F.col("rep"))).alias("main")).where("lo <> hi")
    split = cut(split.select("token", "least", "main"), "jaccard-split")
    open_ = each.join(split, "token")
    nearest = F.greatest("least", F.ceil(F.col("n") * F.lit(spec.percent) / 100.0 - 1e-9).cast("long"))
    far = open_.where((F.col("comp") != F.col("main")) & (F.col("n") - F.col("pos") >= spec.overlap(F.col("n"), nearest)))
    far = far.select("token", F.col("rep").alias("a"), F.col("comp").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    met = far.join(open_.select("token", F.col("rep").alias("b"), F.col("comp").alias("c2"), "n", "pos", "main"), "token")
    met = met.where((F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("a") < F.col("b"))) & may(F.col("n1"), F.col("p1"), F.col("n"), F.col("pos")))
    rest = met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    rest = cut(rest, "jaccard-rest")
    if not rest.isEmpty():
        found = cut(components(links.unionAll(verified(rest, docs, spec))), "jaccard-found")
    return rows.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, spec: Jaccard | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns of any type, that stand for their component: its least
    doc_id. Of rows that share a doc_id one stays, that of the least digest of its columns; rows
    without one all stay. A bitmap of the ids that go or repeat tells most rows that stay, which don't
    move; only rows it marks are joined."""
    found = similar_documents(docs, spec).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("keep"), F.count("*").alias("rows"))
    special = cut(found.where("not keep or rows > 1"), "jaccard-special")
    several = special.where("keep").select("doc_id")
    name = "row_"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marks, places = _marks(special, "doc_id")
    marks = cut(marks.select(F.col("part").alias(name), F.col("bits").alias(name + "b")), "jaccard-marks")
    place = _place("doc_id", places)
    rows = docs.join(F.broadcast(marks), (place / 32768).cast("int") == F.col(name), "left")
    byte = F.conv(F.hex(F.substring(name + "b", (F.pmod(place, F.lit(32768)) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    still, near = rows.where(~marked).select(*columns), rows.where(marked).select(*columns)
    single = still.unionAll(near.join(special.select("doc_id"), "doc_id", "left_anti").select(*columns))
    if several.isEmpty():
        return single
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    again = near.join(several, "doc_id", "left_semi").select(*columns, digest.alias(name))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(name))  # each task passes on one row of an id
    again = again.withColumn(name + "n", nth).where(F.col(name + "n") == 1).drop(name, name + "n")
    return single.unionAll(again)
