"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors are dealt over shards of bounded size; each shard's graph is built in one task and written;
every vector meets its own shard and half of the others, so that each pair of shards meets once, and
searches a graph where a row of it shares a cross-polytope bucket with the vector and is about as
near as a link. A shard's beam starts as wide as planted
queries, whose links are known, ask for; a search goes on from all that it finds near enough, along
their links; when an audit of a task's own queries, above all of those with links, falls short of a
scan, all queries search the graph and later beams are widened. Links are verified in double
precision, and components are their unions.

A task reads its shard's graph and then streams the vectors past it. A shard's queries are parted
only so far that the copies of its graph stay within about four times the size of the queries.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import cut
from ._vectors import comparable, distinct_vectors, matrix


@dataclass
class Graph:
    """Layers over unit vectors sorted by falling level: layer l links the first ``sizes[l]`` rows."""

    x: np.ndarray
    links: list[np.ndarray]
    width: int = 16
    routed: bool = True  # until an audit finds links of a query that no bucket led here

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest rows that a best-first search of one layer finds for each query."""
        links, x = self.links[layer], self.x
        n, e = len(q), entry.shape[1]
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        seen = np.zeros((n, size + 1), bool)
        rows = np.arange(n)
        e = min(e, width)
        ids[:, :e] = entry[:, :e]
        for j in range(e):  # an entry given twice counts once
            twice = seen[rows, ids[:, j]]
            seen[rows, ids[:, j]] = True
            sims[:, j] = np.where(twice, -np.inf, np.einsum("nd,nd->n", x[ids[:, j]], q))
            done[:, j] = twice
        live = rows
        step = max(2, width // 16)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_sims, min(step, width) - 1, axis=1)[:, :step]
            chosen = np.take_along_axis(open_sims, pick, 1)
            has = chosen > -np.inf
            some = has.any(1)
            live, pick, has = live[some], pick[some], has[some]
            if not len(live):
                break
            nodes = np.where(has, np.take_along_axis(ids[live], pick, 1), 0)
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            done[live] = flags
            near = np.where(has[:, :, None], links[nodes], -1).reshape(len(live), -1)
            near = np.where((near >= 0) & (near < size), near, size)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = size
            fresh = ~seen[live[:, None], near] & (near < size)
            seen[live[:, None], near] = True
            found = np.einsum("nmd,nd->nm", x[np.where(fresh, near, 0)], q[live])
            found[~fresh] = -np.inf
            all_s = np.concatenate((sims[live], found), 1)
            all_i = np.concatenate((ids[live], near), 1)
            all_d = np.concatenate((done[live], ~fresh), 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live], ids[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_d))
        order = np.argsort(-sims, axis=1)
        ids[sims == -np.inf] = -1
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int, layer: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        size = size or len(self.x)
        entry = np.zeros((len(q), 1), np.int64)
        for l in range(len(self.links) - 1, layer, -1):
            entry = self._beam(l, q, entry, 4, len(self.links[l]))[0]
            entry = np.where(entry < 0, entry[:, :1], entry)
        entry = np.where(entry < size, entry, 0)  # rows not in this layer yet
        return self._beam(layer, q, entry, min(width, max(size, 1)), size)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, width=self.width, **{f"l{k}": a for k, a in enumerate(self.links)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        got = np.load(io.BytesIO(data))
        return Graph(got["x"], [got[f"l{k}"] for k in range(len(got.files) - 2)], int(got["width"]))


SPARE = 8  # links of a row kept for rows that no search would find


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, in falling order (-1 where there is none), those nearer to it than
    to any kept before; then the nearest of the rest."""
    out = np.full((len(ids), most), -1, ids.dtype)
    for at in range(0, len(ids), 256):
        some, near = ids[at : at + 256], sims[at : at + 256]
        v = x[some]
        among = v @ v.transpose(0, 2, 1)
        kept, count = np.zeros(some.shape, bool), np.zeros(len(some), int)
        for j in range(some.shape[1]):
            kept[:, j] = (near[:, j] > -np.inf) & (count < most) & ~((among[:, j] >= near[:, j : j + 1]) & kept).any(1)
            count += kept[:, j]
        turn = np.where(near == -np.inf, 2, np.where(kept, 0, 1))
        order = np.argsort(turn, axis=1, kind="stable")[:, :most]
        out[at : at + 256, : order.shape[1]] = np.where(np.take_along_axis(turn, order, 1) == 2, -1, np.take_along_axis(some, order, 1))
    return out


def _link_back(x: np.ndarray, links: np.ndarray, most: int, to: np.ndarray, new: np.ndarray) -> None:
    """Add ``new`` rows to the links of ``to``; where that is more than ``most``, the diverse ones of the nearest stay."""
    nodes = np.unique(to)
    have = links[nodes, :most]
    at, _ = np.nonzero(have >= 0)
    a, b = np.divmod(np.unique(np.concatenate((to, nodes[at])).astype(np.int64) * len(x) + np.concatenate((new, have[have >= 0]))), len(x))
    sims = np.einsum("nd,nd->n", x[a], x[b])
    order = np.lexsort((-sims, a))
    a, b, sims = a[order], b[order], sims[order]
    row = np.searchsorted(nodes, a)
    place = np.arange(len(a)) - np.searchsorted(a, nodes)[row]
    fits = place < 2 * most
    ids, near = np.full((len(nodes), 2 * most), -1, np.int64), np.full((len(nodes), 2 * most), -np.inf, np.float32)
    ids[row[fits], place[fits]], near[row[fits], place[fits]] = b[fits], sims[fits]
    links[nodes, :most] = ids[:, :most]
    full = np.flatnonzero(ids[:, most] >= 0)
    links[nodes[full], :most] = _diverse(x, ids[full], near[full], most)


def _mend(graph: Graph, most: int, rounds: int = 4) -> None:
    """Links to rows that their own search does not find, from those that it ends at."""
    x, links = graph.x, graph.links[0]
    todo = np.arange(len(x))
    for _ in range(rounds):
        lost = []
        for at in range(0, len(todo), 512):
            some = todo[at : at + 512]
            ids, sims = graph.search(x[some], min(16, len(x)))
            for r in np.flatnonzero(~(ids == some[:, None]).any(1)):
                lost.append(some[r])
                for near in ids[r][ids[r] >= 0]:
                    free = most + np.flatnonzero(links[near, most:] < 0)
                    if len(free):
                        links[near, free[0]] = some[r]
                        break
        if not lost:
            return
        todo = np.asarray(lost)


def build(x: np.ndarray, m: int = 12, width: int = 48, seed: int = 3) -> tuple[Graph, np.ndarray]:
    """A graph over unit rows and the order in which it holds them."""
    n = len(x)
    level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    x, level = np.ascontiguousarray(x[order], np.float32), level[order]
    sizes = [n]
    while sizes[-1] > 64 and (k := int((level >= len(sizes)).sum())) > 1:
        sizes.append(k)
    graph = Graph(x, [np.full((s, 2 * m + SPARE * (not l)), -1, np.int32) for l, s in enumerate(sizes)])
    for layer in range(len(sizes) - 1, -1, -1):
        links, size, at = graph.links[layer], sizes[layer], 0
        while at < size:
            end = min(size, max(64, at + min(1024, max(64, at))))
            q = x[at:end]
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            w = min(m, end - at - 1)
            ids, sims = np.empty((end - at, 0), np.int64), np.empty((end - at, 0), np.float32)
            if w > 0:
                ids = np.argpartition(-inner, w - 1, axis=1)[:, :w]
                sims, ids = np.take_along_axis(inner, ids, 1), ids + at
            if at:
                i2, s2 = (np.concatenate(p) for p in zip(*(graph.search(q[k : k + 512], width, layer, at) for k in range(0, len(q), 512)), strict=True))
                ids, sims = np.concatenate((ids, i2), 1), np.concatenate((sims, s2), 1)
            turn = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, turn, 1), np.take_along_axis(sims, turn, 1)
            if ids.shape[1]:
                chosen = _diverse(x, ids, sims, m)
                links[at:end, :m] = chosen
                row, _ = np.nonzero(chosen >= 0)
                _link_back(x, links, 2 * m, chosen[chosen >= 0], row + at)
            at = end
    _mend(graph, 2 * m)
    return graph, order


def _scan(graph: Graph, q: np.ndarray, low: np.float32) -> list[np.ndarray]:
    found = []
    for s in range(0, len(q), 256):
        parts = [np.nonzero(q[s : s + 256] @ graph.x[b : b + 8192].T >= low) for b in range(0, len(graph.x), 8192)]
        k = np.concatenate([p[0] for p in parts])
        near = np.concatenate([p[1] + 8192 * i for i, p in enumerate(parts)])[np.argsort(k, kind="stable")]
        found += np.split(near, np.cumsum(np.bincount(k, minlength=len(q[s : s + 256])))[:-1])
    return found


def _widest(graph: Graph) -> int:
    """The widest beam: with the links of its rows it looks at about as many rows as there are."""
    return max(64, len(graph.x) // graph.links[0].shape[1])


def _low(least: float) -> np.float32:
    return np.float32(least - 1e-4)


SLACK = 0.02  # how much farther than a link a row may be to lead to links
AXES, PARTS, CROWD, ROWS = 32, 5, 8, 26  # a bucket's number takes 30 bits, its table's 7, a row's place 26


@cache
def _tables(least: float, missed: float = 1e-5, most: int = 100) -> int:
    """Tables in which vectors at a cosine of ``least`` share no bucket with a probability of ``missed``,
    whatever their length: projections on normal directions depend on the cosine alone. 0 if it takes
    more than ``most``."""
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(2, 20_000, AXES, PARTS))
    y = least * x + np.sqrt(max(0.0, 1 - least**2)) * y
    shared = (_probes(_axes(x.astype(np.float32), 2)) == _probes(_axes(y.astype(np.float32), 1))).any(-1).mean()
    tables = int(np.ceil(np.log(missed) / np.log(1 - min(shared, 0.999)))) if shared else most + 1
    return tables if tables <= most else 0


def _axes(y: np.ndarray, count: int) -> list[np.ndarray]:
    """The ``count`` nearest signed axes of each part, from projections (row, axis, part) in floats,
    whose last bits make room for an axis and its sign."""
    bits = y.view(np.int32)
    size = bits & np.int32(0x7FFFFFFF - (2 * AXES - 1))
    bits >>= 31
    bits &= np.int32(AXES)
    size |= bits
    size |= np.arange(AXES, dtype=np.int32)[:, None]
    out = [size.max(1)]
    for _ in range(1, count):
        size[size == out[-1][:, None]] = 0
        out.append(size.max(1))
    return [o & np.int32(2 * AXES - 1) for o in out]


def _probes(axes: list[np.ndarray]) -> np.ndarray:
    """Buckets by the nearest axes of all parts; with second axes also those where one or two parts have these."""
    place = (2 * AXES) ** np.arange(PARTS)
    own = (axes[0] @ place)[..., None]
    if len(axes) == 1:
        return own
    other = (axes[1] - axes[0]) * place
    a, b = np.array(list(combinations(range(PARTS), 2))).T
    return np.concatenate((own, own + other, own + other[..., a] + other[..., b]), -1)


class Buckets:
    """Rows of a graph by buckets of cross-polytope hashes, one in each table; queries also look into
    the next ones."""

    def __init__(self, x: np.ndarray, least: float):
        self.x, self.low, self.tables = x, _low(least), _tables(least)
        self.turn = np.random.default_rng(12).standard_normal((x.shape[1], self.tables * PARTS * AXES), np.float32)
        held = self._keys(x, 1).reshape(len(x), -1)
        bits = min(28, max(10, int(64 * held.size).bit_length()))
        self.shift, self.marks = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        for s in range(0, len(x), 4096):
            np.bitwise_or.at(self.marks, *self._bit(held[s : s + 4096].ravel()))
        held <<= ROWS
        held |= np.arange(len(x))[:, None]
        self.held = held.ravel()
        self.held.sort()

    def _keys(self, q: np.ndarray, count: int) -> np.ndarray:
        out = np.empty((len(q), self.tables, 1 if count == 1 else 1 + PARTS * (PARTS + 1) // 2), np.int64)
        for s in range(0, len(q), 64):
            y = (q[s : s + 64] @ self.turn).reshape(-1, AXES, self.tables * PARTS)
            out[s : s + 64] = _probes([a.reshape(-1, self.tables, PARTS) for a in _axes(y, count)])
        out += (2 * AXES) ** PARTS * np.arange(self.tables)[:, None]
        return out

    def _bit(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7), dtype=np.uint8, casting="unsafe")

    def near(self, q: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a query and a row that share a bucket and are about as near as links, and whether
        each query has one with another row than ``same``, itself. Of a crowded bucket some rows are
        given, and the query counts as having one."""
        pairs, ask = [], np.zeros(len(q), bool)
        for s in range(0, len(q), 512):
            some = q[s : s + 512]
            keys = self._keys(some, 2)
            each, keys = keys[0].size, keys.ravel()
            at, bit = self._bit(keys)
            hit = np.flatnonzero(self.marks[at] & bit)
            hit = hit[np.argsort(keys[hit])]
            first = np.searchsorted(self.held, keys[hit] << ROWS)
            there = self.held[first.clip(max=len(self.held) - 1)] >> ROWS == keys[hit]
            hit, first = hit[there], first[there]
            k, size = hit // each, np.searchsorted(self.held, (keys[hit] + 1) << ROWS) - first
            ask[s + k[size > CROWD]] = True
            size = np.minimum(size, CROWD)
            row = self.held[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())] & ((1 << ROWS) - 1)
            k, row = np.divmod(np.unique(np.repeat(k, size) * len(self.x) + row), len(self.x))
            sim = np.concatenate([np.empty(0, np.float32), *[np.einsum("nd,nd->n", self.x[row[i : i + 65536]], some[k[i : i + 65536]]) for i in range(0, len(k), 65536)]])
            k, row = s + k[sim >= self.low - SLACK], row[sim >= self.low - SLACK]
            ask[k[row != same[k]]] = True
            pairs.append((k, row))
        k, row = (np.concatenate(p) for p in zip(*pairs, strict=True))
        return k, row, ask


def _search(graph: Graph, q: np.ndarray, low: np.float32, width: int, entries: tuple[np.ndarray, np.ndarray] | None = None, slack: float = SLACK) -> list[np.ndarray]:
    """Rows at least as near as ``low``: those that a beam finds, and those that links of rows at
    most ``slack`` farther lead to, from ``entries`` (queries in order, and rows), too, in graphs of
    every size. Queries of more such rows than the widest beam holds are scanned."""
    x, links, n, out = graph.x, graph.links[0], len(graph.x), [np.empty(0, np.int64)] * len(q)
    most, many, width = _widest(graph), [], min(width, len(graph.x))
    batch = max(16, min(512, (1 << 25) // (n + 1)))
    for s in range(0, len(q), batch):
        some = q[s : s + batch]
        ids, sims = graph.search(some, width)
        k, j = np.nonzero(sims >= low - slack)
        node, sim = ids[k, j], sims[k, j]
        if entries is not None:
            i, e = np.searchsorted(entries[0], (s, s + len(some)))
            k, node = np.divmod(np.unique(np.concatenate((k * n + node, (entries[0][i:e] - s) * n + entries[1][i:e]))), n)
            sim = np.einsum("nd,nd->n", x[node], some[k])
        hit = sim >= low
        seen, got, held = np.zeros((len(some), n), bool), [(k[hit], node[hit])], np.bincount(k[hit], minlength=len(some))
        seen[k, node] = True
        while len(k):
            near = links[node]
            k = np.repeat(k, near.shape[1])[near.ravel() >= 0]
            node = near.ravel()[near.ravel() >= 0]
            fresh = ~seen[k, node]
            k, node = np.divmod(np.unique(k[fresh] * n + node[fresh]), n)
            seen[k, node] = True
            sim = np.concatenate([np.empty(0, np.float32), *[np.einsum("nd,nd->n", x[node[i : i + 65536]], some[k[i : i + 65536]]) for i in range(0, len(k), 65536)]])
            got.append((k[sim >= low], node[sim >= low]))
            held += np.bincount(k[sim >= low], minlength=len(some))
            go = (sim >= low - slack) & (held[k] < most)
            k, node = k[go], node[go]
        k, node = (np.concatenate(g) for g in zip(*got, strict=True))
        order = np.argsort(k, kind="stable")
        out[s : s + batch] = np.split(node[order], np.cumsum(np.bincount(k, minlength=len(some)))[:-1])
        many.append(s + np.flatnonzero(held >= most))
    many = np.concatenate([np.empty(0, int), *many])
    for k, found in zip(many, _scan(graph, q[many], low), strict=True):
        out[k] = found
    return out


def tune(graph: Graph, least: float, planted: int = 256, seed: int = 7) -> None:
    """Widen the graph's beam until queries planted near its rows find all that a scan does."""
    rng, n = np.random.default_rng(seed), len(graph.x)
    rows = np.unique(np.linspace(0, n - 1, planted).astype(int))
    cosine = rng.uniform(min(0.999, least + 0.01), 1, (len(rows), 1))
    noise = rng.normal(size=(len(rows), graph.x.shape[1]))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    q = graph.x[rows] * cosine + noise * np.sqrt(1 - cosine**2)
    q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
    true = _scan(graph, q, _low(least))
    while graph.width < _widest(graph) and any(len(np.setdiff1d(t, f)) for t, f in zip(true, _search(graph, q, _low(least), graph.width), strict=True)):
        graph.width *= 2


def linked(graph: Graph, q: np.ndarray, least: float, audit: int = 128, buckets: Buckets | None = None, same: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the graph at least about as near as ``least`` to each query. With ``buckets`` only
    queries that these lead to another row than ``same`` (-1: none) search the graph, from there, too. The
    audit scans for ``audit`` queries with several links (for a row of the graph one is itself) and as
    many of all; if it finds links of queries that have not searched, all do, from now on; while it
    finds more than the searches, the beam is widened, for later calls, too. Only if it still finds
    more beside the widest beam are all the queries scanned."""
    low, k, row, ask = _low(least), None, None, np.ones(len(q), bool)
    if buckets is not None and buckets.tables and graph.routed:
        k, row, ask = buckets.near(q, same)
    while True:
        out = [np.empty(0, np.int64)] * len(q)
        if not ask.all():  # the others have no near row but themselves
            for i, r in zip(k[~ask[k]], row[~ask[k]], strict=True):
                out[i] = np.array([r])
        if ask.any():
            entries = None if k is None else ((np.cumsum(ask) - 1)[k[ask[k]]], row[ask[k]])
            for i, found in zip(np.flatnonzero(ask), _search(graph, q[ask], low, graph.width, entries), strict=True):
                out[i] = found
        several = np.flatnonzero([len(o) > 1 for o in out])
        probe = np.unique(np.concatenate([s[np.linspace(0, len(s) - 1, min(audit, len(s))).astype(int)] for s in (several, np.arange(len(q)))]))
        short = [i for t, i in zip(_scan(graph, q[probe], low), probe, strict=True) if len(np.setdiff1d(t, out[i]))]
        if not short:
            return out
        if not ask[short].all():
            graph.routed, ask = False, np.ones(len(q), bool)
        elif graph.width >= _widest(graph):
            return _scan(graph, q, low)
        else:
            graph.width *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links connect: each end with the least of its component."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[u], root[v]), root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


_PIECE = 1 << 23
_FOUND = "a long, b long, n long"


def near_vectors(vectors: DataFrame, least: float = 0.9, shards: int | None = None, shard_rows: int = 100_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (vec_id, embedding, any others).

    Null vectors, zero ones and those with null or non-finite values link with nothing, and vectors
    of different lengths don't link. Equal vectors always link. Rows that repeat a vec_id link as
    others do, and their component is their id's. A null vec_id has a null component and no links.
    An empty table gives no rows. The vectors of one length have ``shards`` shards: six, fewer if
    these were tiny, or as many as shards of ``shard_rows`` vectors need.
    """
    rows = cut(comparable(vectors), "hnsw-rows")
    classes = distinct_vectors(rows, 1)
    plain = dict(classes.dtypes)["v"]
    # one row per length of a vector, so no more than the longest has values
    n = F.count("*")
    dealt = F.lit(shards) if shards else F.greatest(F.ceil(n / shard_rows), F.least(F.lit(6), F.ceil(n / 64)))
    lengths = cut(classes.groupBy(F.size("v").alias("d")).agg(n.alias("of"), dealt.cast("int").alias("shards")), "hnsw-lengths")
    lengths = lengths.withColumn("blocks", F.least(F.lit(64), F.greatest(F.lit(1), F.col("shards") / 2)).cast("int"))
    units = lengths.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    placed = classes.withColumn("d", F.size("v")).join(F.broadcast(lengths), "d")

    def index(key, table):
        table = table.sort_by("cid")
        v = matrix(table.column("v"))
        graph, order = build(v / np.linalg.norm(v, axis=1, keepdims=True))
        tune(graph, least)
        raw = io.BytesIO()
        v = v.astype(np.float32) if plain == "array<float>" else v
        np.savez(raw, graph=np.frombuffer(graph.dump(), np.uint8), ids=table.column("cid").to_numpy()[order], v=v[order], copies=table.column("copies").to_numpy()[order])
        data = raw.getvalue()
        parts = [data[k : k + _PIECE] for k in range(0, len(data), _PIECE)]
        return pa.table({"d": pa.array([key[0].as_py()] * len(parts), pa.int32()), "shard": pa.array([key[1].as_py()] * len(parts), pa.int32()), "piece": pa.array(range(len(parts)), pa.int32()), "data": parts})

    shard = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("shards")).cast("int")
    by_shard = placed.select("d", shard.alias("shard"), "cid", "v", "copies").repartition(max(8, 8 * units), "d", "shard")
    graphs = cut(by_shard.groupBy("d", "shard").applyInArrow(index, "d int, shard int, piece int, data binary"), "hnsw-graphs")

    every = graphs.join(F.broadcast(lengths), "d").select("d", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "piece", "data", F.lit(None).cast("long").alias("cid"), F.lit(None).cast(plain).alias("v"), F.lit(None).cast("long").alias("copies"))
    block = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("blocks")).cast("int")
    # a vector meets its own shard and the next ones, around, as far as half way; just half way half of the shards meet the others
    steps = placed.select("*", shard.alias("own"), F.explode(F.sequence(F.lit(0), F.floor(F.col("shards") / 2).cast("int"))).alias("step"))
    steps = steps.where((2 * F.col("step") < F.col("shards")) | (2 * F.col("own") < F.col("shards")))
    met = F.pmod(F.col("own") + F.col("step"), F.col("shards")).cast("int")
    asked = steps.select("d", met.alias("shard"), block.alias("block"), F.lit(1 << 30).alias("piece"), F.lit(None).cast("binary").alias("data"), "cid", "v", "copies")
    key = ["d", "shard", "block"]
    stream = every.unionByName(asked).repartition(max(8, 4 * units), *key).sortWithinPartitions(*key, "piece")

    def ask(batches):
        now, parts, graph, buckets, ids, v, copies, length, place = None, [], None, None, None, None, None, None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            isgraph = np.asarray(batch.column(4).is_valid())
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1) | (isgraph[1:] != isgraph[:-1]))))
            for s, e in zip(new, [*new[1:], len(keys)], strict=True):
                if tuple(keys[s]) != now:
                    now, parts, graph, buckets = tuple(keys[s]), [], None, None
                if isgraph[s]:
                    parts += batch.column(4).slice(s, e - s).to_pylist()
                    continue
                if graph is None:
                    got = np.load(io.BytesIO(b"".join(parts)))
                    graph, parts = Graph.load(got["graph"].tobytes()), []
                    ids, v, copies = got["ids"], got["v"].astype(float), got["copies"]
                    length, place = np.linalg.norm(v, axis=1), np.argsort(ids)
                    buckets = Buckets(graph.x, least)
                for at in range(s, e, 2048):
                    part = batch.slice(at, min(2048, e - at))
                    q, own = matrix(part.column(6)), part.column(5).to_numpy()
                    lq = np.linalg.norm(q, axis=1)
                    same = place[np.searchsorted(ids, own, sorter=place).clip(max=len(ids) - 1)]
                    same = np.where(ids[same] == own, same, -1)
                    found = linked(graph, (q / lq[:, None]).astype(np.float32), least, buckets=buckets, same=same)
                    k, near = np.repeat(np.arange(len(q)), [len(f) for f in found]), np.concatenate(found)
                    other = ids[near] != own[k]
                    k, near = k[other], near[other]
                    cosine = np.concatenate([np.empty(0), *[(v[near[j : j + 65536]] * q[k[j : j + 65536]]).sum(1) for j in range(0, len(k), 65536)]]) / (length[near] * lq[k])
                    k, near = k[cosine >= least], near[cosine >= least]
                    if len(k):
                        count = np.bincount(k, copies[near], len(q)).astype(np.int64)
                        a, b = _forest(own[k], ids[near])
                        some = np.flatnonzero(count)
                        once = same[k] < 0  # rows of other shards don't meet the query in its own
                        back, nth = np.unique(near[once], return_inverse=True)
                        theirs = np.bincount(nth, part.column(7).to_numpy()[k[once]], len(back)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own[some], ids[back], a))), pa.array([None] * (len(some) + len(back)) + b.tolist(), pa.int64()), pa.array(np.concatenate((count[some], theirs, np.zeros(len(a), np.int64))))], names=["a", "b", "n"])

    found = cut(stream.mapInArrow(ask, _FOUND), "hnsw-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    # copies of one vector are linked through its class; an id with several vectors joins their classes
    named = cut(rows.join(classes.select("v", "cid", "copies"), "v").select("vec_id", "cid", "copies"), "hnsw-named")
    twice = named.where("vec_id <> cid").select(F.col("vec_id").alias("a"), F.col("cid").alias("b"))
    whole = components(found.where("b is not null").select("a", "b").unionAll(twice))
    linked_ = named.join(counts, "cid", "left").groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked_.withColumnRenamed("vec_id", "id_"), F.col("vec_id") == F.col("id_"), "left").join(whole, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
