"""Language-model scores from a log-frequency Bloom filter.

N-grams of all training texts are counted. A count c is quantised to the level 1 + floor(log_b c),
and for every level up to its own an n-gram sets the bits of one event (n-gram, level) in a filter.
Tasks hold the filter; they find a level by probing for the events 1, 2, ... until one is absent, so
a wrong level can only be too high, and by one more level with the filter's error rate each time.
Probabilities are smoothed from the lowest order up, each by a fixed weight of the order below:

    p(w) = (c(w) + 1) / (N + V + 1),    p(w | v) = (c(v w) + prior p(w)) / (c(v) + prior).

Words and n-grams are told apart by 62-bit hashes, which also deal them into buckets: one for every
``bucket_bytes`` of text, so that a bucket is a group of bounded size, which one shuffle brings
together. A bucket adds up its n-grams' counts, sets the bits of its own part of the filter, and
keeps the counts of its words. Tasks are sent the filter in segments of at most ``segment_bytes``. A
filter of several segments takes a pass over the texts for each, with the levels found so far
carried along as bytes.

Beside that score, every text has an exact one by words alone (``base_score``): the frequent
words, at most 262,144 by their definition, are sent to all tasks, and all others are joined.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut
from .jaccard import _mix, word_hashes

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_HEADS = 1 << 18
_CHUNK = 1 << 21
_ROWS = 1 << 18


def _named(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: No word holds white space, so these are no words' names.
_START, _END = b"\n", b" "


@dataclass(frozen=True)
class LogFilter:
    """``order``: words of the longest n-gram. ``base``: of the logarithm that quantises counts.
    ``bits`` and ``probes``: of the filter, for each event. ``prior``: weight of the order below."""

    order: int = 2
    base: float = 1.5
    bits: int = 10
    probes: int = 6
    prior: float = 100.0
    bucket_bytes: int = 1 << 18
    segment_bytes: int = 1 << 28

    def __post_init__(self) -> None:
        if self.order < 1 or len(self.counts()) > 256:
            raise ValueError("an order of 1 or more and a base of 1.2 or more are needed")

    def levels(self, n: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(n) / math.log(self.base) + 1e-9).astype(np.int64)

    def counts(self) -> np.ndarray:
        """The count that a level stands for: the middle of the integers that have it; 0 for none."""
        edges = [math.ceil(self.base**q - 1e-9) for q in range(int(63 * math.log(2) / math.log(self.base)) + 1)]
        return np.array([0.0] + [(a + max(a, b - 1)) / 2 for a, b in zip(edges, edges[1:], strict=False)])

    def event(self, h: np.ndarray, level: int) -> np.ndarray:
        """The hash of an event, from which its probes follow."""
        return _mix(h + np.uint64(level * int(_FOLD) & (1 << 64) - 1))

    def place(self, z: np.ndarray, k: int, size: np.ndarray | int) -> np.ndarray:
        """The bit of an event's ``k``th probe in a part of the filter of ``size`` bits."""
        first, step = z & np.uint64(0xFFFFFFFF), (z >> np.uint64(32)) | np.uint64(1)
        return ((first + np.uint64(k) * step + np.uint64((k**3 - k) // 6)) % np.asarray(size, np.uint64)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def training(key: str = "doc_id") -> Column:
    """Rows to learn from: those whose CRC-32 of the key as text (null: empty) isn't 2 modulo 7."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def _chunks(column: pa.Array):
    """Positions of texts in the column, in runs of a few megabytes or one text."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + _CHUNK, "right")) - 1)
        yield at, end
        at = end


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words and ends (62 bits, the two lowest 01) and, per text, how many there are. Words
    are named by :func:`jaccard.word_hashes`, all texts' bytes at once."""
    data = [(t or "").encode() for t in texts]
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
    whole = b" ".join(data)
    a = np.frombuffer(whole, np.uint8)
    space = np.ones(len(a) + 1, bool)
    space[1:] = (a == 32) | ((a >= 9) & (a <= 13))
    counts = np.diff(np.searchsorted(np.flatnonzero(space[:-1] & ~space[1:]), np.concatenate(([0], ends))))
    lengths = counts + 1
    out = np.full(lengths.sum(), _named(_END), np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(lengths) - 1] = False
    out[word] = word_hashes(whole)
    return _tagged(out, 1), lengths


def _tagged(h: np.ndarray, order: int) -> np.ndarray:
    return (h & ~np.uint64(3)) | np.uint64(order & 3)


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Names of the n-grams that end at each word, by order; 0 where a text's start is nearer than
    that. A text's first word follows the start, so it ends a pair."""
    first = np.zeros(len(words), bool)
    first[np.cumsum(lengths) - lengths] = True
    out = [words]
    for n in range(2, order + 1):
        before = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
        if n == 2:
            before[first] = _tagged(np.array([_named(_START)], np.uint64), 0)[0]
            here = _tagged(_mix(before * _FOLD + words), 2)
        else:
            here = np.where(first | (before == 0), np.uint64(0), _tagged(_mix(before * _FOLD + words), 3))
        out.append(here)
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Names and their counts added up over all parts, a sixteenth of the names at a time; empties the list."""
    h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    parts.clear()
    share, out = (h >> np.uint64(58)).astype(np.uint8) & 15, []
    for k in range(16):
        mine = np.flatnonzero(share == k)
        at, kinds = pd.factorize(h[mine])
        out.append((kinds, np.bincount(at, n[mine], len(kinds)).astype(np.int64)))
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))


def count_grams(docs: DataFrame, how: LogFilter, buckets: int, text: str = "text") -> DataFrame:
    """``bucket, h, n``: names and counts of all n-grams of the texts, and of their starts, added up in
    each task as far as they are held there."""

    def batches_of(names: np.ndarray, counts: np.ndarray):
        for a in range(0, len(names), _ROWS):
            h, n = names[a : a + _ROWS], counts[a : a + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(h, buckets).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["bucket", "h", "n"])

    def run(batches):
        parts, held, texts = [], 0, 0
        for batch in batches:
            column = batch.column(0)
            for a, b in _chunks(column):
                words, lengths = words_of(column.slice(a, b - a).to_pylist())
                texts += b - a
                h = np.concatenate(grams(words, lengths, how.order))
                codes, kinds = pd.factorize(h[h != 0])  # no order is needed, so nothing is sorted
                parts.append((kinds, np.bincount(codes, minlength=len(kinds))))
                held += len(parts[-1][0])
            if held > 1 << 22:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > 1 << 21:
                    yield from batches_of(*parts.pop())
                    parts, held = [], 0
        if texts:
            parts.append((_tagged(np.array([_named(_START)], np.uint64), 0), np.array([texts])))
            yield from batches_of(*_summed(parts))

    return docs.select(text).mapInArrow(run, "bucket int, h long, n long")


_BUCKETS = "bucket int, bits binary, starts long, words array<struct<h:long,n:long>>"


def filter_buckets(grams: DataFrame, how: LogFilter) -> DataFrame:
    """``bucket, bits, starts, words``: each bucket's part of the filter, how many texts start there, and
    the exact counts of its words."""

    def build(key, table):
        h, at = np.unique(table.column("h").to_numpy().view(np.uint64), return_inverse=True)
        n = np.bincount(at, table.column("n").to_numpy()).astype(np.int64)
        level, order = how.levels(n), h & np.uint64(3)
        on = np.zeros(8 * max(8, -(-int(level.sum()) * how.bits // 8)), bool)
        for q in range(1, int(level.max()) + 1):
            z = how.event(h[level >= q], q)
            for k in range(how.probes):
                on[how.place(z, k, len(on))] = True
        words = pa.StructArray.from_arrays([pa.array(h[order == 1].view(np.int64)), pa.array(n[order == 1])], names=["h", "n"])
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary()), "starts": pa.array([int(n[order == 0].sum())], pa.int64()), "words": words})

    return grams.groupBy("bucket").applyInArrow(build, _BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    """``tokens``, ``kinds`` and ``starts``: N, V and the texts. ``heads``: names, in order, and counts of
    the frequent words. ``rest``: table of the others. ``filter``: table of its buckets."""

    how: LogFilter
    tokens: int
    kinds: int
    starts: int
    heads: tuple[np.ndarray, np.ndarray]
    rest: DataFrame
    filter: DataFrame
    buckets: int
    segments: int

    def segment(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the buckets with the remainder ``k``, and the bit each begins at and its size, by
        bucket; partition by partition, so that the driver holds them once."""
        start, size, parts, at = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64), [], 0
        for r in self.filter.where(F.col("bucket") % self.segments == k).select("bucket", "bits").toLocalIterator():
            start[r["bucket"]], size[r["bucket"]] = at, 8 * len(r["bits"])
            at += 8 * len(r["bits"])
            parts.append(np.frombuffer(r["bits"], np.uint8))
        mine = slice(k, None, self.segments)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), start[mine], size[mine]


def fit_model(docs: DataFrame, how: LogFilter = LogFilter(), text: str = "text") -> LanguageModel:
    """The filter over all n-grams of the texts (null: empty). No rows give a model that knows nothing.
    Its frequent words are those that make up at least one in 262,144 tokens, which no more than as
    many can."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // how.bucket_bytes))
    table = cut(filter_buckets(count_grams(docs, how, buckets, text), how), "lm-filter")
    words = table.select(F.explode("words").alias("w")).select("w.h", "w.n")
    starts, room = (int(v or 0) for v in table.agg(F.sum("starts"), F.sum(F.octet_length("bits"))).first())
    tokens, kinds = (int(v or 0) for v in words.agg(F.sum("n"), F.count("*")).first())
    segments = max(1, -(-room // how.segment_bytes))
    while segments < buckets and table.groupBy(F.col("bucket") % segments).agg(F.sum(F.octet_length("bits")).alias("n")).agg(F.max("n")).first()[0] > how.segment_bytes:
        segments += 1 + segments // 8
    often = F.col("n") * F.lit(_HEADS) >= F.lit(tokens)
    top = words.where(often).orderBy("h").toArrow().combine_chunks()
    names, counts = (top.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(names.view(np.uint64))
    return LanguageModel(how, tokens, kinds, starts, (names.view(np.uint64)[order], counts[order]), words.where(~often), table, buckets, min(segments, buckets))


def _find(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_names):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return at, sorted_names[at] == names


def probed(h: np.ndarray, part: tuple[np.ndarray, np.ndarray, np.ndarray], how: LogFilter, buckets: int, segment: int = 0, segments: int = 1, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Levels of n-grams whose buckets lie in the segment, 0 for all others and for those without the
    first event: each next level is asked for those that have all events before it, and each next probe
    for those that have all bits before it. ``known``: names, in order, whose levels were asked before, and these."""
    at, kinds = pd.factorize(h)
    level, (bits, start, size) = np.zeros(len(kinds), np.uint8), part
    bucket = _bucket(kinds, buckets)
    open_ = (bucket % segments == segment) & (kinds != 0)
    if known is not None:
        place, found = _find(known[0], kinds)
        level[found] = known[1][place[found]]
        open_ &= ~found
    mine = np.flatnonzero(open_)
    start, size = (x[bucket[mine] // segments] for x in (start, size))
    alive = np.flatnonzero(size > 0)
    mine, start, size = mine[alive], start[alive], size[alive].astype(np.uint64)
    q = 0
    while len(mine):
        q += 1
        z = how.event(kinds[mine], q)
        for k in range(how.probes):
            p = start + how.place(z, k, size)
            there = np.flatnonzero((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1)
            if len(there) < len(mine):
                mine, start, size, z = mine[there], start[there], size[there], z[there]
            if not len(mine):
                break
        level[mine] = q
    return level[at]


def log10_probabilities(levels: list[np.ndarray], lengths: np.ndarray, how: LogFilter, tokens: int, kinds: int, starts: int) -> np.ndarray:
    """Of every word, from the levels of the n-grams that end at it (0: none)."""
    value = how.counts()
    c = [value[q] for q in levels]
    first = np.zeros(len(c[0]), bool)
    first[np.cumsum(lengths) - lengths] = True
    p = np.minimum((c[0] + 1) / (tokens + kinds + 1), 1.0)
    for n in range(1, len(c)):
        context = np.concatenate((np.zeros(1), c[n - 1][:-1]))
        context[first] = starts if n == 1 else 0.0
        context = np.maximum(context, c[n])  # quantised counts may cross
        p = (c[n] + how.prior * p) / (context + how.prior)
    return np.log10(p)


def score_texts(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A null text is an empty one, which has one token, its end; a null key is learned from; repeated
    rows are rows of their own; an empty table gives no rows. Texts are scored whole. Other columns
    don't matter, whatever their names."""
    spark, how, segments = docs.sparkSession, model.how, model.segments
    names, sums = model.heads
    buckets, facts = model.buckets, (model.how, model.tokens, model.kinds, model.starts)
    floor = float(model.tokens + model.kinds + 1)

    def one(k: int, sent, last: bool):
        def run(batches):
            (filled, often), row = sent.value, TaskContext.get().partitionId() << 40
            for batch in batches:
                for a, b in _chunks(batch.column(2)):
                    part = batch.slice(a, b - a)
                    words, lengths = words_of(part.column(2).to_pylist())
                    found = grams(words, lengths, how.order)
                    ends = np.cumsum(lengths)
                    levels = [probed(h, filled, how, buckets, k, segments, (names, often) if n == 0 else None) for n, h in enumerate(found)]
                    if k:  # each n-gram is in one segment
                        before = _unpacked(np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8), lengths, how.order)
                        levels = [np.maximum(x, y) for x, y in zip(levels, before, strict=True)]
                    if not last:
                        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(_packed(levels, lengths), pa.binary())], names=["key", "train", "text", "levels"])
                        continue
                    score = np.add.reduceat(log10_probabilities(levels, lengths, *facts), ends - lengths)
                    at, head = _find(names, words)
                    each = np.where(head, np.log10((sums[at] + 1) / floor) if len(names) else 0.0, 0.0)
                    texts = np.repeat(np.arange(len(lengths)), lengths)
                    code, kinds = pd.factorize(words[~head])
                    other, n = np.unique(texts[~head] * max(len(kinds), 1) + code, return_counts=True)
                    rest = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(other, np.arange(len(lengths) + 1) * max(len(kinds), 1)).astype(np.int32)),
                        pa.StructArray.from_arrays([pa.array(kinds[other % max(len(kinds), 1)].view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "k"]),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row + np.arange(len(lengths))), part.column(0), part.column(1), pa.array(lengths), pa.array(score),
                            pa.array(np.add.reduceat(head.astype(np.int64), ends - lengths)), pa.array(np.add.reduceat(each, ends - lengths)), rest,
                        ],
                        names=["row", "key", "train", "n_tokens", "score", "head_tokens", "head_score", "rest"],
                    )
                    row += len(lengths)

        return run

    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(f"`{key}`").alias("key"), training(f"`{key}`").alias("train"), F.col(f"`{text}`").alias("text"))
    for k in range(segments):
        last, filled = k == segments - 1, model.segment(k)
        sent = spark.sparkContext.broadcast((filled, probed(names, filled, how, buckets, k, segments)))
        schema = f"row long, key {kind}, train boolean, n_tokens long, score double, head_tokens long, head_score double, rest array<struct<h:long,k:long>>" if last else f"key {kind}, train boolean, text string, levels binary"
        state = cut(state.mapInArrow(one(k, sent, last), schema), "lm-pass")
    rest = state.select("row", F.explode("rest").alias("r")).select("row", "r.h", "r.k").join(model.rest, "h")
    rest = rest.groupBy("row").agg(F.sum("k").alias("rest_tokens"), F.sum(F.col("k") * F.log10((F.col("n") + 1) / F.lit(floor))).alias("rest_score"))
    known = F.col("head_tokens") + F.coalesce("rest_tokens", F.lit(0))
    return state.drop("rest").join(rest, "row", "left").select(
        F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest_score", F.lit(0.0)) + (F.col("n_tokens") - known) * F.lit(-math.log10(floor))).alias("base_score"), "score",
    )


def _packed(levels: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    """Per text the levels of its words, order by order."""
    ends = np.cumsum(lengths)
    return [b"".join(x[e - n : e].tobytes() for x in levels) for e, n in zip(ends, lengths, strict=True)]


def _unpacked(flat: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    starts = order * (np.cumsum(lengths) - lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return [flat[np.repeat(starts + k * lengths, lengths) + within] for k in range(order)]


def language_scores(docs: DataFrame, how: LogFilter = LogFilter()) -> DataFrame:
    """:func:`score_texts` of all rows, learned from those of :func:`training`."""
    return score_texts(docs, fit_model(docs.where(training()), how))
