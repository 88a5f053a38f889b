"""Best-fit packing of token sequences.

Texts are tokenized where they lie, cut into pieces of at most ``capacity`` tokens, and the pieces
(a few numbers each) are packed by vector best fit: every open bin has residual tokens, documents
and attention cost; a piece goes to the feasible bin whose residual, after it, has the least norm
(or that has the largest weighted dot product of demand and residual). Pieces are dealt over groups
of about ``group_pieces`` rows, whatever their key, so no task grows with the input; each group
leaves at most a bin or so partly filled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import handled
from ._store import cut
from .tokenizing import shared, text_chunks


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, pieces of documents, and attention cost (the sum of squared
    piece lengths). Where the last two are not given they are what ``tokens`` pieces of one token
    and one piece of ``tokens`` take, so that all three are finite and count in the choice of a bin."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, eos: int = 1) -> DataFrame:
    """One row per piece of each document's ids. A null text has only the closing id."""

    def run(batches):
        words, count, base = shared(tokenizer), 0, TaskContext.get().partitionId()

        def work(batch):
            nonlocal count
            docs_of = batch.column(0).to_pylist()
            for low, high, texts in text_chunks(batch.column(1)):
                ids, ends = words.encode(texts)
                rows, at = [], 0
                for doc_id, end in zip(docs_of[low:high], ends.tolist(), strict=True):
                    whole = np.append(ids[at:end], np.uint32(eos)).astype("<u4")
                    at = end
                    for k, s in enumerate(range(0, len(whole), capacity)):
                        piece = whole[s : s + capacity]
                        count += 1
                        deal = ((base * 1_000_003 + count) * 0x9E3779B97F4A7C15 >> 20) & 0x7FFFFFFF
                        rows.append((doc_id, k, s, len(piece), zlib.crc32(piece), deal))
                cols = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

        return handled(batches, work)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: best fit over descending lengths, under every limit."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    limit = capacity.limits()
    if len(lengths) and ((top := int(lengths.max())) > limit[0] or top * top > limit[2]):
        raise ValueError("a piece alone exceeds a limit of its bin")
    whole = int((lengths[order] >= capacity.tokens).sum())  # these fill a bin alone
    bins[order[:whole]] = np.arange(whole)
    n, size = whole, max(16, len(lengths) - whole)
    residual = np.empty((3, size), np.int64)
    names = np.empty(size, np.int64)
    live, least = 0, int(lengths.min(initial=1))
    scale = np.asarray(capacity.weights) / limit
    for i in order[whole:]:
        need = np.array([lengths[i], 1, lengths[i] ** 2], np.int64)
        left = residual[:, :live] - need[:, None]
        fits = (left >= 0).all(0)
        if fits.any():
            if capacity.rule == "dot":
                value = -((residual[:, :live] * scale[:, None] * (need * scale)[:, None]).sum(0))
            else:
                value = ((left * scale[:, None]) ** 2).sum(0)
            b = int(np.where(fits, value, np.inf).argmin())
        else:
            b, live = live, live + 1
            residual[:, b], names[b] = limit, n
            n += 1
        bins[i], offsets[i] = names[b], capacity.tokens - residual[0, b]
        residual[:, b] -= need
        if residual[0, b] < least or residual[1, b] < 1 or residual[2, b] < least * least:
            live -= 1
            residual[:, b], names[b] = residual[:, live], names[live]
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity, group_pieces: int = 16384) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` must read a written table, as it is read twice."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        group = table.column("pack_group").to_numpy().astype(np.int64)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(group * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("pack_group", F.pmod("deal", F.lit(groups))).drop("deal").groupBy("pack_group").applyInArrow(one, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, eos: int = 1, group_pieces: int = 16384) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text, any others) into sequences.

    Null texts and empty ones are their closing id alone; a null doc_id is kept; repeated rows are
    packed each; an empty table gives no rows; other columns are left out.
    """
    capacity = capacity or Capacity()
    return pack(cut(token_pieces(docs, tokenizer, capacity.tokens, eos), "pieces"), capacity, group_pieces)
