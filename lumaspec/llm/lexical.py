"""Ranked lexical search by terms, in whole numbers.

Documents are scored in blocks, each with its own inverted lists, term at a time, rarest first. A
document gets an accumulator when a term first meets it. Before each term the bounds of the terms
still to come are added up (the largest score each gives in the block); once that sum cannot reach
the kth partial score, no new document can come among the first k, and no more accumulators are
made. Those that can still come among the first k are then brought up to date with every other term,
which is exact. The first k of each block are merged.

A term's weight, the documents' lengths and the number of documents are of the whole table, found in
one pass that also keeps, for each document, the occurrences of the items' terms only.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

#: In UTF-8 every byte of a character beyond ASCII is 0x80 or more.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_ITEM_TERMS = 1 << 20
_POSTINGS = 1 << 22


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of all characters beyond ASCII, with
    A-Z lower-cased. A null text has none."""
    return _TERM.findall((text or "").encode().lower())


def items_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term``: the terms of each item, once each. Rows of one key are one item."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                found = sorted(set(terms(one.column(1)[0].as_py())))
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array([0] * len(found), pa.int64())), pa.array(found, pa.binary())], names=["item", "term"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"item {kind}, term binary").distinct()


def _forward(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``doc_id, n, term, tf``: every document's number of terms and the items' terms among them."""

    def run(batches):
        for batch in batches:
            n, ids, tfs, ends = [], [], [], [0]
            for at in range(batch.num_rows):
                found = terms(batch.column(1)[at].as_py())
                n.append(len(found))
                mine = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                ids += [i for i, _ in mine]
                tfs += [c for _, c in mine]
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores that hold the first ``k`` of a block, ties included, and how many
    accumulators were made. ``lists``, rarest first: documents in rising order, and what the term
    adds to each, which is not negative."""
    score, made = np.zeros(documents, np.int64), np.zeros(documents, bool)
    bounds = np.array([int(gain.max(initial=0)) for _, gain in lists], np.int64)
    to_come = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0]))
    alive = None
    for at, (docs, gain) in enumerate(lists):
        if alive is None:
            some = np.flatnonzero(made)
            if len(some) >= k:
                kth = np.partition(score[some], len(some) - k)[len(some) - k]
                if to_come[at] < kth:
                    alive = some[score[some] + to_come[at] >= kth]
        if alive is None:
            score[docs] += gain
            made[docs] = True
            continue
        place = np.minimum(np.searchsorted(docs, alive), max(len(docs) - 1, 0))
        hit = docs[place] == alive if len(docs) else np.zeros(len(alive), bool)
        score[alive[hit]] += gain[place[hit]]
    some = np.flatnonzero(made) if alive is None else alive
    return some, score[some], int(made.sum())


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = _POSTINGS, item_terms: int = _ITEM_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents with the highest scores above 0.

    With N documents that have a term, L terms in all, n in a document, df documents that hold a term
    and tf of it in one: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + 90 n N div L, and a term
    adds w (10^9 tf div (1000 tf + 8 m)). Ties go to the smaller id, a null id last. Null texts have
    no terms; items without terms or without a match have no rows; rows of one item id are one item,
    null being an id like others; each row of ``docs`` is a document, also when rows are alike. Items
    are taken in runs of about ``item_terms`` of their terms, which is what tasks are sent; each run
    reads the documents once. Other columns don't matter, whatever their names.
    """
    spark, out = docs.sparkSession, None
    wanted = cut(items_terms(items, item, text), "search-items")
    runs = max(1, -(-wanted.count() // item_terms))
    for turn in range(runs):
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(runs)) == turn).orderBy("item", "term").toArrow().combine_chunks()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(mine.column("term").to_pylist()))}
        found = cut(_forward(docs, vocabulary, key, text), "search-terms")
        documents, total = (int(v or 0) for v in found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row a term of the run
            df[r["term"]] = r["count"]
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        new = [at for at, (a, b) in enumerate(zip([object(), *mine.column("item").to_pylist()], mine.column("item").to_pylist(), strict=False)) if a != b]
        ids = np.array([vocabulary[t] for t in mine.column("term").to_pylist()], np.int64)
        each = [t[np.lexsort((t, df[t]))] for t in np.split(ids, new[1:])] if new else []
        names = spark.createDataFrame(pa.table({"ask": pa.array(range(len(new)), pa.int32()), "item": mine.column("item").take(pa.array(new, pa.int64()))}), f"ask int, item {items.schema[item].dataType.simpleString()}")
        top = _ranked(found.where(F.size("term") > 0), each, weight, documents, total, k, block)
        top = top.join(F.broadcast(names), "ask").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")  # an item has a term of the run
        out = top if out is None else out.unionByName(top)
    return out


def _ranked(found: DataFrame, each: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int, block: int) -> DataFrame:
    """``ask, rank, doc_id, score``: the first k of each item, by the first k of each block."""

    def best(parts: list[pa.Table]):
        table = pa.concat_tables(parts).combine_chunks()
        n = table.column("n").to_numpy()
        m = 10 + 90 * n * documents // total
        lists, tf = table.column("term").chunk(0), table.column("tf").chunk(0).flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy()
        gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((doc, term))
        doc, gain, starts = doc[order], gain[order], np.searchsorted(term[order], np.arange(len(weight) + 1))
        for ask, asks in enumerate(each):
            some, score, _ = accumulate([(doc[starts[t] : starts[t + 1]], gain[starts[t] : starts[t + 1]]) for t in asks if starts[t] < starts[t + 1]], len(n), k)
            some, score = some[score > 0], score[score > 0]
            if len(some) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                some, score = some[score >= last], score[score >= last]
            if len(some):
                first = pa.table({"doc_id": table.column("doc_id").take(pa.array(some)), "score": score}).sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, k).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([ask] * len(first), pa.int32()), first.column(0).chunk(0), first.column(1).chunk(0)], names=["ask", "doc_id", "score"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts.append(table)
            held += len(table.column("term").combine_chunks().flatten())
            if held >= block:
                yield from best(parts)
                parts, held = [], 0
        if parts:
            yield from best(parts)

    rows = found.mapInArrow(run, f"ask int, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long")
    turn = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", turn).where(F.col("rank") <= k)
