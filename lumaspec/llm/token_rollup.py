"""Token totals kept by signed deltas.

A change feed of inserts, deletes and revised counts becomes signed sums by source, language and
tokenizer version. A batch's sums lie in a folder of their own; the batch counts from the moment at
which a small file of its name, which says where the sums are, is renamed into place. That happens
once for a name, so a batch committed again, or by two writers at a time, changes nothing. Totals are
the last snapshot and the batches after it; compaction writes the next snapshot from those alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenizing import shared, text_chunks

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def inserts(rows: DataFrame) -> DataFrame:
    """Changes for new rows (source, lang, tokenizer, tokens)."""
    return rows.select(*KEYS, F.lit(1).alias("documents"), F.col("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take away rows counted before."""
    return rows.select(*KEYS, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put new counts in the place of old ones."""
    return deletes(old).unionByName(inserts(new))


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` without its text, with a long column ``tokens_<version>`` for each version of
    ``tokenizers`` (version to file): ids of the whole text, without special tokens, whose strings in
    a text count as text. A null text has 0."""
    kept = [c for c in docs.columns if c != text]
    names = [f"tokens_{v}" for v in tokenizers]

    def run(batches):
        counters = [shared(path, special_tokens=False) for path in tokenizers.values()]
        for batch in batches:
            for low, high, part in text_chunks(batch.column(batch.num_columns - 1)):
                rest = batch.slice(low, high - low).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c.counts(part), pa.int64()) for c in counters]], names=[*kept, *names])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    schema = slim.drop(text).schema
    for name in names:
        schema = schema.add(name, "long")
    return slim.mapInArrow(run, schema)


def _file_name(batch: str) -> str:
    return hashlib.sha1(batch.encode()).hexdigest()


@dataclass
class TokenRollup:
    """Totals under ``path``; any number of writers may repeat a batch, in any order.

    A null source, language or tokenizer is a key of its own; null counts are 0; an empty batch is
    committed as one without sums.
    """

    spark: SparkSession
    path: str

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf), where.getFileSystem(conf), where

    def _names(self, folder: str) -> list[str]:
        _, fs, top = self._files(f"{self.path}/{folder}")
        found = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in found if n[0] not in "._")

    def _publish(self, folder: str, name: str, says: list) -> bool:
        """Put a file of JSON lines in its place in one step; False if there is one already."""
        _, fs, draft = self._files(f"{self.path}/{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write("\n".join(json.dumps(s) for s in says).encode())
        stream.close()
        context, _, place = self._files(f"{self.path}/{folder}/{name}")
        gateway = self.spark.sparkContext._gateway
        never_over = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, never_over)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False

    def _read(self, folder: str, names: list[str]) -> list:
        if not names:
            return []
        return [json.loads(r[0]) for r in self.spark.read.text([f"{self.path}/{folder}/{n}" for n in names]).collect()]

    def _state(self) -> tuple[int, list[str], dict[str, str]]:
        """Number of the last snapshot, the batches in it, and where the sums of it and of later batches are."""
        snapshots = self._names("snapshots")
        folded, sums = [], {}
        if snapshots:
            said = self._read("snapshots", snapshots[-1:])
            folded, sums = [x for s in said for x in s["batches"]], {"": said[0]["sums"]}
        later = set(self._names("commits")) - {_file_name(b) for b in folded}
        sums |= {c["batch"]: c["sums"] for c in self._read("commits", sorted(later))}
        return len(snapshots), folded, sums

    def committed(self) -> set[str]:
        _, folded, sums = self._state()
        return {*folded, *sums} - {""}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the sums of ``changes`` once; False if the batch was there already."""
        name = _file_name(batch)
        if name in self._names("commits"):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum(F.col("documents").cast("long")), F.lit(0)).cast("long").alias("documents"),
            F.coalesce(F.sum(F.col("tokens").cast("long")), F.lit(0)).cast("long").alias("tokens"),
        )
        folder = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/sums/{folder}")
        return self._publish("commits", name, [{"batch": batch, "sums": folder}])

    def _sum(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SUMS).parquet(*[f"{self.path}/sums/{f}" for f in folders])
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.where("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Fold the last snapshot and all later batches into the next snapshot; False if another
        writer did so meanwhile. Sums folded before stay for readers that still use them."""
        number, folded, sums = self._state()
        if not sums:
            return False
        folder = uuid.uuid4().hex
        self._sum(list(sums.values())).write.parquet(f"{self.path}/sums/{folder}")
        batches = sorted({*folded, *sums} - {""})
        says = [{"sums": folder, "batches": batches[k : k + 1000]} for k in range(0, max(1, len(batches)), 1000)]
        return self._publish("snapshots", f"{number:012d}", says)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all batches, without keys that fell to nothing."""
        _, _, sums = self._state()
        if not sums:
            return self.spark.createDataFrame([], _SUMS)
        return self._sum(sorted(sums.values()))
