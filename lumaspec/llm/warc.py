"""WARC archives as chunked record tables.

A payload becomes rows of record identifier and chunk number, each chunk of bounded size, whatever
the payload's; the digest and the length are carried from chunk to chunk and stand in the last one.
In the archive a chunk is a WARC record, those after the first being ``continuation`` records, so
neither writing nor reading holds a payload in one piece: tasks see pieces of a chunk's size that
Spark cuts from the column. Archives are written and read by Spark's text source and so lie in any
store Spark knows; each file is plain or gzip as a whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, new_path

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
CHUNK_BYTES = 1 << 14
_MARK = (END + VERSION).encode()


class Chunker:
    """Chunks of one payload that comes in pieces: UTF-8 of at most ``size`` bytes, cut between
    characters, and none that makes the mark between two records, inside or after its header. It
    holds no more than a piece and a chunk, and the digest and length of all before."""

    def __init__(self, size: int):
        self.size, self.rest, self.sha, self.length = size, b"", hashlib.sha1(), 0

    def add(self, piece, last: bool):
        """Chunks that are whole now, each with whether it is the payload's last."""
        self.sha.update(piece)
        self.length += len(piece)
        data, at = self.rest + bytes(piece), 0
        while len(data) - at > self.size or last:
            end = min(at + self.size, len(data))
            while at < end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            mark = data.find(_MARK, at, end)
            if mark >= 0:
                end = mark + len(END) + 2
            if data.startswith(VERSION.encode(), at):  # it would follow its own header's end
                end = min(end, at + 2)
            done = last and end == len(data)
            yield data[at:end], done
            at = end
            if done:
                break
        self.rest = data[at:]


CHUNKS = "record long, page_id long, url string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html): a record per row, null html being
    empty. ``record`` numbers rows; the last chunk has the payload's length and SHA-1."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("most", F.floor(F.greatest(F.octet_length("html") - 1, F.lit(0)) / chunk_bytes).cast("int"))
    piece = F.col("html").substr(F.col("piece") * chunk_bytes + 1, F.lit(chunk_bytes))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("most")))).select("page_id", "url", piece.alias("data"), (F.col("piece") == F.col("most")).alias("last"))

    def run(batches):
        now, record, chunk = None, TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for page_id, url, data, last in zip(*(batch.column(k) for k in range(4)), strict=True):
                if now is None:
                    now, chunk = Chunker(chunk_bytes), 0
                for some, done in now.add(memoryview(data.as_buffer()), last.as_py()):
                    out.append((record, page_id.as_py(), url.as_py(), chunk, done, some, now.length if done else None, now.sha.hexdigest() if done else None))
                    chunk, held = chunk + 1, held + len(some)
                if last.as_py():
                    now, record = None, record + 1
                if held > 1 << 22:
                    yield _batch(out, CHUNK_TYPES)
                    out, held = [], 0
            if out:
                yield _batch(out, CHUNK_TYPES)

    return pieces.mapInArrow(run, CHUNKS)


CHUNK_TYPES = {"record": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "chunk": pa.int32(), "last": pa.bool_(), "data": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def _batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def revisits(chunks: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``record, first_id``: records whose payload of at least ``min_bytes`` equals that of the
    largest page_id, ``first_id``. Rows that repeat that page_id revisit nothing; null ids are never
    the largest, and revisit one that isn't null."""
    ends = chunks.where(F.col("last") & (F.col("payload_bytes") >= min_bytes)).select("record", "page_id", "payload_bytes", "payload_digest")
    key = ["payload_digest", "payload_bytes"]
    first = ends.groupBy(*key).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    return ends.join(first, key).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("record", "first_id")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def archive_lines(chunks: DataFrame, again: DataFrame, date: str) -> DataFrame:
    """One ``value`` per WARC record: every chunk of a response, and one record without a payload for
    each of ``again`` (of :func:`revisits`)."""
    rows = chunks.join(again, "record", "left")
    revisit = F.col("first_id").isNotNull()
    rows = rows.where(~revisit | F.col("last")).withColumn("chunk", F.when(revisit, 0).otherwise(F.col("chunk")))
    body = F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string"))
    origin = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("record").cast("string"))
    parted = (F.col("chunk") > 0) | ~F.col("last")
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    parts = [
        F.lit(VERSION),
        _header("WARC-Type", F.when(revisit, "revisit").when(F.col("chunk") == 0, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.concat(origin, F.lit(":"), F.col("chunk").cast("string"), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Segment-Number", F.when(parted, F.col("chunk") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(parted, F.concat(origin, F.lit(":0>")))),
        _header("WARC-Segment-Total-Length", F.when(parted & F.col("last"), F.col("payload_bytes"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    ]
    return rows.select(F.concat(*parts).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES, compression: str = "gzip") -> None:
    """One archive per task under ``path`` from ``pages`` (page_id, url, html, any others);
    ``compression`` is gzip or none. Null html is an empty payload, a null url ``urn:none``, a null
    page_id none; repeated rows are records each; an empty table gives archives without records."""
    chunks = cut(chunk_rows(pages, chunk_bytes), "warc-chunks")
    archive_lines(chunks, cut(revisits(chunks), "warc-revisits"), date).write.option("lineSep", END).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table back: one row per WARC record, with the headers used here and ``body``.

    Hadoop's reader of lines overlooks a separator that begins within another's first bytes at a
    buffer's end (a payload that ends with a line feed), so records are parted once more."""
    mark = END + VERSION
    lines = spark.read.option("lineSep", mark).text(path)
    parted = F.when(F.instr("value", mark) > 0, F.split("value", re.escape(mark))).otherwise(F.array("value"))
    lines = lines.select(F.explode(parted).alias("value"))
    head = F.substring_index("value", END, 1)

    def header(name: str) -> Column:
        found = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(found == "", None).otherwise(found)

    size = header("Content-Length").cast("int")
    after = F.expr(f"octet_length(substring_index(value, '{END}', 1)) + {len(END)} + 1".replace("\r", "\\r").replace("\n", "\\n"))
    return lines.where(head != "").select(
        header("WARC-Type").alias("warc_type"),
        header("WARC-Page-ID").cast("long").alias("page_id"),
        header("WARC-Target-URI").alias("url"),
        header("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.substring_index(header("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.regexp_extract(F.coalesce(header("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers"),
        header("WARC-Segment-Origin-ID").alias("origin"),
        header("WARC-Segment-Number").cast("int").alias("segment"),
        header("WARC-Segment-Total-Length").alias("total"),
        F.col("value").cast("binary").substr(after, size).alias("body"),
    )


RECORDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record read back. Sizes
    and digests of responses are those of the bytes read, carried from chunk to chunk; a revisit's
    are those of its headers. Chunks of one record that other tasks may have read meet, in order."""

    def run(batches):
        now, sha, size = None, None, 0
        for batch in batches:
            out = []
            for origin, page_id, kind, said_bytes, said_digest, refers, last, body in zip(*(batch.column(k) for k in range(8)), strict=True):
                if kind.as_py() == "revisit":
                    out.append((page_id.as_py(), said_bytes.as_py(), said_digest.as_py(), "revisit", refers.as_py()))
                    continue
                if sha is None or not origin.is_valid or origin.as_py() != now:
                    now, sha, size = origin.as_py(), hashlib.sha1(), 0
                data = body.as_buffer()
                sha.update(data)
                size += len(data)
                if last.as_py():
                    out.append((page_id.as_py(), size, sha.hexdigest(), "response", None))
                    sha = None
            if out:
                yield _batch(out, RECORDS)

    rows = read_archives(spark, path).withColumn("last", F.col("origin").isNull() | F.col("total").isNotNull())
    parted = rows.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    names = ["origin", "page_id", "warc_type", "payload_bytes", "payload_digest", "refers", "last", "body"]
    both = rows.where("origin is null").select(*names).unionAll(parted.select(*names))
    return both.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, compression: str = "gzip") -> DataFrame:
    """Write every row of ``pages`` to archives in the shared folder and read them back. Nulls, empty
    payloads, repeated rows and empty tables: see :func:`write_archives`; other columns are left out."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, chunk_bytes=chunk_bytes, compression=compression)
    return records(spark, path)
