"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled text; a text is compressed
with every dictionary, and the language whose dictionary makes it smallest is chosen. Texts whose
two smallest sizes lie too close are rejected. Case, digits and punctuation say little about the
language, so both sides are reduced to lower-case letters and single spaces.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """Letters with their marks, composed, in lower case, and single spaces."""
    return unicodedata.normalize("NFC", _OTHER.sub(" ", text).strip().lower())


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and their dictionaries' contents. Texts are compressed at ``level`` in
    blocks of equal length of at most ``block_bytes``: each is a frame of its own, so that the
    dictionary never gives way to the text's own history and all parts of a text weigh the same.
    ``search_log`` bounds the level's search for matches: 3 tells held-out texts apart as well as the
    level's own 7, in three quarters of the time.
    The lead of the smallest size over the next must be ``min_bytes`` and ``min_margin`` of the text
    at least, and that size at most ``most_rate`` of the text and ``frame_bytes``: what every
    dictionary fails to shorten is in none of the languages."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]
    level: int = 12
    search_log: int = 3
    block_bytes: int = 4096
    min_margin: float = 0.0005
    min_bytes: int = 3
    most_rate: float = 0.55
    frame_bytes: int = 25

    def sizes(self):
        """A function from an encoded text to its sizes under each dictionary."""
        import zstandard

        made = []
        for content in self.contents:
            how = zstandard.ZstdCompressionParameters.from_level(
                self.level, dict_size=len(content), source_size=self.block_bytes, search_log=self.search_log, write_content_size=0, write_dict_id=0, write_checksum=0
            )
            use = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            use.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=use))

        def total(data: bytes) -> list[int]:
            n = max(1, -(-len(data) // self.block_bytes))
            blocks = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
            return [sum(len(c.compress(b)) for b in blocks) for c in made]

        return total


def excerpts(texts: list[bytes], room: int) -> list[bytes]:
    """The texts, each cut to one length, the longest at which they fill ``room`` together."""
    sizes, left = sorted(map(len, texts)), room
    for k, size in enumerate(sizes):
        if size * (len(sizes) - k) > left:
            return [t[: left // (len(sizes) - k)] for t in texts]
        left -= size
    return texts


def fit_languages(docs: DataFrame, where: Column, docs_per_language: int = 400, excerpt_chars: int = 20_000, dictionary_bytes: int = 64_000, **options) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows for which ``where`` holds.

    The sample: of each language about ``docs_per_language`` rows, by the least hashes of doc_id, of
    each at most its first ``excerpt_chars`` characters; rows alike in these count once. A dictionary
    of ``dictionary_bytes`` holds all of its language's sample, each text cut to the same length,
    so that many documents' words are in it: with the defaults and texts that are long enough, the
    first 160 bytes of 400 texts. Counts per language cover all rows. Languages with a dictionary
    are a bounded set, as every task has all of them. No labelled rows give a model without any.
    """
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.select("lang", F.substring("text", 1, excerpt_chars).alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)).alias("hash"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in found.collect()}
    if not counts:
        return LanguageModel((), (), **options)
    # an Arrow table needs no Python worker, as a list would: those stay beside the ones of the functions
    limits = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(counts, pa.string()), "limit_": pa.array([int((1 << 30) * min(1.0, docs_per_language / n)) for n in counts.values()], pa.int64())}))
    sample = rows.join(F.broadcast(limits), "lang").where("hash < limit_").orderBy("lang", "hash", "text").collect()
    names = tuple(sorted(counts, key=lambda x: (-counts[x], x)))  # ties go to the more frequent
    contents = []
    for name in names:
        texts = list(dict.fromkeys(letters(r["text"]).encode("utf-8", "replace") for r in sample if r["lang"] == name))
        contents.append(b"\n".join(excerpts(texts, dictionary_bytes)) or b"\n")
    return LanguageModel(names, tuple(contents), **options)


PREDICTION = "lang_pred string, score double, rejected boolean"


def predict_language(model: LanguageModel, text: str = "text") -> Column:
    """A struct of ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for the text column.

    Null texts, texts without a letter, and all texts of a model without languages are ``und`` with
    score 0, rejected. ``rejected`` is also true if the two smallest sizes differ by less than
    ``min_bytes`` or ``min_margin`` of the text, or no dictionary shortens it well. The whole text counts, whatever its length.
    """

    def run(texts: pa.Array) -> pa.Array:
        sizes, out = model.sizes(), []
        for value in texts:  # one text at a time is a Python string
            whole = value.as_py()
            plain = letters(whole) if whole is not None and model.languages else ""
            if not _LETTER.search(plain):
                out.append((UNKNOWN, 0.0, True))
                continue
            data = (" " + plain + " ").encode("utf-8", "replace")
            found = np.asarray(sizes(data), float)
            best = int(found.argmin())
            if len(found) == 1:
                out.append((model.languages[best], 1.0, False))
                continue
            lead = np.partition(found, 1)[1] - found[best]
            margin = lead / len(data)
            out.append((model.languages[best], float(1 - 0.5 * np.exp(-8 * margin * min(len(data), 400) / 20)), bool(lead < model.min_bytes or margin < model.min_margin or found[best] > model.most_rate * len(data) + model.frame_bytes)))
        columns = [[r[k] for r in out] for k in range(3)]
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, PREDICTION)(F.col(text))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning: a fifth, by the CRC-32 of the key as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row, learned from rows not held out."""
    model = model or fit_languages(docs, ~held_out())
    return docs.select("doc_id", held_out().alias("held_out"), predict_language(model).alias("p")).select("doc_id", "held_out", "p.*")


def drop_rejected(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told clearly, with their own columns. Rows whose text is
    null or has no letter go; repeated rows stay or go together; a null doc_id changes nothing."""
    model = model or fit_languages(docs, ~held_out())
    return docs.withColumn("lumaspec_lang_", predict_language(model)).where("not lumaspec_lang_.rejected").drop("lumaspec_lang_")
