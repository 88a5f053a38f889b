"""Files against their manifests, archives' members, spectral tables and result sinks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checksums(files: DataFrame, name: str, content: str) -> DataFrame:
    """``name, size, md5, sha256`` of a binary or string column."""
    body = F.col(content).cast("binary")
    return files.select(F.col(name).alias("name"), F.octet_length(body).cast("long").alias("size"), F.md5(body).alias("md5"), F.sha2(body, 256).alias("sha256"))


def verify(found: DataFrame, manifest: DataFrame, digest: str = "sha256") -> DataFrame:
    """``name, state`` for each row of the manifest (name, size, <digest>): ok, missing, size or checksum."""
    have = found.select(F.col("name").alias("n_"), F.col("size").alias("s_"), F.col(digest).alias("d_"))
    state = F.when(F.col("n_").isNull(), "missing").when(F.col("s_") != F.col("size"), "size").when(F.col("d_") != F.col(digest), "checksum").otherwise("ok")
    return manifest.join(have, F.col("name") == F.col("n_"), "left").select("name", state.alias("state"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unsafe_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path leaves its root."""
    p = F.col(path)
    return df.where(p.startswith("/") | F.array_contains(F.split(p, "/"), ".."))


def zip_members(files: DataFrame) -> DataFrame:
    """``path, member, size, corrupt`` of ``binaryFile`` rows, without writing any member."""

    def run(batches):
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    bad = z.testzip()
                    rows += [(path, i.filename, i.file_size, i.filename == bad) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["path", "member", "size", "corrupt"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, corrupt boolean")


def json_rows(df: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """``<key>, readable, record``: JSON texts as structs; what can't be read has no record."""
    kind = f"{schema}, corrupt_ string"
    read = F.from_json(column, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"})
    ok = F.col("r").isNotNull() & F.col("r.corrupt_").isNull()
    return df.select(key, read.alias("r")).select(key, ok.alias("readable"), F.when(ok, F.col("r").dropFields("corrupt_")).alias("record"))


def spectral_table(spark: SparkSession, path: str, wavelength: str = "wavelength_nm") -> DataFrame:
    """A wide CSV of spectra as ``name, wavelengths, spectrum``, each sorted by wavelength."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    long = wide.unpivot([wavelength], [c for c in wide.columns if c != wavelength], "name", "value").where("value is not null")
    rows = long.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col(wavelength).cast("double").alias("w"), F.col("value").cast("double").alias("v")))).alias("s"))
    return rows.select("name", F.transform("s", lambda p: p["w"]).alias("wavelengths"), F.transform("s", lambda p: p["v"]).alias("spectrum"))


def mat_cube(spark: SparkSession, path: str, key: str | None = None, scene: str = "scene") -> DataFrame:
    """Pixels of the named (or first) 3-D numeric array of an uncompressed or zlib-packed MAT file of version 5."""
    from .mat5 import first_cube

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                cube = first_cube(bytes(content), key)
                h, w, b = cube.shape
                for y in range(h):
                    yield pd.DataFrame({"scene_id": [scene] * w, "pixel_id": [y * w + x for x in range(w)], "y": [y] * w, "x": list(range(w)), "spectrum": list(cube[y].astype(float).reshape(w, b))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "scene_id string, pixel_id long, y int, x int, spectrum array<double>")


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON; NaN is written as null."""
    df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(path)


def svg_bars(df: DataFrame, name: str, value: str, low: str, high: str, width: int = 400, row: int = 22) -> DataFrame:
    """One row ``svg``: bars with their intervals, by falling value, scaled to the largest upper bound.
    For summaries of a few rows."""
    top = df.agg(F.max(high).alias("top_"), F.count("*").alias("n_"))
    place = F.row_number().over(Window.orderBy(F.desc(value), name)) - 1
    rows = df.select(F.col(name).cast("string").alias("name_"), value, low, high, place.alias("at_")).crossJoin(F.broadcast(top))
    x = lambda c: F.format_string("%.1f", F.lit(float(width)) * F.col(c) / F.greatest("top_", F.lit(1e-12)))
    safe = F.replace(F.replace(F.replace("name_", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    y = F.col("at_") * row
    bar = F.concat(
        F.format_string('<g transform="translate(0 %d)"><text x="0" y="%d">', y, F.lit(row - 8)), safe, F.lit("</text>"), F.lit(f'<rect x="150" y="3" height="{row - 8}" width="'), x(value), F.lit('"/>'),
        F.lit(f'<path transform="translate(150 {row // 2})" d="M'), x(low), F.lit(" 0H"), x(high), F.lit('"/></g>'),
    )
    all_ = rows.select("at_", "n_", bar.alias("bar_")).agg(F.max("n_").alias("n_"), F.sort_array(F.collect_list(F.struct("at_", "bar_"))).alias("b"))
    head = F.format_string(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 160}" height="%d">', F.coalesce("n_", F.lit(0)) * row)
    return all_.select(F.concat(head, F.array_join(F.transform("b", lambda p: p["bar_"]), ""), F.lit("</svg>")).alias("svg"))
