"""Published analyses as tables: their JSON protocols, file manifests, spectra and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import interpolate
from ..operators.metrics import match
from .files import spectral_table

_PROTOCOL = """schema_version int, sources string, primary_analysis struct<sample_name string, crop_yx array<array<int>>, rotation_degrees double, positive_threshold_um double,
rois array<struct<index int, top_left_yx array<int>, bottom_right_yx array<int>, concentration_um double, published_classification_score double>>>"""


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """One row per region of each protocol file: ``path, sample_name, rotation_degrees, threshold_um,
    height, width, top, left, roi, y0, x0, y1, x1, concentration_um, published_score, positive``.

    The job fails for a file of another version, one whose regions aren't numbered from 0 in turn,
    and one with a region that is empty or leaves the crop."""
    raw = spark.read.schema(_PROTOCOL).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), "schema_version", "primary_analysis.*")
    crop = F.col("crop_yx")
    size = lambda k: crop[k][1] - crop[k][0]
    each = raw.select("path", "schema_version", "sample_name", "rotation_degrees", F.col("positive_threshold_um").alias("threshold_um"), size(0).alias("height"), size(1).alias("width"), crop[0][0].alias("top"), crop[1][0].alias("left"), F.posexplode("rois").alias("at", "r"))
    rows = each.select(
        "path", "schema_version", "sample_name", "rotation_degrees", "threshold_um", "height", "width", "top", "left", "at", F.col("r.index").alias("roi"),
        F.col("r.top_left_yx")[0].alias("y0"), F.col("r.top_left_yx")[1].alias("x0"), F.col("r.bottom_right_yx")[0].alias("y1"), F.col("r.bottom_right_yx")[1].alias("x1"),
        F.col("r.concentration_um").alias("concentration_um"), F.col("r.published_classification_score").alias("published_score"), (F.col("r.concentration_um") >= F.col("threshold_um")).alias("positive"),
    )
    inside = (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= F.col("height")) & (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= F.col("width"))
    for holds, says in ((F.col("schema_version") == 1, "a protocol of another version"), (F.col("at") == F.col("roi"), "regions are not numbered in turn"), (inside, "a region leaves the crop")):
        rows = rows.where(F.assert_true(F.coalesce(holds, F.lit(False)), F.lit(says)).isNull())
    return rows.drop("schema_version", "at")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, checksum, download_url, role`` of the files that JSON manifests list, by name."""
    kind = "files map<string, struct<size: bigint, checksum: string, download_url: string, role: string>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path)
    return raw.select(F.explode("files").alias("name", "f")).select("name", "f.*").orderBy("name")


def absorbance_at(spark: SparkSession, path: str, wavelengths: Column, value: str = "absorbance", wavelength: str = "wavelength_nm") -> DataFrame:
    """``name, absorbance``: a CSV's curve at other wavelengths, constant beyond its ends."""
    table = spectral_table(spark, path, wavelength).where(F.col("name") == value)
    return table.select("name", F.transform(wavelengths, lambda x: interpolate(x, F.col("wavelengths"), F.col("spectrum"))).alias("absorbance"))


def long_spectra(tables: list[tuple[DataFrame, DataFrame]], step: float = 1.0, missing: float = -1e20) -> DataFrame:
    """Spectra of an archive on one grid: ``name, wavelength_nm, value`` at every ``step`` nm that the
    curve covers. Each of ``tables`` is its wavelengths in micrometres (``row, value``) and its spectra
    (``name, row, value``); values below ``missing`` are holes and are bridged."""
    every = None
    for grid, spectra in tables:
        part = match(spectra, grid.select("row", F.col("value").alias("um")), ["row"]).where((F.col("value") >= missing) & (F.col("um") >= missing)).select("name", (F.col("um") * 1000).alias("w"), "value")
        every = part if every is None else every.unionByName(part)
    curve = every.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("w", "value"))).alias("s"))  # one measured curve: some thousand values
    curve = curve.select("name", F.transform("s", lambda p: p["w"]).alias("w"), F.transform("s", lambda p: p["value"]).alias("v"))
    on = F.sequence(F.ceil(F.array_min("w") / step), F.floor(F.array_max("w") / step))
    out = curve.select("name", "w", "v", F.explode(on).alias("k"))
    return out.select("name", (F.col("k") * step).alias("wavelength_nm"), interpolate(F.col("k") * F.lit(step), F.col("w"), F.col("v")).alias("value"))


def wide_spectra(spectra: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """``wavelength_nm`` and a column per name, as the library's CSV has them."""
    return spectra.groupBy("wavelength_nm").pivot("name", names).agg(F.first(value)).orderBy("wavelength_nm")


STATUSES = ("supported", "blocked", "inconclusive")


def check_evidence(entries: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``<key>, id, state`` for each entry (key, id, status, claim, command, limitations, artifacts of
    path and sha256) of a manifest against the files ``found`` (path, sha256): the first that is
    wrong of id, status, claim, command, limitations and artifacts, or ok."""
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    words = F.split(F.trim("command"), r"\s+")
    twice = entries.groupBy("id").agg(F.count("*").alias("n_")).where("n_ > 1")
    files = found.select(F.col("path").alias("have_"), F.col("sha256").alias("is_"))
    each = entries.select(key, F.explode("artifacts").alias("a")).select(key, F.col("a.path").alias("path"), F.col("a.sha256").alias("sha256"))
    outside = F.coalesce(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."), F.lit(True))
    each = each.join(files, F.col("path") == F.col("have_"), "left").select(
        key, F.when(outside, 1).when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), 2).when(F.col("have_").isNull(), 3).when(F.col("sha256") != F.col("is_"), 4).alias("fault"), F.lit(1).alias("one")
    )
    faults = each.groupBy(key).agg(F.min("fault").alias("fault"), F.sum("one").alias("artifacts_"))
    rows = match(match(entries, twice, ["id"], "left"), faults, [key], "left")
    limits = F.coalesce((F.size("limitations") > 0) & F.forall("limitations", text), F.lit(False))
    state = (
        F.when(~text(F.col("id")), "id missing").when(F.col("n_").isNotNull(), "id given twice").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status").when(~text(F.col("claim")), "claim")
        .when(~F.coalesce((F.size(words) >= 2) & words[0].isin("python", "python3"), F.lit(False)), "command").when(~limits, "limitations").when(F.col("artifacts_").isNull(), "no artifacts")
        .when(F.col("fault") == 1, "path leaves its root").when(F.col("fault") == 2, "digest").when(F.col("fault") == 3, "artifact missing").when(F.col("fault") == 4, "checksum").otherwise("ok")
    )
    return rows.select(key, "id", state.alias("state"))
