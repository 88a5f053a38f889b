"""ENVI cubes as a Spark data source: ``spark.read.format("envi").load(header)``."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: ENVI's codes of number types.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
REQUIRED = ("samples", "lines", "bands", "data type", "interleave", "byte order")


@dataclass(frozen=True)
class Header:
    fields: dict[str, str]
    comments: dict[str, str] = field(default_factory=dict)

    def number(self, name: str, default: int | None = None) -> int:
        if name not in self.fields and default is not None:
            return default
        return int(self.fields[name])

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.number("lines"), self.number("samples"), self.number("bands")

    @property
    def dtype(self) -> np.dtype:
        code = self.number("data type")
        if code not in DTYPES:
            raise ValueError(f"unknown data type {code}")
        return np.dtype((">" if self.number("byte order") else "<") + DTYPES[code])

    @property
    def interleave(self) -> str:
        return self.fields["interleave"].strip().lower()

    @property
    def wavelengths(self) -> list[float] | None:
        text = self.fields.get("wavelength")
        return None if text is None else [float(v) for v in re.split(r"[,\s]+", text.strip(" {}\n\r\t")) if v]


def _bare(value: str) -> str:
    """A value without the braces around it."""
    value = value.strip()
    return value[1 : value.index("}")].strip() if value.startswith("{") and "}" in value else value


def parse_header(text: str) -> Header:
    """Header of ``name = value`` lines, values in braces over several lines, comments after ``;``."""
    if not text.lstrip().upper().startswith("ENVI"):
        raise ValueError("not an ENVI header")
    fields: dict[str, str] = {}
    comments: dict[str, str] = {}
    open_name, parts = None, []
    for line in text.splitlines()[1:]:
        if open_name is not None:
            parts.append(line)
            if "}" in line:
                fields[open_name], open_name = _bare("\n".join(parts)), None
            continue
        bare = line.strip()
        if not bare:
            continue
        where = comments if bare.startswith(";") else fields
        name, sep, value = bare.lstrip("; ").partition("=")
        if not sep:
            continue
        name, value = name.strip().lower(), value.strip()
        if where is fields and "{" in value and "}" not in value:
            open_name, parts = name, [value]
        else:
            where[name] = _bare(value) if where is fields else value
    if open_name is not None:
        raise ValueError(f"the braces of {open_name} never close")
    header = Header(fields, comments)
    missing = [n for n in REQUIRED if n not in fields]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if header.interleave not in ("bsq", "bil", "bip"):
        raise ValueError(f"unknown interleave {header.interleave}")
    wl = header.wavelengths
    if wl is not None and len(wl) != header.number("bands"):
        raise ValueError("as many wavelengths as bands are needed")
    return header


def binary_of(header_path: str) -> Path:
    """The one file in the header's folder that shares its name up to the ending, as the format pairs
    them: ``a.hdr`` or ``a.img.hdr`` beside ``a`` or ``a.img``. Of several the one that a second ending
    in the header's own name asks for, else there must be only one."""
    header = Path(header_path)
    asked = header.name[: -len(header.suffix)]
    beside = sorted(p for p in header.parent.iterdir() if p.is_file() and p != header and p.suffix.lower() not in (".hdr", ".txt", ".json", ".xml", ".png"))
    found = [p for p in beside if p.name == asked] or [p for p in beside if p.stem == asked]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} binaries beside {header_path}")
    return found[0]


class _Lines(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class EnviReader(DataSourceReader):
    """Reads the lines, samples and bands that are asked for and no other bytes of the cube."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.header = parse_header(Path(self.path).read_text())
        self.binary = options.get("binary") or str(binary_of(self.path))
        self.parts = int(options.get("partitions", "8"))
        lines, samples, bands = self.header.shape
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else list(range(bands))
        if any(not 0 <= b < bands for b in self.bands):
            raise ValueError(f"bands are from 0 to {bands - 1}")
        self.ranges = {"y": (0, lines), "x": (0, samples)}
        if options.get("strict", "true").lower() == "true":
            want = int(np.prod(self.header.shape)) * self.header.dtype.itemsize + self.header.number("header offset", 0)
            if Path(self.binary).stat().st_size != want:
                raise ValueError(f"{self.binary} should have {want} bytes")

    def partitions(self):
        first, last = self.ranges["y"]
        step = max(1, -(-(last - first) // self.parts))
        return [_Lines(a, min(last, a + step)) for a in range(first, last, step)] or [_Lines(first, first)]

    def _line(self, file, y: int) -> np.ndarray:
        """Samples by bands of one line."""
        h, (lines, samples, bands) = self.header, self.header.shape
        left, right = self.ranges["x"]
        start, item = h.number("header offset", 0), h.dtype.itemsize

        def values(at: int, count: int) -> np.ndarray:
            file.seek(start + at * item)
            return np.frombuffer(file.read(count * item), h.dtype)

        if h.interleave == "bip":
            return values((y * samples + left) * bands, (right - left) * bands).reshape(-1, bands)[:, self.bands]
        place = (lambda b: (b * lines + y) * samples) if h.interleave == "bsq" else (lambda b: (y * bands + b) * samples)
        return np.stack([values(place(b) + left, right - left) for b in self.bands], 1)

    def read(self, part):
        samples, (left, right) = self.header.shape[1], self.ranges["x"]
        if left >= right or part.first >= part.last:
            return
        x = np.arange(left, right)
        with open(self.binary, "rb") as file:
            for y in range(part.first, part.last):
                flat = pa.array(np.ascontiguousarray(self._line(file, y), float).ravel())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(self.bands))
                yield pa.RecordBatch.from_arrays([pa.array(x + y * samples), pa.array(np.full(len(x), y, np.int32)), pa.array(x.astype(np.int32)), pa.ListArray.from_arrays(ends, flat)], names=["pixel_id", "y", "x", "spectrum"])


class PruningEnviReader(EnviReader):
    """Spark refuses a reader that takes filters unless it is set to offer them."""

    def pushFilters(self, filters):
        """Comparisons of y and x with numbers narrow what is read. All filters are left to Spark, too."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name in self.ranges:
                low, high = self.ranges[name]
                if isinstance(f, In) and f.value and all(v is not None for v in f.value):
                    low, high = max(low, math.ceil(min(f.value))), min(high, math.floor(max(f.value)) + 1)
                elif isinstance(value, (int, float)) and math.isfinite(value):
                    if isinstance(f, (EqualTo, EqualNullSafe, GreaterThanOrEqual)):
                        low = max(low, math.ceil(value))
                    elif isinstance(f, GreaterThan):
                        low = max(low, math.floor(value) + 1)
                    if isinstance(f, (EqualTo, EqualNullSafe, LessThanOrEqual)):
                        high = min(high, math.floor(value) + 1)
                    elif isinstance(f, LessThan):
                        high = min(high, math.ceil(value))
                self.ranges[name] = low, max(low, high)
            yield f


class EnviSource(DataSource):
    """Options: ``path`` (the header), ``binary``, ``partitions``, ``strict`` and ``bands`` (numbers from 0,
    with commas; all if there are none), and ``pruning``: with it, and with
    ``spark.sql.python.filterPushdown.enabled`` set, filters on y and x choose what is read. Paths are those of a file system that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return "pixel_id long, y int, x int, spectrum array<double>"

    def reader(self, schema):
        return (PruningEnviReader if self.options.get("pruning", "false").lower() == "true" else EnviReader)(self.options)


def load_cube(spark, header: str, **options):
    """The pixels of a cube; filters on y and x choose what is read where Spark is set to offer them."""
    spark.dataSource.register(EnviSource)
    offered = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("envi").options(pruning=offered, **options).load(header)


def load_normalised(spark, header: str, scene: str = "scene", **options):
    """The pixels of a cube under one scene id, scaled to 0 to 1."""
    from pyspark.sql import functions as F

    pixels = load_cube(spark, header, **options)
    return normalise(pixels.select(F.lit(scene).alias("scene_id"), "*"))


def normalise(pixels):
    """All values moved and scaled to 0 to 1 over the whole cube."""
    from pyspark.sql import functions as F

    low, high = pixels.agg(F.min(F.array_min("spectrum")), F.max(F.array_max("spectrum"))).first()
    scale = (high - low) or 1.0
    return pixels.withColumn("spectrum", F.transform("spectrum", lambda v: (v - F.lit(low)) / F.lit(scale)))
