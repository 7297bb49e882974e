"""Raster cubes and binary spectral libraries as a Spark data source.

``spark.read.format("raster_cube")`` lists the headers of a folder and gives
every block of scan lines its own partition; a task opens the flat file and
reads no other bytes than those of its lines and bands.  What it hands over are
Arrow batches.  ``write_cubes`` and ``write_libraries`` are the matching sinks.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from .rasters import DATA_TYPES

CUBE = "scene_id string, line int, sample int, spectrum array<double>"
LIBRARY = "source_id string, source_index int, raw_name string, wavelengths array<double>, values array<double>"
#: Bytes of a partition, if its lines allow it.
BLOCK_BYTES = 16 << 20
#: Endings of the flat file beside a header (fixed values).
ENDINGS = ("", ".dat", ".img", ".raw", ".bin", ".bil", ".bip", ".bsq", ".sli", ".lib")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or local path, and the path in it."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def parse_header(text: str) -> dict[str, str]:
    """``key = value`` pairs, values in braces over any lines; the last of repeated keys wins."""
    pairs = re.findall(r"(?m)^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def listed(value: str | None) -> list[str]:
    return [x.strip() for x in value.strip().strip("{}").split(",") if x.strip()] if value else []


def nanometres(header: dict[str, str]) -> list[float] | None:
    """Wavelengths in nm: micrometre values are scaled, whatever unit a header claims for plain nm values."""
    axis = [float(x) for x in listed(header.get("wavelength"))]
    units = header.get("wavelength units", "").lower()
    if not axis:
        return None
    top = max(axis)
    return [x * 1000.0 for x in axis] if top <= 20 or ("micro" in units and top <= 100) else axis


@dataclass
class Layout(InputPartition):
    """Where the lines ``start`` to ``stop`` of one file lie, and which bands of them are wanted."""

    uri: str
    name: str
    lines: int
    samples: int
    bands: int
    offset: int
    kind: str
    interleave: str
    first_line: int
    start: int
    stop: int
    wanted: list[int]
    header: dict[str, str]

    def __init__(self, uri: str, header: dict[str, str]):
        number = lambda key, default=None: int(header.get(key, default))
        missing = [k for k in ("samples", "lines", "bands", "data type", "interleave") if k not in header]
        if missing:
            raise ValueError(f"{uri}: header lacks {missing}")
        self.uri, self.name, self.header = uri, uri.rsplit("/", 1)[-1].rsplit(".", 1)[0], header
        self.lines, self.samples, self.bands = number("lines"), number("samples"), number("bands")
        self.offset, self.first_line = number("header offset", 0), number("y start", 0)
        if number("data type") not in DATA_TYPES:
            raise ValueError(f"{uri}: data type {header['data type']} is not supported")
        self.kind = (">" if number("byte order", 0) == 1 else "<") + DATA_TYPES[number("data type")]
        self.interleave = header["interleave"].lower()
        if self.interleave not in ("bip", "bil", "bsq"):
            raise ValueError(f"{uri}: interleave {self.interleave} is not supported")
        axis = nanometres(header)
        if axis is not None and len(axis) not in (self.bands, self.samples):
            raise ValueError(f"{uri}: {len(axis)} wavelengths for {self.bands} bands")
        self.start, self.stop, self.wanted = 0, self.lines, list(range(self.bands))

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def part(self, start: int, stop: int, wanted: Sequence[int]) -> Layout:
        out = object.__new__(Layout)
        out.__dict__.update(self.__dict__, start=start, stop=stop, wanted=list(wanted))
        return out

    def reads(self) -> list[tuple[int, int]]:
        """``(place, bytes)`` of the stretches that hold the wanted values, in the order they are decoded in."""
        w, row = self.width, self.samples * self.width
        runs = _runs(self.wanted)
        if self.interleave == "bip":  # a pixel's bands lie together, so its lines are read whole
            return [(self.offset + self.start * row * self.bands, (self.stop - self.start) * row * self.bands)]
        if self.interleave == "bil":
            if len(self.wanted) == self.bands:
                return [(self.offset + self.start * row * self.bands, (self.stop - self.start) * row * self.bands)]
            return [(self.offset + (line * self.bands + a) * row, (b - a) * row) for line in range(self.start, self.stop) for a, b in runs]
        if self.start == 0 and self.stop == self.lines:
            return [(self.offset + a * self.lines * row, (b - a) * self.lines * row) for a, b in runs]
        return [(self.offset + (band * self.lines + self.start) * self.samples * w, (self.stop - self.start) * row) for band in self.wanted]

    def values(self, handle) -> np.ndarray:
        """``lines x samples x wanted bands`` of this part."""
        raw = bytearray()
        for place, size in self.reads():
            handle.seek(place)
            got = handle.read(size)
            if len(got) != size:
                raise ValueError(f"{self.uri}: {size} bytes wanted at {place}, {len(got)} found")
            raw += got
        flat, lines = np.frombuffer(bytes(raw), self.kind), self.stop - self.start
        if self.interleave == "bip":
            return flat.reshape(lines, self.samples, self.bands)[:, :, self.wanted]
        if self.interleave == "bil":
            return flat.reshape(lines, len(self.wanted), self.samples).transpose(0, 2, 1)
        return flat.reshape(len(self.wanted), lines, self.samples).transpose(1, 2, 0)


def _runs(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Neighbouring numbers together as ``[first, last)``."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n:
            out[-1] = (out[-1][0], n + 1)
        else:
            out.append((n, n + 1))
    return out


def layouts(folder: str) -> list[Layout]:
    """Every cube and library whose header lies under ``folder``; a file of the wrong length is refused."""
    store, path = located(folder)
    found = {f.path: f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file}

    def one(header_path: str) -> Layout:
        with store.open_input_file(header_path) as handle:
            header = parse_header(handle.read().decode("utf-8", "replace"))
        base = header_path[: -len(".hdr")]
        data = next((base + e for e in ENDINGS if base + e in found), None)
        if data is None:
            raise ValueError(f"{header_path}: no data file beside it")
        prefix = folder.split("://", 1)[0] + "://" if "://" in folder else ""
        layout = Layout(prefix + data, header)
        expected = layout.offset + layout.lines * layout.samples * layout.bands * layout.width
        if found[data].size != expected:
            raise ValueError(f"{data}: {found[data].size} bytes, its header says {expected}")
        return layout

    headers = sorted(p for p in found if p.lower().endswith(".hdr"))
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, headers))


def _present(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values, dtype=np.float64).reshape(-1)
    return pa.array(flat, mask=~np.isfinite(flat))


class CubeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], library: bool):
        self.library = library
        self.folder = options["path"]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.block_bytes = int(options.get("blockbytes", BLOCK_BYTES))
        self.first, self.last = int(options.get("firstline", 0)), int(options.get("lastline", (1 << 31) - 1))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for layout in layouts(self.folder):
            if self.library != ("spectral library" in layout.header.get("file type", "").lower()):
                continue
            if self.library:
                if layout.interleave != "bsq" or layout.bands != 1 or len(nanometres(layout.header) or []) != layout.samples:
                    raise ValueError(f"{layout.uri}: a library is one band by band plane with a wavelength for each column")
                wanted = [0]
            else:
                wanted = list(range(layout.bands)) if self.bands is None else self.bands
                if wanted and not 0 <= min(wanted) <= max(wanted) < layout.bands:
                    raise ValueError(f"{layout.uri}: bands {wanted} of {layout.bands}")
            low, high = max(self.first - layout.first_line, 0), min(self.last + 1 - layout.first_line, layout.lines)
            step = max(1, self.block_bytes // max(1, layout.samples * len(wanted) * layout.width))
            out += [layout.part(s, min(s + step, high), wanted) for s in range(low, high, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, path = located(partition.uri)
        with store.open_input_file(path) as handle:
            cube = partition.values(handle)
        yield (self._spectra if self.library else self._pixels)(partition, cube)

    @staticmethod
    def _pixels(at: Layout, cube: np.ndarray) -> pa.RecordBatch:
        lines, samples, bands = cube.shape
        n = lines * samples
        place = np.arange(n)
        spectra = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(bands)), _present(cube))
        return pa.RecordBatch.from_arrays([
            pa.array([at.header.get("scene", at.name)] * n, pa.string()), pa.array((place // samples + at.start + at.first_line).astype(np.int32)),
            pa.array((place % samples).astype(np.int32)), spectra], names=["scene_id", "line", "sample", "spectrum"])

    @staticmethod
    def _spectra(at: Layout, cube: np.ndarray) -> pa.RecordBatch:
        spectra = cube[:, :, 0]
        n, width = spectra.shape
        names = listed(at.header.get("spectra names"))
        if len(names) != at.lines:
            names = [f"Spectrum {i + 1}" for i in range(at.lines)]
        axis = nanometres(at.header)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width))
        return pa.RecordBatch.from_arrays([
            pa.array([at.name] * n, pa.string()), pa.array(np.arange(at.start, at.stop, dtype=np.int32)), pa.array(names[at.start : at.stop], pa.string()),
            pa.ListArray.from_arrays(ends, pa.array(np.tile(axis, n))), pa.ListArray.from_arrays(ends, _present(spectra))],
            names=["source_id", "source_index", "raw_name", "wavelengths", "values"])


class FilteringCubeReader(CubeReader):
    """Takes comparisons of ``line`` with constants into the choice of line blocks."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            on_line = getattr(f, "attribute", None) == ("line",) and isinstance(getattr(f, "value", None), int)
            if on_line and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if on_line and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            if not (on_line and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                yield f


class RasterCube(DataSource):
    """Options: ``path``; ``bands`` as numbers with commas; ``firstLine``, ``lastLine``; ``blockBytes``; ``pushdown``."""

    library = False

    @classmethod
    def name(cls) -> str:
        return "raster_cube"

    def schema(self) -> str:
        return LIBRARY if self.library else CUBE

    def reader(self, schema) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringCubeReader if options.get("pushdown") == "true" else CubeReader)(options, self.library)


class SpectralLibrary(RasterCube):
    library = True

    @classmethod
    def name(cls) -> str:
        return "spectral_library"


def _reader(spark: SparkSession, kind: type[DataSource], folder: str, options: dict[str, object]) -> DataFrame:
    spark.dataSource.register(kind)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(kind.name()).options(path=folder, pushdown=push, **options).load()


def read_cubes(spark: SparkSession, folder: str, bands: Sequence[int] | None = None, first_line: int | None = None,
               last_line: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pixels of every cube under ``folder``, with the given bands in the given order.

    NaN and infinities are NULL.  Line ranges cut the files that are opened,
    also as filters on ``line`` where the session lets Python sources take them
    (``spark.sql.python.filterPushdown.enabled``).
    """
    options = {"bands": ",".join(map(str, bands)) if bands is not None else None, "firstLine": first_line, "lastLine": last_line, "blockBytes": block_bytes}
    return _reader(spark, RasterCube, folder, {k: v for k, v in options.items() if v is not None})


def read_libraries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per spectrum of every binary library under ``folder``; missing names become ``Spectrum i``."""
    return _reader(spark, SpectralLibrary, folder, {})


def put(uri: str, content: bytes) -> None:
    """A file that appears whole or not at all, so a repeated attempt is harmless."""
    store, path = located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)


def _header(values: dict[str, object]) -> bytes:
    return ("ENVI\n" + "".join(f"{k} = {v}\n" for k, v in values.items())).encode()


def write_cubes(pixels: DataFrame, folder: str, interleave: str = "bil", block_lines: int = 64, big_endian: bool = False) -> DataFrame:
    """``pixels(scene_id, line, sample, spectrum)`` as cube files of up to ``block_lines`` lines; returns one row per file.

    A scene of any length is many small files, each written by one task; a
    file's header says where its lines start.  Cells without a pixel hold NaN.
    ``interleave`` is bip, bil or bsq, or a column of ``pixels`` that says it.
    """
    kind = F.col(interleave) if interleave in pixels.columns else F.lit(interleave)
    code = ">f8" if big_endian else "<f8"

    def write(group: pa.Table) -> pa.Table:
        scene, block, order = (group.column(c)[0].as_py() for c in ("scene_id", "block", "_order"))
        line, sample = (group.column(c).to_numpy() for c in ("line", "sample"))
        spectra = group.column("spectrum").combine_chunks()
        sizes = np.diff(spectra.offsets.to_numpy())
        first, bands = int(line.min()), int(sizes.max(initial=0))
        cube = np.full((int(line.max()) - first + 1, int(sample.max()) + 1, bands), np.nan)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cube[np.repeat(line - first, sizes), np.repeat(sample, sizes), within] = spectra.flatten().to_numpy(zero_copy_only=False)
        axes = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[order]
        out = io.BytesIO()
        out.write(np.ascontiguousarray(cube.transpose(axes)).astype(code).tobytes())
        name = f"{folder}/{order}-{scene}-{block}"
        put(f"{name}.dat", out.getvalue())
        put(f"{name}.hdr", _header({
            "samples": cube.shape[1], "lines": cube.shape[0], "bands": bands, "data type": 5, "interleave": order, "byte order": int(big_endian),
            "header offset": 0, "y start": first, "scene": scene}))
        return pa.table({"file": [f"{name}.dat"], "pixels": [group.num_rows]})

    placed = pixels.select("scene_id", "line", "sample", "spectrum", kind.alias("_order"), F.floor(F.col("line") / block_lines).alias("block"))
    return placed.groupBy("scene_id", "block").applyInArrow(write, "file string, pixels long")


def write_libraries(rows: DataFrame, folder: str) -> DataFrame:
    """``rows(source_id, names, wavelengths, spectra)`` as one binary library each; returns one row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for row in batch.to_pylist():
                spectra = np.array([[np.nan if x is None else x for x in s] for s in row["spectra"]], "<f8").reshape(len(row["spectra"]), -1)
                name = f"{folder}/{row['source_id']}"
                text = {"samples": spectra.shape[1], "lines": spectra.shape[0], "bands": 1, "data type": 5, "interleave": "bsq", "byte order": 0,
                        "file type": "ENVI Spectral Library", "wavelength units": "Nanometers", "wavelength": "{" + ", ".join(map(repr, row["wavelengths"])) + "}"}
                if row["names"]:
                    text["spectra names"] = "{" + ",\n ".join(row["names"]) + "}"
                put(f"{name}.sli", spectra.tobytes())
                put(f"{name}.hdr", _header(text))
                files.append(f"{name}.sli")
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return rows.select(F.col("source_id").cast("string").alias("source_id"), "names", "wavelengths", "spectra").mapInArrow(write, "file string")
