"""Class maps, tables and reports to storage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .cubes import located, put

#: What a task holds of a file while it digests it.
PIECE_BYTES = 4 << 20


def write_class_maps(maps: DataFrame, folder: str, masked: DataFrame | None = None, classes: int | None = None) -> None:
    """Sparse class maps, laid out so a crop reads only its own files.

    With ``masked`` (scene_id, line, sample), pixels outside the material are
    written to every policy's map as class ``classes`` + 1.
    """
    if masked is not None:
        policies = maps.select("scene_id", "policy").distinct()
        grey = masked.select("scene_id", "line", "sample").join(policies, "scene_id").withColumn("class_id", F.lit(classes + 1))
        maps = maps.unionByName(grey, allowMissingColumns=True)
    blocked = maps.withColumn("line_block", F.floor(F.col("line") / 512).cast("int"))
    (
        blocked.repartition("scene_id", "policy", "line_block")
        .write.mode("overwrite").partitionBy("scene_id", "policy").parquet(folder)
    )


def class_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``class_id, class_name, red, green, blue``: background, the classes and the masked pixels."""
    called = ["background", *names, "masked"]
    return spark.createDataFrame([(i, called[i], r, g, b) for i, r, g, b in palette(len(names))], "class_id int, class_name string, red int, green int, blue int")


def read_class_maps(spark: SparkSession, folder: str, classes: DataFrame | None = None) -> DataFrame:
    """Rows of the maps, with the columns of a ``class_table``; it has one row per class of a map."""
    rows = spark.read.parquet(folder)
    return rows if classes is None else rows.join(F.broadcast(classes), "class_id", "left")


def palette(count: int) -> list[tuple[int, int, int, int]]:
    """Class colours: black, evenly spaced hues, grey for masked pixels."""
    import colorsys

    rows = [(0, 0, 0, 0)]
    for i in range(1, count + 1):
        r, g, b = colorsys.hsv_to_rgb((i - 1) / max(count, 1), 0.75, 0.95)
        rows.append((i, round(r * 255), round(g * 255), round(b * 255)))
    rows.append((count + 1, 96, 96, 96))
    return rows


def write_candidates(candidates: DataFrame, folder: str, selected: DataFrame | None = None) -> None:
    """Library audit: all candidates with their reasons, and the spectra of the ``selected`` ones.

    Parquet for machines, JSON lines without the spectra for people.
    """
    audit = candidates.drop("values", "wavelengths")
    candidates.write.mode("overwrite").parquet(f"{folder}/candidates")
    audit.write.mode("overwrite").json(f"{folder}/audit")
    if selected is not None:
        selected.write.mode("overwrite").parquet(f"{folder}/selected")


def write_counts(counts: DataFrame, folder: str) -> None:
    counts.write.mode("overwrite").option("header", True).csv(folder)


def json_report(rows: DataFrame, *columns: str):
    return rows.select(F.to_json(F.struct(*columns)).alias("report"))


def write_texts(rows: DataFrame) -> DataFrame:
    """``rows(path, body)`` as one text file each; returns the paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
                put(path, (body or "").encode())
            yield batch.select(["path"])

    return rows.select("path", "body").mapInArrow(write, "path string")


def fingerprints(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``path, bytes, modified, sha256, error`` of every row of ``files(path)``, folders with all files below them.

    A task reads a file in pieces and holds one piece, so a file of any length
    has a digest.  What cannot be read is a row with its error.
    """
    kinds = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("sha256", pa.string()), ("error", pa.string())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = [path]
                try:
                    store, inner = located(path)
                    if store.get_file_info(inner).type == fs.FileType.Directory:
                        prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
                        found = [prefix + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
                except (OSError, ValueError, TypeError, AttributeError):
                    pass  # the reading task says what is wrong with it
                for start in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(found[start : start + 4096], pa.string())], names=["path"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                row = {"path": path, "bytes": None, "modified": None, "sha256": None, "error": None}
                try:
                    store, inner = located(path)
                    info = store.get_file_info(inner)
                    row["bytes"], row["modified"] = info.size, info.mtime
                    digest = hashlib.sha256()
                    with store.open_input_stream(inner) as stream:
                        while piece := stream.read(PIECE_BYTES):
                            digest.update(piece)
                    row["sha256"] = digest.hexdigest()
                except (OSError, ValueError, TypeError, AttributeError) as error:
                    row["error"] = f"{type(error).__name__}: {error}".split("\n")[0]
                yield pa.RecordBatch.from_pylist([row], kinds)

    single = files.select(F.col("path").cast("string").alias("path")).mapInArrow(listed, "path string")
    return single.repartition("path").mapInArrow(digested, "path string, bytes long, modified timestamp, sha256 string, error string")
