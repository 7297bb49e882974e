"""Detection and evidence of whole scenes in two passes over the cube.

A task needs the limits and the column bias of its own scenes only.  They are
written as a small table in folders by scene bucket, and a task looks up the
scenes its batch holds; so spectra meet them without any exchange, however many
scenes there are.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..functions import kernels as K, spectral as S
from ..session import scratch_folder

#: Scenes a task remembers; a batch of a cube holds one or two.
REMEMBERED = 8
SCENES_PER_BUCKET = 64


class SceneTable:
    """Rows of a scene, read by tasks from ``folder/_bucket=N``; pickled as a path."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self._kept: OrderedDict[str, pa.Table] = OrderedDict()

    def __reduce__(self):
        return SceneTable, (self.folder, self.buckets)

    def of(self, scene: str) -> pa.Table:
        if scene not in self._kept:
            uri = f"{self.folder}/_bucket={zlib.crc32(scene.encode()) % self.buckets}"
            store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
            if store.get_file_info(path).type == fs.FileType.NotFound:
                return pa.table({})
            self._kept[scene] = ds.dataset(path, filesystem=store, format="parquet").to_table(filter=ds.field("scene_id") == scene)
            while len(self._kept) > REMEMBERED:
                self._kept.popitem(last=False)
        return self._kept[scene]


def scene_table(df: DataFrame, scenes: int) -> SceneTable:
    """Write ``df(scene_id, ...)`` for lookups by scene."""
    buckets = max(1, scenes // SCENES_PER_BUCKET)
    folder = scratch_folder(df.sparkSession, "scenes")
    bucket = F.pmod(F.crc32("scene_id"), F.lit(buckets)).alias("_bucket")
    df.select("*", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    return SceneTable(folder, buckets)


def _scenes(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for code, scene in enumerate(coded.dictionary.to_pylist()):
        yield scene, np.flatnonzero(codes == code)


class Detector:
    """Smoothed, column-corrected spectra and their smallest angle to every group's references."""

    def __init__(self, groups: dict[int, dict], bands: int, bias: SceneTable | None, strength: float):
        self.numbers, self.bias, self.strength = list(groups), bias, strength
        self.smoothing = K.taps_matrix(bands, S._clamped_taps(bands, S.smoothing_weights(11, 2)))
        self.plans = [(list(g["detect"]), K._units(np.asarray(g["references"], float)[:, list(g["detect"])]).T) for g in groups.values()]

    def smooth(self, batch: pa.RecordBatch) -> np.ndarray:
        return K._matrix(batch.column("spectrum")) @ self.smoothing

    def scores(self, batch: pa.RecordBatch, smooth: np.ndarray) -> np.ndarray:
        corrected = smooth
        if self.bias is not None:
            corrected = smooth.copy()
            sample = batch.column("sample").to_numpy()
            for scene, rows in _scenes(batch.column("scene_id")):
                known = self.bias.of(scene)
                if known.num_rows:
                    at = known.column("sample").to_numpy()
                    offset = np.zeros((max(int(at.max()), int(sample[rows].max())) + 1, smooth.shape[1]))
                    offset[at] = K._matrix(known.column("bias").combine_chunks())
                    corrected[rows] -= self.strength * offset[sample[rows]]
        out = np.full((len(smooth), len(self.plans)), np.nan)
        for g, (at, directions) in enumerate(self.plans):
            cosine = np.clip(K._units(corrected[:, at]) @ directions, -1.0, 1.0)
            with np.errstate(invalid="ignore"):
                out[:, g] = np.arccos(np.fmax.reduce(cosine, axis=1))
        return out


def detection_scores(pixels: DataFrame, detector: Detector, level_band: int) -> DataFrame:
    """``scene_id, line, sample, level, scores``: all that thresholds need, one narrow row per pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                level = K._matrix(batch.column("spectrum"))[:, level_band]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("scene_id", "line", "sample")), pa.array(level, mask=~np.isfinite(level)),
                     K._lists(detector.scores(batch, detector.smooth(batch)))], names=["scene_id", "line", "sample", "level", "scores"])

    return pixels.select("scene_id", "line", "sample", "spectrum").mapInArrow(
        run, "scene_id string, line int, sample int, level double, scores array<double>")


def candidate_evidence(pixels: DataFrame, detector: Detector, limits: SceneTable, policies: Sequence[str], level_band: int,
                       plans: dict[int, Callable], width: int) -> DataFrame:
    """One row per pixel and group within a limit of any policy, with its evidence.

    ``limits`` holds scene_id, group_no, sample, limits (one per policy) and
    top (the scene's saturation level); ``plans`` maps a group to a function
    from smoothed spectra to depths and distances.
    """
    kinds = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            smooth = detector.smooth(batch)
            scores = detector.scores(batch, smooth)
            sample = batch.column("sample").to_numpy()
            bound = np.full((batch.num_rows, len(detector.numbers), len(policies)), -np.inf)
            top = np.full(batch.num_rows, np.inf)
            for scene, rows in _scenes(batch.column("scene_id")):
                known = limits.of(scene)
                if not known.num_rows:
                    continue
                at, group = known.column("sample").to_numpy(), known.column("group_no").to_numpy()
                dense = np.full((max(int(at.max()), int(sample[rows].max())) + 1, len(detector.numbers), len(policies)), -np.inf)
                dense[at, np.searchsorted(detector.numbers, group)] = np.nan_to_num(K._matrix(known.column("limits").combine_chunks()), nan=-np.inf)
                bound[rows] = dense[sample[rows]]
                top[rows] = np.nan_to_num(known.column("top").to_numpy().astype(float)[0], nan=np.inf)
            with np.errstate(invalid="ignore"):
                passed = scores[:, :, None] <= bound
                saturated = K._matrix(batch.column("spectrum"))[:, level_band] >= top
            for g, number in enumerate(detector.numbers):
                rows = np.flatnonzero(passed[:, g].any(axis=1))
                if not len(rows):
                    continue
                depth, found = plans[number](smooth[rows])
                distances = np.full((len(rows), width), np.nan)
                distances[:, : found.shape[1]] = found
                named = [[p for p, ok in zip(policies, row) if ok] for row in passed[rows, g].tolist()]
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(taken) for c in ("scene_id", "line", "sample")), pa.array(np.full(len(rows), number, np.int32)),
                     pa.array(scores[rows, g]), pa.array(named, kinds), pa.array(saturated[rows]), pa.array(depth, mask=~np.isfinite(depth)), K._lists(distances)],
                    names=["scene_id", "line", "sample", "group_no", "score", "policies", "saturated", "depth", "distances"])

    return pixels.select("scene_id", "line", "sample", "spectrum").mapInArrow(
        run, "scene_id string, line int, sample int, group_no int, score double, policies array<string>, saturated boolean, depth double, distances array<double>")
