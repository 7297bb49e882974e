"""Arrow-batched numeric kernels for wide scenes.

Each kernel sees one Arrow batch of spectra as a matrix and agrees with the
expression form in ``spectral``.  The reference library it closes over is
configuration-sized and checked by ``collect_bounded`` before it is shipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import spectral as S

DOUBLES = T.ArrayType(T.DoubleType())


def _matrix(batch: pa.Array) -> np.ndarray:
    """Batch of arrays as rows; a NULL row is NaN, and so is what a shorter row lacks."""
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (sizes == width).all():
        return values.reshape(len(batch), width)
    out = np.full((len(batch), width), np.nan)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = values
    return out


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    flat = np.ascontiguousarray(values).ravel()
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat, mask=~np.isfinite(flat), type=pa.float64())
    )


def _units(values: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, length, out=np.full_like(values, np.nan), where=length > 0)


def taps_matrix(bands: int, taps: Sequence[Sequence[tuple[int, float]]]) -> np.ndarray:
    out = np.zeros((bands, len(taps)))
    for column, row in enumerate(taps):
        for position, weight in row:
            out[position, column] += weight
    return out


def angles_to(references: Sequence[Sequence[float]], positions: Sequence[int] | None = None):
    """Spectral angle to every reference, in library order."""
    library = np.asarray(references, dtype=np.float64)
    if positions is not None:
        library = library[:, positions]
    directions = _units(library).T

    @arrow_udf(DOUBLES)
    def kernel(spectra: pa.Array) -> pa.Array:
        pixels = _matrix(spectra)
        if positions is not None and len(pixels):
            pixels = pixels[:, positions]
        cosine = _units(pixels) @ directions if len(pixels) else np.empty((0, directions.shape[1]))
        return _lists(np.arccos(np.clip(cosine, -1.0, 1.0)))

    return kernel


def smooth(bands: int, window: int = 11, order: int = 2):
    weights = taps_matrix(bands, S._clamped_taps(bands, S.smoothing_weights(window, order)))

    @arrow_udf(DOUBLES)
    def kernel(spectra: pa.Array) -> pa.Array:
        return _lists(_matrix(spectra) @ weights) if len(spectra) else _lists(np.empty((0, bands)))

    return kernel


class SegmentLine:
    """Straight lines between the ends of every axis segment, as one matrix applied to all spectra."""

    def __init__(self, axis: np.ndarray):
        self.ends = np.zeros((len(axis), len(axis)))
        for first, stop in S.axis_segments(axis):
            last, here = stop - 1, np.arange(first, stop)
            rise = (axis[here] - axis[first]) / max(axis[last] - axis[first], np.finfo(float).tiny)
            np.add.at(self.ends, (first, here), 1.0 - rise)
            np.add.at(self.ends, (last, here), rise)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        usable = (np.isfinite(values) & (values > 0)).all(axis=1, keepdims=True)
        safe = np.where(usable, values, 1.0)
        return np.where(usable, safe / (safe @ self.ends), np.nan)


def _hull(values: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Upper hull of every row at once: walk from each hull point to the
    steepest chord, so the loop runs over hull points, not over pixels."""
    out = np.full_like(values, np.nan)
    good = np.flatnonzero(np.all(np.isfinite(values) & (values > 0), axis=1))
    if not len(good):
        return out
    y = values[good]
    line = np.empty_like(y)
    line[:, 0] = y[:, 0]
    at = np.zeros(len(good), dtype=int)
    bands = np.arange(len(axis))
    alive = np.flatnonzero(at < len(axis) - 1)
    while len(alive):
        here = at[alive]
        ahead = bands[None, :] > here[:, None]
        run = np.where(ahead, axis[None, :] - axis[here][:, None], 1.0)
        slope = np.where(ahead, (y[alive] - y[alive, here][:, None]) / run, -np.inf)
        best = slope.max(axis=1)
        nxt = len(axis) - 1 - np.argmax((slope == best[:, None])[:, ::-1], axis=1)
        cover = ahead & (bands[None, :] <= nxt[:, None])
        chord = y[alive, here][:, None] + best[:, None] * (axis[None, :] - axis[here][:, None])
        line[alive] = np.where(cover, chord, line[alive])
        line[alive, nxt] = y[alive, nxt]
        at[alive] = nxt
        alive = alive[nxt < len(axis) - 1]
    out[good] = y / line
    return out


def absorb(axis: Sequence[float], positions: Sequence[int], method: str = "segmented"):
    """Absorption curve over the chosen bands."""
    sub = np.asarray([axis[i] for i in positions], dtype=float)
    remove = SegmentLine(sub) if method == "segmented" else partial(_hull, axis=sub)

    @arrow_udf(DOUBLES)
    def kernel(spectra: pa.Array) -> pa.Array:
        values = _matrix(spectra)
        if not len(values):
            return _lists(np.empty((0, len(positions))))
        return _lists(np.maximum(1.0 - remove(values[:, positions]), 0.0))

    return kernel


class FeaturePlan:
    """All diagnostic features of a table of curves by three reductions over concatenated windows.

    A feature is (position or peak - shift) / span, and a relative one is also divided by the curve's
    own peak; what differs between kinds is kept in vectors, one entry per feature.
    """

    def __init__(self, axis: np.ndarray, definitions: Sequence[dict]):
        bounds = np.array([d["window_nm"] for d in definitions], float).reshape(-1, 2)
        kinds = np.array([d["type"] for d in definitions], dtype=object)
        members = [np.flatnonzero((axis >= lo) & (axis <= hi)) for lo, hi in bounds]
        self.width = len(members)
        self.present = np.array([i for i, m in enumerate(members) if len(m)], int)
        self.bands = np.concatenate([members[i] for i in self.present]) if len(self.present) else np.zeros(0, int)
        sizes = np.array([len(members[i]) for i in self.present], int)
        self.cuts, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.axis = axis[self.bands]
        self.positional, self.relative = kinds[self.present] == "center_nm", kinds[self.present] == "depth_ratio"
        self.shift = np.where(self.positional, bounds[self.present, 0], 0.0)
        self.span = np.where(self.positional, np.maximum(bounds[self.present, 1] - bounds[self.present, 0], 1.0), 1.0)

    def __call__(self, curves: np.ndarray) -> np.ndarray:
        out = np.full((len(curves), self.width), np.nan)
        if len(curves) and len(self.present):
            inside = curves[:, self.bands]
            peak = np.maximum.reduceat(inside, self.cuts, axis=1)
            place = np.minimum.reduceat(np.where(inside == peak[:, self.owner], self.axis, np.inf), self.cuts, axis=1)
            own = np.where(self.relative, np.maximum(curves.max(axis=1, keepdims=True), 1e-12), 1.0)
            out[:, self.present] = (np.where(self.positional, place, peak) - self.shift) / self.span / own
        return out


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(left) @ _units(right).T, -1.0, 1.0))


def _shared_distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Root mean square difference over the columns that both rows have."""
    known = np.isfinite(left)[:, None, :] & np.isfinite(right)[None, :, :]
    gaps = np.where(known, np.nan_to_num(left)[:, None, :] - np.nan_to_num(right)[None, :, :], 0.0)
    count = known.sum(axis=2)
    return np.sqrt(np.divide((gaps**2).sum(axis=2), count, out=np.full(count.shape, np.nan), where=count > 0))


def _unexplained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the best multiple of each right row leaves of a left row, relative to its level."""
    energy = (right**2).sum(axis=1)
    explained = np.divide((left @ right.T) ** 2, energy, out=np.zeros((len(left), len(right))), where=energy > 0)
    rest = np.maximum((left**2).sum(axis=1, keepdims=True) - explained, 0.0)
    level = np.maximum(np.abs(left).mean(axis=1, keepdims=True), 1e-8)
    return np.minimum(np.sqrt(rest / left.shape[1]) / level, np.pi)


def evidence_function(
    references: Sequence[Sequence[float]], axis: Sequence[float], definitions: Sequence[dict], weights: dict
):
    """Matrix function: absorption curves to total distances from every reference.

    Each term is a pair of prepared tables and a distance between them; the total is their weighted
    mean over the terms that are defined for the pair.
    """
    grid, library = np.asarray(axis, dtype=float), np.asarray(references, dtype=float)
    slopes, features = taps_matrix(len(grid), S.gradient_taps(list(grid))), FeaturePlan(grid, definitions)
    terms = {
        "shape": (lambda x: x, _angles), "derivative": (lambda x: x @ slopes, _angles),
        "features": (features, _shared_distance), "fit": (lambda x: x, _unexplained),
    }
    share = {name: w for name, w in (S.DEFAULT_WEIGHTS | dict(weights)).items() if name in terms and w > 0}
    prepared = {name: terms[name][0](library) for name in share}
    scale = np.array(list(share.values()))[:, None, None]

    def totals(pixels: np.ndarray) -> np.ndarray:
        stack = np.stack([terms[name][1](terms[name][0](pixels), prepared[name]) for name in share])
        weight = np.where(np.isfinite(stack), scale, 0.0)
        sums = weight.sum(axis=0)
        return np.divide((np.nan_to_num(stack) * weight).sum(axis=0), sums, out=np.full(sums.shape, np.nan), where=sums > 0)

    return totals


def evidence_to(
    references: Sequence[Sequence[float]], axis: Sequence[float], definitions: Sequence[dict], weights: dict
):
    """Total evidence distance of an absorption curve to every reference curve."""
    totals = evidence_function(references, axis, definitions, weights)
    width = len(references)

    @arrow_udf(DOUBLES)
    def kernel(curves: pa.Array) -> pa.Array:
        pixels = _matrix(curves)
        return _lists(totals(pixels) if len(pixels) else np.empty((0, width)))

    return kernel


EVIDENCE = T.StructType([T.StructField("depth", T.DoubleType()), T.StructField("distances", DOUBLES)])


def evidence_plans(groups: dict[int, dict], axis: Sequence[float]):
    """Per group a function from spectra to their deepest absorption and their distance from every reference."""
    grid = np.asarray(axis, dtype=float)

    def plan(g: dict):
        at = list(g["positions"])
        line = SegmentLine(grid[at])
        totals = evidence_function(np.maximum(1.0 - line(np.asarray(g["references"], dtype=float)[:, at]), 0.0), grid[at], g["features"], g["weights"])

        def judge(spectra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            curves = np.maximum(1.0 - line(spectra[:, at]), 0.0)
            return curves.max(axis=1), totals(curves)

        return judge

    return {number: plan(g) for number, g in groups.items()}


def grouped_evidence(groups: dict[int, dict], axis: Sequence[float]):
    """``(group, spectrum) -> depth and distances`` with one plan per group.

    Rows of a batch are dealt to their group's references, so a pixel is only
    compared with the library it competes in.  Distances are padded with NULL
    to the largest group.
    """
    width = max(len(g["references"]) for g in groups.values())
    plans = evidence_plans(groups, axis)

    @arrow_udf(EVIDENCE)
    def kernel(numbers: pa.Array, spectra: pa.Array) -> pa.Array:
        values = _matrix(spectra)
        chosen = numbers.to_numpy(zero_copy_only=False)
        depth = np.full(len(values), np.nan)
        distances = np.full((len(values), width), np.nan)
        for number, plan in plans.items():
            rows = np.flatnonzero(chosen == number)
            if len(rows):
                depth[rows], found = plan(values[rows])
                distances[rows, : found.shape[1]] = found
        return pa.StructArray.from_arrays(
            [pa.array(depth, mask=~np.isfinite(depth)), _lists(distances)], names=["depth", "distances"])

    return kernel
