"""Per-spectrum maths as column expressions on the ``spectrum`` array.

Axes, windows and filter weights are plan-time constants of a scene, so each
function returns an expression in which only the spectrum varies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from . import arrays as A


# --- band choice ---------------------------------------------------------

def window_positions(
    axis: Sequence[float],
    windows: Sequence[Sequence[float]],
    bad: Sequence[int] = (),
    minimum: int = 1,
) -> list[int]:
    """Bands inside the union of closed windows, without the bad ones."""
    dropped = set(bad)
    chosen = [
        i
        for i, w in enumerate(axis)
        if i not in dropped and any(lo <= w <= hi for lo, hi in windows)
    ]
    if len(chosen) < minimum:
        raise ValueError(f"windows {list(windows)} leave {len(chosen)} bands, {minimum} are needed")
    return chosen


def spread_positions(axis: Sequence[float], maximum: int = 9) -> list[int]:
    """Bands nearest to equally spaced wavelengths, first one on ties."""
    count = min(max(maximum, 3), len(axis))
    if count == len(axis):
        return list(range(count))
    step = (axis[-1] - axis[0]) / (count + 1)
    nearest = (
        min(range(len(axis)), key=lambda i: (abs(axis[i] - (axis[0] + step * k)), i))
        for k in range(1, count + 1)
    )
    return list(dict.fromkeys(nearest))


# --- smoothing -----------------------------------------------------------

def smoothing_weights(window: int, order: int, at: float = 0.0) -> np.ndarray:
    """Least-squares polynomial weights that give the fitted value at offset ``at``."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return np.array([at**k for k in range(order + 1)]) @ np.linalg.pinv(design)


def _clamped_taps(bands: int, weights: np.ndarray) -> list[list[tuple[int, float]]]:
    half = len(weights) // 2
    return [
        [(min(max(i + k - half, 0), bands - 1), w) for k, w in enumerate(weights)]
        for i in range(bands)
    ]


def _end_fitted_taps(bands: int, window: int, order: int) -> list[list[tuple[int, float]]]:
    """Interior weights inside, the end polynomial evaluated off-centre at both ends."""
    half = window // 2
    rows = []
    for i in range(bands):
        first = min(max(i - half, 0), bands - window)
        weights = smoothing_weights(window, order, at=float(i - first - half))
        rows.append([(first + k, w) for k, w in enumerate(weights)])
    return rows


def savgol(spectrum: Column, bands: int, window: int = 11, order: int = 2) -> Column:
    """Savitzky-Golay smoothing with replicated edges."""
    return A.weighted_taps(spectrum, _clamped_taps(bands, smoothing_weights(window, order)))


def savgol_fitted_ends(spectrum: Column, bands: int, window: int, order: int = 2) -> Column:
    return A.weighted_taps(spectrum, _end_fitted_taps(bands, window, order))


def _odd_window(bands: int, wanted: int) -> int:
    value = min(wanted, bands if bands % 2 else bands - 1)
    return value if value % 2 else value - 1


def narrow_absorption(spectrum: Column, bands: int, fine: int = 5, broad: int = 31) -> Column:
    """(broad fit - fine fit) / |broad fit|; NULL unless every band is positive."""
    smooth = savgol_fitted_ends(spectrum, bands, _odd_window(bands, fine))
    base = savgol_fitted_ends(smooth, bands, _odd_window(bands, broad))
    value = F.zip_with(base, smooth, lambda b, s: (b - s) / F.greatest(F.abs(b), F.lit(1e-8)))
    return F.when(A.all_positive(spectrum), value)


def column_corrected(smoothed: Column, bias: Column, strength: float = 0.70) -> Column:
    """Take a share of the detector-column bias off a smoothed spectrum."""
    return F.zip_with(smoothed, bias, lambda s, b: s - strength * b)


# --- angle and fit -------------------------------------------------------

def spectral_angle(a: Column, b: Column) -> Column:
    def angle(x: Column, y: Column) -> Column:
        denominator = A.norm(x) * A.norm(y)
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), A.dot(x, y) / denominator))
        return F.when(denominator > 0, F.acos(cosine))

    return A.let(a, lambda x: A.let(b, lambda y: angle(x, y)))


def feature_fit(pixel: Column, reference: Column) -> Column:
    """Least-squares scale of the reference, residual RMS and scale / RMS."""
    def solve(p: Column, r: Column) -> Column:
        sums = F.struct(
            A.dot(r, r).alias("energy"), A.dot(p, r).alias("cross"), A.dot(p, p).alias("own"),
            F.size(p).alias("n"),
        )
        scale = lambda s: F.when(s["energy"] > 0, s["cross"] / s["energy"]).otherwise(0.0)
        rest = lambda s, k: s["own"] - 2.0 * k * s["cross"] + k * k * s["energy"]
        fitted = A.let(sums, lambda s: A.let(scale(s), lambda k: F.struct(
            k.alias("scale"), F.sqrt(F.greatest(rest(s, k), F.lit(0.0)) / s["n"]).alias("rms"))))
        return A.let(fitted, lambda f: F.struct(
            f["scale"].alias("scale"), f["rms"].alias("rms"),
            F.when(f["scale"] > 0, f["scale"] / F.greatest(f["rms"], F.lit(1e-12))).otherwise(0.0).alias("quality")))

    return A.let(pixel, lambda p: A.let(reference, lambda r: solve(p, r)))


# --- continuum and absorption --------------------------------------------

def axis_segments(axis: Sequence[float], gap_factor: float = 4.0) -> list[tuple[int, int]]:
    """Half-open band ranges between gaps wider than ``gap_factor`` spacings."""
    spacing = np.diff(np.asarray(axis, dtype=float))
    limit = gap_factor * max(float(np.median(spacing)), 1e-12)
    cuts = [i + 1 for i, gap in enumerate(spacing) if gap > limit]
    return list(zip([0, *cuts], [*cuts, len(axis)]))


def continuum_segmented(spectrum: Column, axis: Sequence[float], gap_factor: float = 4.0) -> Column:
    """Divide by a straight line per segment; a one-band segment is 1."""
    def piece(s: Column, start: int, stop: int) -> Column:
        if stop - start == 1:
            return F.array(F.lit(1.0))
        length = axis[stop - 1] - axis[start]
        share = A.literal_doubles([(axis[i] - axis[start]) / length for i in range(start, stop)])
        left, right = s[start], s[stop - 1]
        return F.zip_with(
            F.slice(s, start + 1, stop - start), share, lambda v, f: v / (left + (right - left) * f)
        )

    def divide(s: Column) -> Column:
        parts = [piece(s, start, stop) for start, stop in axis_segments(axis, gap_factor)]
        return F.when(A.all_positive(s), F.concat(*parts))

    return A.let(spectrum, divide)


def absorption(continuum_removed: Column) -> Column:
    return F.transform(continuum_removed, lambda x: F.greatest(F.lit(1.0) - x, F.lit(0.0)))


def depth(absorbed: Column) -> Column:
    return F.array_max(absorbed)


def feature(absorbed: Column, axis: Sequence[float], kind: str, lo: float, hi: float) -> Column:
    """One diagnostic feature of a window, NULL when no band falls inside."""
    inside = window_positions(axis, [(lo, hi)], minimum=0)
    if not inside:
        return F.lit(None).cast("double")
    part = A.gather(absorbed, inside)
    peak = F.array_max(part)
    if kind == "center_nm":
        centres = A.literal_doubles([axis[i] for i in inside])
        return A.let(part, lambda p: F.get(
            centres, (F.array_position(p, F.array_max(p)) - 1).cast("int")))
    if kind == "depth_ratio":
        return peak / F.greatest(F.array_max(absorbed), F.lit(1e-12))
    if kind == "depth":
        return peak
    raise ValueError(f"unknown feature kind {kind}")


def features(absorbed: Column, axis: Sequence[float], definitions: Sequence[dict]) -> Column:
    pairs = []
    for d in definitions:
        pairs += [F.lit(d["id"]), feature(absorbed, axis, d["type"], *d["window_nm"])]
    return F.create_map(*pairs)


def feature_vector(values: Column, definitions: Sequence[dict]) -> Column:
    """Feature values in order, centres scaled to their window."""
    items = []
    for d in definitions:
        value = values[d["id"]]
        if d["type"] == "center_nm":
            lo, hi = d["window_nm"]
            value = (value - lo) / max(hi - lo, 1.0)
        items.append(value)
    return F.array(*items)


def gradient_taps(axis: Sequence[float]) -> list[list[tuple[int, float]]]:
    """Second-order differences on an uneven axis, one-sided at the ends."""
    n = len(axis)
    first, last = axis[1] - axis[0], axis[-1] - axis[-2]
    rows = [[(0, -1.0 / first), (1, 1.0 / first)]]
    for i in range(1, n - 1):
        a, b = axis[i] - axis[i - 1], axis[i + 1] - axis[i]
        rows.append(
            [(i - 1, -b / (a * (a + b))), (i, (b - a) / (a * b)), (i + 1, a / (b * (a + b)))]
        )
    rows.append([(n - 2, -1.0 / last), (n - 1, 1.0 / last)])
    return rows


def derivative(values: Column, axis: Sequence[float]) -> Column:
    return A.weighted_taps(values, gradient_taps(axis))


DEFAULT_WEIGHTS = {"shape": 0.60, "derivative": 0.20, "features": 0.20, "fit": 0.0}


def evidence_total(
    shape: Column, slope: Column, feature_distance: Column, fit: Column, weights: dict
) -> Column:
    """Weighted mean over the components that are present."""
    merged = {**DEFAULT_WEIGHTS, **weights}
    parts = [
        (value, float(merged[name]))
        for value, name in (
            (shape, "shape"), (slope, "derivative"), (feature_distance, "features"), (fit, "fit"),
        )
        if merged[name] > 0
    ]
    weighted = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    available = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(available > 0, weighted / available)


def feature_distance(a: Column, b: Column) -> Column:
    """RMS difference over the features both sides have."""
    squares = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda d: d.isNotNull())
    return A.let(squares, lambda q: F.when(F.size(q) > 0, F.sqrt(A.total(q) / F.size(q))))


def reference_evidence(
    pixel: Column,
    reference: Column,
    axis: Sequence[float],
    definitions: Sequence[dict],
    weights: dict,
) -> Column:
    """Shape, derivative, feature and fit distance of two absorption curves."""
    shape = spectral_angle(pixel, reference)
    slope = spectral_angle(derivative(pixel, axis), derivative(reference, axis))
    if definitions:
        distance = feature_distance(
            feature_vector(features(pixel, axis, definitions), definitions),
            feature_vector(features(reference, axis, definitions), definitions),
        )
    else:
        distance = F.lit(0.0)
    if weights.get("fit", 0.0) > 0:
        fitted = feature_fit(pixel, reference)
        level = F.greatest(
            A.total(F.transform(pixel, F.abs)) / F.size(pixel), F.lit(1e-8)
        )
        fit = F.least(F.greatest(fitted["rms"] / level, F.lit(0.0)), F.lit(float(np.pi)))
        quality = fitted["quality"]
    else:
        fit, quality = F.lit(0.0), F.lit(0.0)
    return F.struct(
        evidence_total(shape, slope, distance, fit, weights).alias("total"),
        shape.alias("shape"),
        slope.alias("derivative"),
        distance.alias("feature"),
        fit.alias("fit"),
        quality.alias("fit_quality"),
    )


# --- quality of a spectrum -----------------------------------------------

def relative_noise(spectrum: Column, bands: int) -> Column:
    """MAD of the second differences over the median signal."""
    unit = 1.0 / float(np.sqrt(6.0))
    taps = [[(i, unit), (i + 1, -2.0 * unit), (i + 2, unit)] for i in range(bands - 2)]
    noise = A.let(
        A.weighted_taps(spectrum, taps),
        lambda d: A.let(A.median(d), lambda m: A.median(F.transform(d, lambda x: F.abs(x - m)))),
    )
    return 1.4826 * noise / F.greatest(A.median(F.transform(spectrum, F.abs)), F.lit(1e-8))


def brightness_contrast(
    spectrum: Column, positions: Sequence[int], epsilon: float = 1e-10, share: float = 0.70
) -> Column:
    """Median level and relative range of a few spread bands."""
    picked = F.filter(
        F.array(*[spectrum[i] for i in positions]),
        lambda x: x.isNotNull() & (x > epsilon) & (x < float("inf")),  # NaN is above infinity
    )
    needed = max(1, int(np.ceil(len(positions) * share)))
    level = A.median(picked)
    contrast = (F.array_max(picked) - F.array_min(picked)) / F.greatest(F.abs(level), F.lit(epsilon))
    return F.struct(
        level.alias("brightness"),
        contrast.alias("contrast"),
        ((F.size(picked) >= needed) & level.isNotNull()).alias("usable"),
    )


def is_material(values: Column, epsilon: float = 1e-10) -> Column:
    """True when any band carries a finite non-zero value."""
    return F.exists(values, lambda b: b.isNotNull() & (F.abs(b) > epsilon) & (F.abs(b) < float("inf")))


def spectral_domain(lo: Column, hi: Column) -> Column:
    """Label of the wavelength range, joined by '+' when several apply."""
    named = F.concat_ws(
        "+",
        F.when((lo <= 750) & (hi >= 450), "vnir"),
        F.when((lo <= 1700) & (hi >= 900), "nir"),
        F.when((lo <= 2450) & (hi >= 2000), "swir"),
        F.when((lo <= 12000) & (hi >= 8000), "tir"),
    )
    return F.when(named == "", "unknown").otherwise(named)


def data_physics(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.contains("temperature"), "brightness_temperature")
        .when(t.contains("radiance") | t.contains("w/("), "radiance")
        .when(t.contains("emissiv"), "emissivity")
        .when(t.contains("reflect"), "reflectance")
        .otherwise("unknown")
    )


def wavelengths_nm(values: Column, unit_name: Column) -> Column:
    """Micrometres become nanometres by declared unit and by magnitude."""
    top = F.array_max(values)
    micro = (F.lower(unit_name).contains("micro") & (top <= 100)) | (top <= 20)
    return F.when(micro, F.transform(values, lambda x: x * 1000.0)).otherwise(values)
