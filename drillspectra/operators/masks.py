"""Material masks: robust scene statistics, automatic masks, coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays as A, kernels as K, spectral as S
from ..session import durable
from . import components as CC, grid
from .quantiles import exact_quantiles


def robust_scale(
    df: DataFrame, keys: Sequence[str], value: str, relative_floor: float, center: Column | None = None
) -> DataFrame:
    """``keys, n, center, scale``: the larger of MAD, IQR/1.349 and a relative floor."""
    keys = list(keys)
    spread = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    around = df.join(spread, keys).select(*keys, F.abs(F.col(value) - F.col("q1")).alias("_d"))
    mad = exact_quantiles(around, keys, "_d", [0.5]).select(*keys, F.col("q0").alias("_mad"))
    return spread.join(mad, keys).select(
        *keys, "n", F.col("q1").alias("center"),
        F.greatest(
            1.4826 * F.col("_mad"), (F.col("q2") - F.col("q0")) / 1.349,
            F.abs("q1") * relative_floor, F.lit(1e-6),
        ).alias("scale"),
    )


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """``keys, threshold``: bin centre with the largest between-class variance."""
    keys = list(keys)
    x = F.col(value)
    ends = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.join(ends, keys).withColumn(
        "bin", F.coalesce(F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))), F.lit(0))
    )
    counts = placed.groupBy(*keys, "bin", "lo", "hi", "n").agg(F.count(x).alias("k"))
    share = F.col("k") / F.col("n")
    centre = F.col("lo") + width * (F.col("bin") + 0.5)
    upto = W.partitionBy(*keys).orderBy("bin")
    mass = counts.select(*keys, "bin", "lo", "hi", centre.alias("centre"), share.alias("p")).select(
        "*", F.sum("p").over(upto).alias("cp"), F.sum(F.col("p") * F.col("centre")).over(upto).alias("cm"),
        F.sum(F.col("p") * F.col("centre")).over(W.partitionBy(*keys)).alias("tm"),
    )
    split = F.col("cp") * (1 - F.col("cp"))
    between = F.when(split > 1e-12, F.pow(F.col("tm") * F.col("cp") - F.col("cm"), 2) / split)
    best = mass.groupBy(*keys).agg(
        F.max(F.struct(F.coalesce(between, F.lit(float("-inf"))).alias("b"), (-F.col("bin")).alias("r"),
                       F.when(F.col("hi") > F.col("lo"), F.col("centre")).otherwise(F.col("lo")).alias("centre"))).alias("best")
    )
    return best.select(*keys, F.col("best.centre").alias("threshold"))


def on_border(width: int | Column) -> Column:
    return (
        (F.col("line") < width) | (F.col("sample") < width)
        | (F.col("line") >= F.col("lines") - width) | (F.col("sample") >= F.col("samples") - width)
    )


def refine(
    cells: DataFrame, frames: DataFrame, closing: int = 3, hole: int = 125, minimum: int = 64,
    keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """Close, fill small holes, drop small components."""
    keys = list(keys)
    closed = grid.close(cells, frames, keys, closing)
    filled = CC.fill_holes(closed, frames, hole, keys)
    return CC.keep_large(CC.components(filled, keys), minimum).select(*keys, "line", "sample")


def automatic_mask(pixels: DataFrame, frames: DataFrame, positions: Sequence[int], border: int | None = None) -> DataFrame:
    """Raw material pixels of every scene, with the threshold that was used.

    ``pixels`` is (scene_id, line, sample, spectrum).  The frame border models
    the background; a mixed border falls back to a brightness split.
    """
    keys = ["scene_id"]
    if border is None:  # a 32nd of the shorter side, two at least
        border = F.greatest(F.lit(2), F.floor(F.least("lines", "samples") / 32))
    seen = pixels.withColumn("b", S.brightness_contrast(F.col("spectrum"), positions)).where("b.usable").select(
        *keys, "line", "sample", F.col("b.brightness").alias("brightness"), F.col("b.contrast").alias("contrast"))
    marked = seen.join(frames, "scene_id").withColumn("edge", on_border(border))
    few = marked.groupBy(*keys).agg(F.sum(F.col("edge").cast("int")).alias("_e"))
    marked = durable(marked.join(few, keys).withColumn("background", F.col("edge") | (F.col("_e") < 16)).drop("_e"))
    back = marked.where("background")
    level = robust_scale(back, keys, "brightness", 0.02).select(*keys, F.col("center").alias("bc"), F.col("scale").alias("bs"))
    range_ = robust_scale(back, keys, "contrast", 0.05).select(*keys, F.col("center").alias("cc"), F.col("scale").alias("cs"))
    c = F.col
    far = F.abs(c("brightness") - c("bc")) / c("bs")
    lifted = F.greatest((c("contrast") - c("cc")) / c("cs"), F.lit(0.0))
    mixed = c("bs") / F.greatest(F.abs(c("bc")), F.lit(1e-3)) > 0.25
    scored = durable(marked.join(level, keys).join(range_, keys).withColumn("mixed", mixed).withColumn(
        "value", F.when(c("mixed"), c("brightness")).otherwise(F.least(0.70 * far + 0.30 * lifted, F.lit(1000.0)))))
    split = otsu(scored, keys, "value")
    guard = exact_quantiles(scored.where("background"), keys, "value", [0.995]).select(*keys, c("q0").alias("_g"))
    cap = exact_quantiles(scored, keys, "value", [0.80]).select(*keys, c("q0").alias("_c"))
    limit = split.join(guard, keys).join(cap, keys)
    chosen = scored.join(limit, keys).withColumn(
        "threshold", F.when(c("mixed"), c("threshold")).otherwise(F.greatest("threshold", F.least("_g", "_c"))))
    return chosen.where("value >= threshold").select(
        *keys, "line", "sample", "threshold",
        F.when(c("mixed"), "brightness_split").otherwise("border_score_split").alias("method"))


def clean_mask(raw: DataFrame, frames: DataFrame, minimum: int | None = None) -> DataFrame:
    """Drop components below 0.01 % of the frame (at least eight pixels)."""
    labelled = CC.components(raw.select("scene_id", "line", "sample")).join(frames, "scene_id")
    floor = F.lit(minimum) if minimum else F.greatest(F.lit(8), F.ceil(F.col("lines") * F.col("samples") * 0.0001))
    return labelled.withColumn("kept", F.col("size") >= floor)


def mask_audit(
    labelled: DataFrame, frames: DataFrame, automatic: bool = True, minimum_fraction: float = 0.005,
    maximum_fraction: float = 0.85, minimum_pixels: int = 128, minimum_interior: float = 0.65,
) -> DataFrame:
    """One row per scene: counts, interior share, flags and a ready/blocked status."""
    from .quality import flags

    kept = labelled.where("kept").select("scene_id", "line", "sample")
    inner = grid.box_counts(kept, kept, ["scene_id"], 1, 1).groupBy("scene_id").agg(
        F.avg((F.col("n") >= 8).cast("double")).alias("interior"))
    totals = labelled.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("raw_pixels"), F.sum(F.col("kept").cast("long")).alias("pixels"),
        F.count_distinct("label").alias("components"), F.count_distinct(F.when(F.col("kept"), F.col("label"))).alias("kept_components"))
    c = F.col
    rows = frames.join(totals, "scene_id", "left").join(inner, "scene_id", "left").fillna(
        0, ["raw_pixels", "pixels", "components", "kept_components"]).fillna(0.0, ["interior"])
    area = c("lines") * c("samples")
    issues = flags({
        "MASK_TOO_SMALL": (c("pixels") < F.greatest(F.lit(minimum_pixels), F.ceil(area * minimum_fraction)), "error"),
        "MASK_TOO_LARGE": (c("pixels") / area > maximum_fraction, "error"),
        "MASK_EDGE_LIKE": (F.lit(automatic) & (c("interior") < minimum_interior), "error"),
        "SMALL_COMPONENTS_REMOVED": (c("raw_pixels") > c("pixels"), "info"),
        "MASK_HIGHLY_FRAGMENTED": (c("kept_components") > F.greatest(F.lit(32), F.floor(c("lines") / 64)), "warning"),
    })
    return rows.withColumn("flags", issues).withColumn(
        "status", F.when(F.exists("flags", lambda f: f["severity"] == "error"), "blocked").otherwise("ready"))


def _gaussian_taps(radius: int = 4) -> tuple[list[float], list[float]]:
    import math

    raw = [math.exp(-0.5 * k * k) for k in range(-radius, radius + 1)]
    smooth = [r / sum(raw) for r in raw]
    return smooth, [-k * s for k, s in zip(range(-radius, radius + 1), smooth)]


def _mirrored(index: np.ndarray, n: int, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For places along an axis of length ``n``: where in a plane that starts at ``first`` their values stand, and whether they do."""
    source = np.where(index < 0, -index - 1, np.where(index >= n, 2 * n - 1 - index, index))
    at = source - first
    return np.clip(at, 0, size - 1), (source >= 0) & (source < n) & (at >= 0) & (at < size)


def log_gradient(cells: DataFrame, frames: DataFrame, keys: Sequence[str], value: str, radius: int = 4) -> DataFrame:
    """``keys, line, sample, dx, dy``: Gaussian slopes of a plane with mirrored borders; cells without a value count as zero."""
    smooth, slope = _gaussian_taps(radius)

    def run(tile: grid.Tile, table: pa.Table):
        lines, samples = (int(table.column(c)[0].as_py()) for c in ("lines", "samples"))
        plane = tile.plane(table.column(value).to_numpy(zero_copy_only=False))
        tall, wide = plane.shape
        down, down_ok = _mirrored(np.arange(tall) + tile.start - radius, lines, tile.start - radius, tall)
        over, over_ok = _mirrored(np.arange(wide) + tile.low, samples, tile.low, wide)
        plane = plane[down][:, over] * down_ok[:, None] * over_ok[None, :]

        def across(taps):
            padded = np.pad(plane, ((0, 0), (radius, radius)))
            return sum(w * padded[:, 2 * radius - k : 2 * radius - k + wide] for k, w in enumerate(taps))

        def along(part, taps):
            return sum(w * part[2 * radius - k : tall - k] for k, w in enumerate(taps))

        which = np.flatnonzero(tile.home)
        return tile.line[which], tile.sample[which], tile.of(along(across(slope), smooth), which), tile.of(along(across(smooth), slope), which)

    return grid.per_tile(cells.join(frames, "scene_id").select(*keys, "line", "sample", value, "lines", "samples"), keys, radius, radius, run, "dx double, dy double")


def radiometric_stability(
    level: DataFrame, frames: DataFrame, value: str = "level", window: int = 5, minimum_share: float = 0.80,
    maximum_cv: float = 0.30, maximum_gradient: float = 0.25,
) -> DataFrame:
    """Pixels on even ground: full neighbourhood, low local variation, low slope of log reflectance."""
    keys, r = ["scene_id"], window // 2
    good = level.where((F.col(value) > 0) & ~F.isnan(value)).select(*keys, "line", "sample", F.col(value).alias("x"))
    squares = good.select(*keys, "line", "sample", F.col("x").alias("_s"), (F.col("x") * F.col("x")).alias("_q"))
    around = grid.box_sums(squares, keys, r, r, ["_s", "_q"]).withColumnRenamed("n", "_n")
    slopes = log_gradient(good.withColumn("g", F.log(F.greatest("x", F.lit(1e-6)))), frames, keys, "g")
    mean = F.col("_s") / F.col("_n")
    cv = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))) / F.greatest(mean, F.lit(1e-6))
    return good.join(around, [*keys, "line", "sample"]).join(slopes, [*keys, "line", "sample"]).select(
        *keys, "line", "sample", (F.col("_n") / float(window * window)).alias("support"), cv.alias("cv"),
        F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("gradient"),
    ).withColumn("stable", (F.col("support") >= minimum_share) & (F.col("cv") <= maximum_cv) & (F.col("gradient") <= maximum_gradient))


def depth_coverage(
    cells: DataFrame, frames: DataFrame, scales: Sequence[int] = (256, 512), neighbours: int = 3,
    minimum_expected: float = 0.20, minimum_drop: float = 0.12, maximum_ratio: float = 0.55, minimum_z: float = 2.5,
    active_share: float = 0.05,
) -> DataFrame:
    """Coverage of every depth block against the blocks around it.

    One row per line is the largest table; blocks compare through windows of
    three rows on either side.
    """
    lines = frames.select("scene_id", "samples", "lines", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"))
    counts = cells.groupBy("scene_id", "line").agg(F.count(F.lit(1)).alias("c"))
    share = lines.join(counts, ["scene_id", "line"], "left").select(
        "scene_id", "line", "lines", (F.coalesce("c", F.lit(0)) / F.col("samples")).alias("share"),
        F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"))
    active = F.col("share") >= active_share
    blocks = share.groupBy("scene_id", "scale", "lines", F.floor(F.col("line") / F.col("scale")).cast("int").alias("block")).agg(
        F.avg("share").alias("observed"), F.avg(active.cast("double")).alias("active"),
        F.coalesce(F.percentile(F.when(active, F.col("share")), F.lit(0.5)), F.lit(0.0)).alias("active_median"))
    order = W.partitionBy("scene_id", "scale").orderBy("block")
    left = F.collect_list("observed").over(order.rowsBetween(-neighbours, -1))
    right = F.collect_list("observed").over(order.rowsBetween(1, neighbours))
    near = blocks.withColumns({"left": left, "right": right}).withColumn("all", F.concat("left", "right"))
    judged = near.withColumn("expected", A.median(F.col("all"))).withColumn(
        "_mad", 1.4826 * A.median(F.transform("all", lambda x: F.abs(x - F.col("expected"))))).withColumn(
        "_iqr", (A.quantile(F.col("all"), 0.75) - A.quantile(F.col("all"), 0.25)) / 1.349)
    scale = F.least(F.greatest("_mad", "_iqr", F.lit(0.025)), F.greatest(F.lit(0.025), F.col("expected") * 0.15))
    strong = lambda side: F.exists(side, lambda x: x >= minimum_expected)
    c = F.col
    drop = c("expected") - c("observed")
    two_sided = strong("left") & strong("right")
    anomaly = two_sided & (c("expected") >= minimum_expected) & (drop >= minimum_drop) & (
        F.try_divide(c("observed"), c("expected")) <= maximum_ratio) & (drop / scale >= minimum_z)
    return judged.select(
        "scene_id", "scale", (c("block") * c("scale")).alias("start"), F.least((c("block") + 1) * c("scale"), c("lines")).alias("stop"),
        "observed", "active", "active_median", "expected", F.coalesce(anomaly, F.lit(False)).alias("anomaly"),
        F.when(F.coalesce(anomaly, F.lit(False)), "warning").when(~two_sided & (c("observed") < minimum_expected), "info").otherwise("normal").alias("severity"))


def coverage_regions(blocks: DataFrame) -> DataFrame:
    """Touching anomalous blocks as depth regions; two scales make it critical."""
    merged = grid.islands(blocks.where("anomaly"), ["scene_id"], "start", 0, "stop").groupBy("scene_id", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count_distinct("scale").alias("scales"),
        F.min("observed").alias("observed"), F.max("expected").alias("expected"), F.max("active_median").alias("active_median"))
    severity = F.when(F.col("scales") >= 2, "critical").when(F.col("active_median") >= 0.75 * F.col("expected"), "info").otherwise("review")
    return merged.withColumn("severity", severity).drop("island")


def coverage_gate(regions: DataFrame, frames: DataFrame) -> DataFrame:
    """blocked / review / passed per scene."""
    worst = regions.groupBy("scene_id").agg(
        F.max((F.col("severity") == "critical").cast("int")).alias("c"), F.max((F.col("severity") == "review").cast("int")).alias("r"))
    return frames.select("scene_id").join(worst, "scene_id", "left").select(
        "scene_id", F.when(F.col("c") == 1, "blocked").when(F.col("r") == 1, "review").otherwise("passed").alias("status"))


def hybrid_mask(base: DataFrame, probability: DataFrame, frames: DataFrame, minimum: float = 0.90, reach: int = 2,
                hole: int = 64, component: int = 16) -> DataFrame:
    """Base plus confident pixels close to it, filled and cleaned.

    ``agreement``: 1 base only, 2 added only, 3 both.
    """
    keys, cell = ["scene_id"], ["scene_id", "line", "sample"]
    near = grid.dilate(base, frames, keys, 2 * reach + 1)
    sure = probability.where(F.col("probability") >= minimum).select(*cell)
    united = base.select(*cell).unionByName(sure.join(near, cell, "left_semi")).distinct()
    filled = CC.fill_holes(united, frames, hole)
    kept = CC.keep_large(CC.components(filled), component).select(*cell)
    both = kept.join(base.select(*cell).withColumn("_b", F.lit(1)), cell, "left").join(sure.withColumn("_s", F.lit(2)), cell, "left")
    return both.select(*cell, (F.coalesce("_b", F.lit(0)) + F.coalesce("_s", F.lit(0))).alias("agreement"))


def vnir_anomalies(
    pixels: DataFrame, references: Sequence[Sequence[float]], bands: int, ladder: dict[str, dict[str, float]], component: int = 2,
) -> DataFrame:
    """Narrow-absorption matches to user references under three nested ladders,
    kept where the neighbourhood supports them."""
    keys, cell = ["scene_id"], ["scene_id", "line", "sample"]
    features = pixels.withColumn("feature", S.narrow_absorption(F.col("spectrum"), bands))
    strength = F.array_max(F.transform("feature", F.abs))
    scored = features.withColumn("angle", F.array_min(K.angles_to(references)(F.col("feature")))).withColumn("strength", strength)
    hits = F.array_compact(F.array(*[
        F.when(candidate_of(rule), p) for p, rule in ladder.items()]))
    named = durable(scored.select(*cell, "angle", "strength", F.explode(hits).alias("policy")))
    by = [*keys, "policy"]
    around = grid.box_counts(named, named, by, 1, 1)
    supported = around.where(F.col("n") >= 2).select(*by, "line", "sample")
    kept = CC.keep_large(CC.components(supported, by), component).select(*by, "line", "sample")
    return named.join(kept, [*cell, "policy"], "left_semi")


def candidate_of(rule: dict[str, float]) -> Column:
    from ..functions.scoring import strength_candidate

    return strength_candidate(F.col("angle"), F.col("strength"), rule["maximum_angle"], rule["minimum_strength"], rule["maximum_strength"])
