"""Audits of finished maps: nesting, clustering, stripes, flags and grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from . import artifacts, columns, grid


def flags(conditions: dict[str, tuple[Column, str]]) -> Column:
    """Array of ``(code, severity)`` for the conditions that hold."""
    return F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
        for code, (test, severity) in conditions.items()
    ]))


HIGH_RISK = ("FIXED_COLUMN_RESIDUAL", "POLICY_NOT_NESTED", "REPEATED_NARROW_COLUMN_RESIDUAL")


def grade(issues: Column) -> Column:
    """D for errors, C for high-risk findings, B for warnings, A otherwise."""
    severe = F.exists(issues, lambda i: i["severity"] == "error")
    risky = F.exists(issues, lambda i: i["code"].isin(*HIGH_RISK))
    warned = F.exists(issues, lambda i: i["severity"] == "warning")
    return F.when(severe, "D").when(risky, "C").when(warned, "B").otherwise("A")


def clustered_share(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of pixels with a neighbour of the same class."""
    by_class = [*keys, "class_id"]
    near = grid.box_counts(classes, classes, by_class, 1, 1, include_self=False)
    return near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classified"), F.avg((F.col("n") > 0).cast("double")).alias("clustered"))


def residual_stripes(classes: DataFrame, valid: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Removable repeated-column pixels left in every class."""
    keys = list(keys)
    by_class = [*keys, "class_id"]
    peaks = artifacts.segment_peaks(classes, valid, frames, by_class)
    repetition = peaks.groupBy(*by_class, "sample").count().groupBy(*by_class).agg(F.max("count").alias("repetition"))
    removed = artifacts.repeated_stripes(classes, valid, frames, by_class)
    stripes = removed.groupBy(*by_class).agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("sample").alias("columns"))
    present = classes.select(*by_class).distinct()
    return present.join(repetition, by_class, "left").join(stripes, by_class, "left").fillna(0, ["repetition", "pixels", "columns"])


def quality_report(wide: DataFrame, confidence: DataFrame, valid: DataFrame, frames: DataFrame, class_count: int) -> DataFrame:
    """One graded row per scene from nested maps (conservative, balanced, sensitive)."""
    from .maps import nesting_breaks

    breaks = wide.groupBy("scene_id").agg(F.sum(nesting_breaks(wide).cast("long")).alias("breaks"))
    ranges = confidence.groupBy("scene_id").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    balanced = wide.where("balanced > 0").select("scene_id", "line", "sample", F.col("balanced").alias("class_id"))
    seen = balanced.groupBy("scene_id").agg(F.count_distinct("class_id").alias("seen"))
    cluster = clustered_share(balanced, ["scene_id"])
    profile = columns.dense(columns.density(balanced, valid, ["scene_id"]), ["scene_id"], ["density"], frames)
    profile = profile.withColumn("density", F.transform("density", lambda x: F.coalesce(x, F.lit(0.0))))  # a column without material is empty
    dense = profile.select("scene_id", F.array_max("density").alias("peak"), A.median(F.col("density")).alias("middle"))
    stripes = residual_stripes(balanced, valid, frames, ["scene_id"]).groupBy("scene_id").agg(
        F.sum("pixels").alias("stripe_pixels"), F.max("repetition").alias("repetition"))
    joined = frames.select("scene_id")
    for part in (breaks, ranges, seen, cluster, dense, stripes):
        joined = joined.join(part, "scene_id", "left")
    c = F.col
    issues = flags({
        "POLICY_NOT_NESTED": (F.coalesce(c("breaks"), F.lit(0)) > 0, "error"),
        "CONFIDENCE_RANGE_INVALID": ((c("low") < 0) | (c("high") > 1), "error"),
        "SCATTERED_DETECTIONS": ((c("classified") >= 20) & (c("clustered") < 0.25), "warning"),
        "FIXED_COLUMN_RESIDUAL": ((c("peak") >= F.greatest(F.lit(0.15), c("middle") + 0.10))
                                  & (c("peak") >= 3.0 * F.greatest(c("middle"), F.lit(0.01))), "warning"),
        "REPEATED_NARROW_COLUMN_RESIDUAL": (F.coalesce(c("stripe_pixels"), F.lit(0)) > 0, "warning"),
        "ZERO_DETECTION": (F.coalesce(c("seen"), F.lit(0)) < class_count, "warning"),
        "NO_GROUND_TRUTH": (F.lit(True), "info"),
    })
    return joined.withColumn("issues", issues).withColumn("grade", grade(c("issues"))).withColumn(
        "publishable", c("grade").isin("A", "B"))
