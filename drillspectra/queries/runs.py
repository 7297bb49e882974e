"""Whole runs: audits, regressions and the mapping flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A, spectral as S
from ..operators import library as L, maps, masks, sampling, sensor
from ..plans.flagship import run_flagship
from ..plans.registry import query
from ..plans.views import AXIS, KEY
from .decisions import POLICY_SQL, policy_maps
from .libraries import required_windows, sensor_axis, shapes
from .spectra import WINDOWS


@query("q13_flagship_mapping_run")
def q13(v):
    return run_flagship(v.spark, v.folder)


@query("q4_recipe_regression", f"""
    WITH {POLICY_SQL}, fz AS (SELECT scene_id, line, sample, policy, class_id FROM pl WHERE line % 13 <> 0), cd AS (SELECT scene_id, line, sample, policy, class_id FROM pl WHERE sample % 13 <> 0)
    SELECT scene_id, policy, count(*) FILTER (WHERE a.class_id = b.class_id) AS intersection, count(*) FILTER (WHERE a.class_id IS NULL) AS false_positive, count(*) FILTER (WHERE b.class_id IS NULL) AS false_negative
    FROM fz a FULL JOIN cd b USING (scene_id, line, sample, policy) GROUP BY ALL""")
def q4(v):
    """Every policy of a run against its frozen maps, in one join."""
    rows = policy_maps(v)
    frozen = rows.where("line % 13 <> 0").withColumnRenamed("class_id", "r")
    now = rows.where("sample % 13 <> 0").withColumnRenamed("class_id", "c")
    both = frozen.join(now, [*KEY, "policy"], "full_outer").withColumns({"in_reference": F.col("r").isNotNull(), "in_candidate": F.col("c").isNotNull()})
    return maps.agreement(both, ["scene_id", "policy"]).select("scene_id", "policy", "intersection", "false_positive", "false_negative")


@query("l11_ensemble_availability")
def l11(v):
    """Curves through diagnostics, sample collapse and greedy choice; minerals
    whose windows the axis does not cover are refused with a reason."""
    judged = v.pixels.withColumn("d", L.diagnostics(F.col("spectrum"), AXIS, WINDOWS)).select(
        "vec_id", "label", F.col("d.quality").alias("quality"), F.col("d.embedding").alias("unit"), F.col("d.rejection").alias("rejection"))
    good = judged.where("rejection is null").join(shapes(v).select("vec_id", "source_family", "geometry", "anchor_order"), "vec_id")
    sampled = L.collapse_samples(good.withColumn("sample_id", F.col("label") * 1000 + F.col("vec_id") % 40), "sample_id",
                                 [F.col("anchor_order").isNull(), -F.col("quality")], "vec_id")
    kept = sampled.where("kept").select("vec_id", "label", "quality", "unit", "source_family", "geometry", "anchor_order")
    chosen = L.diverse_references(kept, "label", "vec_id", "unit", maximum=3, minimum=2).groupBy("label").agg(F.count(F.lit(1)).alias("selected"))
    cover = L.window_coverage(sensor_axis(v), required_windows(v), ["scene_id"]).groupBy("window_id").agg(F.min("coverage").alias("coverage"))
    asked = judged.groupBy("label").agg(F.count(F.lit(1)).alias("candidates"), F.count("rejection").alias("rejected")).withColumn(
        "window_id", (F.col("label") % 4 + 1).cast("int"))
    return asked.join(cover, "window_id", "left").join(chosen, "label", "left").select(
        "label", "candidates", "rejected", F.coalesce("selected", F.lit(0)).alias("selected"),
        F.array_join(F.array_compact(F.array(
            F.when(F.coalesce("coverage", F.lit(0.0)) < 0.97, "insufficient_axis_coverage"),
            F.when(F.coalesce("selected", F.lit(0)) < 2, "too_few_references"))), ",").alias("reasons"))


@query("q12_project_audit")
def q12(v):
    """Grid, mask, sensor and plan of every scene in one readiness row."""
    area = v.pixel_frames
    quality = sensor.sensor_quality(v.pixels).select("scene_id", "snr", "bad_bands")
    mask = v.pixels.where(S.is_material(F.col("spectrum"))).groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"))
    plan = sampling.depth_blocks(v.pixels.select(*KEY), area, desired=4, height=8, minimum=16).groupBy("scene_id").agg(F.count("start").alias("blocks"))
    spacing = sensor_axis(v).groupBy("scene_id").agg((F.max("wavelength_nm") - F.min("wavelength_nm")).alias("span"))
    rows = area.join(mask, "scene_id", "left").join(quality, "scene_id", "left").join(plan, "scene_id", "left").join(spacing, "scene_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("pixels", F.lit(0)) < 128, "MASK_TOO_SMALL"), F.when(F.col("snr") < 50, "LOW_ESTIMATED_SNR"),
        F.when(F.coalesce("blocks", F.lit(0)) == 0, "NO_SAMPLE_BLOCKS"), F.when(F.col("span") < 1000, "NARROW_AXIS")))
    return rows.select("scene_id", "lines", "samples", "pixels", F.round("snr", 4).alias("snr"), "bad_bands", "blocks", F.array_join(reasons, ",").alias("reasons"),
                       F.when(F.exists(reasons, lambda r: r.isin("MASK_TOO_SMALL", "NO_SAMPLE_BLOCKS")), "blocked").when(F.size(reasons) > 0, "review").otherwise("ready").alias("status"))
