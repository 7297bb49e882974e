"""Scenes to class maps: the whole mapping run as one dataflow.

The pixels are read twice for the detector's column bias, once for the scores
behind the thresholds and once for the candidates that pass them.  Spectra cross
no exchange: limits and bias are looked up by scene (``operators.candidates``).
What is shuffled are counts, scores, labels and per-column statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels as K, scoring, spectral as S
from ..operators import artifacts, calibrate, candidates, columns, grid, maps, sampling
from ..operators.quantiles import exact_quantiles
from ..session import collect_bounded, durable, ship_package
from .views import AXIS, Views

CELL = ["scene_id", "line", "sample"]
LIBRARY_BOUND = 20_000

# settings of every group in the demonstration domain
POLICIES = {
    "conservative": {"column_percentile": 0.20, "absolute_sam_threshold_rad": 0.18, "minimum_absorption_depth": 0.02, "minimum_margin": 0.0, "confidence_threshold": 0.45, "minimum_reference_consensus": 0.50},
    "balanced": {"column_percentile": 0.40, "absolute_sam_threshold_rad": 0.20, "minimum_absorption_depth": 0.012, "minimum_margin": 0.0, "confidence_threshold": 0.30, "minimum_reference_consensus": 0.34},
    "sensitive": {"column_percentile": 0.60, "absolute_sam_threshold_rad": 0.22, "minimum_absorption_depth": 0.008, "minimum_margin": 0.0, "confidence_threshold": 0.15, "minimum_reference_consensus": 0.20},
}
GROUP = {
    "detection": [(1350.0, 1800.0), (1850.0, 2260.0)],
    "classification": [(1350.0, 2260.0)],
    "features": [
        {"id": "water_ratio", "type": "depth_ratio", "window_nm": (1410.0, 1490.0)},
        {"id": "aloh_center_nm", "type": "center_nm", "window_nm": (2140.0, 2250.0)},
    ],
    "weights": {"shape": 0.55, "derivative": 0.15, "features": 0.30},
}
#: Share of the detector-column bias that is taken off before detection.
CORRECTION = 0.70
#: Strength and cap of the shift of a mineral whose scores are high all over a scene.
OFFSETS = (0.25, 0.03)


def candidate_limits(scores: DataFrame, frames: DataFrame) -> DataFrame:
    """Column, scene and absolute limits of every policy per (scene, group, column)."""
    names = list(POLICIES)
    keys = ["scene_id", "group_no"]
    fractions = [POLICIES[p]["column_percentile"] for p in names]
    limits = columns.column_thresholds(
        scores, frames, fractions, keys=keys, minimum=5,
        scene_fractions=[max(calibrate.scene_fraction(POLICIES[p]), f) for p, f in zip(names, fractions)])
    return limits.select(*keys, "sample", F.array(*[
        F.least(f"t{i}", f"s{i}", F.lit(POLICIES[p]["absolute_sam_threshold_rad"])) for i, p in enumerate(names)]).alias("limits"))


def map_scenes(pixels: DataFrame, library: list, frames: DataFrame, axis: list[float]) -> DataFrame:
    """Final class maps: (scene, line, sample, group_no, policy, mineral, confidence, status).

    ``library`` holds rows with mineral, group_no and spectrum.
    """
    names = list(POLICIES)
    groups = {}
    for number in sorted({r["group_no"] for r in library}):
        own = [r for r in library if r["group_no"] == number]
        groups[number] = {
            "references": [r["spectrum"] for r in own], "minerals": [r["mineral"] for r in own],
            "detect": S.window_positions(axis, GROUP["detection"], minimum=3),
            "positions": S.window_positions(axis, GROUP["classification"], minimum=3),
            "features": GROUP["features"], "weights": GROUP["weights"],
        }
    middle, bands = len(axis) // 2, len(axis)
    scenes = frames.count()
    smooth = pixels.select(*CELL, K.smooth(bands)(F.col("spectrum")).alias("smooth"))
    bias = candidates.scene_table(columns.column_bias(smooth, frames, "smooth"), scenes)
    detector = candidates.Detector(groups, bands, bias, CORRECTION)
    narrow = durable(candidates.detection_scores(pixels, detector, middle))
    valid = narrow.select(*CELL)
    scored = narrow.select(*CELL, F.posexplode("scores").alias("_g", "score")).withColumn("group_no", F.array(*map(F.lit, groups))[F.col("_g")]).drop("_g")
    top = exact_quantiles(narrow, ["scene_id"], "level", [0.999]).select("scene_id", F.col("q0").alias("top"))
    limits = candidates.scene_table(candidate_limits(scored, frames).join(top, "scene_id", "left"), scenes)
    evidence = candidates.candidate_evidence(
        pixels, detector, limits, names, middle, K.evidence_plans(groups, axis), max(len(g["references"]) for g in groups.values()))

    per_group = F.lit(None)
    for number, g in groups.items():
        order = sorted(set(g["minerals"]))
        per_group = F.when(F.col("group_no") == number, scoring.mineral_scores(F.col("distances"), g["minerals"], order, 2)).otherwise(per_group)
    counts = F.create_map(*[x for n, g in groups.items() for x in (F.lit(n), F.lit(len(set(g["minerals"]))))])
    held = {m: sum(r["mineral"] == m for r in library) for m in {r["mineral"] for r in library}}
    references = F.create_map(*[x for m, n in sorted(held.items()) for x in (F.lit(m), F.lit(n))])
    judged = durable(evidence.select(*CELL, "group_no", "score", "policies", "saturated", "depth", per_group.alias("m")))
    # minerals that sit above the best one all over a scene are shifted before they compete again
    medians = judged.select("scene_id", "group_no", F.inline("m"))
    shifts = calibrate.domain_offsets(medians, *OFFSETS).groupBy("scene_id", "group_no").agg(
        F.map_from_entries(F.collect_list(F.struct("mineral", "offset"))).alias("shift"))  # one entry per mineral of a group
    shifted = judged.join(shifts, ["scene_id", "group_no"], "left").withColumn(
        "s", F.transform("m", lambda x: x["score"] - F.coalesce(F.col("shift")[x["mineral"]], F.lit(0.0))))
    settled = shifted.withColumn("c", scoring.competition(F.col("s"))).withColumn("raw", scoring.competition(F.col("m")["score"])["label"])
    table = durable(settled.select(
        *CELL, "group_no", "score", "policies", "saturated", "depth", F.col("c.label").alias("label"), F.col("c.best").alias("best"),
        F.col("c.margin").alias("margin"), counts[F.col("group_no")].alias("minerals"), (F.col("raw") == F.col("c.label")).alias("agrees"),
        scoring.gather_winner(F.col("m")["consensus"], F.col("c.label")).alias("consensus"),
        scoring.gather_winner(F.col("m")["mineral"], F.col("c.label")).alias("mineral"),
    ).withColumn("references", references[F.col("mineral")]))
    accepted = durable(accept(table, valid, frames))
    kept = artifacts.terminal_filter(
        accepted.select("scene_id", "group_no", "policy", "line", "sample", F.col("mineral").alias("class_id")),
        valid, frames, groups=["group_no"]).where("removed_in is null")
    confidence = accepted.where("policy = 'sensitive'").select(*CELL, "group_no", "confidence", "status")
    final = maps.arbitrate(kept.select(*CELL, "policy", "group_no", "class_id"), confidence, CELL)
    return final.join(confidence, [*CELL, "group_no"]).select(
        *CELL, "group_no", "policy", F.col("class_id").alias("mineral"), "confidence", "status")


def accept(table: DataFrame, valid: DataFrame, frames: DataFrame) -> DataFrame:
    """Confidence of every candidate, then the gates of each policy, nested."""
    keys = ["scene_id", "group_no"]
    raw = exact_quantiles(table, keys, "best", [0.10, 0.90]).select(*keys, F.col("q0").alias("p10"), F.col("q1").alias("p90"))
    finite = table.where("margin < double('infinity')")
    gaps = exact_quantiles(finite, keys, "margin", [0.75]).select(*keys, F.col("q0").alias("p75"))
    plan = durable(sampling.depth_blocks(valid, frames, desired=8, height=16, minimum=1).select("scene_id", "start", "stop"))
    # without a block there is no column risk: such scenes are mapped without it and say so
    blind = plan.where("start IS NULL").select("scene_id", F.lit("no_block").alias("_blind"))
    hits = table.where(F.array_contains("policies", "balanced")).select(*CELL).distinct()
    risk = columns.fixed_column_risk(hits, valid, plan, frames)
    edges = grid.edge_risk(valid, ["scene_id"]).select(*CELL, "edge_risk")
    joined = table.join(raw, keys).join(gaps, keys, "left").join(risk, ["scene_id", "sample"], "left").join(edges, CELL, "left").join(blind, "scene_id", "left")
    c = F.col
    both = scoring.confidence(
        angle=c("score"), angle_limit=F.lit(POLICIES["sensitive"]["absolute_sam_threshold_rad"]), best_raw=c("best"), p10=c("p10"), p90=c("p90"),
        margin=c("margin"), margin_p75=F.coalesce("p75", F.lit(0.0)), minerals=c("minerals"), consensus_share=c("consensus"), depth=c("depth"),
        depth_floor=F.lit(POLICIES["sensitive"]["minimum_absorption_depth"]), agrees=F.coalesce("agrees", F.lit(False)), classified=c("label") > 0,
        column_risk=F.coalesce("risk", F.lit(0.0)), edge_risk=F.coalesce("edge_risk", F.lit(0.0)), saturated=c("saturated"))
    scored = joined.withColumn("e", both).select(*table.columns, "e.confidence", F.coalesce("_blind", F.lit("mapped")).alias("status"))
    rules = F.filter(F.array(*[
        F.struct(F.lit(p).alias("policy"), *[F.lit(float(rule[k])).alias(k) for k in (
            "minimum_absorption_depth", "minimum_margin", "confidence_threshold", "minimum_reference_consensus")])
        for p, rule in POLICIES.items()]), lambda r: F.array_contains("policies", r["policy"]))
    rows = scored.select("*", F.inline(rules))
    ok = rows.where(
        scoring.margin_pass(c("margin"), c("minimum_margin"), c("minerals"), c("label") > 0)
        & (c("depth") >= c("minimum_absorption_depth")) & (c("confidence") >= c("confidence_threshold"))
        & (c("consensus") >= calibrate.consensus_floor(c("minimum_reference_consensus"), c("policy"), c("references"))))
    # a pixel a stricter policy takes also belongs to the weaker ones
    ranks = F.create_map(F.lit("conservative"), F.lit(0), F.lit("balanced"), F.lit(1), F.lit("sensitive"), F.lit(2))
    strictest = ok.groupBy(*CELL, "group_no", "mineral", "confidence", "status").agg(F.min(ranks[c("policy")]).alias("r"))
    names = F.array(*[F.lit(p) for p in POLICIES])
    return strictest.select(*CELL, "group_no", "mineral", "confidence", "status", F.explode(F.slice(names, c("r") + 1, 3)).alias("policy"))


def run_scenes(views: Views, pixels: DataFrame) -> DataFrame:
    """Map ``pixels`` with the reference library of the demonstration domain: pixels per scene, group, policy and mineral."""
    frames = durable(pixels.groupBy("scene_id").agg((F.max("line") + 1).alias("lines"), (F.max("sample") + 1).alias("samples")))
    library = sorted(collect_bounded(views.refs, LIBRARY_BOUND, "the reference library"), key=lambda r: (r["mineral"], r["ref_id"]))
    final = map_scenes(pixels, library, frames, AXIS)
    return final.groupBy("scene_id", "status", "group_no", "policy", "mineral").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def run_flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels per scene, group, policy and mineral."""
    ship_package(spark)
    views = Views(spark, folder)
    return run_scenes(views, views.pixels)
