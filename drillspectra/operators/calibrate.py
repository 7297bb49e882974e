"""Thresholds resolved from a scene and gates learned from reviewed labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scoring import candidate
from ..session import durable
from . import columns, components as CC, grid
from .quantiles import exact_quantile_array, exact_quantiles
from .sampling import strongest


def scene_fraction(settings: Mapping) -> float:
    p = float(settings["column_percentile"])
    return float(settings.get("scene_percentile", min(0.30, max(0.10, 2.5 * p))))


def policy_candidates(
    scores: DataFrame, frames: DataFrame, policies: Mapping[str, Mapping], minimum: int = 20
) -> DataFrame:
    """Candidate pixels of every policy: column, scene and absolute limits at once.

    All percentiles of a column come from one pass, and every pixel meets the
    thresholds once; the policies are unfolded only for the pixels that pass.
    """
    names = list(policies)
    limits = columns.column_thresholds(
        scores, frames, [float(policies[p]["column_percentile"]) for p in names], minimum=minimum,
        scene_fractions=[scene_fraction(policies[p]) for p in names])
    passed = F.array_compact(F.array(*[
        F.when(
            candidate(F.col("score"), F.col(f"t{i}"), F.col(f"s{i}"),
                      F.lit(float(policies[p].get("absolute_sam_threshold_rad", float("inf"))))), p)
        for i, p in enumerate(names)
    ]))
    return scores.join(limits.drop("n"), ["scene_id", "sample"]).withColumn("policy", F.explode(passed)).select(
        *scores.columns, "policy"
    )


def split_labels(labels: DataFrame, block: int = 256, modulo: int = 5) -> DataFrame:
    """Every fifth depth block is held out."""
    held = F.floor(F.col("line") / block) % modulo == 0
    return labels.withColumn("split", F.when(held, "holdout").otherwise("training"))


# fixed values: multiples of the scene noise
NOISE_FACTOR = {"conservative": 3.0, "balanced": 2.2, "sensitive": 1.5}
POLICIES = ("conservative", "balanced", "sensitive")


def resolve_policies(scores: DataFrame, noise: DataFrame, policies: Mapping[str, Mapping]) -> DataFrame:
    """``scene_id, policy`` with the scene threshold and the depth floor.

    The floor is the larger of the catalog's and a multiple of the scene noise.
    """
    names = list(policies)
    scene = exact_quantiles(scores, ["scene_id"], "score", [scene_fraction(policies[p]) for p in names])
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("policy"), F.col(f"q{i}").alias("scene_threshold"),
            F.lit(float(policies[p].get("absolute_sam_threshold_rad", float("inf")))).alias("absolute_threshold"),
            F.greatest(F.lit(float(policies[p].get("minimum_absorption_depth", 0.0))),
                       NOISE_FACTOR[p] * F.col("noise")).alias("minimum_depth"),
        ) for i, p in enumerate(names)
    ])
    return scene.join(noise, "scene_id").select("scene_id", F.inline(rows))


# --- threshold search ------------------------------------------------------

# fixed values: largest accepted share of a scene
COVERAGE_CAP = {"conservative": 0.08, "balanced": 0.18, "sensitive": 0.30}


def search_grid(policies: Mapping[str, Mapping], policy: str, steps: int = 5) -> tuple[list[float], list[float]]:
    """Percentile and absolute candidates between the strictest and widest policy."""

    def values(name: str) -> list[float]:
        given = [float(p[name]) for p in policies.values() if name in p]
        lo, hi = min(given), max(given)
        spread = [lo + (hi - lo) * k / max(steps - 1, 1) for k in range(steps)]
        return sorted({round(x, 12) for x in [*spread, float(policies[policy][name])]})

    return values("column_percentile"), values("absolute_sam_threshold_rad")


def fixed_column_penalty(hits: DataFrame, valid: DataFrame, blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Root of (peak severity x share of the hits in suspicious columns)."""
    keys = ["scene_id"]
    spans = blocks.select("scene_id", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    exposed = columns.in_blocks(valid.select("scene_id", "line", "sample"), spans).groupBy("scene_id", "_a", "sample").agg(F.count(F.lit(1)).alias("valid"))
    counted = columns.in_blocks(hits.select(*keys, "line", "sample"), spans).groupBy(*keys, "_a", "sample").agg(F.count(F.lit(1)).alias("hits"))
    totals = hits.groupBy(*keys, "sample").agg(F.count(F.lit(1)).alias("n"))
    return penalty_of_counts(exposed, counted, totals, frames, keys)


def penalty_of_counts(exposed: DataFrame, counted: DataFrame, totals: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The penalty from pixels and hits per block ``_a`` and column, and all hits per column."""
    cells = totals.select(*keys).distinct().join(exposed, "scene_id")
    share = cells.join(counted, [*keys, "_a", "sample"], "left").select(
        *keys, "_a", "sample", (F.coalesce("hits", F.lit(0)) / F.col("valid")).alias("d"))
    # a block in which a column has no material counts as density 0
    used = exposed.select("scene_id", "_a").distinct().groupBy("scene_id").agg(F.count(F.lit(1)).alias("blocks"))
    gathered = share.groupBy(*keys, "sample").agg(F.collect_list("d").alias("ds")).join(used, "scene_id")
    padded = F.concat("ds", F.array_repeat(F.lit(0.0), (F.col("blocks") - F.size("ds")).cast("int")))
    from ..functions import arrays as A

    persistent = gathered.select(*keys, "sample", A.median(padded).alias("p"))
    packed = columns.dense(persistent, keys, ["p"], frames).withColumn("p", F.transform("p", lambda x: F.coalesce(x, F.lit(0.0))))
    local = packed.withColumn("local", columns.neighbour_median(F.col("p"), 3, 0, 1, F.lit(None).cast("double"))).withColumn("whole", A.median(F.col("p")))
    severity = F.zip_with("p", "local", lambda p, m: F.least(F.greatest(
        (F.greatest(p - F.coalesce(m, F.col("whole")), F.lit(0.0)) - 0.03) / 0.20, F.lit(0.0)), F.lit(1.0)))
    rows = columns.column_rows(local.withColumn("severity", severity), keys, ["severity"])
    joined = rows.join(totals, [*keys, "sample"], "left").groupBy(*keys).agg(
        F.max("severity").alias("peak"), F.sum("n").alias("all"), F.sum(F.when(F.col("severity") > 0, F.col("n"))).alias("bad"))
    return joined.select(*keys, F.when(
        (F.col("all") > 0) & (F.col("peak") > 0), F.sqrt(F.col("peak") * F.coalesce("bad", F.lit(0)) / F.col("all"))).otherwise(0.0).alias("column_penalty"))


def _pair_counts(
    rows: DataFrame, percentiles: Sequence[float], absolutes: Sequence[float], edge_width: int, isolated_pixels: int, tile_lines: int = 512
) -> DataFrame:
    """Hits per pair, block and column, those at run ends and those in small patches.

    A pixel passes the percentiles whose bit ``_p`` has, and the absolute
    limits from ``_first`` on.  A patch of fewer than ``isolated_pixels`` cells
    lies within so many lines of each of its cells, and of a larger one at least
    so many cells do: haloed tiles tell both, and no patch is followed further.
    """
    halo, width = max(isolated_pixels - 1, 0), max(edge_width, 1)
    kind = rows.schema["scene_id"].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        tile = grid.Tile(table, halo, width, tile_lines)
        bits, first, start = (table.column(c).to_numpy() for c in ("_p", "_first", "_a"))
        present = tile.plane(1.0) > 0
        edge = ~np.logical_and.reduce([present[tile.at[0], tile.at[1] + d] for d in range(-width, width + 1)])
        places, place = np.unique(np.stack([start, tile.sample], 1), axis=0, return_inverse=True)
        place = place.reshape(-1)
        found = []
        for i, p in enumerate(percentiles):
            for j, a in enumerate(absolutes):
                at = np.flatnonzero(((bits >> i) & 1 == 1) & (first <= j))
                home = tile.home[at]
                if not home.any():
                    continue
                _, label, size = np.unique(CC.tile_labels(tile.line[at], tile.sample[at]), return_inverse=True, return_counts=True)
                small = size[label][home] < isolated_pixels
                which = at[home]
                hits, edges, smalls = (
                    np.bincount(place[which], w, len(places)).astype(np.int64) for w in (None, edge[which], small))
                full = np.flatnonzero(hits)
                found.append([np.full(len(full), p), np.full(len(full), a), *places[full].T, hits[full], edges[full], smalls[full]])
        values = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 7
        types = [pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["percentile", "absolute", "_a", "sample", "hits", "edges", "small"]
        made = {n: pa.array(x).cast(k) for n, x, k in zip(names, values, types)}
        return pa.table({"scene_id": pa.repeat(table.column("scene_id")[0], len(values[0]))} | made)

    haloed = grid.with_halo(rows.select("scene_id", "line", "sample", "_a", "_p", "_first"), halo, tile_lines).drop("home")
    return haloed.groupBy("scene_id", "tile").applyInArrow(
        count, f"scene_id {kind}, percentile double, absolute double, _a long, sample int, hits long, edges long, small long")


def candidate_terms(
    scores: DataFrame, valid: DataFrame, frames: DataFrame, blocks: DataFrame, percentiles: Sequence[float], absolutes: Sequence[float],
    edge_width: int = 2, isolated_pixels: int = 4,
) -> DataFrame:
    """Every (percentile, absolute) pair of a scene with its pixels and terms, which depend on no policy.

    A sampled pixel meets its column's thresholds once and keeps which it
    passes; tiles then count all pairs together.  Blocks do not overlap.
    """
    percentiles, absolutes = sorted(percentiles), sorted(absolutes)
    if len(percentiles) > 62:
        raise ValueError("more than 62 percentiles to search")
    spans = blocks.select("scene_id", F.col("start").cast("long").alias("_a"), F.col("stop").cast("long").alias("_b"))
    material = columns.in_blocks(valid.select("scene_id", "line", "sample"), spans)
    sampled = durable(columns.in_blocks(scores.select("scene_id", "line", "sample", "score"), spans).join(
        material, ["scene_id", "line", "sample"], "left_semi").select("scene_id", "line", "sample", "score", "_a"))
    limits = durable(columns.column_thresholds(sampled, frames, percentiles, minimum=1, radius=1, whole_scene=False).select(
        "scene_id", "sample", *[f"t{i}" for i in range(len(percentiles))]))
    bits, over = F.lit(0).cast("long"), F.lit(0)
    for i in range(len(percentiles)):
        bits = bits + F.when(F.col("score") <= F.col(f"t{i}"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    for a in absolutes:
        over = over + F.when(F.col("score") <= a, 0).otherwise(1)
    marked = durable(sampled.join(limits, ["scene_id", "sample"]).select(
        "scene_id", "line", "sample", "score", "_a", bits.alias("_p"), over.alias("_first")))
    counts = durable(_pair_counts(marked, percentiles, absolutes, edge_width, isolated_pixels))
    keys = ["scene_id", "percentile", "absolute"]
    pairs = [(i, j, F.struct(F.lit(p).alias("percentile"), F.lit(a).alias("absolute"))) for i, p in enumerate(percentiles) for j, a in enumerate(absolutes)]
    passed = F.array_compact(F.array(*[
        F.when(F.col("_p").bitwiseAND(F.lit(1 << i)).cast("boolean") & (F.col("_first") <= j), pair) for i, j, pair in pairs]))
    hits = marked.where(F.col("_first") < len(absolutes)).select("scene_id", "score", F.explode(passed).alias("c")).select(
        "scene_id", "score", "c.percentile", "c.absolute")
    middle = exact_quantiles(hits, keys, "score", [0.5]).select(*keys, F.col("q0").alias("_median"))
    size = sampled.groupBy("scene_id").agg(F.count(F.lit(1)).alias("sample_pixels"))
    sums = counts.groupBy(*keys).agg(
        F.sum("hits").alias("pixels"), (F.sum("edges") / F.sum("hits")).alias("edge_penalty"), (F.sum("small") / F.sum("hits")).alias("isolated"))
    exposed = sampled.groupBy("scene_id", "_a", "sample").agg(F.count(F.lit(1)).alias("valid"))
    counted = counts.groupBy(*keys, "_a", "sample").agg(F.sum("hits").alias("hits"))
    totals = counts.groupBy(*keys, "sample").agg(F.sum("hits").alias("n"))
    penalty = penalty_of_counts(exposed, counted, totals, frames, keys)
    table = size.select("scene_id", "sample_pixels", F.inline(F.array(*[pair for _, _, pair in pairs])))
    for part in (sums, middle, penalty):
        table = table.join(part, keys, "left")
    return table


def search_policies(
    scores: DataFrame, valid: DataFrame, frames: DataFrame, blocks: DataFrame, policies: Mapping[str, Mapping], searched: Sequence[str],
    steps: int = 5, minimum_pixels: int = 16, hard_coverage: float = 0.65, edge_width: int = 2, isolated_pixels: int = 4,
) -> dict[str, DataFrame]:
    """Of each searched policy every (percentile, absolute) candidate with its terms and objective.

    The terms are measured once for the candidates of all of them.
    """
    grids = {policy: search_grid(policies, policy, steps) for policy in searched}
    every = [sorted({x for g in grids.values() for x in g[k]}) for k in (0, 1)]
    terms = durable(candidate_terms(scores, valid, frames, blocks, *every, edge_width, isolated_pixels))
    c = F.col
    found = {}
    for policy, (percentiles, absolutes) in grids.items():
        reference, cap = max(absolutes), min(COVERAGE_CAP.get(policy, 0.18), hard_coverage)
        none = c("pixels").isNull()
        table = terms.where(c("percentile").isin(percentiles) & c("absolute").isin(absolutes)).withColumns({
            "pixels": F.coalesce("pixels", F.lit(0)), "edge_penalty": F.coalesce("edge_penalty", F.lit(1.0)),
            "isolated": F.coalesce("isolated", F.lit(1.0)), "column_penalty": F.when(none, 1.0).otherwise(F.coalesce("column_penalty", F.lit(0.0))),
            "evidence": F.coalesce(F.least(F.greatest((reference - c("_median")) / reference, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)),
        }).withColumn("coverage", c("pixels") / c("sample_pixels")).withColumn("accepted", (c("pixels") >= minimum_pixels) & (c("coverage") <= hard_coverage))
        target = max(min(cap * 0.25, 0.05), 0.005)
        over = F.pow(F.greatest((c("coverage") - cap) / cap, F.lit(0.0)), 2)
        objective = (
            1.25 * c("evidence") + 0.35 * F.least(c("coverage") / target, F.lit(1.0)) + 0.25 * (1.0 - c("isolated"))
            - 0.90 * c("column_penalty") - 0.45 * c("edge_penalty") - 0.55 * c("isolated") - 1.35 * over)
        found[policy] = table.withColumn("overcoverage", over).withColumn("objective", F.when(c("accepted"), objective)).drop("_median")
    return found


def search_thresholds(
    scores: DataFrame, valid: DataFrame, frames: DataFrame, blocks: DataFrame, policies: Mapping[str, Mapping], policy: str, steps: int = 5, **limits
) -> DataFrame:
    """``search_policies`` for one policy."""
    return search_policies(scores, valid, frames, blocks, policies, [policy], steps, **limits)[policy]


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Accepted candidate with the largest objective, NULLs when none passes."""
    down = lambda n: (-F.col(n)).alias(n)
    key = F.struct("objective", down("column_penalty"), down("edge_penalty"), down("isolated"), down("overcoverage"),
                   down("coverage"), down("absolute"), down("percentile"))
    best = candidates.groupBy("scene_id").agg(F.max(F.when(F.col("accepted"), key)).alias("b"))
    return best.select(
        "scene_id", F.when(F.col("b").isNull(), "blocked").otherwise("resolved").alias("status"),
        (-F.col("b.percentile")).alias("percentile"), (-F.col("b.absolute")).alias("absolute"), F.col("b.objective").alias("objective"))


def joint_objective(objective: Column, ready: Column, pixels: Column) -> Column:
    """Objective with feature support: log-scaled ready pixels and their share."""
    support = F.least(F.log1p(ready) / F.log1p(F.lit(64.0)), F.lit(1.0))
    return (objective + 0.35 * support + 0.15 * F.sqrt(ready / F.greatest(pixels, F.lit(1)))
            - F.when(ready == 0, 0.20).otherwise(0.0))


def threshold_trial(
    per_policy: Mapping[str, DataFrame], ready: Mapping[str, DataFrame], overrides: Mapping[str, Mapping[str, float]] | None = None
) -> DataFrame:
    """Pick one candidate per policy so that thresholds never tighten from
    conservative to sensitive; a user override replaces the picked value."""
    keys = ["scene_id", "percentile", "absolute"]
    scenes = durable(reduce(DataFrame.union, [df.select("scene_id") for df in per_policy.values()]).distinct())
    floor = scenes.select("scene_id", F.lit(float("-inf")).alias("_p"), F.lit(float("-inf")).alias("_a"))
    out = None
    for policy in POLICIES:
        rows = per_policy[policy].join(ready[policy], keys, "left").withColumn("ready", F.coalesce("ready", F.lit(0)))
        rows = rows.withColumn("joint", joint_objective(F.col("objective"), F.col("ready"), F.col("pixels")))
        rows = rows.join(floor, "scene_id").where("percentile >= _p - 1e-12 and absolute >= _a - 1e-12")
        key = F.struct("joint", "ready", (-F.col("column_penalty")).alias("cp"), (-F.col("edge_penalty")).alias("ep"),
                       (-F.col("absolute")).alias("a"), (-F.col("percentile")).alias("p"))
        fixed = (overrides or {}).get(policy, {})
        best = rows.where("accepted").groupBy("scene_id").agg(F.max(key).alias("b"))
        found = F.col("b").isNotNull()
        given = lambda name, own: F.when(found, F.coalesce(F.lit(fixed.get(name)).cast("double"), own))
        # a scene without an accepted candidate is blocked here and keeps its limits for the weaker policies
        picked = durable(scenes.join(best, "scene_id", "left").select(
            "scene_id", F.lit(policy).alias("policy"), F.when(found, "resolved").otherwise("blocked").alias("status"),
            given("column_percentile", -F.col("b.p")).alias("percentile"), given("absolute_sam_threshold_rad", -F.col("b.a")).alias("absolute"),
            F.col("b.joint").alias("joint"), F.col("b.ready").alias("ready")))
        floor = durable(floor.join(picked, "scene_id").select(
            "scene_id", F.coalesce("percentile", "_p").alias("_p"), F.coalesce("absolute", "_a").alias("_a")))
        out = picked if out is None else out.unionByName(picked)
    return out


# --- learning from reviewed labels ----------------------------------------

# fixed values: recall targets of training positives
RECALL = {"conservative": 0.80, "balanced": 0.93, "sensitive": 0.985}
CANDIDATE_COVERAGE = {"conservative": 0.20, "balanced": 0.38, "sensitive": 0.60}


def detection_thresholds(scored: DataFrame, current: Mapping[str, float], minimum: int = 100) -> DataFrame:
    """Threshold per policy from labels: recall of training positives, capped by scene coverage.

    ``scored`` is (scene_id, score, positive, split); also reports both recalls.  A scene with fewer
    than ``minimum`` training positives keeps the ``current`` thresholds and says so in ``status``.
    """
    positive, training = F.col("positive"), F.col("split") == "training"
    labels = scored.groupBy("scene_id").agg(F.sum((positive & training).cast("long")).alias("training_pixels"))
    recall = exact_quantiles(scored.where(positive & training), ["scene_id"], "score", [RECALL[p] for p in POLICIES])
    cover = exact_quantiles(scored, ["scene_id"], "score", [CANDIDATE_COVERAGE[p] for p in POLICIES])
    known = labels.join(recall.select("scene_id", *[F.col(f"q{i}").alias(f"r{i}") for i in range(3)]), "scene_id", "left").join(
        cover.select("scene_id", *[F.col(f"q{i}").alias(f"c{i}") for i in range(3)]), "scene_id", "left")
    enough = F.col("training_pixels") >= minimum
    status = F.when(enough, "resolved").otherwise("insufficient_training_labels")
    rows = known.select("scene_id", "training_pixels", status.alias("status"), F.inline(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.when(enough, F.least(f"r{i}", f"c{i}")).otherwise(F.lit(float(current[p]))).alias("threshold"))
        for i, p in enumerate(POLICIES)])))
    inside, learned = F.col("score") <= F.col("threshold"), F.col("status") == "resolved"
    share = lambda test: F.try_divide(F.sum((learned & inside & test).cast("long")), F.sum((learned & test).cast("long")))
    return scored.join(rows, "scene_id").groupBy("scene_id", "policy", "threshold", "status", "training_pixels").agg(
        share(positive & training).alias("training_recall"), share(positive & (F.col("split") == "holdout")).alias("holdout_recall"),
        share(F.lit(True)).alias("coverage"))


def domain_offsets(mineral_scores: DataFrame, strength: float, cap: float) -> DataFrame:
    """Per-mineral shift: median above the group's lowest median, scaled and capped."""
    medians = exact_quantiles(mineral_scores, ["scene_id", "group_no", "mineral"], "score", [0.5])
    low = medians.groupBy("scene_id", "group_no").agg(F.min("q0").alias("_low"))
    return medians.join(low, ["scene_id", "group_no"]).select(
        "scene_id", "group_no", "mineral", F.col("q0").alias("median"),
        F.least(F.greatest(strength * (F.col("q0") - F.col("_low")), F.lit(0.0)), F.lit(cap)).alias("offset"))


def score_offsets(sample: DataFrame, minerals: int, maximum: float = 0.45, ridge: float = 0.02, rounds: int = 25) -> list[float]:
    """Class-balanced multinomial intercepts per mineral.

    ``sample`` is (scores ARRAY, label INT), already thinned per class.  Each
    Newton round is one aggregation that returns a gradient and a Hessian of
    mineral-count size, so only those small sums reach the driver.
    """
    import numpy as np

    from ..functions import arrays as A

    weights = sample.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    classes = weights.count()
    gap = F.sort_array("scores")[1] - F.sort_array("scores")[0]
    rows = durable(sample.join(weights, "label").select(
        "scores", "label", (1.0 / (F.col("_n") * classes)).alias("w"), gap.alias("gap")))
    temperature = max(float(exact_quantiles(rows.withColumn("k", F.lit(1)), ["k"], "gap", [0.5]).first()["q0"]), 0.03)
    b = np.zeros(minerals)
    for _ in range(rounds):
        shift = A.literal_doubles(b)
        logits = F.zip_with("scores", shift, lambda s, k: -s / temperature + k)
        raw = A.let(logits, lambda l: A.let(F.array_max(l), lambda top: F.transform(l, lambda x: F.exp(x - top))))
        p = rows.select("label", "w", A.let(raw, lambda e: A.let(A.total(e), lambda z: F.transform(e, lambda x: x / z))).alias("p"))
        cell = lambda i: F.col("p")[i]
        target = lambda i: (F.col("label") == i).cast("double")
        sums = p.agg(
            *[F.sum(F.col("w") * (target(i) - cell(i))).alias(f"g{i}") for i in range(minerals)],
            *[F.sum(F.col("w") * cell(i) * ((1.0 if i == j else 0.0) - cell(j))).alias(f"h{i}_{j}")
              for i in range(minerals) for j in range(i, minerals)],
        ).first()
        gradient = np.array([sums[f"g{i}"] for i in range(minerals)]) - ridge * b
        hessian = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(minerals)] for i in range(minerals)])
        step = np.linalg.solve(hessian + ridge * np.eye(minerals), gradient)
        b = b + step
        b -= b.mean()
        if np.max(np.abs(step - step.mean())) < 1e-10:
            break
    offsets = np.clip(b * temperature, -maximum, maximum)
    return [float(x) for x in offsets - offsets.mean()]


# fixed values: ends of learned windows
GATE_QUANTILES = {"conservative": (0.10, 0.90), "balanced": (0.02, 0.98), "sensitive": (0.005, 0.995)}
GATE_FLOOR = {"conservative": 0.35, "balanced": 0.10, "sensitive": 0.02}


def feature_gates(training: DataFrame, keys: Sequence[str], center: str, window: tuple[float, float], minimum: str, catalog_minimum: float) -> DataFrame:
    """Centre window and feature minimum per policy from training positives."""
    keys = list(keys)
    ends = [GATE_QUANTILES[p] for p in POLICIES]
    c = exact_quantiles(training, keys, center, [q for pair in ends for q in pair]).drop("n")
    m = exact_quantiles(training, keys, minimum, [pair[0] for pair in ends]).drop("n")
    m = m.select(*keys, *[F.col(f"q{i}").alias(f"m{i}") for i in range(3)])
    rows = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.greatest(F.lit(window[0]), F.col(f"q{2 * i}")).alias("center_lo"),
                 F.least(F.lit(window[1]), F.col(f"q{2 * i + 1}")).alias("center_hi"),
                 F.greatest(F.lit(0.0), F.col(f"m{i}"), F.lit(GATE_FLOOR[p] * catalog_minimum)).alias("minimum"),
                 F.lit("any" if p == "sensitive" else "all").alias("match"))
        for i, p in enumerate(POLICIES)])
    return c.join(m, keys).select(*keys, F.inline(rows))


def gate_model(training: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Scaled diagonal two-class model per key, one row of parameters each.

    ``training`` has a boolean ``positive``; missing values take the median.
    """
    keys = list(keys)
    long = training.select(*keys, "positive", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    by = [*keys, "feature"]
    mid = exact_quantiles(long, by, "x", [0.5]).select(*by, F.col("q0").alias("median"))
    filled = durable(long.join(mid, by, "left").select(*by, "positive", F.coalesce("x", "median", F.lit(0.0)).alias("x"), F.coalesce("median", F.lit(0.0)).alias("median")))
    ends = exact_quantiles(filled, by, "x", [0.25, 0.75])
    spread = filled.groupBy(*by, "median").agg(F.stddev_pop("x").alias("_std")).join(ends, by)
    iqr = F.col("q1") - F.col("q0")
    scale = F.when(iqr > 1e-8, iqr).when(F.col("_std") > 1e-8, F.col("_std")).otherwise(1.0)
    scaled = spread.select(*by, "median", scale.alias("scale"))
    moments = filled.drop("median").join(scaled, by).groupBy(*by, "median", "scale").agg(*[
        agg(F.when(test, (F.col("x") - F.col("median")) / F.col("scale"))).alias(name)
        for agg, test, name in (
            (F.avg, F.col("positive"), "mp"), (F.avg, ~F.col("positive"), "mn"),
            (F.var_pop, F.col("positive"), "vp"), (F.var_pop, ~F.col("positive"), "vn"))])
    floored = moments.withColumns({"vp": F.greatest("vp", F.lit(0.20)), "vn": F.greatest("vn", F.lit(0.20))})
    return floored.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("median", "scale", "mp", "mn", "vp", "vn")))).alias("model"))


def gate_score(features: Sequence[str]) -> Column:
    """Log-likelihood ratio of a row under ``model``."""
    total = F.lit(0.0)
    for f in features:
        m = F.col("model")[f]
        z = (F.coalesce(F.col(f).cast("double"), m["median"]) - m["median"]) / m["scale"]
        total = total - 0.5 * (F.pow(z - m["mp"], 2) / m["vp"] + F.log(m["vp"]) - F.pow(z - m["mn"], 2) / m["vn"] - F.log(m["vn"]))
    return total


def _threshold_table(scores: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """True and false positive rates at each distinct quantile of the scores.

    Scores are counted between thresholds and summed from above, so no pixel
    meets every threshold.
    """
    keys = list(keys)
    fractions = [0.02 + 0.96 * i / (steps - 1) for i in range(steps)]
    cuts = exact_quantile_array(scores, keys, "s", fractions).select(*keys, F.array_sort(F.array_distinct("qs")).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c <= F.col("s")))
    bins = scores.join(cuts, keys).groupBy(*keys, at.alias("at")).agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    below = W.partitionBy(*keys).orderBy(F.desc("at"))
    every = W.partitionBy(*keys)
    rates = bins.select(
        *keys, "at", (F.sum("p").over(below) / F.sum("p").over(every)).alias("recall"), (F.sum("n").over(below) / F.sum("n").over(every)).alias("fpr"),
        F.sum("p").over(every).alias("np"), F.sum("n").over(every).alias("nn"))
    # a cut without scores of its own repeats the rates of the next filled one
    listed = cuts.select(*keys, F.posexplode("cuts").alias("i", "threshold")).withColumn("at", F.col("i") + 1)
    filled = W.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    both = listed.join(rates, [*keys, "at"], "full_outer")
    return both.select(*keys, "threshold", *[F.last(c, True).over(filled).alias(c) for c in ("recall", "fpr", "np", "nn")]).where("threshold is not null").fillna(0.0, ["recall", "fpr"])


def gate_threshold(scores: DataFrame, keys: Sequence[str], steps: int = 161) -> DataFrame:
    """Score cut with the best F1, penalised below 0.55 recall."""
    keys = list(keys)
    table = _threshold_table(scores, keys, steps)
    prevalence = F.col("np") / (F.col("np") + F.col("nn"))
    hit = prevalence * F.col("recall")
    precision = hit / F.greatest(hit + (1.0 - prevalence) * F.col("fpr"), F.lit(1e-12))
    f1 = 2.0 * precision * F.col("recall") / F.greatest(precision + F.col("recall"), F.lit(1e-12))
    utility = f1 - 0.15 * F.greatest(0.55 - F.col("recall"), F.lit(0.0))
    best = table.groupBy(*keys).agg(F.max(F.struct(
        utility.alias("u"), "recall", precision.alias("precision"), (-F.col("fpr")).alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.recall").alias("recall"), (-F.col("b.f")).alias("fpr"))


def axis_threshold(rows: DataFrame, keys: Sequence[str], features: Sequence[str], minimum_recall: float = 0.40, steps: int = 97) -> DataFrame:
    """Best single-feature cut in either direction, when the model finds too little."""
    keys = list(keys)
    long = rows.select(*keys, "positive", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"), (d * F.col(f).cast("double")).alias("s"))
        for f in features for d in (-1, 1)]))).where("s is not null")
    table = _threshold_table(long, [*keys, "feature", "direction"], steps).where(F.col("recall") >= minimum_recall)
    best = table.groupBy(*keys).agg(F.max(F.struct(
        (F.col("recall") - F.col("fpr")).alias("utility"), "recall", (-F.col("fpr")).alias("f"), "feature", "direction", "threshold")).alias("b"))
    return best.select(*keys, "b.feature", "b.direction", (F.col("b.direction") * F.col("b.threshold")).alias("threshold"), "b.recall", "b.utility")


# fixed values: recall targets and area caps of learned gates
EVIDENCE_RECALL = {"conservative": 0.55, "balanced": 0.82, "sensitive": 0.95}
AREA_FACTOR = {"conservative": 0.85, "balanced": 1.75, "sensitive": 3.00}
DOMAIN_SHARE = {"conservative": 0.04, "balanced": 0.25, "sensitive": 0.25}


def evidence_gates(scored: DataFrame, keys: Sequence[str], base: DataFrame, identity: Sequence[str], minimum: int = 25) -> DataFrame:
    """Pixels inside each policy's gate.

    ``scored`` is (keys, identity, s, positive, split); ``base`` the F1 cut.
    The cut follows the recall target, and an area cap keeps the strongest.
    A key with fewer than ``minimum`` training pixels of either kind has no gate: all its pixels
    pass, with status ``insufficient_training_labels``.
    """
    keys = list(keys)
    training = F.col("split") == "training"
    sizes = scored.groupBy(*keys).agg(
        F.sum(F.col("positive").cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"),
        F.sum((training & F.col("positive")).cast("long")).alias("_tp"), F.sum((training & ~F.col("positive")).cast("long")).alias("_tn"))
    sizes = durable(sizes.withColumn("_few", (F.col("_tp") < minimum) | (F.col("_tn") < minimum)))
    recall = exact_quantiles(scored.where(training & F.col("positive")), keys, "s", [1.0 - EVIDENCE_RECALL[p] for p in POLICIES])
    merged = recall.drop("n").join(base.select(*keys, "threshold"), keys).join(sizes.where("not _few"), keys)
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("policy"),
            (F.greatest if p == "conservative" else F.least)(F.col("threshold"), F.col(f"q{i}")).alias("cut"),
            F.greatest(F.lit(1), F.rint(AREA_FACTOR[p] * F.col("_p")), F.rint(DOMAIN_SHARE[p] * F.col("_n"))).cast("long").alias("cap"))
        for i, p in enumerate(POLICIES)])
    limits = merged.select(*keys, F.inline(rows))
    inside = scored.join(limits, keys).where("s >= cut")
    learned = strongest(inside, [*keys, "policy"], "s", list(identity), "cap").select(*keys, "policy", *identity, "s", F.lit("resolved").alias("status"))
    poor = scored.join(sizes.where("_few").select(*keys), keys).select(
        *keys, F.explode(F.array(*[F.lit(p) for p in POLICIES])).alias("policy"), *identity, "s", F.lit("insufficient_training_labels").alias("status"))
    return learned.unionByName(poor)


def consensus_floor(catalog: Column, policy: Column, references: Column) -> Column:
    """A policy asks for two agreeing references when strict, one otherwise, never
    more than exist, and never more than the catalog says."""
    needed = F.when(policy == "conservative", 2).otherwise(1)
    count = F.greatest(references, F.lit(1))
    return F.least(catalog, F.least(needed, count) / count)


# fixed values: quantiles of adaptive confidence
CONFIDENCE_Q = {"conservative": 0.60, "balanced": 0.25, "sensitive": 0.05}
LABEL_Q = {"conservative": 0.35, "balanced": 0.15, "sensitive": 0.05}


def adaptive_confidence(evidence: DataFrame, catalog: Mapping[str, float], label_minimum: int, safe_floor: bool = False) -> DataFrame:
    """Confidence threshold per scene, policy and mineral.

    ``evidence`` is (scene_id, policy, mineral, confidence, labelled); labelled
    training pixels may lower a threshold, never below 0.20.
    """
    keys = ["scene_id", "policy", "mineral"]
    fractions = [CONFIDENCE_Q[p] for p in POLICIES]
    scene = exact_quantiles(evidence, keys, "confidence", fractions).drop("n")
    label = exact_quantiles(evidence.where("labelled"), keys, "confidence", [LABEL_Q[p] for p in POLICIES]).select(
        *keys, F.col("n").alias("_n"), *[F.col(f"q{i}").alias(f"l{i}") for i in range(3)])
    joined = scene.join(label, keys, "left")

    def pick(prefix: str) -> Column:
        out = F.lit(None).cast("double")
        for i, p in enumerate(POLICIES):
            out = F.when(F.col("policy") == p, F.col(f"{prefix}{i}")).otherwise(out)
        return out

    floor = F.create_map(*[x for p in POLICIES for x in (F.lit(p), F.lit(float(catalog[p])))])[F.col("policy")]
    own = (F.greatest if safe_floor else F.least)(floor, pick("q"))
    learned = F.greatest(F.lit(0.20), F.least(own, pick("l")))
    return joined.select(*keys, F.when(F.coalesce(F.col("_n") >= label_minimum, F.lit(False)), learned).otherwise(own).alias("threshold"))


# fixed values: quantiles and floors of protection
PROTECTION_Q = {"conservative": 0.50, "balanced": 0.65, "sensitive": 0.80}
PROTECTION_FLOOR = {"conservative": 0.55, "balanced": 0.50, "sensitive": 0.55}


def protection_thresholds(accepted: DataFrame, ceiling: float = 0.72) -> DataFrame:
    """Strong-evidence level per scene, policy and class from low-risk columns.

    ``accepted`` is (scene_id, policy, class_id, confidence, risk).
    """
    keys = ["scene_id", "policy", "class_id"]
    damped = accepted.where("risk < 0.5").withColumn("_c", F.col("confidence") * (1.0 - 0.35 * F.col("risk")))
    q = exact_quantiles(damped, keys, "_c", [PROTECTION_Q[p] for p in POLICIES])
    out = F.lit(None).cast("double")
    for i, p in enumerate(POLICIES):
        out = F.when(F.col("policy") == p, F.greatest(F.lit(PROTECTION_FLOOR[p]), F.least(F.lit(ceiling), F.col(f"q{i}")))).otherwise(out)
    return q.select(*keys, out.alias("protection"))


def saturation(pixels: DataFrame, keys: Sequence[str], level: str, fraction: float = 0.999) -> DataFrame:
    """Flag pixels at or above the scene's top reflectance quantile."""
    top = exact_quantiles(pixels, keys, level, [fraction]).select(*keys, F.col("q0").alias("_top"))
    return pixels.join(top, list(keys)).withColumn("saturated", F.col(level) >= F.col("_top")).drop("_top")
