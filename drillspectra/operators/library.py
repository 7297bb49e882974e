"""Reference-library curation and selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions import arrays as A, kernels as K, spectral as S
from ..session import durable
from . import grid
from .components import connected_roots


def rank_score(value: str, tie: str, keys: Sequence[str], lower_is_better: bool = False) -> Column:
    """0-1 by rank within the key, 0.5 when there is nothing to compare with."""
    order = W.partitionBy(*keys).orderBy(value, tie)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    share = (F.row_number().over(order) - 1) / (n - 1)
    return F.when(n <= 1, 0.5).otherwise(1 - share if lower_is_better else share)


# --- curves ---------------------------------------------------------------

def _prepared(w, v, ceiling: float = 1e6):
    w, v = np.asarray(w, dtype=float), np.asarray(v, dtype=float)
    ok = np.isfinite(w) & np.isfinite(v) & (v > 0) & (np.abs(v) < ceiling)
    unique, inverse = np.unique(w[ok], return_inverse=True)
    return unique, np.bincount(inverse, weights=v[ok]) / np.maximum(np.bincount(inverse), 1) if len(unique) else unique


def _allowed_gap(w: np.ndarray) -> float:
    steps = np.diff(w)
    steps = steps[steps > 0]
    return max(45.0, 8.0 * (float(np.median(steps)) if len(steps) else 1.0))


def resample(targets: Sequence[float], fwhm: Sequence[float] | None = None, gap: float | None = None):
    """Arrow function ``(wavelengths, values) -> values on the target axis``.

    Without FWHM: linear, NULL outside and across wide gaps.  With FWHM: a
    Gaussian over three sigma with at least two points.
    """
    axis = np.asarray(targets, dtype=float)
    sigma = None if fwhm is None else np.asarray(fwhm, dtype=float) / 2.354820045

    def linear(w, v):
        out = np.interp(axis, w, v, left=np.nan, right=np.nan)
        right = np.clip(np.searchsorted(w, axis), 0, len(w) - 1)
        wide = (w[right] - w[np.maximum(right - 1, 0)] > (gap or _allowed_gap(w))) & ~np.isclose(w[right], axis)
        out[wide] = np.nan
        return out

    def gaussian(w, v):
        near = np.abs(w[None, :] - axis[:, None]) <= 3.0 * sigma[:, None]
        weight = np.where(near, np.exp(-0.5 * ((w[None, :] - axis[:, None]) / sigma[:, None]) ** 2), 0.0)
        out = np.full(len(axis), np.nan)
        limit = _allowed_gap(w)
        for k in np.flatnonzero(near.sum(axis=1) >= 2):
            if np.diff(w[near[k]]).max() <= limit:
                out[k] = (weight[k] * v).sum() / weight[k].sum()
        return out

    @arrow_udf(K.DOUBLES)
    def kernel(wavelengths: pa.Array, values: pa.Array) -> pa.Array:
        rows = []
        for w, v in zip(wavelengths.to_pylist(), values.to_pylist()):
            if w is None or v is None:
                rows.append(np.full(len(axis), np.nan))
                continue
            x, y = _prepared([np.nan if i is None else i for i in w], [np.nan if i is None else i for i in v])
            rows.append(np.full(len(axis), np.nan) if len(x) < 2 else (linear if sigma is None else gaussian)(x, y))
        return K._lists(np.array(rows).reshape(len(rows), len(axis)))

    return kernel


def curve_quality(coverage: Column, roughness: Column, depth: Column) -> Column:
    """0-1 from coverage, smoothness and contrast; a roughness that is NaN counts as rough."""
    return F.least(F.greatest(
        0.55 * coverage + 0.25 * (1.0 - F.least(roughness / 0.25, F.lit(1.0)))
        + 0.20 * F.least(depth / 0.10, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def diagnostics(values: Column, axis: Sequence[float], windows, minimum_coverage: float = 0.97) -> Column:
    """Coverage, depth, curvature, roughness, quality, unit shape and rejection code of a curve.

    Roughness is curvature (the median second difference) by depth.
    """
    parts = [S.window_positions(axis, [w], minimum=0) for w in windows]
    every = sorted({i for p in parts for i in p})
    present = lambda x: x.isNotNull() & ~F.isnan(x)

    def share(p):
        return F.size(F.filter(A.gather(values, p), present)) / len(p) if p else F.lit(0.0)

    coverage = F.least(*[share(p) for p in parts]) if len(parts) > 1 else share(parts[0])

    def shape_of(p):
        def curve(c):
            first, last = F.get(c, F.lit(0)), F.get(c, F.lit(len(p) - 1))
            level = F.greatest(A.median(F.transform(c, F.abs)), F.lit(1e-12))
            return A.let(level, lambda s: F.transform(c, lambda x, i: A.let(
                first + (last - first) * i / (len(p) - 1),
                lambda line: F.least(F.greatest(1.0 - x / F.when(F.abs(line) > s * 1e-8, line).otherwise(s), F.lit(0.0)), F.lit(1.5)))))

        return A.let(A.gather(values, p), curve)

    usable = [p for p in parts if len(p) >= 2]
    shape = F.concat(*[shape_of(p) for p in usable])
    second = [[(i, 1.0), (i + 1, -2.0), (i + 2, 1.0)] for i in range(sum(map(len, usable)) - 2)]

    def judge(s):
        depth, length = F.array_max(s), A.norm(s)
        bend = A.median(F.transform(A.weighted_taps(s, second), F.abs))
        rough = bend / F.greatest(depth, F.lit(1e-12))
        return A.let(F.struct(depth.alias("d"), length.alias("n"), bend.alias("b"), rough.alias("r"), coverage.alias("c")), lambda q: F.struct(
            q["c"].alias("coverage"), q["d"].alias("depth"), q["b"].alias("curvature"), q["r"].alias("roughness"),
            F.when(q["n"] > 1e-10, curve_quality(q["c"], q["r"], q["d"])).otherwise(0.0).alias("quality"),
            F.when(q["n"] > 1e-10, F.transform(s, lambda x: x / q["n"])).alias("embedding"),
            F.when(q["n"] <= 1e-10, "featureless_reference_shape").alias("rejection")))

    def refused(reason):
        return F.struct(
            coverage.alias("coverage"), *[F.lit(None).cast("double").alias(c) for c in ("depth", "curvature", "roughness")],
            F.lit(0.0).alias("quality"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(reason).alias("rejection"))

    good = A.all_positive(A.gather(values, every))
    return F.when(coverage < minimum_coverage, refused("insufficient_resampled_coverage")).when(
        ~good, refused("invalid_values_in_required_windows")).otherwise(A.let(shape, judge))


def numeric_qc(values: Column) -> Column:
    """Status, reasons and counts of a stored curve."""
    present = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))

    def judge(p):
        count = lambda test: F.size(F.filter(p, test))
        positive = count(lambda x: (x > 0) & (x < 1e6))
        flat = (F.size(p) >= 2) & (F.array_max(p) - F.array_min(p) <= 1e-8)
        hard = F.array_compact(F.array(
            F.when(F.size(p) != F.size(values), "non_finite_values"),
            F.when(positive < 2, "fewer_than_two_positive_values"), F.when(flat, "constant_curve")))
        soft = F.array_compact(F.array(
            F.when(count(lambda x: x == 0) > 0, "contains_zero_values"),
            F.when(count(lambda x: x < 0) > 0, "contains_negative_values")))
        return F.struct(
            F.when(F.size(hard) > 0, "invalid").when(F.size(soft) > 0, "review").otherwise("pass").alias("status"),
            F.concat(hard, soft).alias("reasons"), F.size(p).alias("finite"), positive.alias("positive"))

    return A.let(present, judge)


def eligibility(role: Column, purity: Column, numeric_status: Column, catalogued: Column) -> Column:
    out = (role != "mineral_reference") | purity.isin("mixture", "not_mineral_reference") | (numeric_status == "invalid")
    return F.when(out, "excluded").when(catalogued & (purity == "declared_pure"), "eligible").otherwise("review")


def label_conflicts(measurements: DataFrame, curve: str, phase: str) -> DataFrame:
    """Curve hashes that carry more than one phase.

    Distinct (curve, phase) pairs are counted, so a widely copied curve costs
    one row per phase.
    """
    pairs = measurements.select(curve, F.coalesce(phase, F.lit("")).alias("_p")).distinct()
    return pairs.groupBy(curve).agg(F.count(F.lit(1)).alias("phases")).where("phases > 1")


def curate(measurements: DataFrame) -> DataFrame:
    """Eligibility of every measurement: numeric QC, name status, label conflicts.

    Expects role, purity, catalogued, values, curve_hash and phase_id columns.
    """
    judged = measurements.withColumn("qc", numeric_qc(F.col("values"))).withColumn(
        "base_status", eligibility(F.col("record_role"), F.col("purity"), F.col("qc.status"), F.col("catalogued"))
    )
    conflicts = label_conflicts(measurements, "curve_hash", "phase_id").withColumn("label_conflict", F.lit(True))
    marked = judged.join(conflicts.drop("phases"), "curve_hash", "left").withColumn(
        "label_conflict", F.coalesce("label_conflict", F.lit(False)))
    return marked.withColumn("qc_status", F.when(F.col("label_conflict"), "excluded").otherwise(F.col("base_status"))).drop("base_status")


# --- selection ------------------------------------------------------------

def collapse_samples(candidates: DataFrame, sample: str, order: Sequence[Column], identity: str) -> DataFrame:
    """Keep one measurement per physical sample; the others name their keeper.

    The keeper is the smallest order struct, found with a combinable minimum.
    """
    best = candidates.groupBy(sample).agg(
        F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(identity).alias("id"))).alias("_b")
    ).select(sample, F.col("_b.id").alias("_keep"))
    joined = candidates.join(best, sample)
    same = F.col(identity) == F.col("_keep")
    return joined.withColumn("kept", same).withColumn("duplicate_of", F.when(~same, F.col("_keep"))).drop("_keep")


def _tiles(df: DataFrame, keys: Sequence[str], identity: str, block: int) -> DataFrame:
    """Send each row to every block pair it takes part in (i <= j)."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    own = df.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64(identity), F.col("_blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(
        F.least(b, F.col("_own")).alias("i"), F.greatest(b, F.col("_own")).alias("j")))
    return own.withColumn("_t", F.explode(pairs)).select("*", F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j")).drop("_t", "_blocks")


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def _against_all(left: DataFrame, right: DataFrame, keys: Sequence[str], identity: str, vector: str, block: int, visit, schema: str) -> DataFrame:
    """Let blocks of ``left`` rows meet all ``right`` rows of their group as a stream.

    A task holds one block of ``left`` (``block`` rows on average) and 1,024
    ``right`` rows at a time.  ``visit(rows)`` starts a block and returns two
    functions: one takes (right ids, weights, vectors), one ends the block; both
    return a frame or None.
    """
    keys = list(keys)
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    held = left.join(sizes, keys).withColumn("_i", F.pmod(F.xxhash64(identity), F.col("_blocks")).cast("int")).withColumn("_side", F.lit(0))
    shown = right.select(*keys, identity, vector, "weight").join(sizes, keys).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_side", F.lit(1))
    dealt = held.unionByName(shown, allowMissingColumns=True).drop("_blocks")
    ordered = dealt.repartition(*keys, "_i").sortWithinPartitions(*keys, "_i", "_side", identity)
    groups = [*keys, "_i"]

    def run(batches):
        rows, take, end, rest = [], None, None, None

        def show(pdf, whole):
            nonlocal rest
            rest = pdf if rest is None else pd.concat([rest, pdf])
            while len(rest) >= 1024 or (whole and len(rest)):
                part, rest = rest.iloc[:1024], rest.iloc[1024:]
                yield take(part[identity].to_numpy(), part["weight"].to_numpy(), np.stack(part[vector]))

        def close():
            if take is not None:
                if rest is not None:
                    yield from show(rest.iloc[:0], True)
                yield end()

        current = None
        for batch in batches:
            pdf = pa.Table.from_batches([batch]).to_pandas()
            for place, part in pdf.groupby([*groups, "_side"], sort=False, dropna=False):
                if place[:-1] != current:
                    for out in close():
                        if out is not None and len(out):
                            yield pa.RecordBatch.from_pandas(out, preserve_index=False)
                    current, rows, take, rest = place[:-1], [], None, None
                if place[-1] == 0:
                    rows.append(part)
                elif rows:
                    if take is None:
                        take, end = visit(pd.concat(rows))
                    for out in show(part, False):
                        if out is not None and len(out):
                            yield pa.RecordBatch.from_pandas(out, preserve_index=False)
        for out in close():
            if out is not None and len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return ordered.mapInArrow(run, schema)


def _angles_of(rows: pd.DataFrame, identity: str, vector: str):
    ids, vectors = rows[identity].to_numpy(), np.stack(rows[vector])

    def angles(other_ids, other):
        angle = _angles(vectors, other)
        angle[ids[:, None] == other_ids[None, :]] = 0.0
        return angle

    return vectors, angles


def _median_windows(asked: DataFrame, folded: DataFrame, keys: Sequence[str], identity: str, vector: str, block: int, bins: int) -> DataFrame:
    """``asked`` rows with narrower ``[_a0, _a1]`` and ``[_c0, _c1]`` around the two middle angles.

    Every row counts its angles in ``bins`` equal steps between its present
    ``_a0`` and ``_c1``; the counts never leave the task.
    """
    keys = list(keys)
    edges = ["_a0", "_a1", "_c0", "_c1"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys, identity).schema)

    def visit(rows):
        _, angles = _angles_of(rows, identity, vector)
        low = rows["_a0"].to_numpy() - 1e-9
        step = (rows["_c1"].to_numpy() + 1e-9 - low) / bins
        wide = bins + 2
        counts = np.zeros((len(rows), wide))
        start = np.arange(len(rows))[:, None] * wide

        def take(ids, weight, vectors):
            at = np.clip(np.floor((angles(ids, vectors) - low[:, None]) / step[:, None]), -1, bins).astype(np.int64) + 1 + start
            counts.ravel()[:] += np.bincount(at.ravel(), np.broadcast_to(weight, at.shape).ravel(), counts.size)

        def end():
            upto = counts.cumsum(axis=1)
            n = upto[:, -1]
            out = rows[[*keys, identity]].copy()
            for name, rank in (("_a", np.floor((n - 1) / 2)), ("_c", np.floor(n / 2))):
                place = (upto <= rank[:, None]).sum(axis=1) - 1
                out[name + "0"], out[name + "1"] = low + place * step, low + (place + 1) * step
            return out[[*keys, identity, *edges]]

        return take, end

    found = _against_all(asked.drop(*edges[1:3]), folded, keys, identity, vector, block, visit, f"{kinds}, " + ", ".join(f"{e} double" for e in edges))
    return durable(found).join(asked.drop(*edges), [*keys, identity])


def _middle_angles(asked: DataFrame, folded: DataFrame, keys: Sequence[str], identity: str, vector: str, block: int) -> DataFrame:
    """Exact medians of ``asked`` rows from the angles inside their windows; smaller ones leave a task as counts."""
    keys = list(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys, identity).schema)

    def visit(rows):
        own, angles = _angles_of(rows, identity, vector)
        low, high = rows["_a0"].to_numpy()[:, None] - 1e-9, rows["_c1"].to_numpy()[:, None] + 1e-9
        names = rows[[*keys, identity]].reset_index(drop=True)
        below = np.zeros(len(rows))
        total = np.zeros(len(rows))

        def take(ids, weight, vectors):
            nonlocal below, total
            angle = angles(ids, vectors)
            below += (angle < low) @ weight
            total += weight.sum()
            r, c = np.nonzero((angle >= low) & (angle <= high))
            # products summed in one order, so both ends of a pair see the same angle
            x = np.arccos(np.clip(np.einsum("ij,ij->i", own[r], vectors[c]), -1.0, 1.0))
            x[angle[r, c] == 0.0] = 0.0
            return names.iloc[r].assign(x=x, m=weight[c].astype(np.int64), below=np.int64(0), n=np.int64(0))

        def end():
            return names.assign(x=np.nan, m=np.int64(0), below=below.astype(np.int64), n=total.astype(np.int64))

        return take, end

    found = durable(_against_all(asked, folded, keys, identity, vector, block, visit, f"{kinds}, x double, m long, below long, n long"))
    own = [*keys, identity]
    heads = found.where("n > 0").select(*own, "below", "n")
    inside = found.where("n = 0").groupBy(*own, "x").agg(F.sum("m").alias("m"))
    upto = W.partitionBy(*own).orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    placed = inside.join(heads, own).withColumn("before", F.col("below") + F.coalesce(F.sum("m").over(upto), F.lit(0)))
    hit = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("m"))
    middle = placed.groupBy(*own).agg(
        F.max(F.when(hit(F.floor((F.col("n") - 1) / 2)), F.col("x"))).alias("a"), F.max(F.when(hit(F.floor(F.col("n") / 2)), F.col("x"))).alias("b"))
    return middle.select(*own, ((F.col("a") + F.col("b")) / 2).alias("median_angle"))


def _whole_range(folded: DataFrame) -> DataFrame:
    return folded.withColumns({"_a0": F.lit(0.0), "_a1": F.lit(float(np.pi)), "_c0": F.lit(0.0), "_c1": F.lit(float(np.pi))})


def median_distances(curves: DataFrame, keys: Sequence[str], identity: str, vector: str, block: int = 4096, bins: int = 512) -> DataFrame:
    """Median angle of every unit vector to all vectors of its group, exactly.

    The pair matrix is visited in bounded blocks and never emitted: the first
    visit counts angles inside the task, the second sends only the values of
    the bins that hold the middle.  Equal vectors are folded into one weighted
    row first.
    """
    folded = durable(curves.groupBy(*keys, vector).agg(F.min(identity).alias(identity), F.count(F.lit(1)).alias("weight")))
    near = _median_windows(_whole_range(folded), folded, keys, identity, vector, block, bins)
    return _middle_angles(near, folded, keys, identity, vector, block)


def medoids(curves: DataFrame, keys: Sequence[str], identity: str, vector: str, quality: str, block: int = 4096, bins: int = 512) -> DataFrame:
    """Curve with the smallest median distance; ties by quality, then id.

    Two visits narrow each curve's median; only curves that may still be the
    smallest of their group go on, and only these send angles in the last.
    """
    keys = list(keys)
    best_copy = F.min(F.struct((-F.col(quality)).alias("q"), F.col(identity).alias("id")))
    folded = durable(curves.groupBy(*keys, vector).agg(best_copy.alias("_b"), F.count(F.lit(1)).alias("weight")).select(
        *keys, vector, F.col("_b.id").alias(identity), F.col("_b.q").alias("_q"), "weight"))
    asked = _whole_range(folded)
    for _ in range(2):
        near = _median_windows(asked, folded, keys, identity, vector, block, bins)
        limit = near.groupBy(*keys).agg(F.min((F.col("_a1") + F.col("_c1")) / 2).alias("_limit"))
        asked = durable(near.join(limit, keys).where((F.col("_a0") + F.col("_c0")) / 2 <= F.col("_limit") + 1e-8).drop("_limit"))
    scored = _middle_angles(asked, folded, keys, identity, vector, block).join(asked.select(*keys, identity, "_q"), [*keys, identity])
    best = scored.groupBy(*keys).agg(F.min(F.struct("median_angle", "_q", identity)).alias("b"))
    return best.select(*keys, F.col(f"b.{identity}").alias(identity), "b.median_angle")


def near_duplicates(curves: DataFrame, keys: Sequence[str], identity: str, vector: str, quality: str,
                    threshold: float = 0.02, block: int = 1024) -> DataFrame:
    """``identity, duplicate_of``: chains of near-equal unit vectors keep their best.

    Equal vectors are folded first; inside a block pair only a spanning forest
    of the near pairs leaves the task, so a large group of copies emits as many
    edges as it has members and not as many as it has pairs.
    """
    keys = list(keys)
    exact = curves.groupBy(*keys, vector).agg(F.min(identity).alias("_head"))
    heads = exact.select(*keys, F.col("_head").alias(identity), vector)

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left, right = pdf[pdf["_own"] == i], pdf[pdf["_own"] == j]
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return out
        ids = np.concatenate([left[identity].to_numpy(), right[identity].to_numpy()])
        a, b = np.nonzero(_angles(np.stack(left[vector]), np.stack(right[vector])) <= threshold)
        nodes, inverse = np.unique(ids, return_inverse=True)
        a, b = inverse[a], inverse[len(left) + b]
        parent = np.arange(len(nodes))
        while len(a) and not np.array_equal(parent[a], parent[b]):
            low = np.minimum(parent[a], parent[b])
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            parent = parent[parent]
        root = parent
        while not np.array_equal(root, root[root]):
            root = root[root]
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})

    tiles = _tiles(heads, keys, identity, block)
    edges = tiles.groupBy(*keys, "_i", "_j").applyInPandas(forest, "a long, b long")
    copies = curves.join(exact, [*keys, vector]).where(F.col(identity) != F.col("_head")).select(
        F.col(identity).alias("a"), F.col("_head").alias("b"))
    roots = connected_roots(edges.unionByName(copies))
    members = curves.select(identity, quality).join(roots, F.col(identity) == F.col("node"), "left").select(
        identity, quality, F.coalesce("root", identity).alias("_root"))
    best = members.groupBy("_root").agg(F.min(F.struct((-F.col(quality)).alias("q"), identity)).alias("b"))
    return members.join(best, "_root").select(
        identity, F.when(F.col(f"b.{identity}") != F.col(identity), F.col(f"b.{identity}")).alias("duplicate_of"))


def diverse_references(curves: DataFrame, key: str, identity: str, vector: str, maximum: int = 6, minimum: int = 3) -> DataFrame:
    """Anchors or the medoid first, then the curve that adds most, round by round.

    Each round scores every remaining curve against the reference chosen last
    and takes one winner per group with a combinable maximum; groups advance
    together and none is gathered.  ``curves`` has ``quality``,
    ``source_family``, ``geometry`` and ``anchor_order`` (NULL when none).
    """
    counts = curves.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    desired = counts.select(key, F.least(F.lit(maximum), F.col("_n"), F.greatest(F.lit(minimum), F.ceil(F.sqrt("_n")))).cast("int").alias("_want"))
    order = F.struct("anchor_order", (-F.col("quality")).alias("q"), identity)
    anchors = curves.where("anchor_order is not null").join(desired, key).withColumn(
        "_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r <= 2").where("_r <= _want")
    plain = curves.join(anchors.select(key).distinct(), key, "left_anti")
    first = medoids(plain, [key], identity, vector, "quality")
    chosen = durable(
        anchors.select(key, identity, F.col("_r").alias("rank"), F.lit("catalog_anchor").alias("reason"))
        .unionByName(first.select(key, identity, F.lit(1).alias("rank"), F.lit("robust_medoid").alias("reason"))))
    rest = curves.join(desired, key).withColumn("_near", F.lit(float(np.pi)))
    fresh = chosen
    for _ in range(maximum):
        packed = curves.join(fresh.select(key, identity), [key, identity]).groupBy(key).agg(
            F.collect_list(F.struct(F.col(vector).alias("v"), F.col("source_family").alias("s"), F.col("geometry").alias("g"))).alias("_new"))
        seen = chosen.join(curves.select(key, identity, "source_family", "geometry"), [key, identity]).groupBy(key).agg(
            F.collect_set("source_family").alias("_sources"), F.collect_set("geometry").alias("_geometries"), F.max("rank").alias("_rank"))
        gap = F.array_min(F.transform("_new", lambda r: F.acos(F.least(F.greatest(A.dot(F.col(vector), r["v"]), F.lit(-1.0)), F.lit(1.0)))))
        rest = durable(
            rest.join(fresh.select(identity), identity, "left_anti").join(packed, key)
            .withColumn("_near", F.least("_near", gap)).drop("_new"))
        open_rows = rest.join(seen, key).where("_rank < _want")
        gain = (0.50 * F.least(F.col("_near") / 0.20, F.lit(1.0)) + 0.25 * F.col("quality")
                + 0.20 * (~F.array_contains("_sources", F.col("source_family"))).cast("double")
                + 0.05 * (~F.array_contains("_geometries", F.col("geometry"))).cast("double"))
        fresh = durable(open_rows.groupBy(key).agg(
            F.max(F.struct(gain.alias("score"), F.col("quality"), F.col("_near"), (-F.col(identity)).alias("r"))).alias("b"),
            F.max("_rank").alias("_rank")).select(
            key, (-F.col("b.r")).alias(identity), (F.col("_rank") + 1).alias("rank"), F.lit("greedy_diversity").alias("reason")))
        if fresh.isEmpty():
            break
        chosen = durable(chosen.unionByName(fresh))
    return chosen


# --- sensor and windows ---------------------------------------------------

def band_intervals(axis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged wavelength intervals the bands cover: FWHM wide, else to the midpoints."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("wavelength_nm")
    here, before, after = F.col("wavelength_nm"), F.lag("wavelength_nm").over(w), F.lead("wavelength_nm").over(w)
    half = F.col("fwhm_nm") / 2
    low = F.coalesce(here - half, (here + before) / 2, here - (after - here) / 2)
    high = F.coalesce(here + half, (here + after) / 2, here + (here - before) / 2)
    spans = axis.select(*keys, low.alias("lo"), high.alias("hi"))
    return grid.islands(spans, keys, "lo", 0, "hi").groupBy(*keys, "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def window_coverage(axis: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered share and usable bands of every required window.

    ``windows`` is catalog-sized: (window_id, lower_nm, upper_nm).
    """
    keys = list(keys)
    spans = band_intervals(axis, keys).join(
        F.broadcast(windows), (F.col("lo") < F.col("upper_nm")) & (F.col("hi") > F.col("lower_nm")))
    width = F.greatest(F.lit(0.0), F.least("hi", "upper_nm") - F.greatest("lo", "lower_nm"))
    covered = spans.groupBy(*keys, "window_id", "lower_nm", "upper_nm").agg(F.sum(width).alias("covered"))
    bands = axis.where("not is_bad").join(
        F.broadcast(windows), F.col("wavelength_nm").between(F.col("lower_nm"), F.col("upper_nm"))
    ).groupBy(*keys, "window_id").agg(F.count(F.lit(1)).alias("bands"))
    return covered.join(bands, [*keys, "window_id"], "left").select(
        *keys, "window_id",
        F.least(F.col("covered") / (F.col("upper_nm") - F.col("lower_nm")), F.lit(1.0)).alias("coverage"),
        F.coalesce("bands", F.lit(0)).alias("bands"))


def mineral_support(coverage: Column, bands: Column, minimum_bands: Column, snr: Column, references: Column,
                    fwhm: Column, maximum_fwhm: Column) -> Column:
    """Support level, score and reasons of one mineral on one sensor."""
    sampling = F.least(bands / F.greatest(minimum_bands, F.lit(1)), F.lit(1.0))
    by_snr = F.when(snr.isNull(), 0.65).otherwise(F.least(snr / 150.0, F.lit(1.0)))
    by_refs = F.when(references.isNull(), 0.50).otherwise(F.least(references / 3.0, F.lit(1.0)))
    score = 0.30 * coverage + 0.20 * sampling + 0.20 * by_snr + 0.15 * 0.75 + 0.15 * by_refs
    wide = F.coalesce(fwhm > maximum_fwhm, F.lit(False))
    hard = (coverage >= 0.97) & (bands >= minimum_bands) & F.coalesce(references > 0, F.lit(True)) & ~wide
    partial = (coverage >= 0.90) & (bands >= F.greatest(F.lit(3), F.floor(minimum_bands / 2)))
    level = (
        F.when(F.coalesce(references < 1, F.lit(False)), "unsupported")
        .when(hard & (score >= 0.75), F.when(references.isNull(), "conditional").otherwise("supported"))
        .when(hard | partial, "conditional").otherwise("unsupported"))
    reasons = F.array_compact(F.array(
        F.when(coverage < 0.97, "insufficient_wavelength_coverage"),
        F.when(bands < minimum_bands, "too_few_diagnostic_bands"),
        F.when(wide, "fwhm_too_wide"),
        F.when(F.coalesce(references < 1, F.lit(False)), "no_usable_reference"),
        F.when(references.isNull(), "references_not_audited")))
    return F.struct(level.alias("level"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), reasons.alias("reasons"))
