"""Neighbourhoods, components and column statistics of score planes."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import arrays as A
from ..operators import columns, components as CC, grid
from ..operators.quantiles import exact_quantiles
from ..plans.registry import query
from ..plans.views import KEY

S = ["scene_id"]


@query("w1_moving_sum", """
    SELECT scene_id, line, sample,
      CAST(count(*) OVER (PARTITION BY scene_id, sample ORDER BY line RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS BIGINT) AS down,
      CAST(count(*) OVER (PARTITION BY scene_id, line ORDER BY sample RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS across
    FROM candidate""")
def w1(v):
    one = {"down": F.count(F.lit(1))}
    down = grid.along_lines(v.candidate.select(*KEY), S, 30, one)
    return grid.across_samples(down, S, 2, {"across": F.count(F.lit(1))})


@query("w2_neighbourhood_counts", """
    SELECT a.scene_id, a.line, a.sample, count(*) AS n, count(*) >= 4 AS supported
    FROM candidate a JOIN candidate b ON a.scene_id = b.scene_id
      AND b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1
    GROUP BY ALL""")
def w2(v):
    counts = grid.box_counts(v.candidate, v.candidate, S, 1, 1)
    return counts.select(*KEY, F.col("n").cast("long").alias("n"), (F.col("n") >= 4).alias("supported"))


PROFILE_SQL = """dn AS (SELECT scene_id, sample, count(*) AS valid, count(*) FILTER (WHERE score <= 0.03) AS hits
      FROM cells WHERE line % 60 < 40 GROUP BY ALL),
    pf AS (SELECT scene_id, sample, valid, hits, CAST(hits AS DOUBLE) / valid AS density FROM dn)"""


def density(v):
    return columns.density(v.candidate, v.valid, S)


@query("a5_column_density", f"""
    WITH {PROFILE_SQL} SELECT scene_id, sample, valid, hits, round(density, 8) AS density FROM pf""")
def a5(v):
    return density(v).withColumn("density", F.round("density", 8))


@query("a5_density_summary", f"""
    WITH {PROFILE_SQL}, fl AS (SELECT f.scene_id, s AS sample, coalesce(density, 0) AS density, coalesce(hits, 0) AS hits FROM frames f JOIN range(0, 32) r(s) ON s < samples LEFT JOIN pf ON pf.scene_id = f.scene_id AND pf.sample = s)
    SELECT scene_id, round(max(density), 8) AS peak, round(median(density), 8) AS middle,
      round(quantile_cont(density, 0.95), 8) AS p95, round(max(hits) / CAST(sum(hits) AS DOUBLE), 8) AS largest_share
    FROM fl GROUP BY scene_id""")
def a5_summary(v):
    every = v.frames.select("scene_id", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("sample"))
    filled = every.join(density(v), ["scene_id", "sample"], "left").fillna(0, ["density", "hits"])
    return filled.groupBy("scene_id").agg(
        F.round(F.max("density"), 8).alias("peak"),
        F.round(F.percentile("density", F.lit(0.5)), 8).alias("middle"),
        F.round(F.percentile("density", F.lit(0.95)), 8).alias("p95"),
        F.round(F.max("hits") / F.sum("hits"), 8).alias("largest_share"))


@query("w3_local_column_median", f"""
    WITH {PROFILE_SQL}, o(k) AS (VALUES (-2), (-1), (0), (1), (2))
    SELECT a.scene_id, a.sample, round(median(b.density), 8) AS middle FROM pf a JOIN frames f USING (scene_id), o
      JOIN pf b ON b.scene_id = a.scene_id AND b.sample = greatest(0, least(f.samples - 1, a.sample + o.k)) GROUP BY ALL""")
def w3(v):
    packed = columns.dense(density(v), S, ["density"], v.frames)
    out = packed.withColumn("middle", columns.edge_median(F.col("density"), 2))
    return columns.column_rows(out, S, ["middle"]).withColumn("middle", F.round("middle", 8))


@query("w4_linear_gap_fill", f"""
    WITH {PROFILE_SQL}, g AS (SELECT scene_id, sample, CASE WHEN sample % 5 NOT IN (1, 2) THEN density END AS x FROM pf),
    b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN sample END) OVER (PARTITION BY scene_id ORDER BY sample) AS p,
      min(CASE WHEN x IS NOT NULL THEN sample END) OVER (PARTITION BY scene_id ORDER BY sample DESC) AS q FROM g)
    SELECT b.scene_id, b.sample, round(coalesce(b.x, l.x + (r.x - l.x) * (b.sample - b.p) / (b.q - b.p), l.x, r.x), 8) AS value
    FROM b LEFT JOIN g l ON l.scene_id = b.scene_id AND l.sample = b.p LEFT JOIN g r ON r.scene_id = b.scene_id AND r.sample = b.q""")
def w4(v):
    holed = density(v).withColumn("x", F.when(~(F.col("sample") % 5).isin(1, 2), F.col("density")))
    packed = columns.dense(holed, S, ["x"], v.frames).withColumn("value", columns.fill_linear(F.col("x")))
    return columns.column_rows(packed, S, ["value"]).withColumn("value", F.round("value", 8))


@query("w5_guarded_baseline", f"""
    WITH {PROFILE_SQL} SELECT a.scene_id, a.sample, round(coalesce(median(b.density), 0), 8) AS baseline,
      a.density >= coalesce(median(b.density), 0) * 1.1 AND a.density >= coalesce(median(b.density), 0) + 0.01 AS peak
    FROM pf a LEFT JOIN pf b ON b.scene_id = a.scene_id AND ((b.sample >= a.sample - 6 AND b.sample < a.sample - 1)
      OR (b.sample >= a.sample + 2 AND b.sample < a.sample + 7)) GROUP BY a.scene_id, a.sample, a.density""")
def w5(v):
    packed = columns.dense(density(v), S, ["density"], v.frames)
    base = columns.neighbour_median(F.col("density"), 6, 1, 2, F.lit(0.0))
    rows = columns.column_rows(packed.withColumn("baseline", base), S, ["density", "baseline"])
    d, b = F.col("density"), F.col("baseline")
    return rows.select("scene_id", "sample", F.round(b, 8).alias("baseline"),
                       ((d >= b * 1.1) & (d >= b + 0.01)).alias("peak"))


RUNS_SQL = """rr AS (SELECT *, sample - row_number() OVER (PARTITION BY scene_id, line ORDER BY sample) AS g FROM valid),
    rn AS (SELECT scene_id, line, sample, min(sample) OVER q AS a, max(sample) OVER q AS b FROM rr
      WINDOW q AS (PARTITION BY scene_id, line, g))"""


@query("w6_row_run_edges", f"""
    WITH {RUNS_SQL} SELECT scene_id, line, sample,
      CAST(greatest(0, 1 - least(sample - a, b - sample) / 2.0::DOUBLE) AS DOUBLE) AS edge_risk FROM rn""")
def w6(v):
    return grid.edge_risk(v.valid, S, 2).select(*KEY, "edge_risk")


SEGMENT_SQL = """act AS (SELECT scene_id, line FROM valid GROUP BY ALL HAVING count(*) >= 4),
    sg AS (SELECT *, sum(CASE WHEN line - prev > 13 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY line) AS isl
      FROM (SELECT *, lag(line) OVER (PARTITION BY scene_id ORDER BY line) AS prev FROM act)),
    seg AS (SELECT scene_id, CAST(min(line) AS INTEGER) AS start, CAST(max(line) + 1 AS INTEGER) AS stop,
      CAST(row_number() OVER (PARTITION BY scene_id ORDER BY min(line)) AS INTEGER) AS segment
      FROM sg GROUP BY scene_id, isl HAVING max(line) + 1 - min(line) >= 16)"""


@query("w7_depth_segments", f"WITH {SEGMENT_SQL} SELECT scene_id, start, stop, segment FROM seg")
def w7(v):
    return grid.depth_segments(v.valid)


@query("w8_interval_merge", """
    WITH iv AS (SELECT scene_id, sample, line AS a, line + 1 + CAST(floor(score * 200) AS INTEGER) AS b FROM candidate),
    m AS (SELECT *, max(b) OVER (PARTITION BY scene_id, sample ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id, sample ORDER BY a) AS isl FROM m)
    SELECT scene_id, sample, min(a) AS start, max(b) AS stop, count(*) AS parts FROM i GROUP BY scene_id, sample, isl""")
def w8(v):
    spans = v.candidate.select("scene_id", "sample", F.col("line").alias("a"),
                               (F.col("line") + 1 + F.floor(F.col("score") * 200).cast("int")).alias("b"))
    return grid.merge_spans(spans, ["scene_id", "sample"], "a", "b", tile=256)


@query("w9_rank_score", f"""
    WITH {PROFILE_SQL} SELECT scene_id, sample, round(CASE WHEN count(*) OVER p <= 1 THEN 0.5
      ELSE 1 - (row_number() OVER (PARTITION BY scene_id ORDER BY density, sample) - 1) / CAST(count(*) OVER p - 1 AS DOUBLE) END, 8) AS rank_score
    FROM pf WINDOW p AS (PARTITION BY scene_id)""")
def w9(v):
    from ..operators.library import rank_score

    return density(v).select("scene_id", "sample", F.round(
        rank_score("density", "sample", S, lower_is_better=True), 8).alias("rank_score"))


BOX_SQL = """bx AS (SELECT a.scene_id, a.line + dl AS line, a.sample + ds AS sample, count(*) AS n
      FROM dense_cells a, (VALUES (-1), (0), (1)) l(dl), (VALUES (-1), (0), (1)) s(ds) GROUP BY ALL),
    bf AS (SELECT bx.* FROM bx JOIN frames USING (scene_id) WHERE line >= 0 AND sample >= 0 AND line < lines AND sample < samples)"""
DENSE_SQL = "dense_cells AS (SELECT scene_id, line, sample FROM cells WHERE score <= 0.085)"


def dense_cells(v):
    return v.cells.where("score <= 0.085").select(*KEY)


@query("w10_erosion", f"WITH {DENSE_SQL}, {BOX_SQL} SELECT scene_id, line, sample FROM bx WHERE n = 9")
def w10_erode(v):
    return grid.erode(dense_cells(v), S)


CLOSE_SQL = f"""{DENSE_SQL}, {BOX_SQL}, dl AS (SELECT scene_id, line, sample FROM bf),
    cl AS (SELECT a.scene_id, a.line, a.sample FROM dl a JOIN dl b ON a.scene_id = b.scene_id
      AND b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1
      GROUP BY ALL HAVING count(*) = 9)"""


@query("w10_closing", f"WITH {CLOSE_SQL} SELECT * FROM cl")
def w10_close(v):
    return grid.close(dense_cells(v), v.frames, S)


@query("w11_majority_filter", f"WITH {DENSE_SQL}, {BOX_SQL} SELECT scene_id, line, sample FROM bf WHERE n >= 5")
def w11(v):
    return grid.majority(dense_cells(v), v.frames, S)


@query("w12_interior_fraction", f"""
    WITH {DENSE_SQL}, {BOX_SQL} SELECT scene_id, count(*) AS pixels,
      round(count(*) FILTER (WHERE n >= 8) / CAST(count(*) AS DOUBLE), 8) AS interior
    FROM dense_cells JOIN bx USING (scene_id, line, sample) GROUP BY scene_id""")
def w12(v):
    cells = dense_cells(v)
    return grid.box_counts(cells, cells, S, 1, 1).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.avg((F.col("n") >= 8).cast("double")), 8).alias("interior"))


@query("w15_local_tie_relabel", """
    WITH nb AS (SELECT a.scene_id, a.line, a.sample, a.class_id, a.margin, b.class_id AS other, count(*) AS n
      FROM candidate a JOIN candidate b ON a.scene_id = b.scene_id AND b.line BETWEEN a.line - 1 AND a.line + 1
      AND b.sample BETWEEN a.sample - 1 AND a.sample + 1 AND (b.line <> a.line OR b.sample <> a.sample) GROUP BY ALL),
    best AS (SELECT scene_id, line, sample, class_id, margin,
      coalesce(max(n) FILTER (WHERE other = class_id), 0) AS own,
      max(n) FILTER (WHERE other <> class_id) AS top, arg_max(other, n * 10 - other) FILTER (WHERE other <> class_id) AS rival FROM nb GROUP BY ALL)
    SELECT c.scene_id, c.line, c.sample, CAST(CASE WHEN own <= 2 AND top >= 2 AND c.margin <= 0.5 THEN rival ELSE c.class_id END AS INTEGER) AS label
    FROM candidate c LEFT JOIN best USING (scene_id, line, sample)""")
def w15(v):
    from ..operators.maps import local_tie_relabel

    return local_tie_relabel(
        v.candidate.select(*KEY, "class_id", "margin"), S, tolerance=0.5, own_at_most=2, rival_at_least=2)


LABEL_SQL = """e AS (SELECT a.scene_id, a.line * 2147483648::BIGINT + a.sample AS u, b.line * 2147483648::BIGINT + b.sample AS w
      FROM candidate a JOIN candidate b ON a.scene_id = b.scene_id AND b.line BETWEEN a.line - 1 AND a.line + 1
      AND b.sample BETWEEN a.sample - 1 AND a.sample + 1),
    r(scene_id, u, w) AS (SELECT scene_id, line * 2147483648::BIGINT + sample, line * 2147483648::BIGINT + sample FROM candidate
      UNION SELECT r.scene_id, r.u, e.w FROM r JOIN e ON e.scene_id = r.scene_id AND e.u = r.w),
    lb AS (SELECT scene_id, CAST(u // 2147483648 AS INTEGER) AS line, CAST(u % 2147483648 AS INTEGER) AS sample, min(w) AS label
      FROM r GROUP BY scene_id, u),
    cc AS (SELECT scene_id, label, count(*) AS size, min(line) AS min_line, max(line) AS max_line,
      min(sample) AS min_sample, max(sample) AS max_sample, avg(line) AS center_line, avg(sample) AS center_sample FROM lb GROUP BY ALL)"""


def labelled(v):
    return CC.components(v.candidate.select(*KEY))


@query("c1_component_labels", f"WITH {LABEL_SQL} SELECT * FROM lb")
def c1(v):
    return labelled(v).select(*KEY, "label")


@query("c2_remove_small_components", f"""
    WITH {LABEL_SQL} SELECT scene_id, line, sample FROM lb JOIN cc USING (scene_id, label) WHERE size >= 4""")
def c2(v):
    return CC.keep_large(labelled(v), 4).select(*KEY)


@query("c3_remove_elongated_components", f"""
    WITH {LABEL_SQL} SELECT scene_id, line, sample FROM lb JOIN cc USING (scene_id, label)
    WHERE NOT (max_line - min_line + 1 >= 4 AND max_sample - min_sample + 1 <= 2
      AND (max_line - min_line + 1) / CAST(max_sample - min_sample + 1 AS DOUBLE) >= 2)""")
def c3(v):
    return labelled(v).where(~CC.elongated(4, 2, 2.0)).select(*KEY)


@query("c4_component_catalogue", f"""
    WITH {LABEL_SQL} SELECT scene_id, label, size, min_line, max_line, min_sample, max_sample,
      round(center_line, 6) AS center_line, round(center_sample, 6) AS center_sample FROM cc""")
def c4(v):
    return CC.catalogue(labelled(v)).select(
        "scene_id", "label", "size", "min_line", "max_line", "min_sample", "max_sample",
        F.round("center_line", 6).alias("center_line"), F.round("center_sample", 6).alias("center_sample"))


def reach_sql(name: str, cells: str, most: int) -> str:
    """Size of each cell's component, exact up to ``most`` cells and larger than that otherwise.

    Walks at most that many steps from each cell, and not beyond one whose neighbours are too many already.
    """
    return f"""{name}_n AS (SELECT a.scene_id, a.line, a.sample, count(*) - 1 AS n FROM {cells} a JOIN {cells} b ON b.scene_id = a.scene_id
        AND b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1 GROUP BY ALL),
    {name}_r(scene_id, l0, s0, line, sample, n, d) AS (SELECT scene_id, line, sample, line, sample, n, 0 FROM {name}_n
      UNION SELECT r.scene_id, r.l0, r.s0, c.line, c.sample, c.n, d + 1 FROM {name}_r r JOIN (SELECT scene_id, line + dl AS fl, sample + ds AS fs, line, sample, n
          FROM {name}_n, (VALUES (-1), (0), (1)) x(dl), (VALUES (-1), (0), (1)) y(ds) WHERE dl <> 0 OR ds <> 0) c
        ON c.scene_id = r.scene_id AND c.fl = r.line AND c.fs = r.sample WHERE d < {most} AND r.n < {most}),
    {name} AS (SELECT scene_id, l0 AS line, s0 AS sample, greatest(count(DISTINCT line * 1000 + sample), max(n) + 1) AS size, min(line) AS lo, max(line) AS hi, min(sample) AS left_, max(sample) AS right_
      FROM {name}_r GROUP BY ALL)"""


def gaps_sql(cells: str) -> str:
    return f"""gaps AS (SELECT f.scene_id, CAST(l AS INTEGER) AS line, CAST(s AS INTEGER) AS sample FROM frames f JOIN range(0, 1000) a(l) ON l < lines JOIN range(0, 32) b(s) ON s < samples
      ANTI JOIN {cells} d ON d.scene_id = f.scene_id AND d.line = l AND d.sample = s)"""


@query("c5_fill_small_holes", f"""
    WITH RECURSIVE {DENSE_SQL}, {gaps_sql('dense_cells')}, {reach_sql('gp', 'gaps', 6)}
    SELECT scene_id, line, sample FROM dense_cells UNION ALL
    SELECT gp.scene_id, line, sample FROM gp JOIN frames USING (scene_id) WHERE size <= 6 AND lo > 0 AND left_ > 0 AND hi < lines - 1 AND right_ < samples - 1""")
def c5(v):
    return CC.fill_holes(dense_cells(v), v.frames, 6)


@query("c6_seeded_region_growing", f"""
    WITH {LABEL_SQL}, k AS (SELECT DISTINCT scene_id, label FROM lb JOIN candidate USING (scene_id, line, sample) WHERE score <= 0.004)
    SELECT scene_id, line, sample FROM lb JOIN k USING (scene_id, label)""")
def c6(v):
    return CC.grow_from_seeds(v.candidate.where("score <= 0.004"), v.candidate)


@query("c7_isolated_pixel_share", f"""
    WITH {LABEL_SQL} SELECT scene_id, round(sum(CASE WHEN size < 4 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 8) AS isolated
    FROM lb JOIN cc USING (scene_id, label) GROUP BY scene_id""")
def c7(v):
    return CC.small_share(labelled(v), 4).withColumn("isolated", F.round("isolated", 8))


@query("c8_mask_cleanup", f"""
    WITH RECURSIVE {DENSE_SQL}, {BOX_SQL}, er AS (SELECT scene_id, line, sample FROM bf WHERE n >= 5),
    e AS (SELECT a.scene_id, a.line * 2147483648::BIGINT + a.sample AS u, b.line * 2147483648::BIGINT + b.sample AS w
      FROM (SELECT * FROM er) a JOIN er b ON a.scene_id = b.scene_id AND b.line BETWEEN a.line - 1 AND a.line + 1
      AND b.sample BETWEEN a.sample - 1 AND a.sample + 1),
    g AS (SELECT scene_id, u, count(*) AS n FROM e GROUP BY ALL)
    SELECT er.scene_id, er.line, er.sample FROM er JOIN g ON g.scene_id = er.scene_id AND g.u = er.line * 2147483648::BIGINT + er.sample WHERE n >= 2""")
def c8(v):
    """Majority filter, then drop single pixels (components below two)."""
    smooth = grid.majority(dense_cells(v), v.frames, S)
    return CC.keep_large(CC.components(smooth), 2).select(*KEY)


@query("c8_spatial_refinement")
def c8_refine(v):
    from ..operators.masks import refine

    return refine(dense_cells(v), v.frames, closing=3, hole=125, minimum=64)


@query("a3_column_thresholds", """
    WITH q AS (SELECT c.scene_id, sample, count(*) AS n, quantile_cont(score, 0.08) AS t FROM cells c JOIN valid USING (scene_id, line, sample) GROUP BY ALL),
    o(k) AS (VALUES (-2), (-1), (0), (1), (2)),
    m AS (SELECT a.scene_id, a.sample, a.n, median(b.t) AS t FROM q a JOIN frames f USING (scene_id), o
      JOIN q b ON b.scene_id = a.scene_id AND b.sample = greatest(0, least(f.samples - 1, a.sample + o.k)) GROUP BY ALL),
    s AS (SELECT scene_id, quantile_cont(score, 0.08) AS scene FROM cells JOIN valid USING (scene_id, line, sample) GROUP BY ALL)
    SELECT scene_id, sample, n, round(t, 8) AS threshold, round(scene, 8) AS scene_threshold FROM m JOIN s USING (scene_id)""")
def a3(v):
    scored = v.cells.where("line % 60 < 40")
    out = columns.column_thresholds(scored, v.frames, [0.08])
    return out.select("scene_id", "sample", "n", F.round("t0", 8).alias("threshold"), F.round("s0", 8).alias("scene_threshold"))


@query("j3_column_threshold_join", """
    WITH v AS (SELECT cells.* FROM cells JOIN valid USING (scene_id, line, sample)),
    q AS (SELECT scene_id, sample, quantile_cont(score, 0.08) AS t FROM v GROUP BY ALL),
    o(k) AS (VALUES (-2), (-1), (0), (1), (2)),
    m AS (SELECT a.scene_id, a.sample, median(b.t) AS t FROM q a JOIN frames f USING (scene_id), o
      JOIN q b ON b.scene_id = a.scene_id AND b.sample = greatest(0, least(f.samples - 1, a.sample + o.k)) GROUP BY ALL)
    SELECT scene_id, line, sample FROM v JOIN m USING (scene_id, sample) WHERE score <= t AND score <= 0.06""")
def j3(v):
    scored = v.cells.where("line % 60 < 40")
    limits = columns.column_thresholds(scored, v.frames, [0.08]).select("scene_id", "sample", "t0")
    from ..functions.scoring import candidate

    return scored.join(limits, ["scene_id", "sample"]).where(
        candidate(F.col("score"), F.col("t0"), F.lit(0.06))).select(*KEY)


@query("p19_candidate_predicate", """
    WITH v AS (SELECT cells.* FROM cells JOIN valid USING (scene_id, line, sample)),
    p(policy, f, a) AS (VALUES ('conservative', 0.04, 0.02), ('balanced', 0.08, 0.03), ('sensitive', 0.12, 0.05)),
    q0 AS (SELECT scene_id, sample, [quantile_cont(score, 0.04), quantile_cont(score, 0.08), quantile_cont(score, 0.12)] AS ts FROM v GROUP BY ALL),
    q AS (SELECT scene_id, sample, policy, ts[CAST(f / 0.04 AS INTEGER)] AS t FROM q0, p),
    o(k) AS (VALUES (-2), (-1), (0), (1), (2)),
    m AS (SELECT a.scene_id, a.sample, a.policy, median(b.t) AS t FROM q a JOIN frames f USING (scene_id), o
      JOIN q b ON b.scene_id = a.scene_id AND b.policy = a.policy AND b.sample = greatest(0, least(f.samples - 1, a.sample + o.k)) GROUP BY ALL),
    s0 AS (SELECT scene_id, [quantile_cont(score, 0.1), quantile_cont(score, 0.2), quantile_cont(score, 0.3)] AS ts FROM v GROUP BY ALL),
    s AS (SELECT scene_id, policy, ts[CAST(f / 0.04 AS INTEGER)] AS sc FROM s0, p)
    SELECT v.scene_id, policy, count(*) AS pixels, CAST(sum(line) AS BIGINT) AS line_sum FROM v JOIN m USING (scene_id, sample)
      JOIN s USING (scene_id, policy) JOIN p USING (policy) WHERE score <= t AND score <= a AND score <= sc GROUP BY ALL""")
def p19(v):
    from ..operators.calibrate import policy_candidates

    policies = {
        "conservative": {"column_percentile": 0.04, "absolute_sam_threshold_rad": 0.02},
        "balanced": {"column_percentile": 0.08, "absolute_sam_threshold_rad": 0.03},
        "sensitive": {"column_percentile": 0.12, "absolute_sam_threshold_rad": 0.05},
    }
    hits = policy_candidates(v.cells.where("line % 60 < 40"), v.frames, policies)
    return hits.groupBy("scene_id", "policy").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("line").alias("line_sum"))


@query("a4_column_bias", """
    WITH b AS (SELECT scene_id, sample, band, median(v) AS m FROM px GROUP BY ALL),
    l AS (SELECT a.scene_id, a.sample, a.band, a.m - median(n.m) AS d FROM b a JOIN b n ON n.scene_id = a.scene_id AND n.band = a.band
      AND n.sample BETWEEN a.sample - 2 AND a.sample + 2 GROUP BY a.scene_id, a.sample, a.band, a.m)
    SELECT scene_id, sample, band, round(d - median(d) OVER (PARTITION BY scene_id, band), 7) AS bias FROM l""")
def a4(v):
    bias = columns.column_bias(v.pixels, v.pixel_frames)
    return bias.select("scene_id", "sample", F.posexplode("bias").alias("band", "bias")).withColumn("bias", F.round("bias", 7))


BLOCK_SQL = "bk AS (SELECT scene_id, CAST(s AS INTEGER) AS start, CAST(s + 64 AS INTEGER) AS stop FROM frames, range(0, 1000, 150) t(s) WHERE s + 64 <= lines)"


def blocks(v):
    starts = F.filter(F.sequence(F.lit(0), F.lit(999), F.lit(150)), lambda s: s + 64 <= F.col("lines"))
    return v.frames.select("scene_id", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + 64)


@query("a6_fixed_column_risk", f"""
    WITH {BLOCK_SQL}, g AS (SELECT bk.scene_id, bk.start, CAST(s AS INTEGER) AS sample FROM bk, range(0, 32) t(s)),
    d AS (SELECT g.scene_id, g.start, g.sample, count(*) FILTER (WHERE score <= 0.03) / greatest(count(c.score), 1)::DOUBLE AS d
      FROM g LEFT JOIN (SELECT * FROM cells WHERE line % 60 < 40) c ON c.scene_id = g.scene_id AND c.sample = g.sample AND c.line >= g.start AND c.line < g.start + 64 GROUP BY ALL),
    z0 AS (SELECT *, median(d) OVER (PARTITION BY scene_id, start) AS mid FROM d),
    z1 AS (SELECT *, 1.4826::DOUBLE * median(abs(d - mid)) OVER (PARTITION BY scene_id, start) AS mad FROM z0),
    c AS (SELECT scene_id, sample, avg(CASE WHEN (d - mid) / greatest(mad, 0.005::DOUBLE) >= 2.5 THEN 1.0::DOUBLE ELSE 0 END) AS rep, median(d) AS profile FROM z1 GROUP BY ALL),
    n AS (SELECT a.scene_id, a.sample, a.rep, a.profile, median(b.profile) AS loc FROM c a LEFT JOIN c b ON b.scene_id = a.scene_id AND ((b.sample >= a.sample - 6 AND b.sample < a.sample - 1)
      OR (b.sample >= a.sample + 2 AND b.sample < a.sample + 7)) GROUP BY ALL)
    SELECT scene_id, sample, round(least(greatest(0.6 * rep + 0.4 * least(greatest((profile - loc) / 0.1, 0), 1), 0), 1), 7) AS risk FROM n""")
def a6(v):
    risk = columns.fixed_column_risk(v.candidate, v.valid, blocks(v), v.frames)
    return risk.withColumn("risk", F.round("risk", 7))


@query("j6_sample_block_join", f"""
    WITH {BLOCK_SQL} SELECT bk.scene_id, start, stop, count(*) AS pixels, round(sum(c.score), 6) AS level
    FROM cells c JOIN bk ON bk.scene_id = c.scene_id AND c.line >= start AND c.line < stop GROUP BY ALL""")
def j6(v):
    named = blocks(v).select("scene_id", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    return columns.in_blocks(v.cells, named).groupBy(
        "scene_id", F.col("_a").alias("start"), F.col("_b").alias("stop")).agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("score"), 6).alias("level"))


@query("a7_scene_robust_scale", """
    WITH c AS (SELECT scene_id, score, median(score) OVER (PARTITION BY scene_id) AS mid FROM cells)
    SELECT scene_id, round(any_value(mid), 8) AS center, round(greatest(1.4826::DOUBLE * median(abs(score - mid)),
      (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, abs(any_value(mid)) * 0.02, 1e-6), 8) AS scale FROM c GROUP BY scene_id""")
def a7(v):
    from ..operators.masks import robust_scale

    return robust_scale(v.cells, S, "score", 0.02).select(
        "scene_id", F.round("center", 8).alias("center"), F.round("scale", 8).alias("scale"))


OTSU_SQL = """r AS (SELECT scene_id, min(score) AS lo, max(score) AS hi, count(*) AS n FROM cells GROUP BY ALL),
    b AS (SELECT c.scene_id, CAST(least(floor((score - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, count(*) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n
      FROM cells c JOIN r USING (scene_id) GROUP BY c.scene_id, bin),
    p AS (SELECT *, CAST(k AS DOUBLE) / n AS pr, lo + (hi - lo) / 256 * (bin + 0.5::DOUBLE) AS ctr FROM b),
    w AS (SELECT *, sum(pr) OVER q AS cp, sum(pr * ctr) OVER q AS cm, sum(pr * ctr) OVER (PARTITION BY scene_id) AS tm FROM p WINDOW q AS (PARTITION BY scene_id ORDER BY bin)),
    ot AS (SELECT scene_id, arg_max(ctr, (tm * cp - cm) ** 2 / (cp * (1 - cp))) FILTER (WHERE cp * (1 - cp) > 1e-12) AS t FROM w GROUP BY scene_id)"""


@query("a8_otsu_threshold", f"WITH {OTSU_SQL} SELECT scene_id, round(t, 8) AS threshold FROM ot")
def a8(v):
    from ..operators.masks import otsu

    return otsu(v.cells, S, "score").withColumn("threshold", F.round("threshold", 8))


@query("a9_border_statistics", """
    WITH b AS (SELECT c.* FROM cells c JOIN frames USING (scene_id) WHERE line < 3 OR sample < 3 OR line >= lines - 3 OR sample >= samples - 3),
    m AS (SELECT scene_id, score, median(score) OVER (PARTITION BY scene_id) AS mid FROM b)
    SELECT scene_id, count(*) AS pixels, round(any_value(mid), 8) AS center, round(greatest(1.4826::DOUBLE * median(abs(score - mid)),
      (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, abs(any_value(mid)) * 0.02, 1e-6), 8) AS scale FROM m GROUP BY scene_id""")
def a9(v):
    from ..operators.masks import on_border, robust_scale

    edge = v.cells.join(v.frames, "scene_id").where(on_border(3))
    return robust_scale(edge, S, "score", 0.02).select(
        "scene_id", F.col("n").alias("pixels"), F.round("center", 8).alias("center"), F.round("scale", 8).alias("scale"))


@query("a11_quantile_profile", """
    SELECT scene_id, count(*) AS n, round(quantile_cont(score, 0.01), 8) AS p01, round(quantile_cont(score, 0.05), 8) AS p05,
      round(quantile_cont(score, 0.5), 8) AS p50, round(quantile_cont(score, 0.95), 8) AS p95, round(quantile_cont(score, 0.99), 8) AS p99
    FROM cells GROUP BY scene_id""")
def a11(v):
    out = exact_quantiles(v.cells, S, "score", [0.01, 0.05, 0.5, 0.95, 0.99])
    return out.select("scene_id", "n", *[F.round(f"q{i}", 8).alias(n) for i, n in enumerate(("p01", "p05", "p50", "p95", "p99"))])


@query("c9_directional_stripes", """
    WITH dn AS (SELECT v.scene_id, v.sample, count(s.score) / CAST(count(*) AS DOUBLE) AS d FROM valid v LEFT JOIN striped s USING (scene_id, line, sample) GROUP BY ALL),
    bl AS (SELECT a.scene_id, a.sample, a.d, coalesce(median(b.d), 0) AS base FROM dn a LEFT JOIN dn b ON b.scene_id = a.scene_id AND ((b.sample >= a.sample - 6 AND b.sample < a.sample - 1)
      OR (b.sample >= a.sample + 2 AND b.sample < a.sample + 7)) GROUP BY ALL),
    vv AS (SELECT v.*, s.score IS NOT NULL AS hit, count(*) OVER q AS exposed, count(s.score) OVER q AS hits FROM valid v LEFT JOIN striped s USING (scene_id, line, sample)
      WINDOW q AS (PARTITION BY v.scene_id, v.sample ORDER BY v.line RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
    lt AS (SELECT scene_id, line, sample, count(*) OVER (PARTITION BY scene_id, line ORDER BY sample RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lateral_hits FROM striped)
    SELECT vv.scene_id, vv.line, vv.sample FROM vv JOIN lt USING (scene_id, line, sample) JOIN bl USING (scene_id, sample)
    WHERE hit AND d >= 0.15 AND d >= base * 1.8 AND d >= base + 0.04 AND CAST(hits AS DOUBLE) / exposed >= 0.15 AND lateral_hits <= 2""")
def c9(v):
    from ..operators.artifacts import directional_stripes

    return directional_stripes(v.striped.select(*KEY), v.valid, v.frames, S).select(*KEY)
