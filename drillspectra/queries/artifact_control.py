"""Stripe and column artifacts, and the audits built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts, columns, components as CC, grid, maps, quality
from ..plans.registry import query
from ..plans.views import KEY
from ..session import durable
from .decisions import POLICY_SQL, policy_maps
from .planes import SEGMENT_SQL, blocks

SC = ["scene_id"]

PEAK_SQL = f"""{SEGMENT_SQL}, ex AS (SELECT v.scene_id, segment, sample, count(*) AS nv FROM valid v JOIN seg ON seg.scene_id = v.scene_id AND v.line >= start AND v.line < stop GROUP BY ALL),
    hc AS (SELECT h.scene_id, segment, sample, count(*) AS nh FROM striped h JOIN seg ON seg.scene_id = h.scene_id AND h.line >= start AND h.line < stop GROUP BY ALL),
    gr AS (SELECT f.scene_id, segment, CAST(s AS INTEGER) AS sample FROM frames f JOIN seg USING (scene_id), range(0, 32) r(s) WHERE s < samples),
    dd AS (SELECT gr.scene_id, gr.segment, gr.sample, CASE WHEN nv >= 8 THEN coalesce(nh, 0) / nv::DOUBLE ELSE 0 END AS d FROM gr LEFT JOIN ex USING (scene_id, segment, sample) LEFT JOIN hc USING (scene_id, segment, sample)),
    lo AS (SELECT a.scene_id, a.segment, a.sample, a.d, coalesce(median(b.d), 0) AS m FROM dd a LEFT JOIN dd b ON b.scene_id = a.scene_id AND b.segment = a.segment
      AND ((b.sample >= a.sample - 8 AND b.sample < a.sample - 2) OR (b.sample >= a.sample + 3 AND b.sample < a.sample + 9)) GROUP BY ALL),
    pk AS (SELECT scene_id, segment, sample FROM lo WHERE d >= 0.035 AND d - m >= 0.02 AND d / greatest(m, 0.005) >= 2.3)"""
BAND_SQL = f"""{PEAK_SQL}, st AS (SELECT scene_id, sample FROM pk GROUP BY ALL HAVING count(*) >= 2),
    rc AS (SELECT * FROM st UNION SELECT a.scene_id, a.sample + 1 FROM st a JOIN st b ON a.scene_id = b.scene_id AND b.sample = a.sample + 2),
    bd AS (SELECT scene_id, min(sample) AS f, max(sample) AS l FROM (SELECT *, sample - row_number() OVER (PARTITION BY scene_id ORDER BY sample) AS g FROM rc) GROUP BY scene_id, g HAVING count(*) <= 6)"""


@query("c10_repeated_column_stripes", f"""
    WITH {BAND_SQL} SELECT h.scene_id, h.line, h.sample FROM striped h JOIN bd ON bd.scene_id = h.scene_id AND h.sample BETWEEN f AND l
    WHERE NOT EXISTS (SELECT 1 FROM striped n WHERE n.scene_id = h.scene_id AND n.line BETWEEN h.line - 2 AND h.line + 2
      AND ((n.sample >= f - 4 AND n.sample < f) OR (n.sample > l AND n.sample <= l + 4)))""")
def c10(v):
    return artifacts.repeated_stripes(v.striped.select(*KEY), v.valid, v.frames, SC, corridors=False).select(*KEY)


def corridor_map(v):
    """Most of this map sits in three neighbouring columns."""
    return v.cells.where("line % 60 < 40").where("score <= 0.002 or (sample between 14 and 16 and score <= 0.08)").select(*KEY)


@query("c11_dominant_corridor")
def c11(v):
    hits = corridor_map(v)
    peaks = durable(artifacts.segment_peaks(hits, v.valid, v.frames, SC))
    bands = durable(artifacts._bands(artifacts.repeated_columns(peaks, v.frames, SC), SC))
    return artifacts.corridor_stripes(hits, peaks, bands, SC).select(*KEY)


def exposed_edge(v):
    """Material mask in which the last column is exposed for a short stretch only."""
    return v.valid.where("sample <> 31 or line < 80")


def edge_hits(v):
    return v.cells.where("line % 60 < 40").where("(sample <> 31 and score <= 0.001) or (sample = 31 and line < 80 and score <= 0.09)")


@query("c12_low_exposure_column", """
    WITH va AS (SELECT * FROM valid WHERE sample <> 31 OR line < 80),
    hi AS (SELECT * FROM cells WHERE line % 60 < 40 AND ((sample <> 31 AND score <= 0.001) OR (sample = 31 AND line < 80 AND score <= 0.09))),
    ev AS (SELECT scene_id, sample, count(*) AS nv FROM va GROUP BY ALL), tp AS (SELECT scene_id, median(nv) AS t FROM ev GROUP BY scene_id),
    ds AS (SELECT ev.scene_id, ev.sample, nv, coalesce(nh, 0) AS nh, coalesce(nh, 0) / nv::DOUBLE AS d FROM ev LEFT JOIN (SELECT scene_id, sample, count(*) AS nh FROM hi GROUP BY ALL) USING (scene_id, sample)),
    lc AS (SELECT a.*, coalesce((SELECT median(b.d) FROM ds b WHERE b.scene_id = a.scene_id AND b.sample BETWEEN a.sample - 6 AND a.sample + 6 AND b.sample <> a.sample), 0) AS m FROM ds a),
    fl AS (SELECT lc.scene_id, sample FROM lc JOIN tp USING (scene_id) WHERE nv >= 32 AND nv <= 0.1 * t AND nh >= 12 AND d >= 0.15 AND d - m >= 0.1 AND d / greatest(m, 0.005) >= 3)
    SELECT h.scene_id, h.line, h.sample FROM hi h JOIN fl USING (scene_id, sample) WHERE NOT EXISTS (SELECT 1 FROM hi n WHERE n.scene_id = h.scene_id
      AND n.line BETWEEN h.line - 2 AND h.line + 2 AND n.sample BETWEEN h.sample - 3 AND h.sample + 3 AND n.sample <> h.sample)""")
def c12(v):
    return artifacts.low_exposure_stripes(edge_hits(v), exposed_edge(v), v.frames, SC).select(*KEY)


def column_risk(v):
    return columns.fixed_column_risk(v.striped, v.valid, blocks(v), v.frames)


@query("c13_residual_column_band")
def c13(v):
    return artifacts.residual_bands(v.striped.select(*KEY, "confidence"), v.valid, column_risk(v), v.frames)


@query("c14_artifact_filter")
def c14(v):
    labels = v.striped.select(*KEY, "class_id", "confidence")
    return artifacts.filter_artifacts(labels, v.valid, column_risk(v), v.frames).select(*KEY, "class_id", "cause")


def striped_policies(v):
    limits = F.filter(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(t).alias("t")) for p, t in (("conservative", 0.002), ("balanced", 0.003), ("sensitive", 0.004))
    ]), lambda x: (F.col("score") <= x["t"]) | ((F.col("sample") % 11 == 5) & (F.col("score") <= x["t"] * 12)))
    return v.cells.where("line % 60 < 40").select(*KEY, F.col("class_id"), F.explode(limits).alias("p")).select(
        *KEY, "p.policy", "class_id")


@query("c15_terminal_filter")
def c15(v):
    return artifacts.terminal_filter(striped_policies(v), v.valid, v.frames).select(*KEY, "policy", "class_id", "removed_in", "inherited")


@query("q2_residual_stripe_metrics", f"""
    WITH {BAND_SQL}, rp AS (SELECT scene_id, max(n) AS repetition FROM (SELECT scene_id, sample, count(*) AS n FROM pk GROUP BY ALL) GROUP BY scene_id)
    SELECT scene_id, repetition FROM rp""")
def q2(v):
    one = v.striped.select(*KEY, F.lit(1).alias("class_id"))
    return quality.residual_stripes(one, v.valid, v.frames, SC).select("scene_id", "repetition")


@query("q1_run_quality_report")
def q1(v):
    wide = maps.enforce_nesting(policy_maps(v), KEY)
    report = quality.quality_report(wide, v.cells, v.valid, v.frames, 3)
    return report.select("scene_id", "grade", "publishable", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issues"), "classified", "clustered", "peak", "stripe_pixels")


@query("q6_spatial_distribution", f"""
    WITH {POLICY_SQL}, u AS (SELECT scene_id, line, sample, policy, class_id FROM (UNPIVOT nst ON conservative, balanced, sensitive INTO NAME policy VALUE class_id) WHERE class_id > 0),
    n AS (SELECT a.scene_id, a.policy, a.class_id, a.line, a.sample, count(*) - 1 AS near FROM u a JOIN u b ON a.scene_id = b.scene_id AND a.policy = b.policy AND a.class_id = b.class_id
      AND b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1 GROUP BY ALL)
    SELECT scene_id, policy, class_id, count(*) AS pixels, count(*) FILTER (WHERE near > 0) AS supported, count(*) FILTER (WHERE near = 0) AS singletons FROM n GROUP BY ALL""")
def q6(v):
    long = maps.unpivot_policies(maps.enforce_nesting(policy_maps(v), KEY), KEY)
    by = ["scene_id", "policy", "class_id"]
    near = grid.box_counts(long, long, by, 1, 1, include_self=False)
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("n") > 0).cast("long")).alias("supported"),
                                 F.sum((F.col("n") == 0).cast("long")).alias("singletons"))


@query("q9_stripe_audit", """
    WITH d AS (SELECT v.scene_id, v.sample, count(*) AS nv, count(s.score) AS nh FROM valid v LEFT JOIN striped s USING (scene_id, line, sample) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY nh / nv::DOUBLE DESC, sample) AS rank FROM d)
    SELECT scene_id, sample, CAST(rank AS INTEGER) AS rank, round(nh / nv::DOUBLE, 8) AS density FROM k WHERE rank <= 5""")
def q9(v):
    from pyspark.sql import Window as W

    d = columns.density(v.striped, v.valid, SC)
    rank = F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("density"), "sample"))
    return d.withColumn("rank", rank).where("rank <= 5").select("scene_id", "sample", "rank", F.round("density", 8).alias("density"))


VARIANTS = [("narrow", 41, 0.12, 2.0), ("default", 61, 0.15, 1.8), ("strict", 61, 0.25, 2.5), ("wide", 81, 0.10, 1.5)]


def variant_sql(name: str, window: int, density: float, ratio: float) -> str:
    half = window // 2
    return f"""SELECT vv.scene_id, '{name}' AS variant, count(*) AS removed FROM (SELECT v.*, s.score IS NOT NULL AS hit, count(*) OVER q AS exposed, count(s.score) OVER q AS hits
        FROM valid v LEFT JOIN striped s USING (scene_id, line, sample) WINDOW q AS (PARTITION BY v.scene_id, v.sample ORDER BY v.line RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)) vv
      JOIN lt USING (scene_id, line, sample) JOIN bl USING (scene_id, sample)
      WHERE hit AND d >= {density} AND d >= base * {ratio} AND d >= base + 0.04 AND CAST(hits AS DOUBLE) / exposed >= {density} AND lateral_hits <= 2 GROUP BY vv.scene_id"""


@query("q11_stripe_filter_variants", f"""
    WITH dn AS (SELECT v.scene_id, v.sample, count(s.score) / CAST(count(*) AS DOUBLE) AS d FROM valid v LEFT JOIN striped s USING (scene_id, line, sample) GROUP BY ALL),
    bl AS (SELECT a.scene_id, a.sample, a.d, coalesce(median(b.d), 0) AS base FROM dn a LEFT JOIN dn b ON b.scene_id = a.scene_id AND ((b.sample >= a.sample - 6 AND b.sample < a.sample - 1)
      OR (b.sample >= a.sample + 2 AND b.sample < a.sample + 7)) GROUP BY ALL),
    lt AS (SELECT scene_id, line, sample, count(*) OVER (PARTITION BY scene_id, line ORDER BY sample RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lateral_hits FROM striped)
    {" UNION ALL ".join(variant_sql(*x) for x in VARIANTS)}""")
def q11(v):
    hits = v.striped.select(*KEY)
    rows = None
    for name, window, density, ratio in VARIANTS:
        found = artifacts.directional_stripes(hits, v.valid, v.frames, SC, window, density, ratio).groupBy("scene_id").agg(
            F.count(F.lit(1)).alias("removed")).withColumn("variant", F.lit(name))
        rows = found if rows is None else rows.unionByName(found)
    return rows
