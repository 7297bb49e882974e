"""Per-spectrum operators over the pixel table (P1-P18, X1-X3)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import arrays as A, kernels as K, scoring, spectral as S, udfs
from ..plans.registry import query
from ..plans.views import AXIS, BANDS, KEY
from ..session import collect_bounded

LIBRARY_BOUND = 20_000
WINDOWS = [(1350.0, 1800.0), (1850.0, 2260.0)]
POSITIONS = S.window_positions(AXIS, WINDOWS, minimum=3)
SUB_AXIS = [AXIS[i] for i in POSITIONS]
IN_WINDOW = "(w BETWEEN 1350 AND 1800 OR w BETWEEN 1850 AND 2260)"
FEATURES = [
    {"id": "center", "type": "center_nm", "window_nm": (1410.0, 1490.0)},
    {"id": "ratio", "type": "depth_ratio", "window_nm": (1720.0, 1785.0)},
    {"id": "depth", "type": "depth", "window_nm": (2140.0, 2250.0)},
    {"id": "absent", "type": "depth", "window_nm": (3000.0, 3100.0)},
]


def library(v) -> list:
    """The checked, configuration-sized reference library in a fixed order."""
    rows = collect_bounded(v.refs, LIBRARY_BOUND, "the reference library")
    return sorted(rows, key=lambda r: (r["mineral"], r["ref_id"]))


def long(df, digits: int = 6):
    return df.select(*KEY, F.posexplode("x").alias("band", "value")).withColumn(
        "value", F.round("value", digits)
    )


@query("p1_band_window_selection", f"""
    SELECT scene_id, line, sample, count(*) AS bands, round(sum(v), 6) AS level
    FROM px WHERE {IN_WINDOW} GROUP BY ALL""")
def p1(v):
    x = A.gather(F.col("spectrum"), POSITIONS)
    return v.pixels.select(
        *KEY, F.size(x).cast("long").alias("bands"), F.round(A.total(x), 6).alias("level")
    )


def _weights_sql(window: int, order: int) -> str:
    half = window // 2
    return ", ".join(
        f"({k - half}, {float(w)!r}::DOUBLE)" for k, w in enumerate(S.smoothing_weights(window, order))
    )


SMOOTH_SQL = f"""k(o, wt) AS (VALUES {_weights_sql(11, 2)}),
    sm AS (SELECT p.scene_id, p.line, p.sample, p.band, sum(q.v * k.wt) AS s
      FROM px p, k, px q WHERE q.vec_id = p.vec_id
      AND q.band = greatest(0, least(63, p.band + k.o)) GROUP BY ALL)"""


@query("p2_savgol_smoothing", f"""
    WITH {SMOOTH_SQL} SELECT scene_id, line, sample, band, round(s, 6) AS value FROM sm""")
def p2(v):
    return long(v.pixels.withColumn("x", S.savgol(F.col("spectrum"), BANDS)))


@query("p2_savgol_smoothing_kernel", f"""
    WITH {SMOOTH_SQL} SELECT scene_id, line, sample, band, round(s, 6) AS value FROM sm""")
def p2_kernel(v):
    return long(v.pixels.withColumn("x", K.smooth(BANDS)(F.col("spectrum"))))


@query("p3_detector_column_correction", f"""
    WITH {SMOOTH_SQL}, b AS (SELECT scene_id, sample, band, median(s) AS m FROM sm GROUP BY ALL),
    l AS (SELECT a.scene_id, a.sample, a.band, a.m - median(n.m) AS d FROM b a JOIN b n ON n.scene_id = a.scene_id AND n.band = a.band
      AND n.sample BETWEEN a.sample - 2 AND a.sample + 2 GROUP BY a.scene_id, a.sample, a.band, a.m),
    c AS (SELECT scene_id, sample, band, d - median(d) OVER (PARTITION BY scene_id, band) AS bias FROM l)
    SELECT scene_id, line, sample, band, round(s - 0.7::DOUBLE * bias, 6) AS value FROM sm JOIN c USING (scene_id, sample, band)""")
def p3(v):
    from ..operators.columns import column_bias

    smooth = v.pixels.select(*KEY, K.smooth(BANDS)(F.col("spectrum")).alias("smooth"))
    joined = smooth.join(column_bias(smooth, v.pixel_frames, "smooth"), ["scene_id", "sample"])
    return long(joined.withColumn("x", S.column_corrected(F.col("smooth"), F.col("bias"))))


ANGLE_SQL = """acos(greatest(-1, least(1, list_dot_product(p.spectrum, r.spectrum) /
    (sqrt(list_dot_product(p.spectrum, p.spectrum)) * sqrt(list_dot_product(r.spectrum, r.spectrum))))))"""


@query("p4_spectral_angle", f"""
    SELECT p.scene_id, p.line, p.sample, CAST(r.pos AS INTEGER) AS band, round({ANGLE_SQL}, 6) AS value
    FROM pixels p, (SELECT spectrum, row_number() OVER (ORDER BY mineral, ref_id) - 1 AS pos FROM refs) r""")
def p4(v):
    refs = A.literal_matrix([r["spectrum"] for r in library(v)])
    x = F.transform(refs, lambda r: S.spectral_angle(F.col("spectrum"), r))
    return long(v.pixels.withColumn("x", x))


@query("p5_angle_classification", f"""
    WITH a AS (SELECT p.scene_id, p.line, p.sample, r.pos, {ANGLE_SQL} AS angle FROM pixels p,
      (SELECT spectrum, row_number() OVER (ORDER BY mineral, ref_id) - 1 AS pos FROM refs) r),
    b AS (SELECT scene_id, line, sample, pos, angle,
      row_number() OVER (PARTITION BY scene_id, line, sample ORDER BY angle, pos) AS rn FROM a)
    SELECT scene_id, line, sample, CAST(CASE WHEN angle <= 0.15 THEN pos + 1 ELSE 0 END AS INTEGER) AS label
    FROM b WHERE rn = 1""")
def p5(v):
    angles = K.angles_to([r["spectrum"] for r in library(v)])(F.col("spectrum"))
    best = F.array_min(
        F.transform("angles", lambda a, i: F.struct(a.alias("angle"), i.alias("at")))
    )
    return (
        v.pixels.withColumn("angles", angles)
        .withColumn("best", best)
        .select(*KEY, F.when(F.col("best.angle") <= 0.15, F.col("best.at") + 1).otherwise(0).alias("label"))
    )


@query("p6_continuum_upper_hull", """
    WITH RECURSIVE nx AS (SELECT a.vec_id, a.band, arg_max(b.band, struct_pack(s := (b.v - a.v) / (b.w - a.w), b := b.band)) AS nb
      FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.band > a.band GROUP BY ALL),
    hull(vec_id, band, nb) AS (SELECT vec_id, band, nb FROM nx WHERE band = 0
      UNION ALL SELECT nx.vec_id, nx.band, nx.nb FROM hull JOIN nx ON nx.vec_id = hull.vec_id AND nx.band = hull.nb),
    c AS (SELECT p.scene_id, p.line, p.sample, p.band, p.v, a.v + (b.v - a.v) * (p.w - a.w) / (b.w - a.w) AS c
      FROM hull h JOIN px a ON a.vec_id = h.vec_id AND a.band = h.band JOIN px b ON b.vec_id = h.vec_id AND b.band = h.nb
      JOIN px p ON p.vec_id = h.vec_id AND p.band >= h.band AND (p.band < h.nb OR p.band = 63 AND h.nb = 63))
    SELECT scene_id, line, sample, band, round(greatest(1 - v / c, 0), 6) AS value FROM c""")
def p6(v):
    return long(v.pixels.withColumn("x", K.absorb(AXIS, range(BANDS), "hull")(F.col("spectrum"))))


# the sub-axis splits at the 1800/1860 gap only when it exceeds four spacings
GAPPED = [i for i in range(BANDS) if not 20 <= i < 40]
GAPPED_AXIS = [AXIS[i] for i in GAPPED]
SEGMENT_SQL = """g AS (SELECT *, CASE WHEN band < 20 THEN 0 ELSE 1 END AS seg FROM px
      WHERE band < 20 OR band >= 40),
    e AS (SELECT vec_id, seg, min(w) AS w0, max(w) AS w1, min_by(v, band) AS l, max_by(v, band) AS r
      FROM g GROUP BY ALL),
    cr AS (SELECT g.*, row_number() OVER (PARTITION BY vec_id ORDER BY band) - 1 AS pos,
      g.v / (e.l + (e.r - e.l) * ((g.w - e.w0) / (e.w1 - e.w0))) AS c
      FROM g JOIN e USING (vec_id, seg))"""


@query("p7_continuum_segmented_line", f"""
    WITH {SEGMENT_SQL} SELECT scene_id, line, sample, CAST(pos AS INTEGER) AS band, round(c, 6) AS value FROM cr""")
def p7(v):
    x = S.continuum_segmented(A.gather(F.col("spectrum"), GAPPED), GAPPED_AXIS)
    return long(v.pixels.withColumn("x", x))


@query("p8_absorption_depth", f"""
    WITH {SEGMENT_SQL} SELECT scene_id, line, sample, round(max(greatest(1 - c, 0)), 6) AS depth,
      round(sum(greatest(1 - c, 0)), 6) AS area FROM cr GROUP BY ALL""")
def p8(v):
    x = S.absorption(S.continuum_segmented(A.gather(F.col("spectrum"), GAPPED), GAPPED_AXIS))
    return v.pixels.withColumn("x", x).select(
        *KEY, F.round(S.depth(F.col("x")), 6).alias("depth"), F.round(A.total(F.col("x")), 6).alias("area")
    )


def absorbed(v):
    """Pixels with the absorption curve over the classification windows."""
    curve = K.absorb(AXIS, POSITIONS)(F.col("spectrum"))
    return v.pixels.withColumn("curve", curve)


# one segment: the windows sit 60 nm apart, below four 20 nm spacings
ABSORBED_SQL = f"""e AS (SELECT vec_id, min(w) AS w0, max(w) AS w1, min_by(v, band) AS l, max_by(v, band) AS r
      FROM px WHERE {IN_WINDOW} GROUP BY vec_id),
    ab AS (SELECT p.*, greatest(1 - p.v / (e.l + (e.r - e.l) * ((p.w - e.w0) / (e.w1 - e.w0))), 0) AS a
      FROM px p JOIN e USING (vec_id) WHERE {IN_WINDOW})"""
FEATURE_SQL = f"""{ABSORBED_SQL},
    ft AS (SELECT scene_id, line, sample, vec_id,
      arg_max(w, struct_pack(a := a, b := -band)) FILTER (WHERE w BETWEEN 1410 AND 1490) AS center,
      max(a) FILTER (WHERE w BETWEEN 1720 AND 1785) / greatest(max(a), 1e-12) AS ratio,
      max(a) FILTER (WHERE w BETWEEN 2140 AND 2250) AS depth FROM ab GROUP BY ALL)"""


@query("p9_diagnostic_features", f"""
    WITH {FEATURE_SQL} SELECT scene_id, line, sample, center, round(ratio, 6) AS ratio,
      round(depth, 6) AS depth, CAST(NULL AS DOUBLE) AS absent FROM ft""")
def p9(v):
    f = S.features(F.col("curve"), SUB_AXIS, FEATURES)
    return absorbed(v).withColumn("f", f).select(
        *KEY, F.col("f")["center"].alias("center"), F.round(F.col("f")["ratio"], 6).alias("ratio"),
        F.round(F.col("f")["depth"], 6).alias("depth"), F.col("f")["absent"].alias("absent"),
    )


@query("p10_feature_normalisation", f"""
    WITH {FEATURE_SQL} SELECT scene_id, line, sample, round((center - 1410) / 80, 6) AS center,
      round(ratio, 6) AS ratio, round(depth, 6) AS depth FROM ft""")
def p10(v):
    vector = S.feature_vector(S.features(F.col("curve"), SUB_AXIS, FEATURES), FEATURES)
    return absorbed(v).withColumn("f", vector).select(
        *KEY, *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(("center", "ratio", "depth"))]
    )


@query("p11_unit_vector", """
    SELECT scene_id, line, sample, band, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM px""")
def p11(v):
    return long(v.pixels.withColumn("x", A.unit(F.col("spectrum"))))


@query("p12_spectral_derivative", """
    WITH n AS (SELECT *, lag(v) OVER p AS pv, lead(v) OVER p AS nv, lag(w) OVER p AS pw, lead(w) OVER p AS nw
      FROM px WHERE band % 7 <> 3 WINDOW p AS (PARTITION BY vec_id ORDER BY band))
    SELECT scene_id, line, sample, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY band) - 1 AS INTEGER) AS band,
      round(CASE WHEN pv IS NULL THEN (nv - v) / (nw - w) WHEN nv IS NULL THEN (v - pv) / (w - pw)
      ELSE ((w - pw) * (w - pw) * nv + ((nw - w) * (nw - w) - (w - pw) * (w - pw)) * v - (nw - w) * (nw - w) * pv)
        / ((w - pw) * (nw - w) * (nw - pw)) END, 6) AS value FROM n""")
def p12(v):
    kept = [i for i in range(BANDS) if i % 7 != 3]
    x = S.derivative(A.gather(F.col("spectrum"), kept), [AXIS[i] for i in kept])
    return long(v.pixels.withColumn("x", x))


PAIR_SQL = f"""{ABSORBED_SQL},
    ra AS (SELECT ab.vec_id AS ref_id, band, a, mineral FROM ab JOIN refs ON ref_id = vec_id),
    d AS (SELECT ab.scene_id, ab.line, ab.sample, ref_id, mineral, sum(ab.a * ra.a) AS cross_sum, sum(ra.a * ra.a) AS energy,
      sum(ab.a * ab.a) AS own, count(*) AS n FROM ab JOIN ra USING (band) GROUP BY ALL)"""


@query("p13_feature_fit", f"""
    WITH {PAIR_SQL}, s AS (SELECT *, cross_sum / energy AS scale FROM d),
    r AS (SELECT *, sqrt(greatest(own - 2 * scale * cross_sum + scale * scale * energy, 0) / n) AS rms FROM s)
    SELECT scene_id, line, sample, ref_id, round(scale, 6) AS scale, round(rms, 6) AS rms,
      round(CASE WHEN scale > 0 AND rms > 1e-6 THEN scale / rms ELSE 0 END, 4) AS quality FROM r""")
def p13(v):
    curves = absorbed(v)
    refs = collect_bounded(
        curves.join(v.refs.select("ref_id"), F.col("vec_id") == F.col("ref_id"), "left_semi")
        .select("vec_id", "curve"), LIBRARY_BOUND, "the reference library")
    table = A.literal_matrix([r["curve"] for r in refs])
    ids = A.literal_doubles([r["vec_id"] for r in refs])
    fits = F.transform(table, lambda r, i: F.struct(
        F.get(ids, i).cast("long").alias("ref_id"), S.feature_fit(F.col("curve"), r).alias("f")))
    return curves.select(*KEY, F.inline(fits)).select(
        *KEY, "ref_id", F.round("f.scale", 6).alias("scale"), F.round("f.rms", 6).alias("rms"),
        F.round(F.when((F.col("f.rms") > 1e-6), F.col("f.quality")).otherwise(0.0), 4).alias("quality"))


def evidence_inputs(v):
    curves = absorbed(v)
    rows = collect_bounded(
        curves.join(v.refs.select("ref_id", "mineral"), F.col("vec_id") == F.col("ref_id"))
        .select("mineral", "vec_id", "curve"), LIBRARY_BOUND, "the reference library")
    return curves, sorted(rows, key=lambda r: (r["mineral"], r["vec_id"]))


GRADIENT_SQL = """gr AS (SELECT vec_id, band, a, CASE WHEN pa IS NULL THEN (na - a) / (nw - w) WHEN na IS NULL THEN (a - pa) / (w - pw)
      ELSE ((w - pw) * (w - pw) * na + ((nw - w) * (nw - w) - (w - pw) * (w - pw)) * a - (nw - w) * (nw - w) * pa)
        / ((w - pw) * (nw - w) * (nw - pw)) END AS g FROM
      (SELECT *, lag(a) OVER q AS pa, lead(a) OVER q AS na, lag(w) OVER q AS pw, lead(w) OVER q AS nw FROM ab
       WINDOW q AS (PARTITION BY vec_id ORDER BY band)))"""
EVIDENCE_SQL = f"""{FEATURE_SQL}, {GRADIENT_SQL},
    rr AS (SELECT ref_id, mineral, row_number() OVER (ORDER BY mineral, ref_id) - 1 AS pos FROM refs),
    dd AS (SELECT p.vec_id, rr.pos, sum(p.a * r.a) AS c, sum(p.a * p.a) AS pp, sum(r.a * r.a) AS qq,
      sum(p.g * r.g) AS gc, sum(p.g * p.g) AS gp, sum(r.g * r.g) AS gq, avg(abs(p.a)) AS lvl, count(*) AS n
      FROM gr p JOIN gr r USING (band) JOIN rr ON rr.ref_id = r.vec_id GROUP BY ALL),
    ev AS (SELECT f.scene_id, f.line, f.sample, dd.pos, dd.vec_id,
      CASE WHEN pp > 0 AND qq > 0 THEN acos(greatest(-1, least(1, c / (sqrt(pp) * sqrt(qq))))) END AS shape,
      CASE WHEN gp > 0 AND gq > 0 THEN acos(greatest(-1, least(1, gc / (sqrt(gp) * sqrt(gq))))) END AS slope,
      sqrt((((f.center - rf.center) / 80) ** 2 + (f.ratio - rf.ratio) ** 2 + (f.depth - rf.depth) ** 2) / 3) AS feat,
      least(sqrt(greatest(pp - CASE WHEN qq > 0 THEN c * c / qq ELSE 0 END, 0) / n) / greatest(lvl, 1e-8), pi()) AS fit
      FROM dd JOIN ft f USING (vec_id) JOIN rr USING (pos) JOIN ft rf ON rf.vec_id = rr.ref_id)"""
EVIDENCE_WEIGHTS = {"shape": 0.5, "derivative": 0.15, "features": 0.25, "fit": 0.1}


@query("p14_reference_evidence", f"""
    WITH {EVIDENCE_SQL} SELECT scene_id, line, sample, CAST(pos AS INTEGER) AS band,
      round(((coalesce(0.5 * shape, 0) + coalesce(0.15 * slope, 0) + 0.25 * feat + 0.1 * fit) / (0.35 + CASE WHEN shape IS NULL THEN 0 ELSE 0.5 END + CASE WHEN slope IS NULL THEN 0 ELSE 0.15 END)), 5) AS value FROM ev
      WHERE vec_id NOT IN (SELECT ref_id FROM refs)""")
def p14(v):
    curves, refs = evidence_inputs(v)
    x = K.evidence_to([r["curve"] for r in refs], SUB_AXIS, FEATURES, EVIDENCE_WEIGHTS)(F.col("curve"))
    pixels = curves.join(v.refs.select("ref_id"), F.col("vec_id") == F.col("ref_id"), "left_anti")
    return long(pixels.withColumn("x", x), 5)


@query("p14_reference_evidence_expression", f"""
    WITH {EVIDENCE_SQL} SELECT scene_id, line, sample,
      round(sum(((coalesce(0.5 * shape, 0) + coalesce(0.15 * slope, 0) + 0.25 * feat + 0.1 * fit) / (0.35 + CASE WHEN shape IS NULL THEN 0 ELSE 0.5 END + CASE WHEN slope IS NULL THEN 0 ELSE 0.15 END))), 4) AS total FROM ev
      WHERE vec_id NOT IN (SELECT ref_id FROM refs) GROUP BY ALL""")
def p14_expression(v):
    curves, refs = evidence_inputs(v)
    pixels = curves.join(v.refs.select("ref_id"), F.col("vec_id") == F.col("ref_id"), "left_anti")
    table = A.literal_matrix([r["curve"] for r in refs])
    values = F.transform(table, lambda r: S.reference_evidence(F.col("curve"), r, SUB_AXIS, FEATURES, EVIDENCE_WEIGHTS)["total"])
    return pixels.select(*KEY, F.round(A.total(values), 4).alias("total"))


def _end_weights_sql(name: str, window: int) -> str:
    rows = [
        f"({i}, {p}, {float(w)!r}::DOUBLE)"
        for i, row in enumerate(S._end_fitted_taps(BANDS, window, 2)) for p, w in row
    ]
    return f"{name}(o, i, wt) AS (VALUES {', '.join(rows)})"


@query("p15_narrow_absorption", f"""
    WITH {_end_weights_sql('f5', 5)}, {_end_weights_sql('f31', 31)},
    a AS (SELECT vec_id, o AS band, sum(v * wt) AS s FROM px JOIN f5 ON i = band GROUP BY ALL),
    b AS (SELECT vec_id, o AS band, sum(s * wt) AS t FROM a JOIN f31 ON i = band GROUP BY ALL)
    SELECT scene_id, line, sample, band, round((t - s) / greatest(abs(t), 1e-8), 6) AS value
    FROM px JOIN a USING (vec_id, band) JOIN b USING (vec_id, band)""")
def p15(v):
    return long(v.pixels.withColumn("x", S.narrow_absorption(F.col("spectrum"), BANDS)))


@query("p16_relative_noise", """
    WITH d AS (SELECT scene_id, vec_id, abs(v) AS m, (v - 2 * lead(v, 1) OVER p + lead(v, 2) OVER p) / sqrt(6) AS s
      FROM px WINDOW p AS (PARTITION BY vec_id ORDER BY band)),
    c AS (SELECT *, median(s) OVER (PARTITION BY vec_id) AS k FROM d),
    r AS (SELECT scene_id, vec_id, 1.4826::DOUBLE * median(abs(s - k)) / greatest(median(m), 1e-8) AS noise FROM c GROUP BY ALL)
    SELECT scene_id, round(least(greatest(median(noise), 0), 0.05), 6) AS noise FROM r GROUP BY scene_id""")
def p16(v):
    from ..operators.quantiles import exact_quantiles

    rows = v.pixels.select("scene_id", S.relative_noise(F.col("spectrum"), BANDS).alias("noise"))
    return exact_quantiles(rows, ["scene_id"], "noise", [0.5]).select(
        "scene_id", F.round(F.least(F.greatest("q0", F.lit(0.0)), F.lit(0.05)), 6).alias("noise")
    )


SPREAD = S.spread_positions(AXIS)
SPREAD_SQL = ", ".join(str(i) for i in SPREAD)


@query("p17_brightness_contrast", f"""
    WITH b AS (SELECT scene_id, line, sample, median(v) AS level, max(v) AS hi, min(v) AS lo, count(*) AS n
      FROM px WHERE band IN ({SPREAD_SQL}) AND v > 1e-10 GROUP BY ALL)
    SELECT scene_id, line, sample, round(level, 6) AS brightness,
      round((hi - lo) / greatest(abs(level), 1e-10), 6) AS contrast, n >= 7 AS usable FROM b""")
def p17(v):
    return v.pixels.withColumn("b", S.brightness_contrast(F.col("spectrum"), SPREAD)).select(
        *KEY, F.round("b.brightness", 6).alias("brightness"),
        F.round("b.contrast", 6).alias("contrast"), F.col("b.usable").alias("usable"))


@query("p18_band_picker", """
    WITH x AS (SELECT DISTINCT scene_id, band, w FROM px),
    r AS (SELECT scene_id, min(w) AS lo, max(w) AS hi FROM x GROUP BY ALL),
    t AS (SELECT scene_id, lo + (hi - lo) * k / 10.0::DOUBLE AS target FROM r, range(1, 10) q(k)),
    p AS (SELECT scene_id, target, arg_min(band, struct_pack(d := abs(w - target), b := band)) AS band FROM t JOIN x USING (scene_id) GROUP BY ALL)
    SELECT DISTINCT scene_id, band FROM p""")
def p18(v):
    axis = v.px.groupBy("scene_id", "band").agg(F.min("w").alias("w"))
    ends = axis.groupBy("scene_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    targets = ends.select(
        "scene_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)),
                              lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / 10.0)).alias("target"))
    near = targets.join(axis, "scene_id").groupBy("scene_id", "target").agg(
        F.min(F.struct(F.abs(F.col("w") - F.col("target")).alias("gap"), "band")).alias("best"))
    return near.select("scene_id", F.col("best.band").alias("band")).distinct()


@query("u7_near_tie_relabel", f"""
    WITH a AS (SELECT p.scene_id, p.line, p.sample, r.mineral, min({ANGLE_SQL}) AS s FROM pixels p, refs r GROUP BY ALL),
    b AS (SELECT *, min(s) OVER (PARTITION BY scene_id, line, sample) AS best FROM a),
    n AS (SELECT *, s - mineral * 0.001::DOUBLE AS adj FROM b WHERE s <= best + 0.03::DOUBLE)
    SELECT scene_id, line, sample, CAST(arg_min(mineral, adj) + 1 AS INTEGER) AS label, CAST(count(*) AS INTEGER) AS tied
    FROM n GROUP BY ALL""")
def u7(v):
    rows = library(v)
    minerals = sorted({r["mineral"] for r in rows})
    angles = K.angles_to([r["spectrum"] for r in rows])(F.col("spectrum"))
    scored = v.pixels.withColumn("angles", angles).withColumn(
        "scores", scoring.mineral_scores(F.col("angles"), [r["mineral"] for r in rows], minerals, 1)["score"])
    tie = scoring.near_tie_label(F.col("scores"), A.literal_doubles([m * 0.001 for m in minerals]), 0.03)
    return scored.withColumn("t", tie).select(*KEY, "t.label", "t.tied")


SCORE_SQL = f"""sc AS (SELECT p.scene_id, p.line, p.sample, r.mineral, r.group_no, r.ref_id, {ANGLE_SQL} AS s FROM pixels p, refs r),
    rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, line, sample, mineral ORDER BY s) AS rn,
      min(s) OVER (PARTITION BY scene_id, line, sample, mineral) AS best FROM sc),
    ms AS (SELECT scene_id, line, sample, group_no, mineral, avg(s) FILTER (WHERE rn <= 2) AS score,
      avg(CASE WHEN s <= best + greatest(0.025, best * 0.2) THEN 1.0::DOUBLE ELSE 0 END) AS consensus FROM rk GROUP BY ALL)"""


def scored_pixels(v, k: int = 2):
    """Pixels with one score and consensus per library mineral, in mineral order."""
    rows = library(v)
    minerals = sorted({r["mineral"] for r in rows})
    angles = K.angles_to([r["spectrum"] for r in rows])(F.col("spectrum"))
    return v.pixels.withColumn("angles", angles).withColumn(
        "minerals", scoring.mineral_scores(F.col("angles"), [r["mineral"] for r in rows], minerals, k))


@query("a1_best_k_mean_consensus", f"""
    WITH {SCORE_SQL} SELECT scene_id, line, sample, mineral, round(score, 5) AS score, round(consensus, 6) AS consensus FROM ms""")
def a1(v):
    return scored_pixels(v).select(*KEY, F.inline("minerals")).select(
        *KEY, "mineral", F.round("score", 5).alias("score"), F.round("consensus", 6).alias("consensus"))


@query("a2_mineral_competition", f"""
    WITH {SCORE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, line, sample ORDER BY score, mineral) AS pos FROM ms)
    SELECT scene_id, line, sample, CAST(max(CASE WHEN pos = 1 THEN mineral + 1 END) AS INTEGER) AS label,
      round(min(CASE WHEN pos = 1 THEN score END), 5) AS best, round(min(CASE WHEN pos = 2 THEN score END), 5) AS second,
      round(min(CASE WHEN pos = 2 THEN score END) - min(CASE WHEN pos = 1 THEN score END), 5) AS margin
    FROM o GROUP BY ALL""")
def a2(v):
    won = scoring.competition(F.col("minerals")["score"])
    return scored_pixels(v).withColumn("c", won).select(
        *KEY, "c.label", *[F.round(f"c.{n}", 5).alias(n) for n in ("best", "second", "margin")])


@query("j1_pixel_reference_scoring", f"""
    WITH {SCORE_SQL} SELECT scene_id, line, sample, group_no, round(min(s), 6) AS score FROM sc GROUP BY ALL""")
def j1(v):
    rows = library(v)
    groups = sorted({r["group_no"] for r in rows})
    angles = K.angles_to([r["spectrum"] for r in rows])(F.col("spectrum"))
    per_group = F.array(*[
        F.struct(F.lit(g).alias("group_no"), F.round(F.array_min(F.array(
            *[F.col("angles")[i] for i, r in enumerate(rows) if r["group_no"] == g])), 6).alias("score"))
        for g in groups])
    return v.pixels.withColumn("angles", angles).select(*KEY, F.inline(per_group))


@query("j2_shared_family_detection", f"""
    WITH {SCORE_SQL} SELECT scene_id, line, sample, g AS group_no, round(min(s), 6) AS score
    FROM sc JOIN (VALUES (0, 0), (1, 0), (2, 1), (3, 1)) f(g, fam) ON fam = group_no // 2 GROUP BY ALL""")
def j2(v):
    rows = library(v)
    groups = sorted({r["group_no"] for r in rows})
    angles = K.angles_to([r["spectrum"] for r in rows])(F.col("spectrum"))
    family = {f: F.array_min(F.array(*[F.col("angles")[i] for i, r in enumerate(rows) if r["group_no"] // 2 == f]))
              for f in {g // 2 for g in groups}}
    shared = F.array(*[F.struct(F.lit(g).alias("group_no"), F.round(family[g // 2], 6).alias("score")) for g in groups])
    return v.pixels.withColumn("angles", angles).select(*KEY, F.inline(shared))


@query("j13_winner_value", f"""
    WITH {SCORE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, line, sample ORDER BY score, mineral) AS pos FROM ms)
    SELECT scene_id, line, sample, mineral + 1 AS label, round(consensus, 6) AS consensus FROM o WHERE pos = 1""")
def j13(v):
    won = scoring.competition(F.col("minerals")["score"])["label"]
    return scored_pixels(v).withColumn("label", won).select(
        *KEY, "label", F.round(scoring.gather_winner(F.col("minerals")["consensus"], F.col("label")), 6).alias("consensus"))


@query("x1_scalar_sql_functions", f"""
    WITH {ABSORBED_SQL}, k(o, wt) AS (VALUES {_weights_sql(5, 2)}),
    sm AS (SELECT p.scene_id, p.line, p.sample, p.vec_id, p.band, sum(q.v * k.wt) AS s FROM px p, k, px q
      WHERE q.vec_id = p.vec_id AND q.band = greatest(0, least(63, p.band + k.o)) GROUP BY ALL),
    m AS (SELECT vec_id, max(a) AS d FROM ab GROUP BY ALL)
    SELECT scene_id, line, sample, round(acos(least(1, sum(s * p.v) / (sqrt(sum(s * s)) * sqrt(sum(p.v * p.v))))), 5) AS angle,
      round(any_value(d), 6) AS depth FROM sm JOIN px p USING (scene_id, line, sample, vec_id, band) JOIN m USING (vec_id) GROUP BY ALL""")
def x1(v):
    udfs.register_scalars(v.spark, AXIS, POSITIONS)
    v.pixels.createOrReplaceTempView("pixels")
    return v.spark.sql("""
        SELECT scene_id, line, sample, round(spectral_angle(smooth5(spectrum), spectrum), 5) AS angle,
          round(array_max(absorption_segmented(spectrum)), 6) AS depth FROM pixels""")


@query("x2_best_k_aggregate", f"""
    WITH {SCORE_SQL} SELECT scene_id, line, sample, mineral, round(score, 5) AS score FROM ms""")
def x2(v):
    rows = library(v)
    angles = K.angles_to([r["spectrum"] for r in rows])(F.col("spectrum"))
    minerals = F.array(*[F.lit(r["mineral"]) for r in rows])
    pairs = v.pixels.select(*KEY, F.inline(F.arrays_zip(minerals.alias("mineral"), angles.alias("angle"))))
    return pairs.groupBy(*KEY, "mineral").agg(F.round(udfs.best_two_mean(F.col("angle")), 5).alias("score"))


@query("x3_feature_table_function", f"""
    WITH {FEATURE_SQL} SELECT scene_id, line, sample, feature_id, round(value, 6) AS value FROM
      (SELECT scene_id, line, sample, unnest([struct_pack(feature_id := 'center', value := center),
        struct_pack(feature_id := 'ratio', value := ratio), struct_pack(feature_id := 'depth', value := depth)], recursive := true) FROM ft)""")
def x3(v):
    udfs.register_feature_table(v.spark, SUB_AXIS, FEATURES[:3])
    absorbed(v).createOrReplaceTempView("absorbed")
    return v.spark.sql("""
        SELECT scene_id, line, sample, f.feature_id, round(f.value, 6) AS value
        FROM absorbed, LATERAL spectrum_features(curve) f""")
