"""Gates, acceptance, map algebra, joins and samples."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import arrays as A, scoring, spectral as S
from ..operators import grid, maps, sampling
from ..operators.quantiles import exact_quantiles
from ..plans.registry import query
from ..plans.views import KEY

SC = ["scene_id"]


# --- gates and acceptance -------------------------------------------------

GATES = {
    1: {"center_feature": "center", "center_window_nm": [2290.0, 2340.0],
        "center_window_nm_by_policy": {"sensitive": [2280.0, 2350.0]},
        "minimum_absorption_depth_by_policy": {"conservative": 0.5, "balanced": 0.4, "sensitive": 0.3}},
    2: {"minimum_feature_values": {"ratio": 0.3, "tax": 0.4}, "minimum_feature_match": "any"},
    3: {"minimum_feature_values": {"ratio": 0.2, "tax": 0.3}},
}


@query("p20_mineral_feature_gate", """
    SELECT scene_id, line, sample, policy, CASE class_id
      WHEN 1 THEN 2250 + confidence * 100 BETWEEN CASE WHEN policy = 'sensitive' THEN 2280 ELSE 2290 END AND CASE WHEN policy = 'sensitive' THEN 2350 ELSE 2340 END
        AND depth >= CASE policy WHEN 'conservative' THEN 0.5 WHEN 'balanced' THEN 0.4 ELSE 0.3 END
      WHEN 2 THEN confidence >= 0.3 OR margin >= 0.4 ELSE confidence >= 0.2 AND margin >= 0.3 END AS passed
    FROM candidate, (VALUES ('conservative'), ('balanced'), ('sensitive')) p(policy)""")
def p20(v):
    gates = v.spark.createDataFrame(scoring.gate_table(GATES), scoring.GATE_SCHEMA)  # a row per mineral and policy of the catalog
    values = F.create_map(F.lit("center"), 2250 + F.col("confidence") * 100, F.lit("ratio"), F.col("confidence"), F.lit("tax"), F.col("margin"))
    return v.candidate.join(gates, F.col("class_id") == F.col("mineral")).select(*KEY, "policy", scoring.gate_passed(F.col("depth"), values).alias("passed"))


@query("p21_margin_gate", """
    SELECT scene_id, line, sample, class_id > 0 AND (class_id = 3 OR margin >= 0.4) AS passed FROM candidate""")
def p21(v):
    alone = F.when(F.col("class_id") == 3, 1).otherwise(2)
    ok = scoring.margin_pass(F.col("margin"), F.lit(0.4), alone, F.col("class_id") > 0)
    return v.candidate.select(*KEY, ok.alias("passed"))


P22_SQL = """q AS (SELECT scene_id, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.9) AS p90, quantile_cont(margin, 0.75) AS m75 FROM candidate GROUP BY scene_id),
    t AS (SELECT c.*, least(greatest((p90 - score) / greatest(p90 - p10, 1e-6), 0), 1) AS bs,
      least(greatest(margin / greatest(m75, 0.015), 0), 1) AS bm, least(greatest(1 - score / 0.03, 0), 1) AS ba,
      least(greatest(depth / 0.6, 0), 1) AS bd, CASE WHEN class_id <> 2 THEN 1 ELSE 0 END AS ag FROM candidate c JOIN q USING (scene_id)),
    u AS (SELECT *, least(0.4::DOUBLE * ag + 0.35 * bm + 0.25 * confidence, 1) AS st FROM t),
    cf AS (SELECT *, (0.2 * ba + 0.2 * bs + 0.2 * bm + 0.15 * confidence + 0.15 * bd + 0.1 * st) * (1 - 0.35 * (sample % 4) / 4.0::DOUBLE)
      * (1 - 0.45 * (line % 2)) * CASE WHEN depth > 0.98 THEN 0.45 ELSE 1 END AS conf FROM u)"""


def evidence(v):
    q = exact_quantiles(v.candidate, SC, "score", [0.1, 0.9]).select("scene_id", F.col("q0").alias("p10"), F.col("q1").alias("p90"))
    m = exact_quantiles(v.candidate, SC, "margin", [0.75]).select("scene_id", F.col("q0").alias("m75"))
    c = F.col
    both = scoring.confidence(
        angle=c("score"), angle_limit=F.lit(0.03), best_raw=c("score"), p10=c("p10"), p90=c("p90"),
        margin=c("margin"), margin_p75=c("m75"), minerals=F.lit(3), consensus_share=c("confidence"),
        depth=c("depth"), depth_floor=F.lit(0.3), agrees=c("class_id") != 2, classified=c("class_id") > 0,
        column_risk=(c("sample") % 4) / 4.0, edge_risk=(c("line") % 2).cast("double"), saturated=c("depth") > 0.98)
    return v.candidate.join(q, SC).join(m, SC).withColumn("e", both)


@query("p22_confidence_stability", f"""
    WITH {P22_SQL} SELECT scene_id, line, sample, round(st, 7) AS stability, round(conf, 7) AS confidence FROM cf""")
def p22(v):
    return evidence(v).select(*KEY, F.round("e.stability", 7).alias("stability"), F.round("e.confidence", 7).alias("confidence"))


ACCEPT = "depth >= 0.4 AND class_id <> 3 AND margin >= 0.2 AND confidence >= 0.2 AND st >= 0.4 AND conf >= 0.25"


def accepted():
    return ((F.col("depth") >= 0.4) & (F.col("class_id") != 3) & (F.col("margin") >= 0.2)
            & (F.col("confidence") >= 0.2) & (F.col("e.stability") >= 0.4) & (F.col("e.confidence") >= 0.25))


@query("p23_acceptance", f"WITH {P22_SQL} SELECT scene_id, line, sample, class_id FROM cf WHERE {ACCEPT}")
def p23(v):
    return evidence(v).where(accepted()).select(*KEY, "class_id")


@query("p24_rejection_waterfall", f"""
    WITH {P22_SQL}, r AS (SELECT scene_id, CASE WHEN ({ACCEPT}) AND line % 5 <> 0 AND depth <= 0.98 AND score <= 0.028 AND score <= 0.025 THEN 0
      WHEN score <= 0.028 AND score <= 0.025 AND depth > 0.98 THEN 9 WHEN ({ACCEPT}) AND score <= 0.028 AND score <= 0.025 THEN 8
      WHEN score > 0.028 THEN 1 WHEN score > 0.025 THEN 2 WHEN depth < 0.4 THEN 3 WHEN class_id = 3 AND confidence < 0.5 THEN 4
      WHEN class_id = 3 OR margin < 0.2 THEN 5 WHEN confidence < 0.2 THEN 6 WHEN st < 0.4 OR conf < 0.25 THEN 7 ELSE 0 END AS code FROM cf)
    SELECT scene_id, CAST(code AS INTEGER) AS code, count(*) AS pixels FROM r GROUP BY ALL""")
def p24(v):
    c = F.col
    candidate = (c("score") <= 0.028) & (c("score") <= 0.025)
    ok = candidate & accepted()
    code = scoring.rejection_reason(
        beyond_absolute=c("score") > 0.028, candidate=candidate, scored=c("class_id") > 0, depth_ok=c("depth") >= 0.4,
        gate_ok=~((c("class_id") == 3) & (c("confidence") < 0.5)), wins=(c("class_id") != 3) & (c("margin") >= 0.2),
        consensus_ok=c("confidence") >= 0.2, evidence_ok=(c("e.stability") >= 0.4) & (c("e.confidence") >= 0.25),
        accepted=ok, saturated=c("depth") > 0.98, final=ok & (c("line") % 5 != 0) & (c("depth") <= 0.98))
    return evidence(v).groupBy("scene_id", code.alias("code")).agg(F.count(F.lit(1)).alias("pixels"))


@query("p25_subtype_binning", """
    SELECT scene_id, CASE WHEN class_id <> 1 THEN 'masked' WHEN 2180 + confidence * 50 < 2201 THEN 'short' WHEN 2180 + confidence * 50 < 2209 THEN 'middle' ELSE 'long' END AS subtype,
      count(*) AS pixels FROM candidate GROUP BY ALL""")
def p25(v):
    nm = 2180 + F.col("confidence") * 50
    kind = (F.when(F.col("class_id") != 1, "masked").when(nm < 2201, "short").when(nm < 2209, "middle").otherwise("long"))
    return v.candidate.groupBy("scene_id", kind.alias("subtype")).agg(F.count(F.lit(1)).alias("pixels"))


@query("p26_staged_joint_gate", """
    WITH o AS (SELECT p.*, CASE WHEN class_id = 2 AND sample % 3 = 0 THEN 3 ELSE class_id END AS second FROM candidate p),
    s AS (SELECT *, score <= 0.02 AS sam, class_id = second AS same, depth >= 0.3 AS deep, margin >= 0.1 AS fit FROM o)
    SELECT scene_id, line, sample, class_id, round(CAST((1 - score / 0.02) * least(depth / 0.6, 1) * least(margin / 0.2, 1) * confidence AS DOUBLE), 7) AS confidence
    FROM s WHERE sam AND same AND deep AND fit""")
def p26(v):
    """Two label planes must confirm the same mineral before depth and fit are asked."""
    second = F.when((F.col("class_id") == 2) & (F.col("sample") % 3 == 0), 3).otherwise(F.col("class_id"))
    product = (scoring.clip(1 - F.col("score") / 0.02) * scoring.clip(F.col("depth") / 0.6)
               * scoring.clip(F.col("margin") / 0.2) * scoring.clip(F.col("confidence")))
    return (v.candidate.where("score <= 0.02").where(second == F.col("class_id"))
            .where("depth >= 0.3 and margin >= 0.1").select(*KEY, "class_id", F.round(product, 7).alias("confidence")))


@query("p27_domain_and_physics_labels", """
    SELECT p_partkey, coalesce(nullif(concat_ws('+', CASE WHEN lo <= 750 AND hi >= 450 THEN 'vnir' END, CASE WHEN lo <= 1700 AND hi >= 900 THEN 'nir' END,
      CASE WHEN lo <= 2450 AND hi >= 2000 THEN 'swir' END, CASE WHEN lo <= 12000 AND hi >= 8000 THEN 'tir' END), ''), 'unknown') AS domain,
      CASE WHEN t LIKE '%temperature%' THEN 'brightness_temperature' WHEN t LIKE '%radiance%' OR t LIKE '%w/(%' THEN 'radiance'
      WHEN t LIKE '%emissiv%' THEN 'emissivity' WHEN t LIKE '%reflect%' THEN 'reflectance' ELSE 'unknown' END AS physics
    FROM (SELECT p_partkey, p_retailprice AS lo, p_retailprice + p_size * 250 AS hi,
      lower(CASE p_partkey % 4 WHEN 0 THEN 'Reflectance ' WHEN 1 THEN 'Radiance ' WHEN 2 THEN 'Emissivity ' ELSE '' END || p_name) AS t FROM part)""")
def p27(v):
    k = F.col("p_partkey") % 4
    text = F.concat(F.when(k == 0, "Reflectance ").when(k == 1, "Radiance ").when(k == 2, "Emissivity ").otherwise(""), F.col("p_name"))
    lo = F.col("p_retailprice")
    return v.table("part").select("p_partkey", S.spectral_domain(lo, lo + F.col("p_size") * 250).alias("domain"),
                                  S.data_physics(text).alias("physics"))


# --- maps -----------------------------------------------------------------

MAP_SQL = """mr AS (SELECT scene_id, line, sample, class_id FROM cells WHERE score <= 0.03),
    mc AS (SELECT scene_id, line, sample, CAST(CASE WHEN line % 7 = 0 THEN class_id % 3 + 1 ELSE class_id END AS INTEGER) AS class_id FROM cells WHERE score <= 0.04 AND line % 11 <> 0)"""


def reference_map(v):
    return v.cells.where("score <= 0.03").select(*KEY, "class_id")


def candidate_map(v):
    return v.cells.where("score <= 0.04 and line % 11 <> 0").select(
        *KEY, F.when(F.col("line") % 7 == 0, F.col("class_id") % 3 + 1).otherwise(F.col("class_id")).alias("class_id"))


@query("j7_map_comparison", f"""
    WITH {MAP_SQL} SELECT scene_id, coalesce(a.class_id, 0) AS reference, coalesce(b.class_id, 0) AS candidate, count(*) AS pixels
    FROM mr a FULL JOIN mc b USING (scene_id, line, sample) JOIN valid USING (scene_id, line, sample) GROUP BY ALL""")
def j7(v):
    both = reference_map(v).withColumnRenamed("class_id", "reference").join(
        candidate_map(v).withColumnRenamed("class_id", "candidate"), KEY, "full_outer")
    inside = both.join(v.valid, KEY, "left_semi")
    return inside.groupBy("scene_id", F.coalesce("reference", F.lit(0)).alias("reference"),
                          F.coalesce("candidate", F.lit(0)).alias("candidate")).agg(F.count(F.lit(1)).alias("pixels"))


AGREE_SQL = """SELECT {keys}, CAST(tp AS BIGINT) AS intersection, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
    round(tp / (tp + fp + fn)::DOUBLE, 8) AS iou, round(tp / (tp + fp)::DOUBLE, 8) AS precision, round(tp / (tp + fn)::DOUBLE, 8) AS recall,
    round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 8) AS dice, round(abs(fp - fn) / (tp + fn)::DOUBLE, 8) AS area_difference FROM
    (SELECT {keys}, sum(CASE WHEN a.class_id = m AND b.class_id = m THEN 1 ELSE 0 END) AS tp,
      sum(CASE WHEN b.class_id = m AND coalesce(a.class_id, 0) <> m THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN a.class_id = m AND coalesce(b.class_id, 0) <> m THEN 1 ELSE 0 END) AS fn
     FROM mr a FULL JOIN mc b USING (scene_id, line, sample), (VALUES (1), (2), (3)) k(m) GROUP BY ALL)"""
METRICS = ("iou", "precision", "recall", "dice", "area_difference")


def per_class(v):
    both = reference_map(v).withColumnRenamed("class_id", "r").join(
        candidate_map(v).withColumnRenamed("class_id", "c"), KEY, "full_outer")
    classes = F.explode(F.array_distinct(F.array_compact(F.array("r", "c")))).alias("m")
    rows = both.select("*", classes).withColumns({
        "in_reference": F.coalesce(F.col("r") == F.col("m"), F.lit(False)),
        "in_candidate": F.coalesce(F.col("c") == F.col("m"), F.lit(False))})
    return maps.agreement(rows, ["scene_id", "m"])


@query("a18_agreement_metrics", f"WITH {MAP_SQL} " + AGREE_SQL.format(keys="scene_id, m"))
def a18(v):
    return per_class(v).select("scene_id", "m", "intersection", "false_positive", "false_negative",
                               *[F.round(n, 8).alias(n) for n in METRICS])


@query("a19_depth_block_metrics", f"""
    WITH {MAP_SQL} SELECT scene_id, line // 512 AS block, count(*) AS pixels, count(a.class_id) AS reference, count(b.class_id) AS candidate,
      round(count(CASE WHEN a.class_id IS NOT NULL AND b.class_id IS NOT NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 8) AS iou
    FROM mr a FULL JOIN mc b USING (scene_id, line, sample) GROUP BY ALL""")
def a19(v):
    both = reference_map(v).withColumnRenamed("class_id", "r").join(
        candidate_map(v).withColumnRenamed("class_id", "c"), KEY, "full_outer")
    return both.groupBy("scene_id", F.floor(F.col("line") / 512).cast("int").alias("block")).agg(
        F.count(F.lit(1)).alias("pixels"), F.count("r").alias("reference"), F.count("c").alias("candidate"),
        F.round(F.avg((F.col("r").isNotNull() & F.col("c").isNotNull()).cast("double")), 8).alias("iou"))


@query("q3_regression_gate", f"""
    WITH {MAP_SQL}, g AS ({AGREE_SQL.format(keys="scene_id, m")})
    SELECT scene_id, m, list_filter([CASE WHEN iou < 0.5 THEN 'iou' END, CASE WHEN precision < 0.6 THEN 'precision' END,
      CASE WHEN recall < 0.8 THEN 'recall' END, CASE WHEN area_difference > 0.2 THEN 'area' END], lambda x: x IS NOT NULL) AS failures FROM g""")
def q3(v):
    gate = {"minimum_iou": 0.5, "minimum_precision": 0.6, "minimum_recall": 0.8, "maximum_area_difference_fraction": 0.2}
    return per_class(v).select("scene_id", "m", maps.gate_failures(gate).alias("failures"))


@query("a12_class_histogram", f"""
    WITH {MAP_SQL}, d AS (SELECT scene_id, m FROM frames, (VALUES (1), (2), (3), (4)) k(m))
    SELECT d.scene_id, d.m AS class_id, count(mr.class_id) AS pixels FROM d LEFT JOIN mr ON mr.scene_id = d.scene_id AND mr.class_id = d.m GROUP BY ALL""")
def a12(v):
    classes = v.frames.select("scene_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("class_id"))
    counts = reference_map(v).groupBy("scene_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counts, ["scene_id", "class_id"], "left").select(
        "scene_id", "class_id", F.coalesce("n", F.lit(0)).alias("pixels"))


@query("a13_cross_tab", f"""
    WITH {MAP_SQL} SELECT a.class_id AS reference, count(*) FILTER (WHERE b.class_id = 1) AS c1, count(*) FILTER (WHERE b.class_id = 2) AS c2,
      count(*) FILTER (WHERE b.class_id = 3) AS c3 FROM mr a JOIN mc b USING (scene_id, line, sample) GROUP BY ALL""")
def a13(v):
    both = reference_map(v).withColumnRenamed("class_id", "reference").join(candidate_map(v), KEY)
    wide = both.groupBy("reference").pivot("class_id", [1, 2, 3]).agg(F.count(F.lit(1)))
    return wide.select("reference", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"c{i}") for i in (1, 2, 3)])


POLICY_SQL = """pl AS (SELECT scene_id, line, sample, policy, CAST(CASE policy WHEN 'balanced' THEN (class_id + line) % 3 + 1 ELSE class_id END AS INTEGER) AS class_id
      FROM cells, (VALUES ('conservative', 0.01), ('balanced', 0.02), ('sensitive', 0.03)) p(policy, t) WHERE score <= t),
    wd AS (SELECT scene_id, line, sample, coalesce(max(class_id) FILTER (WHERE policy = 'conservative'), 0) AS c0,
      coalesce(max(class_id) FILTER (WHERE policy = 'balanced'), 0) AS b0, coalesce(max(class_id) FILTER (WHERE policy = 'sensitive'), 0) AS s0 FROM pl GROUP BY ALL),
    ns AS (SELECT *, CASE WHEN c0 > 0 THEN c0 ELSE b0 END AS b1 FROM wd),
    nst AS (SELECT scene_id, line, sample, c0 AS conservative, b1 AS balanced, CASE WHEN b1 > 0 THEN b1 ELSE s0 END AS sensitive FROM ns)"""


def policy_maps(v):
    limits = F.filter(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(t).alias("t")) for p, t in (("conservative", 0.01), ("balanced", 0.02), ("sensitive", 0.03))
    ]), lambda x: F.col("score") <= x["t"])
    return v.cells.select(*KEY, "class_id", F.explode(limits).alias("p")).select(
        *KEY, "p.policy", F.when(F.col("p.policy") == "balanced", (F.col("class_id") + F.col("line")) % 3 + 1)
        .otherwise(F.col("class_id")).alias("class_id"))


@query("u2_enforce_nesting", f"WITH {POLICY_SQL} SELECT * FROM nst")
def u2(v):
    return maps.enforce_nesting(policy_maps(v), KEY)


@query("u3_nesting_check", f"""
    WITH {POLICY_SQL} SELECT scene_id, count(*) AS pixels, count(*) FILTER (WHERE (c0 > 0 AND b0 <> c0) OR (b0 > 0 AND s0 <> b0)) AS breaks,
      0::BIGINT AS after FROM wd GROUP BY scene_id""")
def u3(v):
    wide = policy_maps(v).groupBy(*KEY).pivot("policy", list(maps.POLICIES)).agg(F.max("class_id")).fillna(0, list(maps.POLICIES))
    fixed = maps.enforce_nesting(policy_maps(v), KEY)
    after = fixed.groupBy("scene_id").agg(F.sum(maps.nesting_breaks(fixed).cast("long")).alias("after"))
    return wide.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(maps.nesting_breaks(wide).cast("long")).alias("breaks")).join(after, "scene_id")


GROUP_SQL = """gm AS (SELECT scene_id, line, sample, g AS group_no, policy, class_id, CASE g WHEN 0 THEN confidence WHEN 1 THEN margin ELSE depth END AS conf
      FROM cells, (VALUES (0), (1), (2)) k(g), (VALUES ('conservative', 0.01), ('balanced', 0.02), ('sensitive', 0.03)) p(policy, t)
      WHERE score <= t AND (line + sample + g) % 4 <> 0)"""


def group_maps(v):
    limits = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(t).alias("t"))
                       for p, t in (("conservative", 0.01), ("balanced", 0.02), ("sensitive", 0.03))])
    groups = F.array(*[F.struct(F.lit(g).alias("group_no"), F.col(c).alias("confidence"))
                       for g, c in enumerate(("confidence", "margin", "depth"))])
    rows = v.cells.where("score <= 0.03").select(*KEY, "class_id", "score", F.inline(groups)).where("(line + sample + group_no) % 4 <> 0")
    stacked = rows.select(*KEY, "group_no", "class_id", "score", F.inline(limits)).where("score <= t").drop("t", "score")
    return stacked, rows.select(*KEY, "group_no", "confidence")


@query("u4_cross_group_winner", f"""
    WITH {GROUP_SQL}, w AS (SELECT scene_id, line, sample, arg_max(group_no, conf * 1000000 - group_no * 0.001::DOUBLE) AS group_no, count(*) AS groups
      FROM gm WHERE policy = 'sensitive' GROUP BY ALL)
    SELECT scene_id, line, sample, policy, group_no, class_id, groups FROM gm JOIN w USING (scene_id, line, sample, group_no)""")
def u4(v):
    stacked, confidence = group_maps(v)
    return maps.arbitrate(stacked, confidence, KEY).select(*KEY, "policy", "group_no", "class_id", "groups")


@query("u5_global_max_confidence", f"""
    WITH {GROUP_SQL} SELECT scene_id, line, sample, round(max(conf), 8) AS confidence,
      CAST(arg_max(group_no, conf * 1000000 - group_no * 0.001::DOUBLE) AS INTEGER) AS group_no FROM gm WHERE policy = 'sensitive' GROUP BY ALL""")
def u5(v):
    _, confidence = group_maps(v)
    best = confidence.groupBy(*KEY).agg(F.max(F.struct("confidence", (-F.col("group_no")).alias("r"))).alias("b"))
    return best.select(*KEY, F.round("b.confidence", 8).alias("confidence"), (-F.col("b.r")).alias("group_no"))


@query("u1_mask_algebra", f"""
    WITH {MAP_SQL}, a AS (SELECT scene_id, line, sample FROM mr), b AS (SELECT scene_id, line, sample FROM mc),
    s AS (SELECT 'union' AS op, * FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', * FROM (FROM a EXCEPT FROM b))
    SELECT op, scene_id, count(*) AS pixels, CAST(sum(line * 32 + sample) AS BIGINT) AS checksum FROM s GROUP BY ALL""")
def u1(v):
    a, b = reference_map(v).select(*KEY), candidate_map(v).select(*KEY)
    named = [df.withColumn("op", F.lit(n)) for n, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.exceptAll(b)))]
    rows = named[0].unionByName(named[1]).unionByName(named[2])
    return rows.groupBy("op", "scene_id").agg(F.count(F.lit(1)).alias("pixels"),
                                              F.sum(F.col("line") * 32 + F.col("sample")).alias("checksum"))


# --- resampling joins -----------------------------------------------------

@query("j9_nearest_resample", """
    SELECT f.scene_id, CAST(l AS INTEGER) AS line, CAST(s AS INTEGER) AS sample FROM frames f, range(0, 700) a(l), range(0, 48) b(s)
    JOIN candidate c ON c.scene_id = f.scene_id AND c.line = (l * f.lines) // 700 AND c.sample = (s * f.samples) // 48""")
def j9(v):
    sized = v.frames.select("scene_id", F.lit(700).alias("to_lines"), F.lit(48).alias("to_samples"))
    return maps.nearest_resample(v.frames, sized, v.candidate.select(*KEY), SC)


@query("j10_line_time_mapping", """
    SELECT m.scene_id, m.t AS target_line, count(c.sample) AS pixels FROM (SELECT scene_id, CAST(t AS INTEGER) AS t, CAST(round_even(t * (lines - 1) / 776.0::DOUBLE, 0) AS INTEGER) AS line
      FROM frames, range(0, 777) r(t)) m LEFT JOIN candidate c ON c.scene_id = m.scene_id AND c.line = m.line GROUP BY ALL""")
def j10(v):
    sized = v.frames.select("scene_id", F.lit(777).alias("to_lines"))
    mapping = maps.time_mapped_lines(v.frames, sized, SC)
    counts = v.candidate.groupBy("scene_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return mapping.join(counts, ["scene_id", "line"], "left").select(
        "scene_id", "target_line", F.coalesce("n", F.lit(0)).alias("pixels"))


INVERSE = [[0.96, 0.04, 0.4], [-0.02, 1.01, 0.7], [0.0, 0.0, 1.0]]


@query("j11_affine_bilinear_resample", """
    WITH t AS (SELECT scene_id, line, sample, 0.96::DOUBLE * sample + 0.04::DOUBLE * line + 0.4::DOUBLE AS x, -0.02::DOUBLE * sample + 1.01::DOUBLE * line + 0.7::DOUBLE AS y FROM candidate),
    k AS (SELECT t.*, CAST(floor(y) AS INTEGER) + dy AS sl, CAST(floor(x) AS INTEGER) + dx AS ss,
      CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w
      FROM t, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
    SELECT k.scene_id, k.line, k.sample, round(sum(w * coalesce(c.score, 0)), 7) AS score FROM k LEFT JOIN cells c ON c.scene_id = k.scene_id AND c.line = k.sl AND c.sample = k.ss GROUP BY ALL""")
def j11(v):
    out = maps.affine_bilinear(v.cells, v.candidate.select(*KEY), INVERSE, SC, "score")
    return out.withColumn("score", F.round("score", 7))


@query("j12_semi_anti", f"""
    WITH {MAP_SQL} SELECT scene_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM mc WHERE mc.scene_id = mr.scene_id AND mc.line = mr.line AND mc.sample = mr.sample)) AS kept,
      count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM mc WHERE mc.scene_id = mr.scene_id AND mc.line = mr.line AND mc.sample = mr.sample)) AS dropped FROM mr GROUP BY ALL""")
def j12(v):
    a, b = reference_map(v), candidate_map(v)
    kept = a.join(b, KEY, "left_semi").groupBy("scene_id").agg(F.count(F.lit(1)).alias("kept"))
    lost = a.join(b, KEY, "left_anti").groupBy("scene_id").agg(F.count(F.lit(1)).alias("dropped"))
    return kept.join(lost, "scene_id", "full_outer").fillna(0, ["kept", "dropped"])


@query("a21_tile_score_blending", """
    WITH t AS (SELECT scene_id, line, sample, score, i, line - i * 32 AS p FROM cells, range(0, 64) r(i) WHERE line >= i * 32 AND line < i * 32 + 64),
    w AS (SELECT *, greatest(0.5 - 0.5 * cos(2 * pi() * (p + 0.5) / 64), 1e-3) AS wt, score * (1 + (i % 3) * 0.1::DOUBLE) AS s FROM t),
    b AS (SELECT scene_id, line, sample, sum(s * wt) / sum(wt) AS s FROM w GROUP BY ALL)
    SELECT scene_id, line // 4 AS line, sample // 4 AS sample, round(avg(s), 6) AS score FROM b GROUP BY scene_id, line // 4, sample // 4""")
def a21(v):
    """Overlapping 64-line tiles at stride 32, blended and mean-pooled by four."""
    blended = maps.blend_tiles(v.cells, SC, lambda i: F.col("score") * (1 + (i % 3) * 0.1), 64, 32)
    at = blended.select("scene_id", F.floor(F.col("line") / 4).cast("int").alias("l"), F.floor(F.col("sample") / 4).cast("int").alias("s"), "score")
    # cells of a pool lie in many tasks: grouped before the exchange, they would fill tables there and hardly get fewer
    pooled = at.repartition("scene_id", "l", "s").groupBy("scene_id", "l", "s")
    return pooled.agg(F.round(F.avg("score"), 6).alias("score")).withColumnsRenamed({"l": "line", "s": "sample"})


@query("a23_profile_correlation", """
    WITH a AS (SELECT scene_id, sample, count(*) FILTER (WHERE score <= 0.03) / count(*)::DOUBLE AS x, count(*) FILTER (WHERE score <= 0.05) / count(*)::DOUBLE AS y FROM cells GROUP BY ALL)
    SELECT scene_id, round(corr(x, y), 7) AS r FROM a GROUP BY scene_id""")
def a23(v):
    rows = v.cells.groupBy("scene_id", "sample").agg(
        F.avg((F.col("score") <= 0.03).cast("double")).alias("x"), F.avg((F.col("score") <= 0.05).cast("double")).alias("y"))
    return rows.groupBy("scene_id").agg(F.round(F.corr("x", "y"), 7).alias("r"))


@query("a24_radiometric_profile", """
    WITH q AS (SELECT scene_id, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.95) AS p95,
      quantile_cont(score, 0.02) AS p02, quantile_cont(score, 0.98) AS p98 FROM cells GROUP BY ALL)
    SELECT scene_id, round(any_value(mean), 7) AS mean, round(any_value(std), 7) AS std, round(any_value(p05), 8) AS p05, round(any_value(p95), 8) AS p95,
      round(avg(least(greatest((score - p02) / (p98 - p02), 0), 1)), 7) AS stretched FROM cells JOIN q USING (scene_id) GROUP BY scene_id""")
def a24(v):
    q = exact_quantiles(v.cells, SC, "score", [0.02, 0.05, 0.95, 0.98])
    moments = v.cells.groupBy("scene_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    stretch = scoring.clip((F.col("score") - F.col("q0")) / F.greatest(F.col("q3") - F.col("q0"), F.lit(1e-12)))
    bounded = v.cells.join(q, SC).groupBy("scene_id").agg(F.round(F.avg(stretch), 7).alias("stretched"))
    return moments.join(q, SC).join(bounded, SC).select(
        "scene_id", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), F.round("q1", 8).alias("p05"), F.round("q2", 8).alias("p95"), "stretched")


# --- samples and rankings -------------------------------------------------

@query("k1_stratified_depth_blocks", """
    WITH RECURSIVE lc AS (SELECT scene_id, line, count(*) AS c FROM valid GROUP BY ALL),
    st AS (SELECT scene_id, lines, least(64, lines) AS h, k, CAST(floor(k * lines / 12.0::DOUBLE) AS INTEGER) AS a, CAST(floor((k + 1) * lines / 12.0::DOUBLE) AS INTEGER) AS b FROM frames, range(0, 12) r(k)),
    ss AS (SELECT st.*, greatest(0, a - h // 2) + 16 * i AS s FROM st, range(0, 64) q(i) WHERE greatest(0, a - h // 2) + 16 * i <= greatest(least(lines, b + h // 2) - h, greatest(0, a - h // 2))),
    sv AS (SELECT ss.scene_id, lines, h, k, s, coalesce(sum(c), 0) AS v FROM ss LEFT JOIN lc ON lc.scene_id = ss.scene_id AND lc.line >= s AND lc.line < least(s + h, lines) GROUP BY ALL),
    bs AS (SELECT scene_id, k, arg_max(s, v * 100000 - s) AS s, max(v) AS v, any_value(h) AS h, any_value(lines) AS lines FROM sv GROUP BY scene_id, k HAVING max(v) >= 128),
    o AS (SELECT scene_id, k, s AS start, least(s + h, lines) AS stop, v FROM bs),
    kp(scene_id, k, kept) AS (SELECT DISTINCT scene_id, -1::BIGINT, []::STRUCT(k BIGINT, start BIGINT, stop BIGINT, v BIGINT)[] FROM o
      UNION ALL SELECT kp.scene_id, o.k, CASE WHEN len(list_filter(kept, lambda y: o.stop > y.start AND o.start < y.stop)) > 0 THEN kept
        ELSE list_append(kept, struct_pack(k := o.k, start := o.start, stop := o.stop, v := o.v)) END
        FROM kp JOIN o ON o.scene_id = kp.scene_id AND o.k = (SELECT min(k) FROM o z WHERE z.scene_id = kp.scene_id AND z.k > kp.k))
    SELECT scene_id, CAST(x.start AS INTEGER) AS start, CAST(x.stop AS INTEGER) AS stop, 'depth_stratum_' || lpad(CAST(x.k + 1 AS VARCHAR), 2, '0') AS reason, CAST(x.v AS BIGINT) AS valid_pixels
    FROM (SELECT scene_id, unnest(kept) AS x FROM (SELECT scene_id, arg_max(kept, k) AS kept FROM kp GROUP BY scene_id))""")
def k1(v):
    return sampling.depth_blocks(v.valid, v.frames)


@query("k2_even_row_subset", """
    WITH b AS (SELECT scene_id, i, i * 150 AS start, i * 150 + 64 AS stop FROM frames, range(0, 4) r(i))
    SELECT DISTINCT scene_id, CAST(start + floor(j * 63 / 9.0::DOUBLE) AS INTEGER) AS line FROM b, range(0, 10) q(j)""")
def k2(v):
    blocks = v.frames.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(450), F.lit(150))).alias("start")).withColumn("stop", F.col("start") + 64)
    return sampling.even_rows(blocks, 40)


@query("k3_evenly_spaced_cap", """
    WITH n AS (SELECT scene_id, class_id, line, sample, row_number() OVER (PARTITION BY scene_id, class_id ORDER BY line, sample) - 1 AS p, count(*) OVER (PARTITION BY scene_id, class_id) AS n FROM candidate),
    t AS (SELECT DISTINCT scene_id, class_id, CAST(floor(i * (n - 1) / 499.0::DOUBLE) AS BIGINT) AS p FROM (SELECT DISTINCT scene_id, class_id, n FROM n), range(0, 500) r(i))
    SELECT scene_id, class_id, line, sample FROM n LEFT JOIN t USING (scene_id, class_id, p) WHERE n <= 500 OR t.p IS NOT NULL""")
def k3(v):
    rows = v.candidate.select("scene_id", "class_id", "line", "sample").withColumn("block", F.floor(F.col("line") / 256))
    return sampling.evenly_spaced(rows, ["scene_id", "class_id"], [F.col("line"), F.col("sample")], 500, "block").drop("block")


@query("k4_strongest_pixels", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY scene_id, class_id ORDER BY depth DESC, line, sample) AS r FROM candidate)
    SELECT scene_id, class_id, line, sample FROM n WHERE r <= 100 * class_id""")
def k4(v):
    rows = v.candidate.withColumn("cap", F.col("class_id") * 100)
    return sampling.strongest(rows, ["scene_id", "class_id"], "depth", ["line", "sample"], "cap").select("scene_id", "class_id", "line", "sample")


@query("k5_candidate_ranking", """
    WITH c AS (SELECT scene_id, class_id, count(*) AS n, round(avg(depth), 6) AS objective, round(avg(margin), 6) AS penalty FROM candidate GROUP BY ALL)
    SELECT scene_id, class_id, n, objective FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY objective DESC, penalty, n, class_id) AS r FROM c) WHERE r = 1""")
def k5(v):
    rows = v.candidate.groupBy("scene_id", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("depth"), 6).alias("objective"), F.round(F.avg("margin"), 6).alias("penalty"))
    key = F.struct("objective", (-F.col("penalty")).alias("p"), (-F.col("n")).alias("m"), (-F.col("class_id")).alias("c"))
    return rows.groupBy("scene_id").agg(F.max(key).alias("b")).select(
        "scene_id", (-F.col("b.c")).alias("class_id"), (-F.col("b.m")).alias("n"), "b.objective")


@query("k6_ranked_report", """
    SELECT scene_id, line, count(*) AS pixels FROM candidate GROUP BY ALL ORDER BY pixels DESC, scene_id, line LIMIT 25""")
def k6(v):
    return v.candidate.groupBy("scene_id", "line").agg(F.count(F.lit(1)).alias("pixels")).orderBy(
        F.desc("pixels"), "scene_id", "line").limit(25)


@query("m6_weak_label_split", """
    SELECT scene_id, class_id, CASE WHEN (line // 256) % 5 = 0 THEN 'holdout' ELSE 'training' END AS split, count(*) AS pixels
    FROM candidate JOIN valid USING (scene_id, line, sample) GROUP BY ALL""")
def m6(v):
    from ..operators.calibrate import split_labels

    return split_labels(v.candidate.join(v.valid, KEY, "left_semi")).groupBy("scene_id", "class_id", "split").agg(
        F.count(F.lit(1)).alias("pixels"))


@query("q8_threshold_sweep", """
    SELECT scene_id, t AS threshold, class_id, count(*) AS pixels FROM cells, (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE)) s(t)
    WHERE score <= t GROUP BY ALL""")
def q8(v):
    steps = F.filter(A.literal_doubles([0.01, 0.02, 0.03, 0.05]), lambda t: F.col("score") <= t)
    return v.cells.select("scene_id", "class_id", F.explode(steps).alias("threshold")).groupBy(
        "scene_id", "threshold", "class_id").agg(F.count(F.lit(1)).alias("pixels"))
