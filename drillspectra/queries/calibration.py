"""Thresholds from the scene and gates learned from reviewed labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, spectral as S
from ..operators import calibrate as M, columns, sampling
from ..plans.registry import query
from ..plans.views import KEY, SCENE_VECTORS
from .planes import BLOCK_SQL, blocks
from .spectra import SCORE_SQL, scored_pixels

SC = ["scene_id"]
POLICIES = {
    "conservative": {"column_percentile": 0.04, "absolute_sam_threshold_rad": 0.02, "minimum_absorption_depth": 0.02},
    "balanced": {"column_percentile": 0.08, "absolute_sam_threshold_rad": 0.03, "minimum_absorption_depth": 0.012},
    "sensitive": {"column_percentile": 0.12, "absolute_sam_threshold_rad": 0.05, "minimum_absorption_depth": 0.008},
}


def masked(v):
    return v.cells.where("line % 60 < 40")


@query("m1_policy_resolution", """
    WITH q AS (SELECT scene_id, quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.2) AS b, quantile_cont(score, 0.3) AS c, stddev_pop(score) AS noise FROM cells WHERE line % 60 < 40 GROUP BY scene_id)
    SELECT scene_id, p.policy, round(CASE p.policy WHEN 'conservative' THEN a WHEN 'balanced' THEN b ELSE c END, 8) AS scene_threshold, CAST(p.ab AS DOUBLE) AS absolute_threshold,
      round(greatest(p.d, p.m * noise)::DOUBLE, 7) AS minimum_depth
    FROM q, (VALUES ('conservative', 0.02, 0.02, 3.0), ('balanced', 0.03, 0.012, 2.2), ('sensitive', 0.05, 0.008, 1.5)) p(policy, ab, d, m)""")
def m1(v):
    noise = masked(v).groupBy("scene_id").agg(F.stddev_pop("score").alias("noise"))
    return M.resolve_policies(masked(v), noise, POLICIES).select(
        "scene_id", "policy", F.round("scene_threshold", 8).alias("scene_threshold"), "absolute_threshold", F.round("minimum_depth", 7).alias("minimum_depth"))


@query("m2_threshold_grid_search")
def m2(v):
    v = v.written("score")
    return M.search_thresholds(masked(v), v.valid, v.frames, blocks(v), POLICIES, "balanced", steps=3)


PENALTY_SQL = f"""{BLOCK_SQL}, g AS (SELECT bk.scene_id, bk.start, CAST(s AS INTEGER) AS sample FROM bk JOIN frames f USING (scene_id), range(0, 32) t(s) WHERE s < samples),
    d AS (SELECT g.scene_id, g.start, g.sample, CASE WHEN count(c.line) > 0 THEN count(h.line) / count(c.line)::DOUBLE ELSE 0 END AS d FROM g LEFT JOIN valid c ON c.scene_id = g.scene_id AND c.sample = g.sample AND c.line >= g.start AND c.line < g.start + 64
      LEFT JOIN striped h ON h.scene_id = c.scene_id AND h.line = c.line AND h.sample = c.sample GROUP BY ALL),
    p AS (SELECT scene_id, sample, median(d) AS p FROM d GROUP BY ALL),
    n AS (SELECT a.scene_id, a.sample, least(greatest((greatest(a.p - median(b.p), 0) - 0.03) / 0.2, 0), 1) AS sev FROM p a JOIN p b ON b.scene_id = a.scene_id AND b.sample BETWEEN a.sample - 3 AND a.sample + 3 AND b.sample <> a.sample GROUP BY a.scene_id, a.sample, a.p),
    c AS (SELECT scene_id, sample, count(*) AS n FROM striped GROUP BY ALL)"""


@query("m3_column_penalty", f"""
    WITH {PENALTY_SQL} SELECT scene_id, round(sqrt(max(sev) * sum(CASE WHEN sev > 0 THEN c.n ELSE 0 END) / sum(c.n)::DOUBLE), 7) AS column_penalty FROM n LEFT JOIN c USING (scene_id, sample) GROUP BY scene_id""")
def m3(v):
    return M.fixed_column_penalty(v.striped, v.valid, blocks(v), v.frames).withColumn("column_penalty", F.round("column_penalty", 7))


@query("m4_threshold_trial")
def m4(v):
    v = v.written("score")
    per_policy = M.search_policies(masked(v), v.valid, v.frames, blocks(v), POLICIES, M.POLICIES, steps=2)
    ready = {policy: found.select("scene_id", "percentile", "absolute", F.floor(F.col("pixels") * 0.4).alias("ready")) for policy, found in per_policy.items()}
    return M.threshold_trial(per_policy, ready).select("scene_id", "policy", "percentile", "absolute", "ready", "status")


@query("m5_domain_offsets", f"""
    WITH {SCORE_SQL}, m AS (SELECT scene_id, group_no, mineral, median(score) AS md FROM ms GROUP BY ALL)
    SELECT scene_id, group_no, mineral, round(md, 5) AS median, round(least(greatest(0.25 * (md - min(md) OVER (PARTITION BY scene_id, group_no)), 0), 0.03), 5) AS offset FROM m""")
def m5(v):
    scores = scored_pixels(v).select("scene_id", F.inline("minerals")).withColumn("group_no", F.floor(F.col("mineral") / 3).cast("int"))
    return M.domain_offsets(scores, 0.25, 0.03).select("scene_id", "group_no", "mineral", F.round("median", 5).alias("median"), F.round("offset", 5).alias("offset"))


LABEL_SQL = """lb AS (SELECT *, class_id = 1 AND depth >= 0.5 AS positive, CASE WHEN (line // 256) % 5 = 0 THEN 'holdout' ELSE 'training' END AS split FROM cells WHERE line % 60 < 40)"""


def labelled_cells(v):
    return M.split_labels(masked(v)).withColumn("positive", (F.col("class_id") == 1) & (F.col("depth") >= 0.5))


@query("m7_detection_thresholds", f"""
    WITH {LABEL_SQL}, q AS (SELECT scene_id, quantile_cont(score, 0.8) FILTER (WHERE positive AND split = 'training') AS r0, quantile_cont(score, 0.93) FILTER (WHERE positive AND split = 'training') AS r1,
      quantile_cont(score, 0.985) FILTER (WHERE positive AND split = 'training') AS r2, quantile_cont(score, 0.2) AS c0, quantile_cont(score, 0.38) AS c1, quantile_cont(score, 0.6) AS c2, count(*) FILTER (WHERE positive AND split = 'training') < 100 AS few FROM lb GROUP BY scene_id),
    t AS (SELECT scene_id, policy, few, CASE WHEN few THEN CASE policy WHEN 'conservative' THEN 0.02 WHEN 'balanced' THEN 0.03 ELSE 0.05 END ELSE CASE policy WHEN 'conservative' THEN least(r0, c0) WHEN 'balanced' THEN least(r1, c1) ELSE least(r2, c2) END END::DOUBLE AS threshold FROM q, (VALUES ('conservative'), ('balanced'), ('sensitive')) p(policy))
    SELECT scene_id, policy, CASE WHEN few THEN 'insufficient_training_labels' ELSE 'resolved' END AS status, round(threshold, 8) AS threshold, round(count(*) FILTER (WHERE NOT few AND score <= threshold AND positive AND split = 'training') / count(*) FILTER (WHERE positive AND split = 'training')::DOUBLE, 7) AS training_recall,
      round(count(*) FILTER (WHERE NOT few AND score <= threshold AND positive AND split = 'holdout') / count(*) FILTER (WHERE positive AND split = 'holdout')::DOUBLE, 7) AS holdout_recall,
      round(count(*) FILTER (WHERE NOT few AND score <= threshold) / count(*)::DOUBLE, 7) AS coverage FROM lb JOIN t USING (scene_id) GROUP BY scene_id, policy, threshold, few""")
def m7(v):
    out = M.detection_thresholds(labelled_cells(v), {p: s["absolute_sam_threshold_rad"] for p, s in POLICIES.items()})
    return out.select("scene_id", "policy", "status", F.round("threshold", 8).alias("threshold"), *[F.round(c, 7).alias(c) for c in ("training_recall", "holdout_recall", "coverage")])


@query("m8_score_offsets")
def m8(v):
    scored = scored_pixels(v)
    minerals = v.refs.select("mineral").distinct().count()
    rows = scored.select("vec_id", "label", F.transform("minerals", lambda m: m["score"]).alias("scores")).where(F.size("scores") == minerals)
    sample = sampling.evenly_spaced(rows.withColumn("block", F.floor(F.col("vec_id") / SCENE_VECTORS)), ["label"], [F.col("vec_id")], 5000, "block")
    offsets = M.score_offsets(sample.select("scores", "label"), minerals)
    shift = F.array(*[F.lit(x) for x in offsets])
    adjusted = F.zip_with("scores", shift, lambda s, o: s - o)
    winner = F.array_position(adjusted, F.array_min(adjusted)) - 1
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg((winner == F.col("label")).cast("double")), 6).alias("recall"))


@query("m9_feature_gate_learning", f"""
    WITH {LABEL_SQL}, q AS (SELECT scene_id, quantile_cont(2200 + confidence * 100, [0.1, 0.9, 0.02, 0.98, 0.005, 0.995]) AS c, quantile_cont(margin, [0.1, 0.02, 0.005]) AS m FROM lb WHERE positive AND split = 'training' GROUP BY scene_id)
    SELECT scene_id, policy, round(greatest(2205, c[2 * k - 1]), 6) AS center_lo, round(least(2295, c[2 * k]), 6) AS center_hi, round(greatest(0, m[k], f * 0.2)::DOUBLE, 7) AS minimum, CASE WHEN k = 3 THEN 'any' ELSE 'all' END AS match
    FROM q, (VALUES ('conservative', 1, 0.35), ('balanced', 2, 0.1), ('sensitive', 3, 0.02)) p(policy, k, f)""")
def m9(v):
    training = labelled_cells(v).where("positive and split = 'training'").withColumn("center", 2200 + F.col("confidence") * 100)
    out = M.feature_gates(training, SC, "center", (2205.0, 2295.0), "margin", 0.2)
    return out.select("scene_id", "policy", F.round("center_lo", 6).alias("center_lo"), F.round("center_hi", 6).alias("center_hi"), F.round("minimum", 7).alias("minimum"), "match")


GATE_FEATURES = ["score", "confidence", "margin"]


def gate_rows(v):
    """Positives lean to low scores so the classes can be told apart."""
    lean = (F.col("score") + F.col("confidence") * 0.02) <= 0.03
    return M.split_labels(masked(v)).withColumn("positive", lean)


GATE_SQL = """gl AS (SELECT *, (score + confidence * 0.02::DOUBLE) <= 0.03 AS positive, CASE WHEN (line // 256) % 5 = 0 THEN 'holdout' ELSE 'training' END AS split FROM cells WHERE line % 60 < 40),
    lg AS (SELECT scene_id, positive, feature, x FROM (UNPIVOT (SELECT scene_id, positive, score, confidence, margin FROM gl WHERE split = 'training') ON score, confidence, margin INTO NAME feature VALUE x)),
    sc AS (SELECT scene_id, feature, median(x) AS md, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) > 1e-8 THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS s FROM lg GROUP BY ALL),
    mo AS (SELECT scene_id, feature, md, s, avg((x - md) / s) FILTER (WHERE positive) AS mp, avg((x - md) / s) FILTER (WHERE NOT positive) AS mn,
      greatest(var_pop((x - md) / s) FILTER (WHERE positive), 0.2) AS vp, greatest(var_pop((x - md) / s) FILTER (WHERE NOT positive), 0.2) AS vn FROM lg JOIN sc USING (scene_id, feature) GROUP BY ALL)"""


@query("m10_evidence_gate_scores", f"""
    WITH {GATE_SQL}, al AS (SELECT scene_id, line, sample, feature, x FROM (UNPIVOT (SELECT scene_id, line, sample, score, confidence, margin FROM gl) ON score, confidence, margin INTO NAME feature VALUE x))
    SELECT scene_id, line, sample, round(sum(-0.5::DOUBLE * (((x - md) / s - mp) ** 2 / vp + ln(vp) - ((x - md) / s - mn) ** 2 / vn - ln(vn))), 6) AS s FROM al JOIN mo USING (scene_id, feature) GROUP BY ALL""")
def m10_scores(v):
    rows = gate_rows(v)
    model = M.gate_model(rows.where("split = 'training'"), SC, GATE_FEATURES)
    return rows.join(model, SC).select(*KEY, F.round(M.gate_score(GATE_FEATURES), 6).alias("s"))


@query("m10_evidence_gates")
def m10(v):
    rows = gate_rows(v)
    model = M.gate_model(rows.where("split = 'training'"), SC, GATE_FEATURES)
    scored = M.durable(rows.join(model, SC, "left").select(*KEY, "positive", "split", M.gate_score(GATE_FEATURES).alias("s")))
    base = M.gate_threshold(scored.where("split = 'training'"), SC)
    inside = M.evidence_gates(scored, SC, base, ["line", "sample"])
    return inside.join(scored.select(*KEY, "positive"), KEY).groupBy("scene_id", "policy", "status").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(F.col("positive").cast("long")).alias("positives"))


@query("m11_single_axis_fallback")
def m11(v):
    return M.axis_threshold(gate_rows(v).where("split = 'training'"), SC, GATE_FEATURES)


@query("m12_discriminant_reassignment", f"""
    WITH {SCORE_SQL}, g AS (SELECT *, (line + sample + mineral) % 3 <> 0 AS gate FROM ms)
    SELECT scene_id, line, sample, CAST(coalesce(arg_min(mineral, struct_pack(s := score, m := mineral)) FILTER (WHERE gate), arg_min(mineral, struct_pack(s := score, m := mineral))) + 1 AS INTEGER) AS label FROM g GROUP BY ALL""")
def m12(v):
    gated = F.transform("minerals", lambda m, i: F.struct(
        F.when((F.col("line") + F.col("sample") + m["mineral"]) % 3 != 0, m["score"]).alias("score"), i.alias("at")))
    first = scoring.competition(F.transform(gated, lambda g: g["score"]))["label"]
    plain = scoring.competition(F.col("minerals")["score"])["label"]
    return scored_pixels(v).select(*KEY, F.when(first > 0, first).otherwise(plain).alias("label"))


EVIDENCE_SQL = """ev AS (SELECT scene_id, policy, class_id AS mineral, confidence, line % 4 = 0 AS labelled, margin AS risk FROM candidate, (VALUES ('conservative', 0.02), ('balanced', 0.025), ('sensitive', 0.03)) p(policy, t) WHERE score <= t)"""


def evidence_rows(v):
    limits = F.filter(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(t).alias("t"))
                                for p, t in (("conservative", 0.02), ("balanced", 0.025), ("sensitive", 0.03))]), lambda x: F.col("score") <= x["t"])
    return v.candidate.select("scene_id", F.col("class_id").alias("mineral"), "confidence", (F.col("line") % 4 == 0).alias("labelled"), F.col("margin").alias("risk"),
                              F.explode(limits).alias("p")).withColumn("policy", F.col("p.policy")).drop("p")


@query("m13_adaptive_gates", f"""
    WITH {EVIDENCE_SQL}, q AS (SELECT scene_id, policy, mineral, quantile_cont(confidence, [0.6, 0.25, 0.05]) AS s, quantile_cont(confidence, [0.35, 0.15, 0.05]) FILTER (WHERE labelled) AS l, count(*) FILTER (WHERE labelled) AS nl FROM ev GROUP BY ALL),
    k AS (SELECT *, CASE policy WHEN 'conservative' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END AS i, CASE policy WHEN 'conservative' THEN 0.58 WHEN 'balanced' THEN 0.45 ELSE 0.3 END::DOUBLE AS c FROM q)
    SELECT scene_id, policy, mineral, round(CASE WHEN nl >= 25 THEN greatest(0.2::DOUBLE, least(least(c, s[i]), l[i])) ELSE least(c, s[i]) END, 7) AS threshold,
      round(least(0.5, least(CASE WHEN policy = 'conservative' THEN 2 ELSE 1 END, mineral) / mineral::DOUBLE), 7) AS consensus FROM k""")
def m13(v):
    out = M.adaptive_confidence(evidence_rows(v), {"conservative": 0.58, "balanced": 0.45, "sensitive": 0.30}, 25)
    return out.select("scene_id", "policy", "mineral", F.round("threshold", 7).alias("threshold"),
                      F.round(M.consensus_floor(F.lit(0.5), F.col("policy"), F.col("mineral")), 7).alias("consensus"))


@query("m14_protection_thresholds", f"""
    WITH {EVIDENCE_SQL}, q AS (SELECT scene_id, policy, mineral AS class_id, quantile_cont(confidence * (1 - 0.35 * risk), [0.5, 0.65, 0.8]) AS s FROM ev WHERE risk < 0.5 GROUP BY ALL)
    SELECT scene_id, policy, class_id, round(greatest(CASE policy WHEN 'balanced' THEN 0.5 ELSE 0.55 END::DOUBLE, least(0.72::DOUBLE, s[CASE policy WHEN 'conservative' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END])), 7) AS protection FROM q""")
def m14(v):
    rows = evidence_rows(v).withColumnRenamed("mineral", "class_id")
    return M.protection_thresholds(rows).withColumn("protection", F.round("protection", 7))


@query("m15_saturation_flag", """
    WITH r AS (SELECT scene_id, line, sample, spectrum[31] AS level FROM pixels), q AS (SELECT scene_id, quantile_cont(level, 0.999) AS top FROM r GROUP BY scene_id)
    SELECT scene_id, line, sample, level >= top AS saturated FROM r JOIN q USING (scene_id)""")
def m15(v):
    rows = v.pixels.select(*KEY, F.col("spectrum")[30].alias("level"))
    return M.saturation(rows, SC, "level").select(*KEY, "saturated")


@query("q5_weak_label_gate_audit", f"""
    WITH {LABEL_SQL} SELECT scene_id, split, class_id, count(*) AS positives, count(*) FILTER (WHERE score <= 0.03) AS candidate, count(*) FILTER (WHERE score <= 0.03 AND depth >= 0.4) AS deep,
      count(*) FILTER (WHERE score <= 0.03 AND depth >= 0.4 AND margin >= 0.2) AS clear, count(*) FILTER (WHERE score <= 0.03 AND depth >= 0.4 AND margin >= 0.2 AND confidence >= 0.3) AS accepted FROM lb GROUP BY ALL""")
def q5(v):
    """Labels left after every gate, in order."""
    gates = [("candidate", F.col("score") <= 0.03), ("deep", F.col("depth") >= 0.4), ("clear", F.col("margin") >= 0.2), ("accepted", F.col("confidence") >= 0.3)]
    counts, so_far = [F.count(F.lit(1)).alias("positives")], F.lit(True)
    for name, test in gates:
        so_far = so_far & test
        counts.append(F.sum(so_far.cast("long")).alias(name))
    return labelled_cells(v).groupBy("scene_id", "split", "class_id").agg(*counts)


@query("q7_threshold_boundary_summary", """
    WITH s AS (SELECT scene_id, sample, least(greatest(quantile_cont(score, 0.08), 0.004), 0.009) AS t FROM cells WHERE line % 60 < 40 GROUP BY ALL)
    SELECT scene_id, count(*) AS columns, count(*) FILTER (WHERE t <= 0.004) AS at_lower, count(*) FILTER (WHERE t >= 0.009) AS at_upper FROM s GROUP BY scene_id""")
def q7(v):
    from ..operators.quantiles import exact_quantiles

    q = exact_quantiles(masked(v), ["scene_id", "sample"], "score", [0.08]).withColumn(
        "t", F.least(F.greatest("q0", F.lit(0.004)), F.lit(0.009)))
    return q.groupBy("scene_id").agg(F.count(F.lit(1)).alias("columns"), F.sum((F.col("t") <= 0.004).cast("long")).alias("at_lower"),
                                     F.sum((F.col("t") >= 0.009).cast("long")).alias("at_upper"))
