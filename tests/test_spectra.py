import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspectra.functions import arrays as A, kernels as K, names as N, scoring, spectral as S


def one(spark, rows, schema="x array<double>"):
    return spark.createDataFrame(rows, schema)


def test_spectral_angle(spark):
    df = one(spark, [([1.0, 0.0],), ([0.0, 1.0],), ([0.0, 0.0],)])
    flat = [r[0] for r in df.select(S.spectral_angle(F.col("x"), A.literal_doubles([1, 0]))).collect()]
    assert flat[:2] == pytest.approx([0.0, np.pi / 2]) and flat[2] is None
    kernel = [r[0][0] for r in df.select(K.angles_to([[1.0, 0.0]])("x")).collect()]
    assert kernel[:2] == pytest.approx([0.0, np.pi / 2]) and kernel[2] is None


def test_hull_continuum(spark):
    df = one(spark, [([1.0, 0.5, 1.0],), ([1.0, 2.0, 1.0],), ([1.0, -1.0, 1.0],)])
    rows = [r[0] for r in df.select(K.absorb([0, 1, 2], range(3), "hull")("x")).collect()]
    assert rows[0] == pytest.approx([0, 0.5, 0]) and rows[1] == pytest.approx([0, 0, 0])
    assert rows[2] == [None] * 3


def test_segmented_continuum(spark):
    axis = [1000.0, 1010.0, 1020.0, 2000.0, 2010.0, 2020.0]
    df = one(spark, [([1.0, 0.8, 1.0, 3.0, 2.4, 3.0],)])
    assert df.select(S.continuum_segmented(F.col("x"), axis)).first()[0] == pytest.approx([1, 0.8, 1, 1, 0.8, 1])
    w = np.linspace(2100, 2300, 101)
    dip = 1 - 0.3 * np.exp(-0.5 * ((w - 2206) / 12) ** 2)
    df = one(spark, [(dip.tolist(),), ((1.7 * dip).tolist(),)])
    removed = S.absorption(S.continuum_segmented(F.col("x"), w.tolist()))
    both = df.select(S.feature(removed, w.tolist(), "center_nm", 2100, 2300).alias("c"), removed.alias("a")).collect()
    assert abs(both[0]["c"] - 2206) <= 2 and both[0]["a"] == pytest.approx(both[1]["a"])


def test_feature_fit(spark):
    df = spark.createDataFrame([([0.0, 0.2, 0.0], [0.0, 0.2, 0.0]), ([0.0, 0.2, 0.1], [0.0, 0.2, 0.0])], "p array<double>, r array<double>")
    rows = df.select(S.feature_fit(F.col("p"), F.col("r")).alias("f")).select("f.*").collect()
    assert rows[0]["scale"] == pytest.approx(1) and rows[0]["rms"] == pytest.approx(0, abs=1e-12)
    assert rows[1]["quality"] == pytest.approx(rows[1]["scale"] / rows[1]["rms"])


def test_features(spark):
    axis = [2100.0, 2150.0, 2200.0, 2250.0, 2300.0]
    df = one(spark, [([0.0, 0.1, 0.2, 0.1, 0.0],), ([0.3, 0.0, 0.04, 0.0, 0.0],)])
    a = F.col("x")
    rows = df.select(S.feature(a, axis, "center_nm", 2175, 2225), S.feature(a, axis, "depth", 2175, 2225), S.feature(a, axis, "depth_ratio", 2175, 2225)).collect()
    assert tuple(rows[0]) == pytest.approx((2200, 0.2, 1.0)) and tuple(rows[1]) == pytest.approx((2200, 0.04, 0.04 / 0.3))


def test_missing_feature_renormalises_evidence(spark):
    axis = [1000.0, 1010.0, 1020.0]
    out = [{"id": "x", "type": "depth", "window_nm": (3000.0, 3100.0)}]
    df = one(spark, [([0.0, 0.2, 0.0],)])
    e = S.reference_evidence(F.col("x"), A.literal_doubles([0, 0.2, 0]), axis, out, {"shape": 0.6, "derivative": 0.2, "features": 0.2})
    row = df.select(e.alias("e")).select("e.*").first()
    assert row["total"] == pytest.approx(0, abs=1e-6) and row["feature"] is None
    kernel = df.select(K.evidence_to([[0, 0.2, 0]], axis, out, {})("x")).first()[0]
    assert kernel == pytest.approx([0], abs=1e-6)


def test_kernels_agree_with_expressions(spark):
    rng = np.random.default_rng(4)
    axis = np.cumsum(rng.uniform(5, 12, 30)).tolist()
    df = one(spark, [(row,) for row in rng.uniform(0.2, 1, (20, 30)).tolist()])
    pairs = [
        (S.savgol(F.col("x"), 30), K.smooth(30)("x")),
        (S.absorption(S.continuum_segmented(F.col("x"), axis)), K.absorb(axis, range(30))("x")),
    ]
    for expression, kernel in pairs:
        for a, b in df.select(expression, kernel).collect():
            assert a == pytest.approx(b, abs=1e-9)


def test_best_k_and_ties(spark):
    df = one(spark, [([0.1, 0.2, 0.3, 0.4, 0.5],)])
    scores = scoring.mineral_scores(F.col("x"), list("aaabb"), ["a", "b"], 2)
    assert [round(s["score"], 6) for s in df.select(scores).first()[0]] == [0.15, 0.45]
    tied = one(spark, [([0.3, 0.3],), ([0.4, None],)])
    rows = tied.select(scoring.competition(F.col("x")).alias("c")).select("c.*").collect()
    assert rows[0]["label"] == 1 and rows[0]["margin"] == 0
    assert rows[1]["label"] == 1 and rows[1]["margin"] == float("inf")


def test_near_tie(spark):
    df = one(spark, [([0.20, 0.21],), ([0.20, 0.40],)])
    rows = df.select(scoring.near_tie_label(F.col("x"), A.literal_doubles([0.0, 0.02]), 0.03).alias("t")).select("t.*").collect()
    assert [(r["label"], r["tied"]) for r in rows] == [(2, 2), (1, 1)]


def test_margin_gate_ignores_lone_mineral(spark):
    df = spark.createDataFrame([(None, 1), (0.1, 2), (0.01, 2)], "m double, n int")
    ok = scoring.margin_pass(F.col("m"), F.lit(0.05), F.col("n"), F.lit(True))
    assert [r[0] for r in df.select(ok).collect()] == [True, True, False]


def test_winner_value(spark):
    df = spark.createDataFrame([([2.0, 1.0], 1), ([1.0, 3.0], 2), ([1.0, 3.0], 0)], "v array<double>, l int")
    assert [r[0] for r in df.select(scoring.gather_winner(F.col("v"), F.col("l"))).collect()] == [2.0, 3.0, None]


def test_name_matcher(spark):
    minerals = {
        "calcite": {"name_patterns": [r"\bcalcite\b"]}, "illite": {"name_patterns": [r"\billite\b"]},
        "montmorillonite": {"name_patterns": [r"\bmontmorillonite\b"]}, "kaolinite": {"name_patterns": [r"\bkaolinite\b"], "reject_patterns": ["halloysite"]},
    }
    df = spark.createDataFrame([("Calcite C-3A",), ("Illite-bearing Shale",), ("Montmorillonite+Illite CM37",), ("Halloysite+Kaolinite CM29",), ("Quartz",)], "name string")
    rows = N.with_mineral_match(df, "name", minerals, [r"\b(?:bearing|shale)\b"]).collect()
    assert [(r["mineral_id"], r["rejection"]) for r in rows] == [
        ("calcite", None), ("illite", "rock_or_mixture_name"), ("illite", "mixed_target_minerals"),
        ("kaolinite", "mineral_specific_rejected_name"), (None, None)]


def test_phase_names(spark):
    rows = [
        ("usgs_v1", "actinolite.spc Actinolite HS116.3B"), ("igcp264", "kaolinite_CM9"), ("igcp264", "drygrass_1"),
        ("jpl", "Calcite/Dolomite C-3"), ("jhu_minerals", "Quartz SiO2 (quartz.1)"), ("usgs_v1", "notro.spc Notronite NG-1"),
    ]
    df = spark.createDataFrame([(f, "mineral_reference", n) for f, n in rows], "family string, role string, name string")
    aliases = {m: m for m in ("actinolite", "kaolinite", "calcite", "dolomite", "quartz")}
    out = {r["name"]: r for r in N.parse_names(df, "family", "role", "name", aliases).collect()}
    assert out[rows[0][1]]["phase_id"] == "actinolite" and out[rows[0][1]]["sample_code"] == "HS116.3B"
    assert out[rows[1][1]]["sample_code"] == "CM9" and out[rows[1][1]]["purity"] == "declared_pure"
    assert out[rows[2][1]]["record_role"] == "vegetation" and out[rows[2][1]]["purity"] == "not_mineral_reference"
    assert out[rows[3][1]]["purity"] == "mixture"
    assert out[rows[4][1]]["sample_code"] == "quartz.1"
    assert out[rows[5][1]]["phase_id"] == "nontronite" and not out[rows[5][1]]["catalogued"]
