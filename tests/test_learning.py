import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspectra.operators import calibrate as M, library as L
from drillspectra.sources import cubes, rasters

SC = ["scene_id"]


def unit_rows(n, width=12, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width)) + 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def curves(spark, groups):
    rows, at = [], 0
    for g, x in groups.items():
        for v in x:
            rows.append((g, at, v.tolist(), (at * 37 % 101) / 101, at % 3, at % 2, None))
            at += 1
    return spark.createDataFrame(rows, "g string, id long, v array<double>, quality double, source_family int, geometry int, anchor_order int")


def test_median_distance_in_blocks(spark):
    x = unit_rows(70)
    x[10:30] = x[10]  # a heap of copies
    out = {r["id"]: r["median_angle"] for r in L.median_distances(curves(spark, {"a": x}), ["g"], "id", "v", block=16).collect()}
    angle = np.arccos(np.clip(x @ x.T, -1, 1))
    angle[np.all(x[:, None] == x[None], axis=2)] = 0
    expected = np.median(angle, axis=1)
    assert set(out) == set(range(11)) | set(range(30, 70))
    assert all(out[i] == pytest.approx(expected[i], abs=1e-7) for i in out)


def test_medoid_is_the_best_of_its_copies(spark):
    x = unit_rows(70, seed=3)
    x[10:60] = x[10]
    row = L.medoids(curves(spark, {"a": x}), ["g"], "id", "v", "quality", block=16).collect()[0]
    best = max(range(10, 60), key=lambda i: ((i * 37 % 101) / 101, -i))
    assert (row["id"], row["median_angle"]) == (best, 0.0)


def test_median_windows_leave_one_row_a_curve(spark):
    x = unit_rows(300, seed=4)
    folded = curves(spark, {"a": x}).select("g", "id", "v", F.lit(1).cast("long").alias("weight"))
    rows = L._median_windows(L._whole_range(folded), folded, ["g"], "id", "v", 32, 512).collect()
    angle = np.arccos(np.clip(x @ x.T, -1, 1))
    np.fill_diagonal(angle, 0)
    expected = np.median(angle, axis=1)
    assert sorted(r["id"] for r in rows) == list(range(300))
    assert all((r["_a0"] + r["_c0"]) / 2 <= expected[r["id"]] <= (r["_a1"] + r["_c1"]) / 2 for r in rows)
    assert all(r["_a1"] - r["_a0"] < 0.0062 for r in rows)


def test_near_duplicates_in_blocks(spark):
    x = unit_rows(40, seed=5)
    x[20:32] = x[20]
    x[33] = x[32] + 1e-4
    x[33] /= np.linalg.norm(x[33])
    df = curves(spark, {"a": x})
    out = {r["id"]: r["duplicate_of"] for r in L.near_duplicates(df, ["g"], "id", "v", "quality", 0.02, block=8).collect()}
    quality = {i: (i * 37 % 101) / 101 for i in range(40)}
    best = max(range(20, 32), key=lambda i: (quality[i], -i))
    assert {out[i] for i in range(20, 32) if i != best} == {best} and out[best] is None
    keep = max((32, 33), key=lambda i: quality[i])
    assert out[keep] is None and out[65 - keep] == keep
    assert all(out[i] is None for i in range(20))


def greedy(x, quality, family, geometry, want):
    angle = np.arccos(np.clip(x @ x.T, -1, 1))
    np.fill_diagonal(angle, 0)
    chosen = [min(range(len(x)), key=lambda i: (np.median(angle[i]), -quality[i], i))]
    while len(chosen) < want:
        def gain(i):
            near = angle[i, chosen].min()
            s = 0.5 * min(near / 0.2, 1) + 0.25 * quality[i] + 0.2 * (family[i] not in {family[c] for c in chosen}) + 0.05 * (geometry[i] not in {geometry[c] for c in chosen})
            return (s, quality[i], near, -i)
        chosen.append(max((i for i in range(len(x)) if i not in chosen), key=gain))
    return chosen


def test_diverse_references_match_greedy(spark):
    a, b = unit_rows(20, seed=1), unit_rows(9, seed=2)
    out = L.diverse_references(curves(spark, {"a": a, "b": b}), "g", "id", "v", maximum=4, minimum=3).orderBy("g", "rank").collect()
    got = {g: [r["id"] for r in out if r["g"] == g] for g in "ab"}
    q = lambda i: (i * 37 % 101) / 101
    assert got["a"] == greedy(a, [q(i) for i in range(20)], [i % 3 for i in range(20)], [i % 2 for i in range(20)], 4)
    ids = range(20, 29)
    assert got["b"] == [20 + i for i in greedy(b, [q(i) for i in ids], [i % 3 for i in ids], [i % 2 for i in ids], 3)]


def test_resampling(spark):
    df = spark.createDataFrame([([1000.0, 1010.0, 1300.0, 1310.0], [1.0, 2.0, 3.0, 4.0])], "w array<double>, y array<double>")
    assert df.select(L.resample([1005.0, 1150.0, 1305.0], gap=50.0)("w", "y")).first()[0] == pytest.approx([1.5, None, 3.5])
    w = np.linspace(2200, 2500, 501)
    y = 1 - 0.2 * np.exp(-0.5 * ((w - 2340) / 15) ** 2)
    targets = np.arange(2250.0, 2450.0, 5.0)
    df = spark.createDataFrame([(w.tolist(), y.tolist())], "w array<double>, y array<double>")
    out = df.select(L.resample(targets.tolist(), [10.0] * len(targets))("w", "y")).first()[0]
    assert abs(targets[int(np.argmin(out))] - 2340) <= 5


def test_score_offsets_match_long_descent(spark):
    x = np.r_[np.tile([0.30, 0.20], (20, 1)), np.tile([0.36, 0.18], (20, 1))]
    y = np.r_[np.zeros(20, int), np.ones(20, int)]
    df = spark.createDataFrame([(r.tolist(), int(l)) for r, l in zip(x, y)], "scores array<double>, label int")
    offsets = M.score_offsets(df, 2)
    assert offsets[0] > offsets[1]
    assert np.mean(np.argmin(x[:20] - offsets, axis=1) == 0) > 0.9
    # plain gradient steps on the same objective
    t = max(np.median(np.abs(x[:, 0] - x[:, 1])), 0.03)
    b = np.zeros(2)
    for _ in range(4000):
        z = -x / t + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        b += 0.25 * ((np.eye(2)[y] - p).mean(0) - 0.02 * b)
        b -= b.mean()
    expected = np.clip(b * t, -0.45, 0.45)
    assert offsets == pytest.approx(expected - expected.mean(), abs=1e-4)


def test_unlabelled_confuser_is_demoted(spark):
    df = spark.createDataFrame([([0.34, 0.18], 0)] * 40, "scores array<double>, label int")
    offsets = M.score_offsets(df, 2)
    assert offsets[0] > offsets[1] and 0.34 - offsets[0] < 0.18 - offsets[1]


def gate_frame(spark, feature, positive, split):
    rows = [("A", i, 0, float(f), float(f * f), bool(p), s) for i, (f, p, s) in enumerate(zip(feature, positive, split))]
    return spark.createDataFrame(rows, "scene_id string, line int, sample int, f double, g double, positive boolean, split string")


def test_evidence_gate_recall_and_nesting(spark):
    f = np.linspace(-2, 2, 200)
    split = ["holdout" if i % 5 == 0 else "training" for i in range(200)]
    df = gate_frame(spark, f, f > 0.8, split)
    train = df.where("split = 'training'")
    scored = df.join(M.gate_model(train, SC, ["f", "g"]), SC).withColumn("s", M.gate_score(["f", "g"])).cache()
    base = M.gate_threshold(scored.where("split = 'training'"), SC)
    inside = M.evidence_gates(scored, SC, base, ["line", "sample"]).collect()
    kept = {p: {r["line"] for r in inside if r["policy"] == p} for p in M.POLICIES}
    held = [i for i in range(0, 200, 5)]
    good = [i for i in held if f[i] > 0.8]
    assert sum(i in kept["balanced"] for i in good) / len(good) > 0.8
    assert sum(i in kept["balanced"] for i in held if f[i] <= 0.8) / len([i for i in held if f[i] <= 0.8]) < 0.2
    assert kept["conservative"] <= kept["balanced"] <= kept["sensitive"]


def test_axis_fallback_finds_the_feature(spark):
    f = np.linspace(-3, 3, 240)
    row = M.axis_threshold(gate_frame(spark, f, f > 1, ["training"] * 240), SC, ["f", "g"]).first()
    assert row["feature"] == "f" and row["direction"] == 1 and 0.8 < row["threshold"] < 1.2 and row["recall"] > 0.9


def test_threshold_table_is_exact(spark):
    rng = np.random.default_rng(8)
    s, p = rng.normal(size=300), rng.random(300) < 0.4
    df = spark.createDataFrame([("A", float(a), bool(b)) for a, b in zip(s, p)], "scene_id string, s double, positive boolean")
    for r in M._threshold_table(df, SC, 21).collect():
        assert r["recall"] == pytest.approx(np.mean(s[p] >= r["threshold"])) and r["fpr"] == pytest.approx(np.mean(s[~p] >= r["threshold"]))


def test_grid_search_prefers_patch_over_column(spark, cells, frame):
    scores = np.full((100, 40), 0.5)
    scores[20:60, 10:20] = 0.05
    scores[:, 30] = 0.11
    valid = cells(np.ones((100, 40), bool))
    blocks = spark.createDataFrame([("A", a, a + 25) for a in range(0, 100, 25)], "scene_id string, start int, stop int")
    policies = {p: {"column_percentile": c, "absolute_sam_threshold_rad": a} for p, c, a in (("conservative", 0.3, 0.08), ("balanced", 0.4, 0.08), ("sensitive", 0.5, 0.12))}
    found = M.search_thresholds(cells(np.ones((100, 40), bool), score=scores), valid, frame((100, 40)), blocks, policies, "balanced", steps=2)
    best = M.best_candidate(found).first()
    assert best["status"] == "resolved" and best["absolute"] == pytest.approx(0.08)


def test_search_terms_over_tile_seams(spark, cells, frame):
    """Terms counted in haloed tiles are those of whole components, run ends and column penalties."""
    rng = np.random.default_rng(8)
    shape = (1100, 12)
    present = rng.random(shape) < 0.85
    scores = rng.random(shape)
    scores[508:518, 4] = 0.01  # one patch over the seam at line 512, and a small one
    scores[511:513, 9] = 0.01
    scores[:, 7] /= 4
    given = cells(present, score=scores)
    blocks = spark.createDataFrame([("A", 0, 300), ("A", 480, 1100)], "scene_id string, start int, stop int")
    keys = ["scene_id", "percentile", "absolute"]
    got = {(r["percentile"], r["absolute"]): r for r in M.candidate_terms(
        given, given, frame(shape), blocks, [0.1, 0.3], [0.05, 0.2], edge_width=2, isolated_pixels=4).collect()}
    assert len(got) == 4
    sampled = given.where("line < 300 or line >= 480").drop("_bin")
    limits = M.columns.column_thresholds(sampled, frame(shape), [0.1, 0.3], minimum=1, radius=1)
    edges = M.grid.edge_risk(sampled.select("scene_id", "line", "sample"), SC, 2).where("edge_risk > 0").select("line", "sample")
    ends = {tuple(r) for r in edges.collect()}
    for i, p in enumerate([0.1, 0.3]):
        for a in (0.05, 0.2):
            hits = sampled.join(limits, ["scene_id", "sample"]).where(f"score <= t{i} and score <= {a}").select("scene_id", "line", "sample", "score")
            rows, r = hits.collect(), got[p, a]
            assert r["sample_pixels"] == sampled.count() and r["pixels"] == len(rows)
            assert r["edge_penalty"] == pytest.approx(np.mean([(h["line"], h["sample"]) in ends for h in rows]))
            assert r["_median"] == pytest.approx(np.median([h["score"] for h in rows]))
            assert r["isolated"] == M.CC.small_share(M.CC.components(hits.drop("score"), SC), 4, SC).first()["isolated"]
            assert r["column_penalty"] == pytest.approx(M.fixed_column_penalty(hits, sampled, blocks, frame(shape)).first()["column_penalty"])


def test_thresholds_of_columns_without_those_of_scenes(spark, cells, frame):
    scores = np.random.default_rng(9).random((50, 6))
    given = cells(np.random.default_rng(10).random((50, 6)) < 0.1, score=scores)
    full = M.columns.column_thresholds(given, frame((50, 6)), [0.2, 0.5], minimum=1, radius=1)
    short = M.columns.column_thresholds(given, frame((50, 6)), [0.2, 0.5], minimum=1, radius=1, whole_scene=False)
    names = ["scene_id", "sample", "n", "t0", "t1"]
    assert short.columns == names and sorted(map(tuple, short.collect())) == sorted(map(tuple, full.select(*names).collect()))
    with pytest.raises(ValueError):
        M.columns.column_thresholds(given, frame((50, 6)), [0.2], minimum=2, whole_scene=False)


def test_consensus_floor(spark):
    df = spark.createDataFrame([(0.50, "balanced", 3), (0.66, "conservative", 3), (0.54, "balanced", 4)], "c double, p string, n int")
    out = [r[0] for r in df.select(M.consensus_floor(F.col("c"), F.col("p"), F.col("n"))).collect()]
    assert out == pytest.approx([1 / 3, 0.66, 0.25])


@pytest.mark.parametrize("interleave", ["bip", "bil", "bsq"])
def test_cube_files(spark, tmp_path, interleave):
    cube = np.arange(24, dtype=">f4").reshape(2, 4, 3)
    order = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[interleave]
    (tmp_path / "a.dat").write_bytes(np.ascontiguousarray(cube.transpose(order)).tobytes())
    (tmp_path / "a.hdr").write_text(
        f"ENVI\nsamples = 4\nlines = 2\nbands = 3\ndata type = 4\ninterleave = {interleave}\nbyte order = 1\nwavelength units = Micrometers\nwavelength = {{2.08,\n 10.0, 25.0}}\n")
    headers = rasters.read_headers(spark, f"{tmp_path}/*.hdr")
    w = headers.select(rasters.number_list(F.col("header")["wavelength"])).first()[0]
    assert w == [2.08, 10.0, 25.0]
    rows = cubes.read_cubes(spark, f"file://{tmp_path}", block_bytes=1).collect()
    assert len(rows) == 8 and all(r["scene_id"] == "a" and r["spectrum"] == cube[r["line"], r["sample"]].tolist() for r in rows)


def test_numeric_qc(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, None, 3.0],), ([0.5, 0.5],), ([0.0, 1.0, 2.0],), ([-1.0, 1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(L.numeric_qc(F.col("v"))["status"]).collect()] == ["pass", "invalid", "invalid", "review", "review"]
