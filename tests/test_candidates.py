"""Detection by scene lookups: scores and limits against plain numpy, no exchange of spectra, boxes on tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspectra.functions import kernels as K
from drillspectra.operators import candidates, grid, maps

BANDS = 24
POLICIES = ["strict", "wide"]


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(4)
    rows = [(s, line, sample, (rng.random(BANDS) + 0.5).tolist()) for s in ("A", "B", "C") for line in range(9) for sample in range(5)]
    return rows, spark.createDataFrame(rows, "scene_id string, line int, sample int, spectrum array<double>").repartition(4)


def _groups():
    rng = np.random.default_rng(6)
    return {n: {"references": (rng.random((3, BANDS)) + 0.5).tolist(), "detect": list(range(a, a + 12))} for n, a in ((2, 0), (5, 10))}


def _plain_scores(rows, groups, bias, strength):
    smoothing = candidates.Detector(groups, BANDS, None, 0.0).smoothing
    out = {}
    for scene, line, sample, spectrum in rows:
        x = np.asarray(spectrum) @ smoothing - strength * bias.get((scene, sample), np.zeros(BANDS))
        for number, g in groups.items():
            at = g["detect"]
            angles = [np.arccos(np.dot(x[at], np.asarray(r)[at]) / np.linalg.norm(x[at]) / np.linalg.norm(np.asarray(r)[at])) for r in g["references"]]
            out[scene, line, sample, number] = min(angles)
    return out


def test_candidates_equal_plain_comparisons(spark, scene):
    rows, pixels = scene
    groups = _groups()
    rng = np.random.default_rng(7)
    bias = {(s, c): rng.normal(0, 0.05, BANDS) for s in ("A", "B") for c in range(4)}  # none for scene C and column 4
    table = candidates.scene_table(spark.createDataFrame([(*k, v.tolist()) for k, v in bias.items()], "scene_id string, sample int, bias array<double>"), 200)
    detector = candidates.Detector(groups, BANDS, table, 0.7)
    want = _plain_scores(rows, groups, bias, 0.7)
    got = {(r["scene_id"], r["line"], r["sample"]): r for r in candidates.detection_scores(pixels, detector, 3).collect()}
    assert len(got) == len(rows)
    for scene_id, line, sample, spectrum in rows:
        r = got[scene_id, line, sample]
        assert r["scores"] == pytest.approx([want[scene_id, line, sample, n] for n in groups]) and r["level"] == pytest.approx(spectrum[3])

    middle = float(np.median(list(want.values())))
    limits = [(s, n, c, [middle * 0.9, None if c == 2 else middle], 1.2 if s == "A" else None) for s in ("A", "B") for n in groups for c in range(5)]
    limit_table = candidates.scene_table(spark.createDataFrame(limits, "scene_id string, group_no int, sample int, limits array<double>, top double"), 3)
    plans = {n: (lambda spectra: (spectra.max(axis=1), np.tile(spectra.min(axis=1)[:, None], (1, 2)))) for n in groups}
    found = candidates.candidate_evidence(pixels, detector, limit_table, POLICIES, 3, plans, 3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    named = {(r["scene_id"], r["line"], r["sample"], r["group_no"]): r for r in found.collect()}
    spectra = {r[:3]: r[3] for r in rows}
    expected = {}
    for (s, line, c, n), score in want.items():
        passed = [p for p, limit in zip(POLICIES, (middle * 0.9, None if c == 2 else middle)) if s != "C" and limit is not None and score <= limit]
        if passed:
            expected[s, line, c, n] = passed
    assert {k: r["policies"] for k, r in named.items()} == expected and 0 < len(expected) < len(want)
    for k, r in named.items():
        assert r["score"] == pytest.approx(want[k]) and r["saturated"] == (k[0] == "A" and spectra[k[:3]][3] >= 1.2)
        assert r["distances"][:2] == pytest.approx([min(np.asarray(spectra[k[:3]]) @ detector.smoothing)] * 2) and r["distances"][2] is None


def test_matrix_of_ragged_rows():
    import pyarrow as pa

    kind = pa.list_(pa.float64())
    np.testing.assert_array_equal(K._matrix(pa.array([[1, 2], None, [4]], kind)), [[1, 2], [np.nan, np.nan], [4, np.nan]])
    np.testing.assert_array_equal(K._matrix(pa.array([[0], [1, None], [3]], kind)[1:]), [[1, np.nan], [3, np.nan]])
    assert K._matrix(pa.array([], kind)).shape == (0, 0)


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_boxes_over_tile_seams(spark, cells, frame, plane, monkeypatch, tile):
    monkeypatch.setattr(grid.per_tile, "__defaults__", (tile,))
    rng = np.random.default_rng(tile)
    shape = (23, 9)
    mask = rng.random(shape) < 0.45
    values = np.round(rng.random(shape), 3)
    df = cells(mask, x=values)
    padded, sums = np.pad(mask.astype(int), 2), np.pad(np.where(mask, values, 0.0), 2)

    def box(source, r, c):
        return sum(source[2 + a : 2 + a + shape[0], 2 + b : 2 + b + shape[1]] for a in range(-r, r + 1) for b in range(-c, c + 1))

    counts = {(r["line"], r["sample"]): r["n"] for r in grid.box_counts(df, df, ["scene_id"], 1, 2, include_self=False).collect()}
    assert counts == {(a, b): int(box(padded, 1, 2)[a, b] - 1) for a, b in np.argwhere(mask).tolist()}
    every = cells(np.ones(shape, bool))
    asked = {(r["line"], r["sample"]): r["n"] for r in grid.box_counts(df, every, ["scene_id"], 2, 1).collect()}
    assert asked == {(a, b): int(box(padded, 2, 1)[a, b]) for a in range(shape[0]) for b in range(shape[1])}
    for r in grid.box_sums(df, ["scene_id"], 2, 2, ["x"]).collect():
        assert r["x"] == pytest.approx(box(sums, 2, 2)[r["line"], r["sample"]]) and r["n"] == box(padded, 2, 2)[r["line"], r["sample"]]
    assert np.array_equal(plane(grid.majority(df, frame(shape), ["scene_id"]), shape), box(padded, 1, 1) >= 5)
    assert np.array_equal(plane(grid.erode(df, ["scene_id"]), shape), (box(padded, 1, 1) == 9) & mask)
    assert np.array_equal(plane(grid.dilate(df, frame(shape), ["scene_id"]), shape), box(padded, 1, 1) > 0)


def test_relabel_takes_the_smallest_of_equal_rivals(spark):
    rows = [("A", 1, 1, 7, 0.0), ("A", 0, 0, 3, 1.0), ("A", 0, 1, 3, 1.0), ("A", 2, 2, 2, 1.0), ("A", 2, 1, 2, 1.0), ("A", 9, 9, 1, 0.0), ("A", 9, 8, 5, 0.9), ("A", 4, 4, 6, None)]
    df = spark.createDataFrame(rows, "scene_id string, line int, sample int, class_id int, margin double")
    got = {(r["line"], r["sample"]): r["label"] for r in maps.local_tie_relabel(df, ["scene_id"], 0.5, 2, 2).collect()}
    assert got[1, 1] == 2 and got[9, 9] == 1 and got[4, 4] == 6 and len(got) == len(rows)
