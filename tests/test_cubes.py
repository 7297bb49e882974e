"""The cube and library data source: interleaves, band subsets, line ranges, damaged files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspectra.operators.profiles import band_medians
from drillspectra.operators.quantiles import exact_quantiles
from drillspectra.sources import cubes

AXES = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}


class Counting:
    """A file that notes what is read from it."""

    def __init__(self, content):
        self.content, self.place, self.bytes = content, 0, 0

    def seek(self, place):
        self.place = place

    def read(self, size):
        self.bytes += size
        self.place += size
        return self.content[self.place - size : self.place]


def _header(shape, interleave, **more):
    lines, samples, bands = shape
    known = {"lines": str(lines), "samples": str(samples), "bands": str(bands), "data type": "2", "interleave": interleave, "header offset": "5"}
    return known | {k.replace("_", " "): str(v) for k, v in more.items()}


@pytest.mark.parametrize("interleave", list(AXES))
@pytest.mark.parametrize("wanted", [[0, 1, 2, 3, 4, 5, 6], [4, 5], [6, 0, 1], [3, 3]])
def test_parts_hold_their_lines_and_bands(interleave, wanted):
    cube = np.random.default_rng(3).integers(-9000, 9000, (11, 5, 7)).astype("<i2")
    content = b"front" + np.ascontiguousarray(cube.transpose(AXES[interleave])).tobytes()
    whole = cubes.Layout("file:///x/a.dat", _header(cube.shape, interleave))
    for start, stop in [(0, 11), (2, 3), (4, 9), (10, 11)]:
        file = Counting(content)
        got = whole.part(start, stop, wanted).values(file)
        assert got.tolist() == cube[start:stop][:, :, wanted].tolist()
        assert file.bytes == (stop - start) * 5 * 2 * (7 if interleave == "bip" else len(wanted))


def test_cubes_go_to_files_and_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(s, line, sample, [None if x > 0.95 else float(x) for x in rng.random(6)]) for s in ("A", "B") for line in range(7) for sample in range(4) if (line, sample) != (3, 1)]
    pixels = spark.createDataFrame(rows, "scene_id string, line int, sample int, spectrum array<double>")
    want = {r[:3]: r[3] for r in rows}
    for order, big in (("bip", True), ("bil", False), ("bsq", True)):
        folder = f"file://{tmp_path}/{order}"
        assert cubes.write_cubes(pixels, folder, order, block_lines=3, big_endian=big).count() == 6
        got = {(r["scene_id"], r["line"], r["sample"]): r["spectrum"] for r in cubes.read_cubes(spark, folder, block_bytes=200).collect()}
        assert len(got) == 56 and got[("A", 3, 1)] == [None] * 6
        assert {k: v for k, v in got.items() if k in want} == want
        part = cubes.read_cubes(spark, folder, bands=[4, 1], first_line=2, last_line=3).collect()
        assert len(part) == 16 and all(r["spectrum"] == [got[(r["scene_id"], r["line"], r["sample"])][b] for b in (4, 1)] for r in part)


def test_line_filters_reach_the_source(spark, tmp_path):
    folder = f"file://{tmp_path}/cube"
    rows = [("A", line, sample, [float(line), float(sample)]) for line in range(40) for sample in range(3)]
    cubes.write_cubes(spark.createDataFrame(rows, "scene_id string, line int, sample int, spectrum array<double>"), folder, block_lines=40).count()
    whole = cubes.read_cubes(spark, folder, block_bytes=48)
    assert whole.rdd.getNumPartitions() == 40
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = cubes.read_cubes(spark, folder, block_bytes=48).where("line >= 10 AND line < 14 AND sample > 0 AND scene_id = 'A'")
        assert some.rdd.getNumPartitions() == 4
        assert sorted((r["line"], r["sample"]) for r in some.collect()) == [(line, s) for line in range(10, 14) for s in (1, 2)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert whole.where("line = 5").count() == 3


def test_damaged_files_are_refused(spark, tmp_path):
    def write(name, header, content=b""):
        (tmp_path / f"{name}.hdr").write_text("ENVI\n" + "".join(f"{k} = {v}\n" for k, v in header.items()))
        (tmp_path / f"{name}.dat").write_bytes(content)

    good = _header((2, 2, 2), "bil")
    write("a", good, bytes(5 + 16))
    assert [x.name for x in cubes.layouts(str(tmp_path))] == ["a"]
    for change, content in [({}, bytes(20)), ({"data type": "6"}, bytes(21)), ({"interleave": "bic"}, bytes(21)), ({"wavelength": "{1, 2, 3}"}, bytes(21))]:
        write("b", good | change, content)
        with pytest.raises(ValueError):
            cubes.layouts(str(tmp_path))
    write("b", {k: v for k, v in good.items() if k != "lines"}, bytes(21))
    with pytest.raises(ValueError, match="lines"):
        cubes.layouts(str(tmp_path))
    (tmp_path / "b.hdr").rename(tmp_path / "c.hdr")
    with pytest.raises(ValueError, match="no data file"):
        cubes.layouts(str(tmp_path))


def test_wavelengths_in_any_unit():
    axis = lambda values, units="": cubes.nanometres({"wavelength": values, "wavelength units": units})
    assert axis("{1000, 1100,\n 1200}", "Micrometers") == [1000, 1100, 1200]
    assert axis("{2.08, 10.0, 25.0}", "Micrometers") == [2080, 10_000, 25_000]
    assert axis("{0.4, 2.5}", "Nanometers") == [400, 2500]
    assert axis("") is None


def test_binary_libraries(spark, tmp_path):
    rows = [("one", ["quartz", "albite, low"], [1.0, 2.5, 4.0], [[0.1, None, 0.3], [1.0, 2.0, 3.0]]), ("two", [], [500.0, 600.5], [[7.0, 8.0], [9.0, 1e-300]])]
    kind = "source_id string, names array<string>, wavelengths array<double>, spectra array<array<double>>"
    folder = f"file://{tmp_path}/libraries"
    assert cubes.write_libraries(spark.createDataFrame(rows, kind), folder).count() == 2
    got = sorted((tuple(r) for r in cubes.read_libraries(spark, folder).collect()))
    assert [g[:2] for g in got] == [("one", 0), ("one", 1), ("two", 0), ("two", 1)]
    assert [g[2] for g in got] == ["Spectrum 1", "Spectrum 2"] * 2  # a comma in a name leaves three names for two spectra
    assert got[0][3:] == ([1000.0, 2500.0, 4000.0], [0.1, None, 0.3]) and got[3][3:] == ([500.0, 600.5], [9.0, 1e-300])
    assert cubes.read_cubes(spark, folder).count() == 0


def test_band_medians_of_ragged_spectra(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        spectrum = [None if x < 0.1 else float("nan") if x < 0.15 else float(x) * float(rng.choice([-1, 1, 1e-3, 1e6])) for x in rng.random(int(rng.integers(0, 7)))]
        rows.append((None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 5}", i % 2, spectrum if i % 50 else None))
    rows += [("same", 0, [0.25, -0.0, 0.0])] * 500 + [("far", 1, [float("inf"), float("-inf"), 5e-324])] * 3
    got = {(r["k"], r["c"], r["band"]): (r["n"], r["m"]) for r in band_medians(spark.createDataFrame(rows, "k string, c int, v array<double>").repartition(7), ["k", "c"], "v").collect()}
    want = {}
    for k, c, spectrum in rows:
        for band, x in enumerate(spectrum or []):
            if k is not None and x is not None and x == x:
                want.setdefault((k, c, band), []).append(x)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == (len(values), float(np.median(values)))


def test_quantiles_of_all_sizes_of_numbers(spark):
    rng = np.random.default_rng(9)
    values = [float(x) for x in np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e-200, 200), rng.normal(0, 1e200, 200), [0.0] * 300, [0.125] * 900])]
    rows = [("a" if i % 3 else "b", x) for i, x in enumerate(values)] + [("a", None), ("a", float("nan")), ("c", float("inf")), ("c", 1.0), ("c", float("-inf"))]
    fractions = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r["k"]: tuple(r)[1:] for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", fractions).collect()}
    for k in "ab":
        own = [x for name, x in rows if name == k and x is not None and x == x]
        assert got[k][0] == len(own) and got[k][1:] == pytest.approx(np.quantile(own, fractions).tolist(), rel=1e-12)
    assert got["c"][:2] == (3, float("-inf")) and got["c"][3] == 1.0 and got["c"][5] == float("inf")
    weighted = spark.createDataFrame([("w", 1.0, 3), ("w", 2.0, 1), ("w", 9.0, 6)], "k string, x double, n int")
    assert tuple(exact_quantiles(weighted, ["k"], "x", [0.5], weight="n").first()) == ("w", 10, 9.0)


def test_digests_of_long_and_missing_files(spark, tmp_path):
    import hashlib
    import os

    from drillspectra.sources import sinks

    with open(tmp_path / "long.bin", "wb") as out:  # a hole takes no space
        out.seek((3 << 30) - 4)
        out.write(b"tail")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.txt").write_text("abc")
    paths = [(f"{tmp_path}/long.bin",), (f"{tmp_path}/empty.bin",), (f"{tmp_path}/deep",), (f"{tmp_path}/none.bin",), (None,), ("nostore://x/y",)]
    got = {r["path"]: r for r in sinks.fingerprints(spark, spark.createDataFrame(paths, "path string")).collect()}
    whole = hashlib.sha256()
    for _ in range(3 * 1024 - 1):
        whole.update(bytes(1 << 20))
    whole.update(bytes((1 << 20) - 4) + b"tail")
    assert got[f"{tmp_path}/long.bin"]["sha256"] == whole.hexdigest() and got[f"{tmp_path}/long.bin"]["bytes"] == 3 << 30
    assert got[f"{tmp_path}/empty.bin"]["sha256"] == hashlib.sha256().hexdigest() and got[f"{tmp_path}/empty.bin"]["error"] is None
    assert got[f"{tmp_path}/deep/x.txt"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and len(got) == 6
    for bad in (f"{tmp_path}/none.bin", None, "nostore://x/y"):
        assert got[bad]["sha256"] is None and got[bad]["error"]
    os.truncate(tmp_path / "long.bin", 0)


def test_equal_scores_are_cut_by_runs_of_lines(spark):
    from drillspectra.operators import sampling

    rows = [("A", line, sample, 0.5, 700) for line in range(900) for sample in range(3)] + [("A", 9000 + i, 0, 0.9, 700) for i in range(20)] + [("B", 1, i, float(i % 3), 4) for i in range(9)]
    df = spark.createDataFrame(rows, "scene_id string, line int, sample int, score double, cap int")
    best = sampling.strongest(df, ["scene_id"], "score", ["line", "sample"], "cap")
    got = sorted((r["scene_id"], r["line"], r["sample"]) for r in best.collect())
    want = []
    for scene, cap in (("A", 700), ("B", 4)):
        own = sorted((r for r in rows if r[0] == scene), key=lambda r: (-r[3], r[1], r[2]))
        want += [r[:3] for r in own[:cap]]
    assert got == sorted(want)
    assert best.select(df.columns).count() == 704
