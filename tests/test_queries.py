"""Queries beside their SQL on tables of a few rows."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from drillspectra.operators import maps
from drillspectra.operators.quantiles import exact_quantiles
from drillspectra.plans.views import BANDS


def beside_sql(spark, folder, name, *tables):
    """None, or how the query differs from its SQL over tables written as folders of files."""
    duck = duckdb.connect()
    for table in tables:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder)).toArrow()
    return compare(name, got, duck.execute(entry.oracle_sql()[name]).to_arrow_table())


def write_spectra(spark, folder, rows):
    spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(
        3).write.parquet(f"{folder}/embeddings.parquet")


def test_a_featureless_curve_keeps_the_plain_ratios(spark, tmp_path):
    bump = [0.5 - ((b - 32) / 64) ** 2 for b in range(BANDS)]  # above its chords, so no absorption at all
    dip = [0.2 + ((b - 30) / 64) ** 2 for b in range(BANDS)]
    write_spectra(spark, tmp_path, [bump, dip])
    assert beside_sql(spark, tmp_path, "l4_reference_diagnostics", "embeddings") is None
    rows = {r["vec_id"]: r for r in entry.queries()["l4_reference_diagnostics"](spark, str(tmp_path)).collect()}
    assert rows[0]["depth"] == 0 and rows[0]["roughness"] != rows[0]["roughness"] and rows[0]["quality"] == 0.55


def test_a_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    write_spectra(spark, tmp_path, [[0.01 * (b % (i + 2)) for b in range(BANDS)] for i in range(7)])
    assert beside_sql(spark, tmp_path, "t1_line_block_stream", "embeddings") is None


def test_quantiles_count_values_without_sorting_rows(spark, capsys):
    """Equal values meet in hash tables: a sort would hold every row of a bin beside its ranks."""
    rows = spark.range(4000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50 / 7.0).alias("x"))
    out = exact_quantiles(rows, ["k"], "x", [0.25, 0.5])
    out.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    got = {r["k"]: (r["n"], r["q0"], r["q1"]) for r in out.collect()}
    for k in range(3):
        x = [i % 50 / 7.0 for i in range(4000) if i % 3 == k]
        assert got[k] == (len(x), *np.quantile(x, [0.25, 0.5]))


def test_tiles_are_blended_in_the_row(spark, tmp_path, capsys):
    """Only cells and pools are grouped: tables of tiles beside those of cells would fill a task."""
    rows = [(p, 1 + (p * 7 + s) % 40, p + s, 100.0 + (p * 31 + s * 17) % 997, (p + s) % 11 / 100, s % 9 / 100) for p in range(0, 1300, 3) for s in range(5)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity long, l_extendedprice double, l_discount double, l_tax double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    assert beside_sql(spark, tmp_path, "a21_tile_score_blending", "lineitem") is None
    entry.queries()["a21_tile_score_blending"](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("HashAggregate") == 4 and "Generate" not in plan


def test_blended_tiles_of_any_stride(spark, cells):
    scores = np.random.default_rng(5).random((40, 2))
    given = cells(np.ones(scores.shape, bool), score=scores)
    for size, stride in ((10, 4), (8, 8), (4, 6)):
        got = {(r["line"], r["sample"]): r["score"] for r in maps.blend_tiles(
            given, ["scene_id"], lambda i: F.col("score") * (1 + i), size, stride).collect()}
        expected = {}
        for line, sample in np.ndindex(scores.shape):
            tiles = [i for i in range(40) if i * stride <= line < i * stride + size]
            weights = [max(0.5 - 0.5 * np.cos(2 * np.pi * (line - i * stride + 0.5) / size), 1e-3) for i in tiles]
            if tiles:
                expected[line, sample] = np.average([scores[line, sample] * (1 + i) for i in tiles], weights=weights)
        assert got.keys() == expected.keys()
        assert all(np.isclose(got[k], expected[k], rtol=1e-12) for k in expected)


def test_a_trial_measures_its_candidates_once(spark, tmp_path):
    """Three policies ask for nine pairs in all; a search of its own for each took 259 jobs."""
    rows = [(p, 1 + (p * 7 + s) % 40, 1 + p % 5, 1000.0 + (p * 31 + s * 17) % 9973, 0.05, 0.02) for p in range(300) for s in range(12)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity long, l_extendedprice double, l_discount double, l_tax double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    context = spark.sparkContext
    context.setJobGroup("trial", "")
    got = entry.queries()["m4_threshold_trial"](spark, str(tmp_path)).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("trial"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [r["policy"] for r in sorted(got, key=lambda r: r["percentile"] or 0)] and len(got) == 3
    assert jobs < 110
