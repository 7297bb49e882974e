"""Sources, sinks, masks, sensor quality and streams."""

from __future__ import annotations

import json

from pyspark.sql import Window as W, functions as F

from ..functions import arrays as A, kernels as K, names as N, spectral as S
from ..operators import calibrate, grid, library as L, masks, quality
from ..operators.quantiles import exact_quantiles
from ..plans import catalog
from ..plans.registry import query
from ..plans.views import AXIS, BANDS, KEY
from ..session import scratch_folder
from ..sources import cubes, rasters, sinks
from ..streaming import lines
from .decisions import POLICY_SQL, policy_maps
from .planes import DENSE_SQL, dense_cells, gaps_sql, reach_sql
from .spectra import IN_WINDOW, POSITIONS, SPREAD, SUB_AXIS, absorbed, library

SC = ["scene_id"]


def written_cubes(v) -> str:
    """The scenes as cube files, a third of them in each interleave; the folder they lie in."""
    folder = scratch_folder(v.spark, "cubes")
    order = F.element_at(F.array(F.lit("bip"), F.lit("bil"), F.lit("bsq")), (F.crc32("scene_id") % 3 + 1).cast("int"))
    cubes.write_cubes(v.pixels.withColumn("order", order), folder, "order", block_lines=2).agg(F.count("file")).collect()
    return folder


@query("s1_raster_cube_scan", """
    SELECT scene_id, line, sample, band, round(v, 9) AS value FROM px""")
def s1(v):
    """Scenes written as cubes and read back by the data source."""
    rows = cubes.read_cubes(v.spark, written_cubes(v)).where(F.exists("spectrum", lambda x: x.isNotNull()))  # cells without a pixel hold nothing
    return rows.select(*KEY, F.posexplode("spectrum").alias("band", "value")).withColumn("value", F.round("value", 9))


@query("s1_cube_band_subset", """
    SELECT scene_id, line, sample, [round(spectrum[13], 9), round(spectrum[4], 9), round(spectrum[5], 9)] AS spectrum FROM pixels WHERE line BETWEEN 1 AND 3""")
def s1_subset(v):
    """Three bands of three scan lines: no other bytes of band-sequential files are read."""
    rows = cubes.read_cubes(v.spark, written_cubes(v), bands=[12, 3, 4], first_line=1, last_line=3).where(F.exists("spectrum", lambda x: x.isNotNull()))
    return rows.withColumn("spectrum", F.transform("spectrum", lambda x: F.round(x, 9)))


@query("s2_header_metadata", """
    SELECT p_partkey, CAST(p_size AS INTEGER) AS samples, 'bil' AS interleave, p_name AS description, CAST(3 AS INTEGER) AS bands, CAST(p_size + 1000.5 AS DOUBLE) AS first_nm FROM part""")
def s2(v):
    text = F.format_string(
        "ENVI\nsamples = %d\nbands   = 3\ninterleave = bil\ndescription = {%s}\nwavelength = {%s,\n 2000.25,\n 3000.0}\n",
        F.col("p_size").cast("int"), F.col("p_name"), (F.col("p_size") + 1000.5).cast("string"))
    h = F.col("h")
    return v.table("part").withColumn("h", rasters.header_map(text)).select(
        "p_partkey", h["samples"].cast("int").alias("samples"), h["interleave"].alias("interleave"),
        F.regexp_replace(h["description"], "[{}]", "").alias("description"), F.size(rasters.number_list(h["wavelength"])).alias("bands"),
        F.get(rasters.number_list(h["wavelength"]), F.lit(0)).alias("first_nm"))


@query("s3_spectral_library_scan", """
    SELECT label * 1000000 + vec_id // 100 AS source_id, CAST(row_number() OVER p - 1 AS INTEGER) AS source_index,
      CASE WHEN label % 2 = 0 THEN 'vec' || vec_id ELSE 'Spectrum ' || row_number() OVER p END AS raw_name, round(list_sum(spectrum), 6) AS total
    FROM pixels WINDOW p AS (PARTITION BY label, vec_id // 100 ORDER BY vec_id)""")
def s3(v):
    """Binary library files of at most a hundred spectra each, written and read back."""
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "spectrum")))
    source = F.col("label") * 1000000 + F.floor(F.col("vec_id") / 100)
    packed = v.pixels.groupBy(source.alias("source_id"), "label").agg(rows.alias("r")).select(
        "source_id", F.when(F.col("label") % 2 == 0, F.transform("r", lambda x: F.concat(F.lit("vec"), x["vec_id"].cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("names"),
        A.literal_doubles(AXIS).alias("wavelengths"), F.transform("r", lambda x: x["spectrum"]).alias("spectra"))
    folder = scratch_folder(v.spark, "libraries")
    cubes.write_libraries(packed, folder).agg(F.count("file")).collect()
    rows = cubes.read_libraries(v.spark, folder).withColumn("source_id", F.col("source_id").cast("long"))
    return rows.select("source_id", "source_index", "raw_name", F.round(A.total(F.col("values")), 6).alias("total"))


@query("s4_ascii_spectrum_scan", """
    SELECT p_partkey, CASE WHEN p_size > 1 THEN p_name END AS label, CASE WHEN p_size > 1 THEN 3 END AS points, CASE WHEN p_size > 1 THEN 1000.0 + p_size END::DOUBLE AS first_nm FROM part""")
def s4(v):
    size = F.col("p_size").cast("int")
    text = F.format_string("Spectra file\nColumn 1: Wavelength\nColumn 2: %s\n  %d.0  0.5\n  1200.5  1.5e-1\n %d 0.75\n",
                           F.col("p_name"), size + 1000, F.when(size > 1, 1300 + size).otherwise(1))
    return v.table("part").withColumn("s", rasters.ascii_spectrum(text)).select(
        "p_partkey", "s.label", F.when(F.col("s").isNotNull(), F.size("s.wavelengths")).alias("points"), F.get("s.wavelengths", F.lit(0)).alias("first_nm"))


@query("s5_wavelength_unit_repair", """
    SELECT p_partkey, round(CASE WHEN (p_partkey % 2 = 0 AND p_size * 3.0 <= 100) OR p_size * 3.0 <= 20 THEN p_size * 3.0 * 1000 ELSE p_size * 3.0 END::DOUBLE, 6) AS top_nm,
      p_partkey % 2 = 0 AND p_size * 3.0 > 100 AS warned FROM part""")
def s5(v):
    unit = F.when(F.col("p_partkey") % 2 == 0, "Micrometers").otherwise("Unknown")
    w = F.array(F.col("p_size") * 1.0, F.col("p_size") * 2.0, F.col("p_size") * 3.0)
    top = F.array_max(S.wavelengths_nm(w, unit))
    return v.table("part").select("p_partkey", F.round(top, 6).alias("top_nm"), (unit.contains("Micro") & (F.array_max(w) > 100)).alias("warned"))


@query("s6_class_map_sink", f"""
    WITH {POLICY_SQL}, lg AS (SELECT scene_id, line, sample, policy, class_id FROM (UNPIVOT nst ON conservative, balanced, sensitive INTO NAME policy VALUE class_id) WHERE class_id > 0),
    al AS (SELECT scene_id, policy, class_id FROM lg UNION ALL SELECT scene_id, policy, 4 FROM (SELECT scene_id, line, sample FROM cells WHERE line % 60 >= 40) JOIN (SELECT DISTINCT scene_id, policy FROM lg) USING (scene_id)),
    cs(class_id, class_name, red, green, blue) AS (VALUES (1, 'class 1', 242, 61, 61), (2, 'class 2', 61, 242, 61), (3, 'class 3', 61, 61, 242), (4, 'masked', 96, 96, 96))
    SELECT scene_id, policy, class_id, class_name, red, green, blue, count(*) AS pixels FROM al JOIN cs USING (class_id) GROUP BY ALL""")
def s6(v):
    from ..operators import maps

    folder = scratch_folder(v.spark, "maps")
    outside = v.cells.where("line % 60 >= 40")
    sinks.write_class_maps(maps.unpivot_policies(maps.enforce_nesting(policy_maps(v), KEY), KEY), folder, outside, 3)
    classes = sinks.class_table(v.spark, [f"class {i}" for i in range(1, 4)])
    return sinks.read_class_maps(v.spark, folder, classes).groupBy("scene_id", "policy", "class_id", "class_name", "red", "green", "blue").agg(F.count(F.lit(1)).alias("pixels"))


@query("s7_crop_georeference", """
    SELECT s_suppkey, round(s_acctbal + 10 * 0.5, 6) AS map_x, round(1000 - s_nationkey * 0.25, 6)::DOUBLE AS map_y FROM supplier""")
def s7(v):
    moved = rasters.moved_tie_point(F.col("s_acctbal"), F.lit(1000.0), F.lit(0.5), F.lit(0.25), F.lit(10), F.col("s_nationkey"))
    return v.table("supplier").select("s_suppkey", moved.alias("m")).select("s_suppkey", F.round("m.map_x", 6).alias("map_x"), F.round("m.map_y", 6).alias("map_y"))


@query("s8_library_sink", """
    WITH p AS (SELECT *, list_filter(values, lambda x: x IS NOT NULL) AS have FROM measurements),
    r AS (SELECT *, list_filter([CASE WHEN len(have) <> len(values) THEN 'non_finite_values' END,
        CASE WHEN len(list_filter(have, lambda x: x > 0 AND x < 1e6)) < 2 THEN 'fewer_than_two_positive_values' END,
        CASE WHEN list_max(have) - list_min(have) <= 1e-8 THEN 'constant_curve' END], lambda x: x IS NOT NULL) AS hard,
      list_filter([CASE WHEN list_contains(have, 0) THEN 'contains_zero_values' END, CASE WHEN list_min(have) < 0 THEN 'contains_negative_values' END], lambda x: x IS NOT NULL) AS soft FROM p),
    s AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'invalid' WHEN len(soft) > 0 THEN 'review' ELSE 'pass' END AS status FROM r),
    n AS (SELECT source_id, string_agg(reason || ':' || c, ',' ORDER BY reason) AS reasons FROM
      (SELECT source_id, reason, count(*) AS c FROM (SELECT source_id, unnest(list_concat(hard, soft)) AS reason FROM s) GROUP BY ALL) GROUP BY source_id)
    SELECT source_id, count(*) AS candidates, count(*) FILTER (status = 'pass') AS selected, any_value(reasons) AS reasons,
      round(sum(list_sum(values)) FILTER (status = 'pass'), 6) AS total FROM s LEFT JOIN n USING (source_id) GROUP BY source_id""")
def s8(v):
    """All measurements with their reasons as an audit, and the spectra that pass."""
    from ..operators import library as L

    folder = scratch_folder(v.spark, "library")
    judged = v.measurements.withColumn("q", L.numeric_qc(F.col("values"))).select(
        "measurement_id", "source_id", "raw_name", "phase", "values", F.col("q.status").alias("status"), F.col("q.reasons").alias("reasons"))
    sinks.write_candidates(judged, folder, judged.where("status = 'pass'"))
    audit = v.spark.read.schema("measurement_id long, source_id string, status string, reasons array<string>").json(f"{folder}/audit")
    spectra = v.spark.read.parquet(f"{folder}/selected").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("selected"), F.round(F.sum(A.total(F.col("values"))), 6).alias("total"))
    counts = audit.select("source_id", F.explode("reasons").alias("reason")).groupBy("source_id", "reason").count().groupBy("source_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", "count"))), ",").alias("reasons"))
    counted = audit.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidates"))
    return counted.join(spectra, "source_id", "left").join(counts, "source_id", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


@query("s9_count_table_report", """
    SELECT scene_id, class_id, count(*) AS pixels, '{"scene_id":"' || scene_id || '","class_id":' || class_id || ',"pixels":' || count(*) || '}' AS report FROM candidate GROUP BY scene_id, class_id""")
def s9(v):
    folder = scratch_folder(v.spark, "counts")
    counts = v.candidate.groupBy("scene_id", "class_id").agg(F.count(F.lit(1)).alias("pixels"))
    sinks.write_counts(counts, folder)
    back = v.spark.read.schema("scene_id string, class_id int, pixels long").option("header", True).csv(folder)
    return back.withColumn("report", F.to_json(F.struct("scene_id", "class_id", "pixels")))


@query("s10_input_fingerprints")
def s10(v):
    files = sinks.fingerprints(v.spark, v.spark.createDataFrame([(v.folder,)], "path string"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256", "error")


@query("s10_written_file_digests", """
    SELECT part_no || '.txt' AS file, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256
    FROM (SELECT p_partkey % 7 AS part_no, string_agg(p_name, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY 1)""")
def s10_written(v):
    """Digests of files written from a table, whose contents SQL knows."""
    folder = scratch_folder(v.spark, "files")
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    bodies = v.table("part").groupBy((F.col("p_partkey") % 7).alias("part_no")).agg(F.array_join(F.transform(rows, lambda r: r["p_name"]), "\n").alias("body"))
    paths = sinks.write_texts(bodies.select(F.concat(F.lit(f"{folder}/"), "part_no", F.lit(".txt")).alias("path"), "body"))
    return sinks.fingerprints(v.spark, paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("s11_mask_derivation", """
    SELECT scene_id, line, sample, (vec_id % 3 <> 0) OR (vec_id % 3 = 0 AND vec_id % 2 = 0) AS material FROM pixels""")
def s11(v):
    keep = F.col("vec_id") % 3 != 0
    planes = F.array(F.when(keep, F.col("spectrum")[0]).otherwise(0.0), F.when(keep, F.col("spectrum")[31]).otherwise(float("nan")),
                     F.when(keep | (F.col("vec_id") % 2 == 0), F.col("spectrum")[63]).otherwise(1e-12))
    return v.pixels.select(*KEY, S.is_material(planes).alias("material"))


# --- sensor quality --------------------------------------------------------

BAND_SQL = """bm AS (SELECT scene_id, band, median(v) AS m, avg(CASE WHEN vec_id % 97 <> band THEN 1.0::DOUBLE ELSE 0 END) AS finite FROM (SELECT scene_id, band, vec_id, CASE WHEN vec_id % 97 <> band THEN v END AS v FROM px) GROUP BY ALL),
    nz AS (SELECT p.scene_id, p.band, 1.4826::DOUBLE * median(abs(v - m)) AS noise FROM (SELECT * FROM px WHERE vec_id % 97 <> band) p JOIN bm USING (scene_id, band) GROUP BY ALL),
    sm AS (SELECT *, m - CASE WHEN lag(m) OVER w IS NULL OR lead(m) OVER w IS NULL THEN m ELSE (lag(m) OVER w + 2 * m + lead(m) OVER w) / 4 END AS res FROM bm WINDOW w AS (PARTITION BY scene_id ORDER BY band)),
    sn AS (SELECT scene_id, median(abs(m)) / (1.4826::DOUBLE * median(abs(res - c))) AS snr FROM (SELECT *, median(res) OVER (PARTITION BY scene_id) AS c FROM sm) GROUP BY scene_id),
    nl AS (SELECT scene_id, median(noise) + 6 * median(abs(noise - c)) AS lim FROM (SELECT *, median(noise) OVER (PARTITION BY scene_id) AS c FROM nz) GROUP BY scene_id)"""


@query("a10_sensor_quality", f"""
    WITH {BAND_SQL} SELECT scene_id, round(any_value(snr), 5) AS snr, count(*) FILTER (WHERE finite < 0.98 OR noise > lim) AS bad_bands, count(*) AS bands
    FROM bm JOIN nz USING (scene_id, band) JOIN sn USING (scene_id) JOIN nl USING (scene_id) GROUP BY scene_id""")
def a10(v):
    from ..operators.sensor import sensor_quality

    holed = v.pixels.withColumn("spectrum", F.transform("spectrum", lambda x, band: F.when(F.col("vec_id") % 97 != band, x)))
    return sensor_quality(holed).select("scene_id", F.round("snr", 5).alias("snr"), "bad_bands", "bands")


VARIANTS = [("full", 0, 64), ("short", 0, 40), ("long", 20, 64), ("core", 12, 52)]


@query("a20_rule_error_ranking", """
    WITH r AS (SELECT ref_id, spectrum AS ref FROM refs),
    v(variant, a, b) AS (VALUES ('full', 1, 64), ('short', 1, 40), ('long', 21, 64), ('core', 13, 52)),
    t AS (SELECT scene_id, variant, vec_id, ref_id, acos(greatest(-1, least(1, list_dot_product(spectrum[a:b], ref[a:b]) / (sqrt(list_dot_product(spectrum[a:b], spectrum[a:b])) * sqrt(list_dot_product(ref[a:b], ref[a:b])))))) AS x FROM pixels, r, v),
    f AS (SELECT scene_id, vec_id, ref_id, x AS truth FROM t WHERE variant = 'full')
    SELECT scene_id, ref_id, variant, round(avg(abs(x - truth)), 6) AS mae, round(max(abs(x - truth)), 6) AS worst, round(sqrt(avg((x - truth) ** 2)), 6) AS rmse FROM t JOIN f USING (scene_id, vec_id, ref_id) GROUP BY ALL""")
def a20(v):
    """Which band window reproduces each reference's stored rule image best."""
    rows = library(v)
    ids = F.array(*[F.lit(r["ref_id"]).cast("long") for r in rows])
    columns = v.pixels.select("scene_id", *[
        K.angles_to([r["spectrum"] for r in rows], list(range(a, b)))(F.col("spectrum")).alias(n) for n, a, b in VARIANTS])
    errors = F.transform(ids, lambda k, i: F.struct(k.alias("ref_id"), *[(F.get(F.col(n), i) - F.get(F.col("full"), i)).alias(n) for n, _, _ in VARIANTS]))
    each = columns.select("scene_id", F.inline(errors))
    gaps = each.select("scene_id", "ref_id", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("e")) for n, _, _ in VARIANTS])))
    return gaps.groupBy("scene_id", "ref_id", "variant").agg(
        F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.max(F.abs("e")), 6).alias("worst"), F.round(F.sqrt(F.avg(F.col("e") ** 2)), 6).alias("rmse"))


@query("a22_library_peak_summary", f"""
    WITH e AS (SELECT vec_id, min_by(v, band) AS l, max_by(v, band) AS r FROM px WHERE {IN_WINDOW} GROUP BY vec_id),
    ab AS (SELECT p.*, greatest(1 - p.v / (e.l + (e.r - e.l) * ((p.w - 1360) / 900)), 0) AS a FROM px p JOIN e USING (vec_id) WHERE {IN_WINDOW}),
    pk AS (SELECT *, lag(a) OVER q AS pa, lead(a) OVER q AS na FROM ab WINDOW q AS (PARTITION BY vec_id ORDER BY band))
    SELECT label, CAST(w // 5 * 5 AS INTEGER) AS bin_nm, count(*) AS peaks, round(median(a), 6) AS depth FROM pk WHERE a >= 0.004 AND a > pa AND a >= na GROUP BY ALL""")
def a22(v):
    from ..operators.sensor import absorption_peaks

    peaks = absorption_peaks(absorbed(v), "curve", SUB_AXIS, 0.004, 18.0).select(
        "label", (F.floor(F.col("nm") / 5) * 5).cast("int").alias("bin_nm"), "depth")
    counts = peaks.groupBy("label", "bin_nm").agg(F.count(F.lit(1)).alias("peaks"))
    middle = exact_quantiles(peaks, ["label", "bin_nm"], "depth", [0.5]).select("label", "bin_nm", F.round("q0", 6).alias("depth"))
    return counts.join(middle, ["label", "bin_nm"])


# --- masks -----------------------------------------------------------------

def cube(v):
    """Pixels in which two blocks of samples are brighter than the border."""
    inside = F.col("sample").between(4, 9) | F.col("sample").between(14, 20)
    return v.pixels.withColumn("spectrum", F.when(inside & F.col("line").between(2, 900) & (F.col("line") % 20 > 1), F.transform("spectrum", lambda x: x + 2.0)).otherwise(F.col("spectrum")))


@query("m16_automatic_material_mask")
def m16(v):
    raw = masks.automatic_mask(cube(v), v.pixel_frames, SPREAD)
    audit = masks.mask_audit(masks.clean_mask(raw, v.pixel_frames), v.pixel_frames, minimum_pixels=16)
    return audit.select("scene_id", "status", "raw_pixels", "pixels", "components", "kept_components", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("flags"))


@query("w13_radiometric_stability", """
    WITH a AS (SELECT c.scene_id, c.line, c.sample, count(*) AS n, sum(b.score) AS s, sum(b.score * b.score) AS q FROM cells c JOIN cells b ON b.scene_id = c.scene_id
      AND b.line BETWEEN c.line - 2 AND c.line + 2 AND b.sample BETWEEN c.sample - 2 AND c.sample + 2 GROUP BY ALL),
    e AS (SELECT d, exp(-0.5::DOUBLE * d * d) AS r FROM range(-4, 5) t(d)), w AS (SELECT d, r / sum(r) OVER () AS smooth, -d * r / sum(r) OVER () AS slope FROM e),
    i AS (SELECT scene_id, line, ln(greatest(score, 1e-6)) AS g, lines, samples, unnest([sample, -sample - 1, 2 * samples - 1 - sample]) AS im FROM cells JOIN frames USING (scene_id)),
    f AS (SELECT scene_id, line, im + d AS sample, any_value(lines) AS lines, sum(g * smooth) AS gs, sum(g * slope) AS gd FROM i, w WHERE im + d >= 0 AND im + d < samples GROUP BY scene_id, line, im + d),
    k AS (SELECT scene_id, sample, gs, gd, lines, unnest([line, -line - 1, 2 * lines - 1 - line]) AS im FROM f),
    g AS (SELECT scene_id, im + d AS line, sample, sqrt(sum(gs * slope) ** 2 + sum(gd * smooth) ** 2) AS gradient FROM k, w WHERE im + d >= 0 AND im + d < lines GROUP BY scene_id, im + d, sample),
    m AS (SELECT a.*, n / 25.0::DOUBLE AS support, sqrt(greatest(q / n - (s / n) ** 2, 0)) / greatest(s / n, 1e-6) AS cv, gradient FROM a JOIN g USING (scene_id, line, sample))
    SELECT scene_id, line, sample, round(support, 6) AS support, round(cv, 6) AS cv, round(gradient, 6) AS gradient, support >= 0.8 AND cv <= 0.3 AND gradient <= 0.25 AS stable FROM m""")
def w13(v):
    out = masks.radiometric_stability(v.cells.select(*KEY, F.col("score").alias("level")), v.frames)
    return out.select(*KEY, F.round("support", 6).alias("support"), F.round("cv", 6).alias("cv"), F.round("gradient", 6).alias("gradient"), "stable")


COVER_SQL = """cf AS (SELECT f.scene_id, l AS line, lines, count(d.sample) / any_value(samples)::DOUBLE AS share FROM frames f JOIN range(0, 1000) r(l) ON l < lines
      LEFT JOIN (SELECT * FROM cells WHERE line NOT BETWEEN 300 AND 430) d ON d.scene_id = f.scene_id AND d.line = l GROUP BY ALL),
    cb AS (SELECT scene_id, s AS scale, line // s AS block, any_value(lines) AS lines, avg(share) AS observed, avg(CASE WHEN share >= 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS active,
      coalesce(median(share) FILTER (share >= 0.05), 0) AS active_median FROM cf, (VALUES (64), (128)) k(s) GROUP BY ALL),
    cn AS (SELECT a.*, median(b.observed) AS expected, quantile_cont(b.observed, 0.75) - quantile_cont(b.observed, 0.25) AS iqr, max(CASE WHEN b.block < a.block THEN b.observed END) AS lm, max(CASE WHEN b.block > a.block THEN b.observed END) AS rm,
      list(b.observed) AS obs FROM cb a JOIN cb b ON a.scene_id = b.scene_id AND a.scale = b.scale AND b.block BETWEEN a.block - 3 AND a.block + 3 AND b.block <> a.block GROUP BY ALL),
    cz AS (SELECT *, least(greatest(1.4826::DOUBLE * list_aggregate(list_transform(obs, lambda x: abs(x - expected)), 'median'), iqr / 1.349, 0.025), greatest(0.025, expected * 0.15)) AS sc FROM cn),
    cj AS (SELECT *, CAST(scale AS INTEGER) AS sz, CAST(block * scale AS INTEGER) AS start, CAST(least((block + 1) * scale, lines) AS INTEGER) AS stop, coalesce(lm >= 0.2, FALSE) AND coalesce(rm >= 0.2, FALSE) AS sided,
      coalesce(lm >= 0.2 AND rm >= 0.2 AND expected >= 0.2 AND expected - observed >= 0.12 AND observed / expected <= 0.55 AND (expected - observed) / sc >= 2.5, FALSE) AS anomaly FROM cz)"""


@query("w14_depth_coverage", f"""
    WITH {COVER_SQL} SELECT scene_id, sz AS scale, start, stop, round(observed, 7) AS observed, round(active, 7) AS active, round(expected, 7) AS expected, anomaly,
      CASE WHEN anomaly THEN 'warning' WHEN NOT sided AND observed < 0.2 THEN 'info' ELSE 'normal' END AS severity FROM cj""")
def w14(v):
    out = masks.depth_coverage(v.cells.where("line not between 300 and 430"), v.frames, (64, 128))
    return out.select("scene_id", "scale", "start", "stop", *[F.round(c, 7).alias(c) for c in ("observed", "active", "expected")], "anomaly", "severity")


REGION_SQL = """ci AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY scene_id ORDER BY start, scale ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cj WHERE anomaly),
    cg AS (SELECT *, sum(fresh) OVER (PARTITION BY scene_id ORDER BY start, scale) AS island FROM ci),
    cr AS (SELECT scene_id, min(start) AS start, max(stop) AS stop, CASE WHEN count(DISTINCT scale) >= 2 THEN 'critical' WHEN max(active_median) >= 0.75 * max(expected) THEN 'info' ELSE 'review' END AS severity FROM cg GROUP BY scene_id, island)"""


@query("w14_coverage_regions", f"WITH {COVER_SQL}, {REGION_SQL} SELECT * FROM cr")
def w14_regions(v):
    blocks = masks.depth_coverage(v.cells.where("line not between 300 and 430"), v.frames, (64, 128))
    return masks.coverage_regions(blocks).select("scene_id", "start", "stop", "severity")


@query("q10_depth_coverage_gate", f"""
    WITH {COVER_SQL}, {REGION_SQL} SELECT scene_id, CASE WHEN coalesce(bool_or(severity = 'critical'), FALSE) THEN 'blocked' WHEN coalesce(bool_or(severity = 'review'), FALSE) THEN 'review' ELSE 'passed' END AS status
    FROM frames LEFT JOIN cr USING (scene_id) GROUP BY scene_id""")
def q10(v):
    blocks = masks.depth_coverage(v.cells.where("line not between 300 and 430"), v.frames, (64, 128))
    return masks.coverage_gate(masks.coverage_regions(blocks), v.frames)


@query("u6_hybrid_mask", f"""
    WITH RECURSIVE base AS (SELECT scene_id, line, sample FROM cells WHERE score <= 0.05), sure AS (SELECT scene_id, line, sample FROM cells WHERE depth >= 0.9),
    un AS (SELECT * FROM base UNION SELECT s.* FROM sure s SEMI JOIN base b ON b.scene_id = s.scene_id AND b.line BETWEEN s.line - 2 AND s.line + 2 AND b.sample BETWEEN s.sample - 2 AND s.sample + 2),
    {gaps_sql('un')}, {reach_sql('gp', 'gaps', 4)},
    filled AS (SELECT * FROM un UNION ALL SELECT gp.scene_id, line, sample FROM gp JOIN frames USING (scene_id) WHERE size <= 4 AND lo > 0 AND left_ > 0 AND hi < lines - 1 AND right_ < samples - 1),
    {reach_sql('fl', 'filled', 4)}
    SELECT scene_id, CAST((b.line IS NOT NULL)::INTEGER + 2 * (s.line IS NOT NULL)::INTEGER AS INTEGER) AS agreement, count(*) AS pixels
    FROM fl LEFT JOIN base b USING (scene_id, line, sample) LEFT JOIN sure s USING (scene_id, line, sample) WHERE size >= 4 GROUP BY ALL""")
def u6(v):
    base = v.cells.where("score <= 0.05").select(*KEY)
    out = masks.hybrid_mask(base, v.cells.select(*KEY, F.col("depth").alias("probability")), v.frames, hole=4, component=4)
    return out.groupBy("scene_id", "agreement").agg(F.count(F.lit(1)).alias("pixels"))


@query("m17_vnir_anomaly_map")
def m17(v):
    from ..session import collect_bounded

    feature = v.refs.select(S.narrow_absorption(F.col("spectrum"), BANDS).alias("f"), "mineral", "ref_id").where("f is not null")
    refs = [r["f"] for r in sorted(collect_bounded(feature, 20_000, "the reference library"), key=lambda r: r["ref_id"])]
    ladder = {p: {"maximum_angle": a, "minimum_strength": 0.001, "maximum_strength": 5.0}
              for p, a in (("conservative", 1.1), ("balanced", 1.25), ("sensitive", 1.4))}
    return masks.vnir_anomalies(v.pixels, refs, BANDS, ladder).groupBy("scene_id", "policy").agg(F.count(F.lit(1)).alias("pixels"))


# --- catalog and flags -----------------------------------------------------

@query("f7_catalog_validation", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'unknown_group' ELSE '' END || CASE WHEN p_size % 5 = 4 THEN ',bad_percentile' ELSE '' END AS problems FROM part""")
def f7(v):
    """Catalog documents built from part rows, parsed and checked."""
    group = F.when(F.col("p_size") % 4 == 3, "missing").otherwise("clays")
    percentile = F.when(F.col("p_size") % 5 == 4, 0.9).otherwise(0.08)
    document = F.format_string(
        '{"experts":[{"id":"swir","implemented":true}],"groups":[{"id":"clays","expert":"swir","policies":[{"policy":"balanced","column_percentile":%s}]}],"minerals":[{"id":"%s","group":"%s"}]}',
        percentile.cast("string"), F.col("p_brand"), group)
    return v.table("part").withColumn("c", catalog.parse(document)).select(
        "p_partkey", F.when(F.size(catalog.problems(F.col("c"))) == 0, "").otherwise(
            F.concat(F.when(F.array_contains(catalog.problems(F.col("c")), "unknown_group"), "unknown_group").otherwise(""),
                     F.when(F.array_contains(catalog.problems(F.col("c")), "bad_percentile"), ",bad_percentile").otherwise(""))).alias("problems"))


@query("f10_flags_to_issues", """
    WITH p AS (SELECT scene_id, sample, count(*) AS nv, count(*) FILTER (WHERE score <= 0.03) / count(*)::DOUBLE AS d FROM cells GROUP BY ALL)
    SELECT scene_id, sample, concat_ws(',', CASE WHEN d > 0.32 THEN 'FIXED_COLUMN_RESIDUAL' END, CASE WHEN nv < 595 THEN 'MASK_TOO_SMALL' END, CASE WHEN d < 0.29 THEN 'ZERO_DETECTION' END) AS codes,
      CASE WHEN nv < 595 THEN 'D' WHEN d > 0.32 THEN 'C' WHEN d < 0.29 THEN 'B' ELSE 'A' END AS grade FROM p""")
def f10(v):
    rows = v.cells.groupBy("scene_id", "sample").agg(F.count(F.lit(1)).alias("nv"), F.avg((F.col("score") <= 0.03).cast("double")).alias("d"))
    issues = quality.flags({
        "FIXED_COLUMN_RESIDUAL": (F.col("d") > 0.32, "warning"), "MASK_TOO_SMALL": (F.col("nv") < 595, "error"), "ZERO_DETECTION": (F.col("d") < 0.29, "warning")})
    return rows.withColumn("i", issues).select("scene_id", "sample", F.array_join(F.transform("i", lambda x: x["code"]), ",").alias("codes"), quality.grade(F.col("i")).alias("grade"))


# --- streams ---------------------------------------------------------------

@query("t1_line_block_stream", """
    SELECT vec_id, round(acos(greatest(-1, least(1, list_sum(spectrum) / (sqrt(list_dot_product(spectrum, spectrum)) * 8)))), 6) AS angle FROM pixels""")
def t1(v):
    """New line blocks scored as they arrive equal the batch result."""
    schema = v.table("embeddings").schema
    stream = lines.read_stream(v.spark, v.folder, "embeddings.parquet", schema)
    flat = K.angles_to([[1.0] * BANDS])

    def score(df):
        spectrum = F.transform("embedding", lambda x: x.cast("double") + 1.0)
        return df.select("vec_id", F.round(F.get(flat(spectrum), F.lit(0)), 6).alias("angle"))

    target, state = scratch_folder(v.spark, "stream"), scratch_folder(v.spark, "state")
    lines.score_lines(stream, score, target, state)
    return v.spark.read.schema("vec_id long, angle double").parquet(target)


@query("t2_running_column_density", """
    SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(user_id % 32 AS INTEGER) AS sample, count(*) AS events, CAST(count(*) FILTER (WHERE value <= 20) AS BIGINT) AS hits,
      round(count(*) FILTER (WHERE value <= 20) / count(*)::DOUBLE, 8) AS density FROM events GROUP BY ALL)
    WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def t2(v):
    """Windows that the watermark has closed."""
    zone = F.current_timezone()  # days are those of the stored clock, in any session time zone
    stream = lines.read_stream(v.spark, v.folder, "events.parquet", v.table("events").schema).withColumns({
        "ts": F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone), "sample": (F.col("user_id") % 32).cast("int")})
    target, state = scratch_folder(v.spark, "density"), scratch_folder(v.spark, "state")
    lines.append_closed(lines.running_density(stream, "ts", "sample", 20.0), target, state)
    return v.spark.read.parquet(target).withColumns({"start": F.to_utc_timestamp("start", zone).cast("timestamp_ntz"), "density": F.round("density", 8)})
