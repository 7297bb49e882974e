"""Sensor quality and absorption peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from .profiles import band_medians


def sensor_quality(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Signal-to-noise and bad bands per scene.

    A band is bad when under 98 % of its values are present or its noise stands
    out.  The spectra are read once for the medians and once for the noise
    around them; what is exchanged are counts and one row per scene and band.
    """
    keys = ["scene_id", "band"]
    middle = band_medians(pixels, ["scene_id"], spectrum)
    size = pixels.groupBy("scene_id").agg(F.count(spectrum).alias("pixels"), F.max(F.size(spectrum)).alias("bands"))
    profile = middle.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("_m"))
    around = pixels.select("scene_id", spectrum).join(profile, "scene_id").select("scene_id", F.transform(
        spectrum, lambda v, b: F.abs(v - F.try_element_at(F.col("_m"), b))).alias("d"))
    noise = band_medians(around, ["scene_id"], "d").select(*keys, (1.4826 * F.col("m")).alias("noise"))
    every = size.select("scene_id", "pixels", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    share = every.join(middle, keys, "left").select(*keys, (F.coalesce("n", F.lit(0)) / F.col("pixels")).alias("finite"))
    middle = middle.drop("n")
    rows = share.join(middle, keys, "left").join(noise, keys, "left")
    packed = rows.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("band", "m", "noise", "finite"))).alias("b")).select(
        "scene_id", "b", F.transform("b", lambda x: x["m"]).alias("m"), F.transform("b", lambda x: x["noise"]).alias("noise"))
    n = F.size("m")
    residual = F.transform("m", lambda x, i: F.when(
        (i == 0) | (i == n - 1), F.lit(0.0)).otherwise(x - (F.get("m", i - 1) + 2.0 * x + F.get("m", i + 1)) / 4.0))

    def mad(values):
        return A.let(values, lambda v: A.let(A.median(v), lambda c: A.median(F.transform(v, lambda x: F.abs(x - c)))))

    limit = A.median(F.col("noise")) + 6.0 * mad(F.col("noise"))
    scored = packed.withColumns({"_noise": 1.4826 * mad(residual), "_limit": limit})
    bad = F.filter("b", lambda x: (x["finite"] < 0.98) | x["m"].isNull() | (x["noise"] > F.col("_limit")))
    return scored.select(
        "scene_id", F.when(F.col("_noise") > 1e-12, A.median(F.transform("m", F.abs)) / F.col("_noise")).alias("snr"),
        F.size(bad).cast("long").alias("bad_bands"), F.size("b").cast("long").alias("bands"),
        F.transform(bad, lambda x: x["band"]).alias("bad"))


def absorption_peaks(df: DataFrame, curve: str, axis: Sequence[float], minimum: float, separation: float) -> DataFrame:
    """Local maxima of an absorption curve, deepest first, kept ``separation`` nm apart."""
    grid = A.literal_doubles(axis)
    n = len(axis)

    def found(c):
        marked = F.transform(c, lambda x, i: F.struct(x.alias("depth"), F.get(grid, i).alias("nm"), (
            (i > 0) & (i < n - 1) & (x >= minimum) & (x > F.get(c, i - 1)) & (x >= F.get(c, i + 1))).alias("peak")))
        return F.sort_array(F.filter(marked, lambda p: F.coalesce(p["peak"], F.lit(False))), asc=False)

    thinned = A.let(found(F.col(curve)), lambda p: F.aggregate(
        p, F.filter(p, lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["nm"] - x["nm"]) < separation), acc).otherwise(F.concat(acc, F.array(x)))))
    return df.withColumn("_p", F.explode(thinned)).withColumns({"nm": F.col("_p.nm"), "depth": F.col("_p.depth")}).drop("_p")
