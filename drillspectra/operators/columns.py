"""Detector-column statistics.

A column of a long scan can hold a large share of all pixels, so per-column
quantiles go through ``exact_quantiles``; what remains afterwards is one row
per (scene, column, band) and is small by the width of the detector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays as A
from ..session import durable
from .profiles import band_medians
from .quantiles import exact_quantiles


def dense(df: DataFrame, keys: Sequence[str], values: Sequence[str], frames: DataFrame) -> DataFrame:
    """One row per key with a value array per detector column (0 .. samples-1).

    The arrays are as long as the detector is wide; absent columns are NULL.
    """
    keys = list(keys)
    entries = F.map_from_entries(F.collect_list(F.struct("sample", F.struct(*values))))
    packed = df.groupBy(*keys).agg(entries.alias("_m")).join(frames, "scene_id")
    columns = F.sequence(F.lit(0), F.col("samples") - 1)

    def array_of(name: str) -> Column:
        return F.transform(columns, lambda s: F.try_element_at(F.col("_m"), s.cast("int"))[name])

    return packed.select(*keys, "lines", "samples", *[array_of(v).alias(v) for v in values])


def column_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Back to one row per column."""
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    return df.select(*keys, F.posexplode(zipped).alias("sample", "_z")).select(
        *keys, "sample", *[F.col(f"_z.{v}").alias(v) for v in values]
    )


def neighbour_median(
    profile: Column, radius: int, left_guard: int, right_guard: int, empty: Column
) -> Column:
    """Median of ``[c-radius, c-left_guard)`` and ``[c+right_guard, c+radius]`` per column."""

    def around(p: Column) -> Column:
        n = F.size(p)

        def at(c: Column) -> Column:
            lo = F.greatest(c - radius, F.lit(0))
            left = F.slice(p, lo + 1, F.greatest(F.greatest(c - left_guard, F.lit(0)) - lo, F.lit(0)))
            first = F.least(c + right_guard, n)
            right = F.slice(p, first + 1, F.greatest(F.least(c + radius + 1, n) - first, F.lit(0)))
            return F.coalesce(A.median(F.concat(left, right)), empty)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return A.let(profile, around)


def edge_median(profile: Column, radius: int) -> Column:
    """Median over +-radius columns with the border value repeated."""

    def around(p: Column) -> Column:
        n = F.size(p)
        taps = [F.lit(k) for k in range(-radius, radius + 1)]
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda c: A.median(F.array(*[
                F.get(p, F.least(F.greatest(c + k, F.lit(0)), n - 1)) for k in taps])),
        )

    return A.let(profile, around)


def shrinking_median(profile: Column, radius: int) -> Column:
    """Median over the columns that exist within +-radius."""
    return A.let(profile, lambda p: F.transform(
        F.sequence(F.lit(0), F.size(p) - 1),
        lambda c: A.median(F.slice(
            p, F.greatest(c - radius, F.lit(0)) + 1,
            F.least(c + radius + 1, F.size(p)) - F.greatest(c - radius, F.lit(0)))),
    ))


def fill_linear(profile: Column) -> Column:
    """NULL columns interpolated between the nearest present ones, flat at the ends."""

    def fill(p: Column) -> Column:
        n = F.size(p)

        def at(c: Column) -> Column:
            before = F.array_max(F.filter(F.sequence(F.lit(0), c), lambda i: F.get(p, i).isNotNull()))
            after = F.array_min(F.filter(F.sequence(c, n - 1), lambda i: F.get(p, i).isNotNull()))

            def between(ends: Column) -> Column:
                left, right = F.get(p, ends["a"]), F.get(p, ends["b"])
                return F.coalesce(left + (right - left) * (c - ends["a"]) / (ends["b"] - ends["a"]), left, right)

            return F.when(F.get(p, c).isNotNull(), F.get(p, c)).otherwise(
                A.let(F.struct(before.alias("a"), after.alias("b")), between)
            )

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return A.let(profile, fill)


def column_thresholds(
    scores: DataFrame, frames: DataFrame, fractions: Sequence[float], keys: Sequence[str] = ("scene_id",),
    minimum: int = 20, radius: int = 2, fallback: str = "interpolate", value: str = "score",
    scene_fractions: Sequence[float] | None = None, whole_scene: bool = True,
) -> DataFrame:
    """Smoothed percentile threshold of every detector column.

    Returns ``keys, sample, n, t0, t1, ...`` plus the scene-wide ``s0, s1, ...``.
    Columns with fewer than ``minimum`` scores take the neighbours'
    interpolation (or the scene value), and a column median follows.  With
    ``scene_fractions`` the scene-wide values are taken there instead.  With
    ``minimum`` 1 and interpolation no column needs them: without
    ``whole_scene`` they are neither worked out nor returned.

    The scores are read once: key, column and score are stored, unless they come
    from a stored table, and both the column and the scene quantiles come from those.
    """
    if not whole_scene and (minimum > 1 or fallback != "interpolate" or scene_fractions):
        raise ValueError("these thresholds need the values of whole scenes")
    keys = list(keys)
    qs = [f"q{i}" for i in range(len(fractions))]
    narrow = scores.select(*keys, "sample", value)
    if not hasattr(scores, "durable_folder"):
        narrow = durable(narrow)
    own = exact_quantiles(narrow, [*keys, "sample"], value, fractions)
    wanted = [*fractions, *(scene_fractions or fractions)] if whole_scene else list(fractions)
    scene = None if not whole_scene else exact_quantiles(narrow, keys, value, wanted).select(
        *keys, *[F.col(q).alias(q.replace("q", "f")) for q in qs],
        *[F.col(f"q{len(fractions) + i}").alias(f"s{i}") for i in range(len(wanted) - len(fractions))],
    )
    trusted = own.select(
        *keys, "sample", "n", *[F.when(F.col("n") >= minimum, F.col(q)).alias(q) for q in qs]
    )
    packed = dense(trusted, keys, ["n", *qs], frames)
    if whole_scene:
        packed = packed.join(scene, keys)

    def resolve(q: str) -> Column:
        whole = F.transform(F.col(q), lambda x: F.col(q.replace("q", "f"))) if whole_scene else F.col(q)
        none = ~F.exists(F.col(q), lambda x: x.isNotNull())
        if fallback == "interpolate":
            filled = fill_linear(F.col(q))
        else:
            filled = F.transform(F.col(q), lambda x: F.coalesce(x, F.col(q.replace("q", "f"))))
        smoothed = edge_median(filled, radius) if radius else filled
        return F.when(none, whole).otherwise(smoothed)

    ss = [f"s{i}" for i in range(len(wanted) - len(fractions))]
    resolved = packed.select(
        *keys, *ss,
        F.transform("n", lambda x: F.coalesce(x, F.lit(0))).alias("n"),
        *[resolve(q).alias(q.replace("q", "t")) for q in qs],
    )
    ts = [q.replace("q", "t") for q in qs]
    return column_rows(resolved, [*keys, *ss], ["n", *ts])


def column_bias(pixels: DataFrame, frames: DataFrame, spectrum: str = "spectrum", radius: int = 2) -> DataFrame:
    """Detector-column offset per band: column median minus its neighbourhood,
    centred per band; columns without pixels get no offset."""
    medians = band_medians(pixels, ["scene_id", "sample"], spectrum)
    packed = dense(medians, ["scene_id", "band"], ["m"], frames)
    raw = packed.withColumn("d", F.zip_with("m", shrinking_median(F.col("m"), radius), lambda a, b: a - b))
    # bound once: a column named inside a lambda would be worked out again for every element
    centred = raw.withColumn("bias", A.let(F.col("d"), lambda d: A.let(A.median(d), lambda mid: F.transform(
        d, lambda x: F.coalesce(x - mid, F.lit(0.0))))))
    flat = centred.select("scene_id", "band", F.posexplode("bias").alias("sample", "b"))
    return flat.groupBy("scene_id", "sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", "b"))), lambda s: s["b"]).alias("bias")
    )


def density(hits: DataFrame, valid: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Hits, valid pixels and their ratio per column; both sides combine before
    the exchange, so a busy column is one small row."""
    by = [*keys, *extra, "sample"]
    counted = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    exposed = valid.groupBy(*[k for k in by if k in valid.columns]).agg(F.count(F.lit(1)).alias("valid"))
    on = [k for k in by if k in exposed.columns]
    return exposed.join(counted, on, "left").select(
        *[c for c in by if c in on or c in counted.columns], "valid",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        (F.coalesce("hits", F.lit(0)) / F.greatest("valid", F.lit(1))).alias("density"),
    )


def fixed_column_risk(hits: DataFrame, valid: DataFrame, blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """0-1 risk that a column answers because of the detector.

    60 % is how often the column stands out among the sampled blocks, 40 % its
    excess over the columns around it.  ``blocks`` is (scene_id, start, stop).
    """
    numbered = blocks.select("scene_id", F.col("start").alias("_a"), F.col("stop").alias("_b"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return (
            in_blocks(df, numbered).groupBy("scene_id", "_a", "sample").agg(F.count(F.lit(1)).alias(name))
        )

    both = counted(valid, "valid").join(counted(hits, "hits"), ["scene_id", "_a", "sample"], "full_outer")
    share = F.coalesce("hits", F.lit(0)) / F.greatest(F.coalesce("valid", F.lit(0)), F.lit(1))
    packed = dense(both.withColumn("d", share), ["scene_id", "_a"], ["d"], frames).withColumn(
        "d", F.transform("d", lambda x: F.coalesce(x, F.lit(0.0)))
    )
    def deviations(d: Column) -> Column:
        return A.let(A.median(d), lambda mid: A.let(
            1.4826 * A.median(F.transform(d, lambda x: F.abs(x - mid))),
            lambda mad: F.transform(d, lambda x: (x - mid) / F.greatest(mad, F.lit(0.005)))))

    z = packed.withColumn("z", A.let(F.col("d"), deviations))
    # all sampled blocks count, also those without any pixel of a column
    columns = z.select(
        "scene_id", F.posexplode(F.arrays_zip("d", "z")).alias("sample", "p")
    ).groupBy("scene_id", "sample").agg(
        F.avg((F.col("p.z") >= 2.5).cast("double")).alias("repeat"),
        F.percentile(F.col("p.d"), F.lit(0.5)).alias("profile"),
    )
    folded = dense(columns, ["scene_id"], ["repeat", "profile"], frames)
    local = neighbour_median(F.col("profile"), 6, 1, 2, F.lit(None).cast("double"))
    scored = folded.withColumn("local", local).withColumn("whole", A.median(F.col("profile")))
    risk = F.zip_with(
        F.arrays_zip("repeat", "profile"), "local",
        lambda p, l: F.least(F.greatest(
            0.60 * p["repeat"] + 0.40 * F.least(F.greatest(
                (p["profile"] - F.coalesce(l, F.col("whole"))) / 0.10, F.lit(0.0)), F.lit(1.0)),
            F.lit(0.0)), F.lit(1.0)),
    )
    return column_rows(scored.withColumn("risk", risk), ["scene_id"], ["risk"])


def in_blocks(df: DataFrame, blocks: DataFrame, size: int = 256) -> DataFrame:
    """Rows whose line lies in a block ``[_a, _b)``: blocks are cut into line
    bins, so the range join is an equi join plus a filter."""
    binned = blocks.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size)))
    )
    return (
        df.withColumn("_bin", F.floor(F.col("line") / size))
        .join(binned, ["scene_id", "_bin"])
        .where("line >= _a and line < _b")
        .drop("_bin")
    )
