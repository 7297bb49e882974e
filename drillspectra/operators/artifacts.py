"""Detector artifacts: stripes, repeated columns, low-exposure columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import durable
from . import columns, components as CC, grid


def directional_stripes(
    hits: DataFrame, valid: DataFrame, frames: DataFrame, keys: Sequence[str], vertical_window: int = 61,
    min_density: float = 0.15, ratio: float = 1.8, excess: float = 0.04, max_lateral: int = 2,
    radius: int = 6,
) -> DataFrame:
    """Hits in a column peak, dense along the column and thin across it."""
    keys = list(keys)
    packed = columns.dense(columns.density(hits, valid, keys), keys, ["density"], frames).withColumn(
        "density", F.transform("density", lambda x: F.coalesce(x, F.lit(0.0)))
    )
    base = columns.neighbour_median(F.col("density"), radius, 1, 2, F.lit(0.0))
    rows = columns.column_rows(packed.withColumn("base", base), keys, ["density", "base"])
    d, b = F.col("density"), F.col("base")
    peaks = rows.where((d >= min_density) & (d >= b * ratio) & (d >= b + excess)).select(*keys, "sample")
    # one window pass over the exposed cells of peak columns counts both
    exposed = valid.join(peaks, [c for c in [*keys, "sample"] if c in valid.columns or c == "sample"])
    marked = exposed.join(hits.select(*keys, "line", "sample").withColumn("_hit", F.lit(1)), [*keys, "line", "sample"], "left")
    counted = grid.along_lines(
        marked, keys, vertical_window // 2, {"_hits": F.count("_hit"), "_seen": F.count(F.lit(1))}
    ).where("_hit = 1").where(F.col("_hits") / F.col("_seen") >= min_density)
    lateral = grid.across_samples(hits.select(*keys, "line", "sample"), keys, 2, {"_lateral": F.count(F.lit(1))})
    return counted.join(lateral.where(F.col("_lateral") <= max_lateral), [*keys, "line", "sample"]).select(
        *keys, "line", "sample"
    )


# limits per policy (fixed values)
REPEATED = {
    "density": {"conservative": 0.025, "balanced": 0.035, "sensitive": 0.045},
    "ratio": {"conservative": 2.5, "balanced": 2.3, "sensitive": 2.1},
    "excess": {"conservative": 0.020, "balanced": 0.020, "sensitive": 0.025},
    "segments": {"conservative": 2, "balanced": 2, "sensitive": 2},
    "dominance": {"conservative": 0.60, "balanced": 0.55, "sensitive": 0.55},
}


def _bands(columns_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unbroken column runs: ``keys, band, first, last, width``."""
    runs = grid.islands(columns_, keys, "sample", 1)
    return runs.groupBy(*keys, F.col("island").alias("band")).agg(
        F.min("sample").alias("first"), F.max("sample").alias("last"),
        (F.max("sample") - F.min("sample") + 1).alias("width"), F.array_sort(F.collect_set("sample")).alias("columns"),
    )


def _supported_lines(hits: DataFrame, bands: DataFrame, keys: Sequence[str], radius: int, rows: int, both: bool) -> DataFrame:
    """Lines on which a band has hits beside it, spread by ``rows`` lines.

    The columns beside a band are listed, so this is an equi join on the
    column; the band table is as small as the detector is wide.
    """
    keys = list(keys)
    left = F.when(F.col("first") > 0, F.sequence(F.greatest(F.col("first") - radius, F.lit(0)), F.col("first") - 1))
    none = F.array().cast("array<int>")
    beside = F.concat(
        F.transform(F.coalesce(left, none), lambda s: F.struct(s.alias("sample"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.col("last") + 1, F.col("last") + radius), lambda s: F.struct(s.alias("sample"), F.lit(1).alias("side"))),
    )
    listed = bands.select(*keys, "band", F.inline(beside))
    around = hits.select(*keys, "line", "sample").join(listed, [*keys, "sample"]).select(
        *keys, "band", "side", F.explode(F.sequence(F.col("line") - rows, F.col("line") + rows)).alias("line"))
    sides = around.groupBy(*keys, "band", "line").agg(F.min("side").alias("_a"), F.max("side").alias("_b"))
    return (sides.where("_a <> _b") if both else sides).select(*keys, "band", "line")


def _unsupported(hits: DataFrame, bands: DataFrame, keys: Sequence[str], radius: int, rows: int, both: bool = False) -> DataFrame:
    keys = list(keys)
    members = bands.select(*keys, "band", F.explode("columns").alias("sample"))
    inside = hits.select(*keys, "line", "sample").join(members, [*keys, "sample"])
    support = _supported_lines(hits, bands, keys, radius, rows, both)
    return inside.join(support, [*keys, "band", "line"], "left_anti").select(*keys, "line", "sample", "band")


def segment_peaks(
    hits: DataFrame, valid: DataFrame, frames: DataFrame, keys: Sequence[str], policy: str = "balanced",
    minimum_valid: int = 8, radius: int = 8, guard: int = 2,
) -> DataFrame:
    """``keys, segment, sample``: columns that stand out inside one core section."""
    keys = list(keys)
    segments = grid.depth_segments(valid)
    enough = segments.groupBy("scene_id").count().where("count >= 2").select("scene_id")
    spans = segments.join(enough, "scene_id").select("scene_id", "segment", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    exposed = columns.in_blocks(valid.select("scene_id", "line", "sample"), spans).groupBy("scene_id", "segment", "sample").agg(
        F.count(F.lit(1)).alias("valid"))
    counted = columns.in_blocks(hits.select(*keys, "line", "sample"), spans).groupBy(*keys, "segment", "sample").agg(
        F.count(F.lit(1)).alias("hits"))
    packed_valid = columns.dense(exposed, ["scene_id", "segment"], ["valid"], frames)
    packed_hits = columns.dense(counted, [*keys, "segment"], ["hits"], frames).drop("lines", "samples")
    both = packed_hits.join(packed_valid, ["scene_id", "segment"]).withColumn(
        "density", F.zip_with("hits", "valid", lambda h, n: F.when(n >= minimum_valid, F.coalesce(h, F.lit(0)) / n).otherwise(0.0)))
    local = columns.neighbour_median(F.col("density"), radius, guard, guard + 1, F.lit(0.0))
    rows = columns.column_rows(both.withColumn("local", local), [*keys, "segment"], ["density", "local"])
    d, m = F.col("density"), F.col("local")
    return rows.where(
        (d >= REPEATED["density"][policy]) & (d - m >= REPEATED["excess"][policy])
        & (d / F.greatest(m, F.lit(0.005)) >= REPEATED["ratio"][policy])
    ).select(*keys, "segment", "sample")


def repeated_columns(peaks: DataFrame, frames: DataFrame, keys: Sequence[str], policy: str = "balanced") -> DataFrame:
    """Columns that peak in enough sections, one-column gaps bridged."""
    keys = list(keys)
    counts = peaks.groupBy(*keys, "sample").agg(F.count(F.lit(1)).alias("repetition"))
    strong = counts.where(F.col("repetition") >= REPEATED["segments"][policy])
    shifted = strong.select(*keys, (F.col("sample") + 1).alias("sample")).unionByName(
        strong.select(*keys, (F.col("sample") - 1).alias("sample")))
    bridged = shifted.groupBy(*keys, "sample").count().where("count = 2").select(*keys, "sample")
    return strong.select(*keys, "sample").unionByName(bridged).distinct()


def repeated_stripes(
    hits: DataFrame, valid: DataFrame, frames: DataFrame, keys: Sequence[str], policy: str = "balanced",
    corridors: bool = True, maximum_width: int = 6, support: int = 4, rows: int = 2,
) -> DataFrame:
    """Hits in columns that peak again and again, without neighbours beside them.

    Returns ``keys, line, sample, cause`` with cause ``repeated`` or ``corridor``.
    """
    keys = list(keys)
    peaks = durable(segment_peaks(hits, valid, frames, keys, policy))
    bands = durable(_bands(repeated_columns(peaks, frames, keys, policy), keys))
    narrow = bands.where(F.col("width") <= maximum_width)
    removed = _unsupported(hits, narrow, keys, support, rows).select(*keys, "line", "sample", F.lit("repeated").alias("cause"))
    if corridors:
        wide = corridor_stripes(hits, peaks, bands, keys, policy).select(*keys, "line", "sample", F.lit("corridor").alias("cause"))
        removed = removed.unionByName(wide)
    return removed.groupBy(*keys, "line", "sample").agg(F.max("cause").alias("cause"))


def dominant_corridors(
    hits: DataFrame, peaks: DataFrame, bands: DataFrame, keys: Sequence[str], policy: str = "balanced",
    gap: int = 7, maximum_width: int = 24, minimum_segments: int = 4,
) -> DataFrame:
    """Groups of nearby bands that repeat often and hold most of a class."""
    keys = list(keys)
    folded = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last", "columns"))).alias("_all"))
    empty = F.filter(F.transform("_all", lambda b: F.array(b)), lambda g: F.lit(False))

    def place(acc, b):
        last = F.get(acc, F.size(acc) - 1)
        joins = (
            (F.size(acc) > 0)
            & (b["first"] - F.get(last, F.size(last) - 1)["last"] - 1 <= gap)
            & (b["last"] - F.get(last, F.lit(0))["first"] + 1 <= maximum_width)
        )
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.array(b))))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(F.concat(acc, F.array(F.array(b))))

    groups = folded.select(*keys, F.posexplode(F.aggregate("_all", empty, place)).alias("band", "_g")).select(
        *keys, "band", F.get(F.col("_g"), F.lit(0))["first"].alias("first"), F.array_max(F.transform("_g", lambda b: b["last"])).alias("last"),
        F.flatten(F.transform("_g", lambda b: b["columns"])).alias("columns"),
    ).withColumn("width", F.col("last") - F.col("first") + 1).where(F.col("width") <= maximum_width)
    members = groups.select(*keys, "band", F.explode("columns").alias("sample"))
    repetition = peaks.join(members, [*keys, "sample"]).groupBy(*keys, "band").agg(F.count_distinct("segment").alias("segments"))
    inside = groups.select(*keys, "band", F.explode(F.sequence("first", "last")).alias("sample"))
    per_column = hits.groupBy(*keys, "sample").agg(F.count(F.lit(1)).alias("c"))
    pixels = per_column.join(inside, [*keys, "sample"]).groupBy(*keys, "band").agg(F.sum("c").alias("pixels"))
    whole = per_column.groupBy(*keys).agg(F.sum("c").alias("all"))
    judged = groups.join(repetition, [*keys, "band"]).join(pixels, [*keys, "band"]).join(whole, keys)
    return judged.withColumn("fraction", F.col("pixels") / F.col("all")).where(
        (F.col("segments") >= minimum_segments) & (F.col("fraction") >= REPEATED["dominance"][policy]))


def corridor_stripes(hits, peaks, bands, keys, policy: str = "balanced", support: int = 6, rows: int = 2) -> DataFrame:
    """Peak-column hits of a dominant corridor without support on both sides."""
    found = dominant_corridors(hits, peaks, bands, keys, policy)
    return _unsupported(hits, found, keys, support, rows, both=True)


def low_exposure_stripes(
    hits: DataFrame, valid: DataFrame, frames: DataFrame, keys: Sequence[str], policy: str = "balanced",
    fraction: float = 0.10, minimum_valid: int = 32, minimum_hits: int = 12, ratio: float = 3.0,
    excess: float = 0.10, radius: int = 6, support: int = 3, rows: int = 2,
) -> DataFrame:
    """Hits in barely exposed, over-dense columns without lateral support."""
    keys = list(keys)
    floor = {"conservative": 0.15, "balanced": 0.15, "sensitive": 0.18}[policy]
    exposure = valid.groupBy("scene_id", "sample").agg(F.count(F.lit(1)).alias("valid"))
    typical = exposure.groupBy("scene_id").agg(F.percentile("valid", F.lit(0.5)).alias("typical"))
    counts = hits.groupBy(*keys, "sample").agg(F.count(F.lit(1)).alias("hits"))
    packed = columns.dense(counts, keys, ["hits"], frames).drop("lines", "samples").join(
        columns.dense(exposure, ["scene_id"], ["valid"], frames), "scene_id"
    ).withColumn("density", F.zip_with("hits", "valid", lambda h, n: F.when(n > 0, F.coalesce(h, F.lit(0)) / n).otherwise(0.0)))
    local = columns.neighbour_median(F.col("density"), radius, 0, 1, F.lit(0.0))
    rows_ = columns.column_rows(packed.withColumn("local", local), keys, ["hits", "valid", "density", "local"]).join(typical, "scene_id")
    d, m = F.col("density"), F.col("local")
    flagged = rows_.where(
        (F.col("valid") >= minimum_valid) & (F.col("valid") <= fraction * F.col("typical")) & (F.col("hits") >= minimum_hits)
        & (d >= floor) & (d - m >= excess) & (d / F.greatest(m, F.lit(0.005)) >= ratio))
    bands = flagged.select(*keys, F.col("sample").alias("band"), F.col("sample").alias("first"), F.col("sample").alias("last"),
                           F.lit(1).alias("width"), F.array("sample").alias("columns"))
    return _unsupported(hits, bands, keys, support, rows).select(*keys, "line", "sample")


def residual_bands(
    labels: DataFrame, valid: DataFrame, risk: DataFrame, frames: DataFrame, policy: str = "balanced",
    risk_floor: float = 0.10, maximum_width: int = 12, protection: float = 0.60,
) -> DataFrame:
    """Dense risky column bands active in two or more depth quarters; confident
    pixels with support beside the band stay."""
    keys = ["scene_id"]
    limit = {"conservative": 0.06, "balanced": 0.075, "sensitive": 0.09}[policy]
    dense = columns.density(labels, valid, keys).join(risk, ["scene_id", "sample"])
    strong = dense.where((F.col("density") >= limit) & (F.col("risk") >= risk_floor)).select("scene_id", "sample")
    shifted = strong.select("scene_id", (F.col("sample") + 1).alias("sample")).unionByName(strong.select("scene_id", (F.col("sample") - 1).alias("sample")))
    bridged = shifted.groupBy("scene_id", "sample").count().where("count = 2").select("scene_id", "sample")
    bands = _bands(strong.unionByName(bridged).distinct(), keys).where(F.col("width") <= maximum_width)
    members = bands.select("scene_id", "band", F.explode("columns").alias("sample"))
    inside = labels.join(members, ["scene_id", "sample"])
    # quarter sizes follow an even split in which the first ones take the rest
    lines, small, more = F.col("lines"), F.floor(F.col("lines") / 4), F.col("lines") % 4
    head = more * (small + 1)
    quarter = F.when(F.col("line") < head, F.floor(F.col("line") / (small + 1))).otherwise(
        more + F.floor((F.col("line") - head) / F.greatest(small, F.lit(1))))
    active = inside.select("scene_id", "band", "line").distinct().join(frames, "scene_id").groupBy(
        "scene_id", "band", quarter.alias("quarter"), (small + F.when(quarter < more, 1).otherwise(0)).alias("size")).count()
    repeated = active.where(F.col("count") / F.col("size") >= 0.02).groupBy("scene_id", "band").count().where("count >= 2").select("scene_id", "band")
    kept_bands = bands.join(repeated, ["scene_id", "band"])
    support = _supported_lines(labels, kept_bands, keys, 3, 2, both=False).withColumn("_s", F.lit(True))
    hit = inside.join(repeated, ["scene_id", "band"]).join(support, ["scene_id", "band", "line"], "left")
    protected = (F.col("confidence") >= protection) & F.coalesce("_s", F.lit(False))
    return hit.where(~protected).select("scene_id", "line", "sample")


def filter_artifacts(
    labels: DataFrame, valid: DataFrame, risk: DataFrame, frames: DataFrame, policy: str = "balanced",
    protection: float = 0.72, vertical_window: int = 61, min_vertical_density: float = 0.10, column_ratio: float = 2.0,
    column_excess: float = 0.03, min_component: int = 2, line: tuple[int, int, float] = (15, 3, 5.0),
) -> DataFrame:
    """Clean one class map: every input pixel with ``cause`` NULL or the reason it goes.

    ``labels`` is (scene_id, line, sample, class_id, confidence), ``risk`` is
    (scene_id, sample, risk).  Steps run in order; each sees what the earlier left.
    """
    cell = ["scene_id", "line", "sample"]
    factor = {"conservative": 0.85, "balanced": 1.0, "sensitive": 1.15}[policy]
    directional = directional_stripes(
        labels.select(*cell), valid, frames, ["scene_id"], vertical_window, min(0.95, min_vertical_density * factor),
        column_ratio, column_excess * factor, 2, 6).withColumn("_dir", F.lit(True))
    lateral = grid.across_samples(labels, ["scene_id"], 2, {"_lateral": F.count(F.lit(1))})
    seen = lateral.join(risk, ["scene_id", "sample"], "left").join(directional, cell, "left").withColumns({
        "risk": F.coalesce("risk", F.lit(0.0)), "_dir": F.coalesce("_dir", F.lit(False)), "strong": F.col("confidence") >= protection})
    geologic = F.col("strong") & ((F.col("risk") < 0.35) | (F.col("_lateral") >= 3))
    along = (F.col("_dir") & (F.col("risk") >= 0.20)) | ((F.col("risk") >= 0.72) & (F.col("_lateral") <= 3))
    state = durable(seen.withColumn("cause", F.when(along & ~geologic, "directional")))
    share = state.groupBy("scene_id").agg(F.avg(F.col("_dir").cast("double")).alias("_share"))
    keys = ["scene_id", "class_id"]

    def left(df: DataFrame) -> DataFrame:
        return df.where("cause is null")

    def tag(df: DataFrame, hits: DataFrame, cause: str) -> DataFrame:
        named = hits.select(*cell).withColumn("_c", F.lit(cause))
        return durable(df.join(named, cell, "left").withColumn("cause", F.coalesce("cause", "_c")).drop("_c"))

    weak = CC.components(left(state).where("not strong").select(*cell, "class_id"), keys)
    state = tag(state, weak.where(CC.elongated(*line)), "elongated")
    weak = CC.components(left(state).where("not strong").select(*cell, "class_id"), keys).join(share, "scene_id")
    base = max(1, min_component + {"conservative": 1, "balanced": 0, "sensitive": -1}[policy])
    floor = F.when(F.col("_share") >= 0.40, 1).otherwise(base) if policy == "balanced" else F.lit(base)
    state = tag(state, weak.where(F.col("size") < floor), "small_component")
    state = tag(state, low_exposure_stripes(left(state), valid, frames, keys, policy), "low_exposure")
    state = tag(state, residual_bands(left(state), valid, risk, frames, policy), "residual_band")
    state = tag(state, repeated_stripes(left(state), valid, frames, keys, policy, corridors=False), "repeated")
    return state.select(*cell, "class_id", "confidence", "cause")


POLICY_RANK = {"conservative": 0, "balanced": 1, "sensitive": 2}


def terminal_filter(
    stacked: DataFrame, valid: DataFrame, frames: DataFrame, passes: int = 4, detection_policy: str = "balanced",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Repeat the column audit on nested maps until nothing is left to remove.

    ``stacked`` is (scene_id, policy, line, sample, class_id, *groups).  What falls
    in a weaker map also falls in the stricter ones of the same group; groups do
    not touch each other.  Returns the input with ``removed_in`` (pass, NULL when
    kept) and ``inherited``.
    """
    cell = ["scene_id", *groups, "line", "sample"]
    rank = F.create_map(*[x for p, r in POLICY_RANK.items() for x in (F.lit(p), F.lit(r))])
    state = stacked.withColumns({
        "rank": rank[F.col("policy")], "removed_in": F.lit(None).cast("int"), "inherited": F.lit(None).cast("boolean")})
    for number in range(1, passes + 1):
        live = state.where("removed_in is null")
        found = repeated_stripes(
            live.select(*cell, "policy", "class_id"), valid, frames,
            ["scene_id", *groups, "policy", "class_id"], detection_policy, corridors=number == 1,
        ).select(*cell, rank[F.col("policy")].alias("_from"))
        falls = durable(found.groupBy(*cell).agg(F.max("_from").alias("_top"), F.collect_set("_from").alias("_own")))
        if falls.isEmpty():
            break
        gone = F.col("removed_in").isNull() & F.coalesce(F.col("rank") <= F.col("_top"), F.lit(False))
        state = durable(state.join(falls, cell, "left").withColumns({
            "inherited": F.when(gone, ~F.array_contains("_own", F.col("rank"))).otherwise(F.col("inherited")),
            "removed_in": F.when(gone, number).otherwise(F.col("removed_in")),
        }).drop("_top", "_own"))
    return state.drop("rank")
