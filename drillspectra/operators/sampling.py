"""Deterministic samples: depth blocks, even subsets, strongest pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Values of the first tie column (a scan line, mostly) that are ordered together.
TIE_RUN = 256


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: str | None = None) -> DataFrame:
    """Add the global 1-based position ``pos`` and count ``n`` within a key.

    With ``buckets`` (a column that rises with the order, such as the line
    block) each bucket is numbered on its own and shifted by the sizes before
    it, so a hot key is never sorted in one task.
    """
    keys = list(keys)
    if buckets is None:
        w = W.partitionBy(*keys)
        return df.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    sizes = df.groupBy(*keys, buckets).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy(buckets).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, buckets, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("n"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, buckets).orderBy(*order))
    return df.withColumn("_r", inside).join(shifts, [*keys, buckets]).withColumn(
        "pos", F.col("_r") + F.col("_before")
    ).drop("_r", "_before")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], maximum: int, buckets: str | None = None) -> DataFrame:
    """At most ``maximum`` rows at ``floor(i (n-1) / (maximum-1))``."""
    numbered = ranked(df, keys, order, buckets)
    zero = F.col("pos") - 1
    # the smallest i that reaches this position; it is taken when it lands on it
    i = F.ceil(zero * (maximum - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("n") - 1) / (maximum - 1)) == zero
    return numbered.where((F.col("n") <= maximum) | hit).drop("pos", "n")


def strongest(
    df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], limit: str, bins: int = 1024
) -> DataFrame:
    """The ``limit`` best rows of a key (``limit`` depends on the key alone).

    A score histogram finds the bin the limit falls into; bins above it are
    taken whole.  In that bin the rows are counted once more by score and by
    runs of the first tie column, so that equal scores are split as well, and
    only the one run that holds the limit is ordered.
    """
    keys = list(keys)
    x = F.col(score)
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = df.join(ends, keys).withColumn(
        "_bin", F.coalesce(F.when(width > 0, F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1))), F.lit(0))
    ).drop("_lo", "_hi")

    def cut_by(rows: DataFrame, within: list[str], order: list[Column], part: list[str], cap: str) -> tuple[DataFrame, DataFrame]:
        """Rows of the parts that are taken whole, and those of the part in which ``cap`` lies."""
        ahead = W.partitionBy(*keys, *within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        counted = rows.groupBy(*keys, *within, *part, F.col(cap).alias("_cap")).agg(F.count(F.lit(1)).alias("_m")).withColumn(
            "_above", F.coalesce(F.sum("_m").over(ahead), F.lit(0))).where("_above < _cap")
        reached = rows.join(counted.select(*keys, *within, *part, "_m", "_above", "_cap"), [*keys, *within, *part])
        whole = reached.where("_above + _m <= _cap").select(*df.columns)
        return whole, reached.where("_above + _m > _cap").withColumn("_left", F.col("_cap") - F.col("_above")).drop("_m", "_above", "_cap")

    taken, rest = cut_by(placed, [], [F.desc("_bin")], ["_bin"], limit)
    rest = rest.withColumns({"_x": x, "_run": F.floor(F.col(tie[0]) / TIE_RUN)})
    more, last = cut_by(rest, ["_bin"], [F.desc("_x"), F.asc("_run")], ["_x", "_run"], "_left")
    order = W.partitionBy(*keys, "_bin", "_x", "_run").orderBy(*tie)
    cut = last.withColumn("_r", F.row_number().over(order)).where("_r <= _left").select(*df.columns)
    return taken.unionByName(more).unionByName(cut)


def depth_blocks(
    valid: DataFrame, frames: DataFrame, desired: int = 12, height: int = 64, minimum: int = 128, forced: DataFrame | None = None
) -> DataFrame:
    """Non-overlapping full-width blocks spread over the depth: per stratum the
    densest block on a quarter-height grid, first one on ties.

    Blocks around ``forced`` lines (scene_id, line) come first.  A scene in which
    no stratum has enough material gets its densest block; if that is too poor as
    well, it keeps one row with reason ``no_block`` and no lines.  Works on line
    counts and on running sums of them, so the pixels are read once.
    """
    counts = valid.groupBy("scene_id", "line").agg(F.count(F.lit(1)).alias("c"))
    h = F.least(F.greatest(F.lit(height), F.lit(8)), F.col("lines"))
    strata = frames.select(
        "scene_id", "lines", h.alias("h"),
        F.posexplode(F.sequence(F.lit(0), F.lit(desired - 1))).alias("_p", "k"),
    ).select(
        "scene_id", "lines", "h", "k",
        F.floor(F.col("k") * F.col("lines") / desired).cast("int").alias("a"),
        F.floor((F.col("k") + 1) * F.col("lines") / desired).cast("int").alias("b"),
    ).where("b > a")
    low = F.greatest(F.lit(0), F.col("a") - F.floor(F.col("h") / 2)).cast("int")
    high = F.least(F.col("lines"), F.col("b") + F.floor(F.col("h") / 2)).cast("int")
    starts = strata.select(
        "*", F.explode(F.sequence(low, F.greatest(high - F.col("h"), low), F.greatest(F.lit(1), F.floor(F.col("h") / 4)).cast("int"))).alias("s")
    ).where(F.col("s") <= F.greatest(high - F.col("h"), low))
    covered = starts.withColumn("line", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + F.col("h"), F.col("lines")) - 1)))
    sums = covered.join(counts, ["scene_id", "line"], "left").groupBy("scene_id", "lines", "h", "k", "s").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("v")
    )
    best = sums.groupBy("scene_id", "lines", "h", "k").agg(F.max(F.struct("v", (-F.col("s")).alias("_s"))).alias("b"))
    picked = best.select(
        "scene_id", "k", (-F.col("b._s")).alias("start"),
        F.least(-F.col("b._s") + F.col("h"), F.col("lines")).cast("int").alias("stop"), F.col("b.v").alias("valid_pixels"),
    ).where(F.col("valid_pixels") >= minimum)
    if forced is not None:
        begin = F.least(F.greatest(F.col("line") - F.floor(F.col("h") / 2), F.lit(0)), F.col("lines") - F.col("h")).cast("int")
        asked = forced.select("scene_id", "line").distinct().join(frames.select("scene_id", "lines", h.alias("h")), "scene_id").select(
            "scene_id", (F.col("line") - (1 << 30)).alias("k"), begin.alias("start"), (begin + F.col("h")).cast("int").alias("stop"), "lines", F.lit(None).alias("h"))
        picked = picked.unionByName(_material(asked, counts).where(F.col("valid_pixels") >= minimum))
    # at most 32 blocks per scene: keep a block unless an earlier kept one overlaps
    folded = picked.groupBy("scene_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "start", "stop", "valid_pixels"))).alias("all")
    )
    kept = F.aggregate(
        "all", F.filter("all", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (x["stop"] > y["start"]) & (x["start"] < y["stop"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = folded.select("scene_id", F.inline(kept)).select(
        "scene_id", "start", "stop",
        F.when(F.col("k") < 0, "forced_line").otherwise(F.format_string("depth_stratum_%02d", F.col("k") + 1)).alias("reason"), "valid_pixels"
    )
    missing = frames.select("scene_id", "lines", h.alias("h")).join(folded, "scene_id", "left_anti")
    every = missing.select("scene_id", "lines", F.explode(F.sequence(F.lit(0), (F.col("lines") - F.col("h")).cast("int"))).alias("start"), "h").select(
        "scene_id", F.lit(0).alias("k"), "start", (F.col("start") + F.col("h")).cast("int").alias("stop"), "lines", "h")
    densest = _material(every, counts).groupBy("scene_id").agg(F.max(F.struct("valid_pixels", (-F.col("start")).alias("_s"), "stop")).alias("b"))
    enough = F.col("b.valid_pixels") >= minimum
    fallback = densest.select(
        "scene_id", F.when(enough, -F.col("b._s")).cast("int").alias("start"), F.when(enough, F.col("b.stop")).alias("stop"),
        F.when(enough, "validity_fallback").otherwise("no_block").alias("reason"), F.col("b.valid_pixels").alias("valid_pixels"))
    return found.unionByName(fallback)


def _material(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Blocks (scene_id, k, start, stop) with the material pixels of their lines."""
    keys = ["scene_id", "k", "start", "stop"]
    lines = blocks.select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("line"))
    return lines.join(counts, ["scene_id", "line"], "left").groupBy(*keys).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("valid_pixels"))


def even_rows(blocks: DataFrame, maximum: int) -> DataFrame:
    """Evenly spread lines of each block within one row budget per scene."""
    folded = blocks.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("all"))
    start = F.struct(F.greatest(F.lit(maximum), F.size("all")).alias("left"), F.array().cast("array<int>").alias("lines"))

    def take(acc, pair):
        block, todo = pair["b"], pair["todo"]
        length = block["stop"] - block["start"]
        quota = F.least(F.greatest(F.lit(1), F.floor(acc["left"] / todo).cast("int")), length)
        lines = F.transform(
            F.sequence(F.lit(0), quota - 1),
            lambda i: (block["start"] + F.floor(i * (length - 1) / F.greatest(quota - 1, F.lit(1)))).cast("int"),
        )
        return F.struct((acc["left"] - quota).alias("left"), F.concat(acc["lines"], lines).alias("lines"))

    pairs = F.transform("all", lambda b, i: F.struct(b.alias("b"), (F.size("all") - i).alias("todo")))
    total = F.aggregate(F.transform("all", lambda b: b["stop"] - b["start"]), F.lit(0), lambda a, x: a + x)
    spread = F.aggregate(pairs, start, take)["lines"]
    every = F.flatten(F.transform("all", lambda b: F.sequence(b["start"], b["stop"] - 1)))
    return folded.select("scene_id", F.explode(F.when(total > maximum, spread).otherwise(every)).alias("line"))
