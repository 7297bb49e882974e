"""8-connected components of sparse cells at scene scale.

Cells are labelled inside line tiles first; a tile is bounded, so its Arrow
batch is too.  Only components that touch a tile seam enter the graph phase,
which contracts edges to stars in a logarithmic number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import durable
from . import grid

STEP = 1 << 31  # line and sample are 32-bit, so no two cells share a code


def tile_labels(lines: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Smallest cell code of each cell's component."""
    code = lines.astype(np.int64) * STEP + samples
    order = np.argsort(code)
    sorted_code = code[order]
    parent = np.arange(len(code))
    left, right = [], []
    for jump in (1, STEP - 1, STEP, STEP + 1):
        at = np.searchsorted(sorted_code, sorted_code + jump)
        at = np.minimum(at, len(code) - 1)
        hit = np.flatnonzero(sorted_code[at] == sorted_code + jump)
        left.append(hit)
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(parent[a], parent[b])
        if not len(a) or np.array_equal(parent[a], parent[b]):
            break
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
    out = np.empty(len(code), dtype=np.int64)
    out[order] = sorted_code[parent]
    return out


def connected_roots(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node, root`` with the smallest node of every component of ``(a, b)`` edges.

    Alternating star contraction: hubs hand their neighbours to the smallest
    one, so a hub never needs its whole neighbourhood in one place.
    """
    pairs = edges.select("a", "b").where("a <> b")
    current = durable(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    previous = None
    for _ in range(limit):
        both = current.union(current.select("v", "u")).hint("merge")  # files are far smaller than their rows
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).hint("merge")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        current = durable(small.where("u <> v").distinct(), replaces=current)
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if previous == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        previous = state
    raise RuntimeError("component contraction did not settle")


def components(cells: DataFrame, keys: Sequence[str] = ("scene_id",), tile_lines: int = 256) -> DataFrame:
    """Cells with ``label`` and their component's size, box and coordinate sums."""
    keys = list(keys)
    tiled = cells.withColumn("tile", F.floor(F.col("line") / tile_lines))
    schema = T.StructType([*tiled.schema.fields, T.StructField("local", T.LongType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(local=tile_labels(pdf["line"].to_numpy(), pdf["sample"].to_numpy()))

    local = durable(tiled.groupBy(*keys, "tile").applyInPandas(label, schema))
    node = F.struct(*keys, "local")
    pieces = local.groupBy(*keys, "tile", "local").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("line").alias("min_line"), F.max("line").alias("max_line"),
        F.min("sample").alias("min_sample"), F.max("sample").alias("max_sample"),
        F.sum("line").alias("sum_line"), F.sum("sample").alias("sum_sample"),
    )
    bottom = local.where((F.col("line") + 1) % tile_lines == 0).select(
        *keys, (F.col("line") + 1).alias("line"),
        F.explode(F.array(F.col("sample") - 1, F.col("sample"), F.col("sample") + 1)).alias("sample"),
        node.alias("a"),
    )
    top = local.where(F.col("line") % tile_lines == 0).select(*keys, "line", "sample", node.alias("b"))
    seams = durable(bottom.join(top, [*keys, "line", "sample"]).select("a", "b").distinct())
    if seams.isEmpty():
        rooted = pieces.withColumn("label", F.col("local"))
    else:
        roots = connected_roots(seams).select(
            *[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.local").alias("local"),
            F.col("root.local").alias("_root"),
        )
        rooted = pieces.join(roots, [*keys, "local"], "left").withColumn(
            "label", F.coalesce("_root", "local")
        ).drop("_root")
    rooted = durable(rooted)
    whole = rooted.groupBy(*keys, "label").agg(
        F.sum("size").alias("size"),
        F.min("min_line").alias("min_line"), F.max("max_line").alias("max_line"),
        F.min("min_sample").alias("min_sample"), F.max("max_sample").alias("max_sample"),
        F.sum("sum_line").alias("sum_line"), F.sum("sum_sample").alias("sum_sample"),
    )
    # one row per tile piece on the small side keeps a huge component from
    # becoming one hot join key; written planes compress to a few bits a cell,
    # so the planner must not take their files' size for that of a broadcast
    known = rooted.select(*keys, "tile", "local", "label").hint("merge").join(whole, [*keys, "label"])
    return local.hint("merge").join(known, [*keys, "tile", "local"]).drop("tile", "local")


def catalogue(labelled: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """One row per component: size, box and centroid."""
    first = labelled.groupBy(*keys, "label").agg(
        *[F.first(c).alias(c) for c in (
            "size", "min_line", "max_line", "min_sample", "max_sample", "sum_line", "sum_sample")]
    )
    return first.withColumn("center_line", F.col("sum_line") / F.col("size")).withColumn(
        "center_sample", F.col("sum_sample") / F.col("size")
    )


def keep_large(labelled: DataFrame, minimum: int) -> DataFrame:
    return labelled.where(F.col("size") >= minimum)


def elongated(min_height: int = 15, max_width: int = 3, min_aspect: float = 5.0):
    height = F.col("max_line") - F.col("min_line") + 1
    width = F.col("max_sample") - F.col("min_sample") + 1
    return (height >= min_height) & (width <= max_width) & (height / width >= min_aspect)


def fill_holes(cells: DataFrame, frames: DataFrame, maximum: int, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Add the enclosed gaps of at most ``maximum`` pixels."""
    keys = list(keys)
    gaps = components(grid.complement(cells, frames, keys), keys).join(frames, "scene_id")
    inside = (
        (F.col("min_line") > 0) & (F.col("min_sample") > 0)
        & (F.col("max_line") < F.col("lines") - 1) & (F.col("max_sample") < F.col("samples") - 1)
    )
    filled = gaps.where(inside & (F.col("size") <= maximum)).select(*keys, "line", "sample")
    return cells.select(*keys, "line", "sample").unionByName(filled)


def grow_from_seeds(seeds: DataFrame, domain: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Domain components that hold at least one seed."""
    keys = list(keys)
    marked = domain.select(*keys, "line", "sample").join(
        seeds.select(*keys, "line", "sample").distinct().withColumn("_seed", F.lit(1)),
        [*keys, "line", "sample"], "left",
    )
    labelled = components(marked, keys)
    seeded = labelled.where("_seed = 1").select(*keys, "label").distinct()
    return labelled.join(seeded, [*keys, "label"], "left_semi").select(*keys, "line", "sample")


def small_share(labelled: DataFrame, minimum: int, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Share of pixels in components below ``minimum`` pixels."""
    return labelled.groupBy(*keys).agg(
        (F.sum(F.when(F.col("size") < minimum, 1).otherwise(0)) / F.count(F.lit(1))).alias("isolated")
    )
