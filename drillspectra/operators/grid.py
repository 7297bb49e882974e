"""Neighbourhoods on the (line, sample) grid.

Only set cells are stored.  A scan line is bounded by the detector width, a
column is not, so anything that runs along a column is cut into line tiles:
each tile also receives the rows its neighbours need (the halo), and every
window stays inside one tile.  Boxes are sums over shifted planes of a tile, so
no cell is sent to the cells around it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELL = ["line", "sample"]


def with_halo(df: DataFrame, radius: int, tile_lines: int = 512) -> DataFrame:
    """Add ``tile`` and ``home``; rows near a tile edge are copied to the neighbour."""
    size = max(tile_lines, 2 * radius)
    own = F.floor(F.col("line") / size)
    tiles = F.filter(
        F.array(
            own,
            F.when(F.col("line") - own * size < radius, own - 1),
            F.when((own + 1) * size - F.col("line") <= radius, own + 1),
        ),
        lambda t: t.isNotNull(),
    )
    return df.withColumn("_own", own).withColumn("tile", F.explode(tiles)).withColumn(
        "home", F.col("tile") == F.col("_own")
    ).drop("_own")


def along_lines(
    df: DataFrame, keys: Sequence[str], radius: int, sums: Mapping[str, Column], tile_lines: int = 512
) -> DataFrame:
    """Aggregates over the cells of the same column within ``radius`` lines."""
    frame = (
        W.partitionBy(*keys, "tile", "sample").orderBy("line").rangeBetween(-radius, radius)
    )
    haloed = with_halo(df, radius, tile_lines)
    return (
        haloed.select("*", *[value.over(frame).alias(name) for name, value in sums.items()])
        .where("home").drop("tile", "home")
    )


def across_samples(
    df: DataFrame, keys: Sequence[str], radius: int, sums: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over the cells of the same scan line within ``radius`` columns."""
    frame = W.partitionBy(*keys, "line").orderBy("sample").rangeBetween(-radius, radius)
    return df.select("*", *[value.over(frame).alias(name) for name, value in sums.items()])


class Tile:
    """One haloed tile as dense planes; a detector is narrow and a tile is short, so planes are small."""

    def __init__(self, table: pa.Table, rows: int, columns: int, tile_lines: int):
        self.line, self.sample = (table.column(c).to_numpy().astype(np.int64) for c in CELL)
        size = max(tile_lines, 2 * rows)
        self.start = int(table.column("tile")[0].as_py()) * size
        self.stop = self.start + size
        self.low = int(self.sample.min()) - columns
        self.rows, self.columns = rows, columns
        self.shape = (size + 2 * rows, int(self.sample.max()) - self.low + columns + 1)
        self.at = (self.line - self.start + rows, self.sample - self.low)
        self.home = (self.line >= self.start) & (self.line < self.stop)

    def plane(self, values) -> np.ndarray:
        out = np.zeros(self.shape)
        np.add.at(out, self.at, values)
        return out

    def around(self, plane: np.ndarray) -> np.ndarray:
        """Sum over the box around every cell of the home lines: first down, then across."""
        r, c = self.rows, self.columns
        tall, wide = self.shape
        down = sum(plane[k : tall - 2 * r + k] for k in range(2 * r + 1))
        padded = np.pad(down, ((0, 0), (c, c)))
        return sum(padded[:, k : wide + k] for k in range(2 * c + 1))

    def of(self, sums: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Values of ``around`` at cells of the home lines."""
        return sums[self.at[0][which] - self.rows, self.at[1][which]]


def per_tile(df: DataFrame, keys: Sequence[str], rows: int, columns: int, run, added: str, tile_lines: int = 512) -> DataFrame:
    """``keys, line, sample`` and ``added`` of every haloed tile: one exchange, in which only seam rows are doubled.

    ``run(tile, table)`` returns lines, samples and the added columns.
    """
    keys = list(keys)
    haloed = with_halo(df, rows, tile_lines).drop("home")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in haloed.select(*keys).schema)
    names = [a.strip().split(" ")[0] for a in added.split(",")] if added else []

    def whole(table: pa.Table) -> pa.Table:
        line, sample, *values = run(Tile(table, rows, columns, tile_lines), table)
        heads = {k: pa.repeat(table.column(k)[0], len(line)) for k in keys}
        return pa.table(heads | {"line": pa.array(line.astype(np.int32)), "sample": pa.array(sample.astype(np.int32))} | dict(zip(names, map(pa.array, values))))

    return haloed.groupBy(*keys, "tile").applyInArrow(whole, f"{kinds}, line int, sample int" + (f", {added}" if added else ""))


def box_counts(
    cells: DataFrame, targets: DataFrame, keys: Sequence[str], rows: int, columns: int,
    include_self: bool = True,
) -> DataFrame:
    """``targets`` with ``n``: the set cells in the box around each one."""
    same = cells is targets
    asked = cells.select(*keys, *CELL)
    if not same:
        asked = asked.withColumn("_set", F.lit(1)).unionByName(targets.select(*keys, *CELL, F.lit(0).alias("_set")))

    def run(tile: Tile, table: pa.Table):
        given = np.ones(table.num_rows) if same else table.column("_set").to_numpy()
        plane = tile.plane(given)
        n = tile.around(plane)
        wanted = tile.home if same else tile.home & (given == 0)
        _, first = np.unique(np.stack([tile.line[wanted], tile.sample[wanted]], 1), axis=0, return_index=True)
        which = np.flatnonzero(wanted)[first]
        found = tile.of(n, which) - (0 if include_self else plane[tile.at[0][which], tile.at[1][which]])
        return tile.line[which], tile.sample[which], found.astype(np.int64)

    return per_tile(asked, keys, rows, columns, run, "n long")


def box_sums(cells: DataFrame, keys: Sequence[str], rows: int, columns: int, values: Sequence[str]) -> DataFrame:
    """Every cell with ``n`` and the sum of each of ``values`` in the box around it."""

    def run(tile: Tile, table: pa.Table):
        which = np.flatnonzero(tile.home)
        planes = [tile.plane(1.0), *(tile.plane(table.column(v).to_numpy(zero_copy_only=False)) for v in values)]
        n, *sums = (tile.of(tile.around(p), which) for p in planes)
        return tile.line[which], tile.sample[which], n.astype(np.int64), *sums

    return per_tile(cells.select(*keys, *CELL, *values), keys, rows, columns, run, ", ".join(["n long", *(f"{v} double" for v in values)]))


def box_map(cells: DataFrame, keys: Sequence[str], rows: int, columns: int, least: int) -> DataFrame:
    """Cells, set or not, whose box holds at least ``least`` set cells."""

    def run(tile: Tile, table: pa.Table):
        line, sample = np.nonzero(tile.around(tile.plane(1.0)) >= least)
        return line + tile.start, sample + tile.low

    return per_tile(cells.select(*keys, *CELL), keys, rows, columns, run, "")


def _inside(cells: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        cells.join(frames, "scene_id")
        .where("line >= 0 and sample >= 0 and line < lines and sample < samples")
        .select(*keys, *CELL)
    )


def erode(cells: DataFrame, keys: Sequence[str], size: int = 3) -> DataFrame:
    return box_map(cells, keys, size // 2, size // 2, size * size)


def dilate(cells: DataFrame, frames: DataFrame, keys: Sequence[str], size: int = 3) -> DataFrame:
    """Grow inside the scene frame ``(scene_id, lines, samples)``."""
    return _inside(box_map(cells, keys, size // 2, size // 2, 1), frames, keys)


def close(cells: DataFrame, frames: DataFrame, keys: Sequence[str], size: int = 3) -> DataFrame:
    return erode(dilate(cells, frames, keys, size), keys, size)


def majority(cells: DataFrame, frames: DataFrame, keys: Sequence[str], size: int = 3) -> DataFrame:
    """Cells of the frame with more than half of the box set."""
    return _inside(box_map(cells, keys, size // 2, size // 2, (size * size) // 2 + 1), frames, keys)


def complement(cells: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unset cells of the frame."""
    extra = [k for k in keys if k != "scene_id"]
    heads = frames.join(cells.select(*keys).distinct(), "scene_id") if extra else frames
    every = heads.select(
        *keys, "samples", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line")
    ).select(*keys, "line", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("sample"))
    return every.join(cells.select(*keys, *CELL), [*keys, *CELL], "left_anti")


def row_runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with the ends of the unbroken run they belong to on their line."""
    by_line = W.partitionBy(*keys, "line").orderBy("sample")
    run = W.partitionBy(*keys, "line", "_run")
    return (
        cells.withColumn("_run", F.col("sample") - F.row_number().over(by_line))
        .withColumn("run_start", F.min("sample").over(run))
        .withColumn("run_stop", F.max("sample").over(run))
        .drop("_run")
    )


def edge_risk(cells: DataFrame, keys: Sequence[str], width: int = 2) -> DataFrame:
    """1 at a run end, falling linearly to 0 over ``width`` pixels."""
    inward = F.least(F.col("sample") - F.col("run_start"), F.col("run_stop") - F.col("sample"))
    return row_runs(cells, keys).withColumn(
        "edge_risk", F.greatest(F.lit(0.0), 1.0 - inward / float(max(width, 1)))
    )


def islands(df: DataFrame, keys: Sequence[str], at: str, gap: int, upto: str | None = None) -> DataFrame:
    """Add ``island``: positions (or ``[at, upto)`` spans) at most ``gap`` apart share one."""
    order = W.partitionBy(*keys).orderBy(at)
    reach = F.max(F.col(upto or at)).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(at) - reach > gap), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn(
        "island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_new")


def merge_spans(
    df: DataFrame, keys: Sequence[str], start: str, stop: str, gap: int = 0, tile: int = 4096
) -> DataFrame:
    """Touching spans as one: ``keys, start, stop, parts``.

    Spans are folded inside tiles of their start first, so a busy key is
    ordered tile by tile and only the folded spans meet.
    """
    keys = list(keys)
    tiled = df.withColumn("_tile", F.floor(F.col(start) / tile))
    inner = islands(tiled, [*keys, "_tile"], start, gap, stop).groupBy(*keys, "_tile", "island").agg(
        F.min(start).alias("start"), F.max(stop).alias("stop"), F.count(F.lit(1)).alias("parts")
    ).drop("_tile", "island")
    return islands(inner, keys, "start", gap, "stop").groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("parts").alias("parts")
    ).drop("island")


def depth_segments(
    valid: DataFrame, keys: Sequence[str] = ("scene_id",), row_pixels: int = 4, gap: int = 12, height: int = 16
) -> DataFrame:
    """Core-box sections ``[start, stop)``: busy lines, short gaps bridged, short pieces dropped.

    Works on one row per busy line; runs of lines are first folded into spans,
    so the ordered pass sees spans and not lines.
    """
    keys = list(keys)
    busy = valid.groupBy(*keys, "line").count().where(F.col("count") >= max(1, row_pixels))
    tile = 4096
    spans = (
        islands(busy.withColumn("tile", F.floor(F.col("line") / tile)), [*keys, "tile"], "line", 1)
        .groupBy(*keys, "tile", "island")
        .agg(F.min("line").alias("start"), (F.max("line") + 1).alias("stop"))
        .drop("tile", "island")
    )
    merged = islands(spans, keys, "start", max(0, gap), "stop").groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    return merged.where(F.col("stop") - F.col("start") >= max(4, height)).select(
        *keys, "start", "stop", F.row_number().over(W.partitionBy(*keys).orderBy("start")).alias("segment")
    )
