"""Exact medians of every band of a cube, without one row per band and pixel.

Tasks count the values of their spectra in histograms of shape (key, band,
bin), so what leaves a task is counts.  They tell between which values each
median lies; a second pass lets only values in between through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import durable

#: Bits of a double that tell its bin: sign, exponent and the first five of the fraction.
BIN_BITS = 17
#: Values a task counts together; the more, the fewer counts leave it.
COUNTED = 4 << 20


def _places(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _values(places: np.ndarray) -> np.ndarray:
    return (places ^ ((places >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The group of every row, and one row of each group."""
    group = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        _, group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)
    return group, np.unique(group, return_index=True)[1]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``COUNTED`` values."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("_v").flatten())
        if size >= COUNTED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(keys: Sequence[str]):
    shift = np.int64(64 - BIN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            columns = [batch.column(k) for k in keys]
            group, sample = _numbered(columns)
            spectra = batch.column("_v").fill_null([])
            sizes = np.diff(spectra.offsets.to_numpy())
            values = spectra.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            band = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            owner = np.repeat(group, sizes)
            use = ~np.isnan(values)
            width = int(sizes.max(initial=0)) + 1
            bins = (_places(values[use] + 0.0) >> shift) + np.int64(1 << (BIN_BITS - 1))
            code, count = np.unique(((owner[use] * width + band[use]) << np.int64(BIN_BITS)) | bins, return_counts=True)
            cell, low = code >> np.int64(BIN_BITS), ((code & np.int64((1 << BIN_BITS) - 1)) - np.int64(1 << (BIN_BITS - 1))) << shift
            taken = pa.array(sample[cell // width])
            with np.errstate(invalid="ignore"):
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(taken) for c in columns), pa.array((cell % width).astype(np.int32)), pa.array(low), pa.array(count.astype(np.int64))],
                    names=[*keys, "band", "_bin", "_m"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least value of the first bin and of the bin behind the last one."""
    step = np.int64(1) << np.int64(64 - BIN_BITS)
    for batch in batches:
        low, last = (batch.column(c).to_numpy() for c in ("_low", "_last"))
        least, most = _places(np.array([-np.inf, np.inf]))  # beyond these lie the NaNs
        high = np.where(last > most - step, most, np.minimum(last, most - step) + step - 1)
        ends = [pa.array(_values(p.astype(np.int64)), pa.float64()) for p in (np.maximum(low, least), high)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*batch.schema.names, "_from", "_to"])


def band_medians(pixels: DataFrame, keys: Sequence[str], spectrum: str = "spectrum") -> DataFrame:
    """``keys, band, n, m``: the exact median of the present values of each band.

    NULL and NaN do not count; spectra may differ in length, and a NULL one has
    no bands.  A key with any share of the pixels leaves a task as counts, and
    in the second pass as values of the one or two bins around its medians.
    """
    keys = list(keys)
    cube = pixels.select(*keys, F.col(spectrum).cast("array<double>").alias("_v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cube.schema if f.name != "_v")
    bins = cube.mapInArrow(_counted(keys), f"{kinds}, band int, _bin long, _m long").groupBy(*keys, "band", "_bin").agg(F.sum("_m").alias("_m"))
    along = W.partitionBy(*keys, "band").orderBy("_bin")
    placed = (bins.withColumn("_before", F.coalesce(F.sum("_m").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("n", F.sum("_m").over(W.partitionBy(*keys, "band"))))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)

    def holds(rank):
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_m"))

    chosen = placed.where(holds(lower) | holds(upper)).groupBy(*keys, "band").agg(
        F.min("_bin").alias("_low"), F.max("_bin").alias("_last"), F.min("_before").alias("_before"), F.max("n").alias("n"))
    chosen = chosen.mapInArrow(_bounds, f"{kinds}, band int, _low long, _last long, _before long, n long, _from double, _to double")
    packed = chosen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("_from", "_to", "_before", "n")))).alias("_by"))
    packed = packed.select(*keys, F.transform(  # by place, so that a band finds its limits without a search
        F.sequence(F.lit(0), F.array_max(F.map_keys("_by"))), lambda b: F.try_element_at(F.col("_by"), b)).alias("_at"))
    # one entry per band of the sensor; a written table has a known size, and while it is small no spectrum is exchanged
    packed = durable(packed)
    near = cube.join(packed, keys).select(*keys, F.inline(F.filter(
        F.transform("_v", lambda v, b: F.struct(b.alias("band"), v.alias("x"), F.get("_at", b).alias("at"))),
        lambda s: (s["x"] >= s["at"]["_from"]) & (s["x"] <= s["at"]["_to"]))))
    equal = near.groupBy(*keys, "band", "x").agg(F.count(F.lit(1)).alias("_c"), F.first("at").alias("at"))
    upto = W.partitionBy(*keys, "band").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    ordered = equal.select("*", F.col("at.n").alias("n"), (F.col("at._before") + F.coalesce(F.sum("_c").over(upto), F.lit(0))).alias("_start"))

    def reached(rank):
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c"))

    return ordered.where(reached(lower) | reached(upper)).groupBy(*keys, "band").agg(
        F.max("n").alias("n"), ((F.min("x") + F.max("x")) / 2).alias("m"))
