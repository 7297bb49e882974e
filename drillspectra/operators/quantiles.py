"""Exact, linearly interpolated quantiles that never hold a group in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import literal_doubles
from ..session import durable

#: Bins per doubling of a value's size, and a place above all exponents of a double.
FINENESS = 512
_ABOVE = 1100


def magnitude_bin(x: Column, fineness: int = FINENESS) -> Column:
    """A whole number that never falls as ``x`` grows; it needs no range of the data to be known first."""
    size = F.abs(x)
    place = F.floor(F.log2(size) * fineness) + F.lit(_ABOVE * fineness)
    place = F.when(size == float("inf"), F.lit(2 * _ABOVE * fineness)).otherwise(place)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * place).cast("long")


def exact_quantile_array(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], fineness: int = FINENESS,
    weight: str | None = None,
) -> DataFrame:
    """``keys, n, qs``: one interpolated quantile per fraction, in order.

    One pass counts the values of every key by size, combined before the
    exchange; the counts tell which bin holds each wanted rank.  A second pass
    keeps only values in those bins, counts equal ones together and orders them
    inside (key, bin).  A hot key is therefore spread over its bins, and a value
    that many rows share is one row.  ``weight`` names a count column.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(
        *keys, x.alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_c"), magnitude_bin(x, fineness).alias("_bin"))
    counts = rows.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_m"))
    along = W.partitionBy(*keys).orderBy("_bin")
    steps = literal_doubles(fractions)
    ranks = F.array_distinct(F.flatten(F.transform(
        steps, lambda f: F.array(F.floor((F.col("n") - 1) * f), F.ceil((F.col("n") - 1) * f)))))

    def inside(start: str, length: str):
        return lambda r: (r >= F.col(start)) & (r < F.col(start) + F.col(length))

    chosen = (
        counts.withColumn("_before", F.coalesce(F.sum("_m").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("_m").over(W.partitionBy(*keys)))
        .withColumn("_ranks", F.filter(ranks, inside("_before", "_m")))
        .where(F.size("_ranks") > 0).select(*keys, "_bin", "_before", "_ranks", "n")
    )
    # a written table has a known size: while it is small the values meet it in place, and only those in its bins are exchanged
    chosen = durable(chosen)
    # values are counted by hash before they meet the ranks, so no task sorts them beside arrays
    equal = rows.join(chosen.select(*keys, "_bin"), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_x").agg(
        F.sum("_c").alias("_c")).join(chosen, [*keys, "_bin"])
    upto = W.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
    ordered = equal.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    hits = ordered.select(*keys, "n", "_x", F.explode(F.filter("_ranks", inside("_start", "_c"))).alias("_rank"))
    known = hits.groupBy(*keys).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def interpolate(f):
        position = (F.col("n") - 1) * f
        low = F.col("_at")[F.floor(position)]
        between = low + (F.col("_at")[F.ceil(position)] - low) * (position - F.floor(position))
        return F.when(position == F.floor(position), low).otherwise(between)

    return known.select(*keys, "n", F.transform(steps, interpolate).alias("qs"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], fineness: int = FINENESS,
    weight: str | None = None,
) -> DataFrame:
    """``keys, n, q0, q1, ...`` for the given fractions."""
    arrays = exact_quantile_array(df, keys, value, fractions, fineness, weight)
    return arrays.select(*keys, "n", *[F.col("qs")[i].alias(f"q{i}") for i in range(len(fractions))])
