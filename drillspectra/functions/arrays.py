"""Column builders over array columns; everything stays in the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal_doubles(values: Sequence[float]) -> Column:
    """A constant ``array<double>`` that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.from_json(
        F.lit(json.dumps([[float(v) for v in row] for row in rows])), "array<array<double>>"
    )


def finite(x: Column) -> Column:
    """Missing measurements are NULL: NaN and infinities never reach an aggregate."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Lambdas are not common-subexpression eliminated, so an expression named
    inside one would be computed again for every item.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column, floor: float = 1e-12) -> Column:
    """Unit vector; a vector with no length becomes zeros."""
    def divide(v: Column) -> Column:
        return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > floor, x / n).otherwise(0.0)))

    return let(a, divide)


def gather(a: Column, positions: Sequence[int]) -> Column:
    """Pick array items by zero-based position; a contiguous range is a slice."""
    positions = list(positions)
    if positions and positions == list(range(positions[0], positions[0] + len(positions))):
        return F.slice(a, positions[0] + 1, len(positions))
    return F.array(*[a[i] for i in positions])


def all_positive(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0))


def _present(a: Column) -> Column:
    return F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)))


def median(a: Column) -> Column:
    """Middle-mean median of the present items, NULL when none is present."""
    return let(
        _present(a),
        lambda s: (
            F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))
        ) / 2.0,
    )


def quantile(a: Column, fraction: float) -> Column:
    """Linearly interpolated quantile of the present items."""

    def pick(s: Column) -> Column:
        position = (F.size(s) - 1) * F.lit(float(fraction))
        low = F.floor(position).cast("int")
        first = F.get(s, low)
        second = F.coalesce(F.get(s, low + 1), first)
        return first + (second - first) * (position - low)

    return let(_present(a), pick)


def weighted_taps(a: Column, taps: Sequence[Sequence[tuple[int, float]]]) -> Column:
    """One output item per tap list: the weighted sum of the named input items."""
    plan = F.from_json(
        F.lit(json.dumps([[{"i": int(i), "w": float(w)} for i, w in row] for row in taps])),
        "array<array<struct<i:int,w:double>>>",
    )
    def apply(v: Column) -> Column:
        return F.transform(
            plan,
            lambda row: F.aggregate(row, F.lit(0.0), lambda acc, t: acc + F.get(v, t["i"]) * t["w"]),
        )

    return let(a, apply)
