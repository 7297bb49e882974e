"""Functions a user can call from SQL."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

from . import kernels as K

FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("scale", "rms", "quality")])


@arrow_udf(T.DoubleType())
def spectral_angle(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = K._matrix(left), K._matrix(right)
    if not len(a):
        return pa.array([], type=pa.float64())
    cosine = np.sum(K._units(a) * K._units(b), axis=1)
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    return pa.array(angle, mask=~np.isfinite(angle))


@arrow_udf(FIT)
def feature_fit(pixel: pa.Array, reference: pa.Array) -> pa.Array:
    p, r = K._matrix(pixel), K._matrix(reference)
    energy, cross = np.sum(r * r, axis=1), np.sum(p * r, axis=1)
    scale = np.divide(cross, energy, out=np.zeros_like(cross), where=energy > 0)
    rms = np.sqrt(np.maximum(np.sum(p * p, axis=1) - 2 * scale * cross + scale**2 * energy, 0) / p.shape[1])
    quality = np.where(scale > 0, scale / np.maximum(rms, 1e-12), 0.0)
    return pa.StructArray.from_arrays(
        [pa.array(scale), pa.array(rms), pa.array(quality)], names=["scale", "rms", "quality"]
    )


@pandas_udf(T.DoubleType())
def best_two_mean(values: pd.Series) -> float:
    """Mean of the two smallest present values of a pixel's mineral."""
    return float(values.dropna().nsmallest(2).mean())


def register_scalars(spark: SparkSession, axis: Sequence[float], positions: Sequence[int]) -> None:
    spark.udf.register("spectral_angle", spectral_angle)
    spark.udf.register("feature_fit", feature_fit)
    spark.udf.register("smooth5", K.smooth(len(axis), 5))
    spark.udf.register("smooth11", K.smooth(len(axis), 11))
    spark.udf.register("absorption_segmented", K.absorb(axis, positions, "segmented"))
    spark.udf.register("absorption_hull", K.absorb(axis, positions, "hull"))


def register_feature_table(spark: SparkSession, axis: Sequence[float], definitions: Sequence[dict]) -> None:
    grid = np.asarray(axis, dtype=float)
    plan, names = K.FeaturePlan(grid, definitions), [d["id"] for d in definitions]
    starts = [d["window_nm"][0] if d["type"] == "center_nm" else 0.0 for d in definitions]
    spans = [max(d["window_nm"][1] - d["window_nm"][0], 1.0) if d["type"] == "center_nm" else 1.0 for d in definitions]

    @udtf(returnType="feature_id string, value double")
    class SpectrumFeatures:
        def eval(self, curve):
            values = plan(np.asarray(curve, dtype=float)[None, :])[0]
            yield from zip(names, (float(s + v * w) for s, v, w in zip(starts, values, spans)))

    spark.udtf.register("spectrum_features", SpectrumFeatures)
