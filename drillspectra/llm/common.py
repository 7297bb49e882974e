"""Registration and shared-storage helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard, durable, scratch_folder, ship_package

__all__ = ["QUERIES", "SQL", "crc32_sql", "discard", "durable", "fits", "query", "scratch_folder", "ship_package", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others with clashing names cannot interfere."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


_CRC = """CAST(list_reduce(list_prepend(4294967295, flatten(list_transform(range(length({0})),
  lambda k: list_concat([-1 - ascii(substr({0}, k + 1, 1))], [0, 0, 0, 0, 0, 0, 0, 0])))),
  lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS BIGINT)"""


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of an ASCII text that is not empty."""
    return f"xor({_CRC.format(text)}, 4294967295)"
