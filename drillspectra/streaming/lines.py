"""Arriving line blocks and running column densities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """Files of one name pattern in a folder, or those inside folders of that name, as they arrive."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{file}}}")


def score_lines(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, state: str) -> None:
    """Stateless scoring of new line blocks into a parquet table; stops when caught up."""
    query = (
        score(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def running_density(stream: DataFrame, time: str, column: str, limit: float, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events, low values and their share per time window and column; rows more than ``late`` behind the newest are refused."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window), column)
        .agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("value") <= limit).cast("long")).alias("hits"))
        .select(F.col("window.start").alias("start"), column, "events", "hits", (F.col("hits") / F.col("events")).alias("density"))
    )


def append_closed(result: DataFrame, target: str, state: str) -> None:
    """Append each window once its end lies behind the watermark; its state is dropped then and later rows are refused."""
    query = (
        result.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
