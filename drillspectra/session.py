"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("drillspectra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per application."""
    context = spark.sparkContext
    archive = f"drillspectra-{context.applicationId}.zip"
    if any(name.endswith(archive) for name in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    with zipfile.ZipFile(folder / archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(folder / archive))


def _checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and cut its lineage.

    A written table keeps its real size for the planner and is read column by
    column; losing an executor costs a re-read and no recomputation.  A table
    that this one ``replaces`` is deleted once the new one is written.
    """
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.durable_folder = folder
    if replaces is not None:
        discard(replaces)
    return out


def discard(table: DataFrame) -> None:
    """Delete a ``durable`` table that nothing reads any more."""
    folder = getattr(table, "durable_folder", None)
    if folder is not None:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_bounded(df: DataFrame, maximum_rows: int, what: str) -> list:
    """Bring a configuration-sized table to the driver, or refuse.

    One row more than the bound is asked for, so an oversized table is noticed
    without being pulled in.
    """
    rows = df.limit(maximum_rows + 1).collect()
    if len(rows) > maximum_rows:
        raise ValueError(f"{what} holds more than {maximum_rows} rows; process it in parts")
    return rows


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, so every executor reaches it."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
