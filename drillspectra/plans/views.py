"""The scan domain expressed over the given tables, in Spark and in SQL.

Both sides start from integer sums, so every view value is the same double in
either engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import durable

BANDS = 64
AXIS = [1000.0 + 20.0 * band for band in range(BANDS)]
SAMPLES = 32
SCENE_LINES = 1000
#: Vectors of one spectrum scene: four full scan lines and a part of a fifth.
SCENE_VECTORS = 110
KEY = ["scene_id", "line", "sample"]


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        """One row per scanned pixel with its spectrum; 25 detector columns."""
        v = F.col("vec_id")
        return self.table("embeddings").select(
            F.concat(F.lit("S"), F.floor(v / SCENE_VECTORS).cast("string")).alias("scene_id"),
            F.floor((v % SCENE_VECTORS) / 25).cast("int").alias("line"),
            (v % SCENE_VECTORS % 25).cast("int").alias("sample"),
            F.col("vec_id"),
            F.col("label").cast("int").alias("label"),
            F.transform("embedding", lambda x: x.cast("double") + 1.0).alias("spectrum"),
        )

    @cached_property
    def px(self) -> DataFrame:
        """Pixels with one row per band."""
        return self.pixels.select(
            *KEY, "vec_id", "label", F.posexplode("spectrum").alias("band", "v")
        ).withColumn("w", (1000 + 20 * F.col("band")).cast("double"))

    @cached_property
    def refs(self) -> DataFrame:
        """Reference library: of each mineral the spectra with the highest peak, the deepest band and the widest range.

        Chosen over all rows by combinable maxima; one spectrum may be extreme in several ways.
        """
        row = F.struct("vec_id", "embedding")
        highest, deepest = F.array_max("embedding"), F.array_min("embedding")
        extremes = [F.max(F.struct(x.alias("x"), (-F.col("vec_id")).alias("first"), row.alias("row")))["row"]
                    for x in (highest, -deepest, highest - deepest)]
        return (
            self.table("embeddings").groupBy("label").agg(F.array_distinct(F.array(*extremes)).alias("rows"))
            .select("label", F.inline("rows")).select(
                F.col("label").cast("int").alias("mineral"),
                F.floor(F.col("label") / 3).cast("int").alias("group_no"),
                F.col("vec_id").alias("ref_id"),
                F.transform("embedding", lambda x: x.cast("double") + 1.0).alias("spectrum"),
            )
        )

    @cached_property
    def cells(self) -> DataFrame:
        """Score plane: one row per scanned (part, supplier column) cell."""
        part = F.col("l_partkey")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        return (
            self.table("lineitem")
            .groupBy(
                F.concat(F.lit("S"), F.floor(part / SCENE_LINES).cast("string")).alias("scene_id"),
                (part % SCENE_LINES).cast("int").alias("line"),
                (F.col("l_suppkey") % SAMPLES).cast("int").alias("sample"),
            )
            .agg(
                F.sum(cents).alias("cents"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("l_quantity").cast("long")).alias("qty"),
                F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
                F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
            )
            .select(
                *KEY,
                (F.col("cents").cast("double") / (F.col("n") * 105000000.0)).alias("score"),
                (F.col("disc").cast("double") / (F.col("n") * 10.0)).alias("confidence"),
                (F.col("qty").cast("double") / (F.col("n") * 50.0)).alias("depth"),
                (F.col("tax").cast("double") / (F.col("n") * 8.0)).alias("margin"),
                (F.col("qty") % 3 + 1).cast("int").alias("class_id"),
            )
        )

    def written(self, *values: str) -> Views:
        """These views over a score plane that is grouped once and written, for queries that read it often."""
        out = Views(self.spark, self.folder)
        out.cells = durable(self.cells.select(*KEY, *values))
        out.frames = durable(out.frames)
        return out

    @cached_property
    def frames(self) -> DataFrame:
        """Lines and detector columns of every score plane."""
        return self.cells.groupBy("scene_id").agg(
            (F.max("line") + 1).alias("lines"), (F.max("sample") + 1).alias("samples")
        )

    @cached_property
    def pixel_frames(self) -> DataFrame:
        return self.pixels.groupBy("scene_id").agg(
            (F.max("line") + 1).alias("lines"), (F.max("sample") + 1).alias("samples")
        )

    @cached_property
    def valid(self) -> DataFrame:
        """Material mask: scanned cells in 40-line boxes, 20 lines apart."""
        return self.cells.where("line % 60 < 40").select(*KEY)

    @cached_property
    def striped(self) -> DataFrame:
        """Classified cells with three over-dense detector columns."""
        return self.cells.where("line % 60 < 40").where(
            "score <= 0.004 or (sample % 11 = 5 and score <= 0.05)"
        )

    @cached_property
    def candidate(self) -> DataFrame:
        """Candidate cells at a moderate threshold."""
        return self.cells.where("line % 60 < 40 and score <= 0.03")

    @cached_property
    def measurements(self) -> DataFrame:
        """Library measurements: a named curve per part, one source per brand."""
        k, size = F.col("p_partkey"), F.col("p_size")
        words = F.split("p_name", " ")
        adjective, noun = words[0], words[1]
        name = (
            F.when(k % 5 == 0, F.concat(noun, F.lit(" "), F.col("p_brand")))
            .when(k % 5 == 1, F.concat(noun, F.lit("/"), adjective))
            .when(k % 5 == 2, F.concat(noun, F.lit(" bearing "), F.col("p_type")))
            .when(k % 5 == 3, F.concat(adjective, F.lit("_"), noun))
            .otherwise(F.concat(F.lit('"'), F.initcap(noun), F.lit("  "), F.col("p_type"), F.lit('"')))
        )
        values = F.array(
            (size - 3).cast("double"), (size % 7).cast("double"), F.when(k % 31 != 0, size / 50.0),
            F.when(k % 97 == 0, 0.5).otherwise((k % 13).cast("double")),
        )
        return self.table("part").select(
            k.alias("measurement_id"), F.col("p_brand").alias("source_id"), name.alias("raw_name"),
            noun.alias("phase"), F.when(k % 3 == 0, F.col("p_type")).alias("sample_code"),
            F.when(k % 97 == 0, F.array(*[F.lit(0.5)] * 4)).otherwise(values).alias("values"),
            F.concat_ws(",", size.cast("string"), F.col("p_type")).alias("curve_text"),
            F.col("p_retailprice").alias("price"), size.cast("int").alias("size"),
        )


SQL_VIEWS = {
    "pixels": f"""SELECT 'S' || CAST(vec_id // {SCENE_VECTORS} AS VARCHAR) AS scene_id,
        CAST((vec_id % {SCENE_VECTORS}) // 25 AS INTEGER) AS line, CAST(vec_id % {SCENE_VECTORS} % 25 AS INTEGER) AS sample,
        vec_id, CAST(label AS INTEGER) AS label,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1.0) AS spectrum FROM embeddings""",
    "px": """SELECT scene_id, line, sample, vec_id, label, CAST(b AS INTEGER) AS band,
        spectrum[b + 1] AS v, CAST(1000 + 20 * b AS DOUBLE) AS w FROM pixels, range(64) t(b)""",
    "refs": """SELECT DISTINCT CAST(e.label AS INTEGER) AS mineral, CAST(e.label // 3 AS INTEGER) AS group_no,
        e.vec_id AS ref_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) + 1.0) AS spectrum
        FROM embeddings e JOIN (SELECT label, unnest([
            arg_max(vec_id, struct_pack(x := list_max(embedding), f := -vec_id)),
            arg_max(vec_id, struct_pack(x := -list_min(embedding), f := -vec_id)),
            arg_max(vec_id, struct_pack(x := list_max(embedding) - list_min(embedding), f := -vec_id))]) AS vec_id
          FROM embeddings GROUP BY label) k ON k.vec_id = e.vec_id""",
    "cells": """SELECT scene_id, line, sample, CAST(cents AS DOUBLE) / (n * 105000000.0::DOUBLE) AS score,
        CAST(disc AS DOUBLE) / (n * 10.0::DOUBLE) AS confidence, CAST(qty AS DOUBLE) / (n * 50.0::DOUBLE) AS depth,
        CAST(tax AS DOUBLE) / (n * 8.0::DOUBLE) AS margin, CAST(qty % 3 + 1 AS INTEGER) AS class_id
        FROM (SELECT 'S' || CAST(l_partkey // 1000 AS VARCHAR) AS scene_id,
          CAST(l_partkey % 1000 AS INTEGER) AS line, CAST(l_suppkey % 32 AS INTEGER) AS sample,
          CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n,
          CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
          CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
          CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
          FROM lineitem GROUP BY ALL)""",
    "measurements": """SELECT p_partkey AS measurement_id, p_brand AS source_id,
        CASE p_partkey % 5 WHEN 0 THEN noun || ' ' || p_brand WHEN 1 THEN noun || '/' || adj
          WHEN 2 THEN noun || ' bearing ' || p_type WHEN 3 THEN adj || '_' || noun
          ELSE '"' || upper(noun[1]) || noun[2:] || '  ' || p_type || '"' END AS raw_name,
        noun AS phase, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS sample_code,
        CASE WHEN p_partkey % 97 = 0 THEN [0.5::DOUBLE, 0.5, 0.5, 0.5] ELSE [CAST(p_size - 3 AS DOUBLE), CAST(p_size % 7 AS DOUBLE),
          CASE WHEN p_partkey % 31 <> 0 THEN p_size / 50.0::DOUBLE END, CAST(p_partkey % 13 AS DOUBLE)] END AS values,
        CAST(p_size AS VARCHAR) || ',' || p_type AS curve_text, p_retailprice AS price, CAST(p_size AS INTEGER) AS size
        FROM (SELECT *, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part)""",
    "frames": """SELECT scene_id, CAST(max(line) + 1 AS INTEGER) AS lines,
        CAST(max(sample) + 1 AS INTEGER) AS samples FROM cells GROUP BY scene_id""",
    "valid": "SELECT scene_id, line, sample FROM cells WHERE line % 60 < 40",
    "striped": """SELECT * FROM cells WHERE line % 60 < 40
        AND (score <= 0.004 OR (sample % 11 = 5 AND score <= 0.05))""",
    "candidate": "SELECT * FROM cells WHERE line % 60 < 40 AND score <= 0.03",
}


def with_views(sql: str) -> str:
    """Prefix the views the text names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    body = sql.strip()
    match = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.IGNORECASE)
    if match:
        return f"WITH RECURSIVE {head},\n{body[match.end():]}"
    return f"WITH RECURSIVE {head}\n{body}"
