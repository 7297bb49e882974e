"""Exact top-k inner products by a three-phase uniform threshold (operator 6).

A score is the sum of ``LISTS`` partial scores, one for each slice of the components.

1. Every task keeps, per query, the entries that lead one of its partial score lists, completes
   their sums and reports the best ones. The worst of the best of all tasks is a safe cutoff.
2. The cutoff is broadcast. An entry can only reach it if one of its partial scores reaches an equal
   share of it; exactly those entries are collected, task by task.
3. The missing partial scores of the collected entries are added, and entries that reach the cutoff
   are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import collect_bounded
from .common import durable, query, ship_package, table

TOP = 5
LISTS = 2
#: Entries that a task takes from the head of each of its score lists.
HEAD = 16
#: Queries that are compared in one pass; each pass broadcasts no more than these.
QUERY_BLOCK = 2048
EVERY = 50
_ROWS = 2048


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integer components; shorter rows continue with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(column), width), np.int64)
    row, place = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, int)])
    values = column.flatten().to_numpy()
    keep = place < width
    out[row[keep], place[keep]] = values[keep]
    return out


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point multiplies where its 53 bits hold every sum."""
    top = max(int(np.abs(rows).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * max(rows.shape[1], 1)
    if top < 1 << 53:
        return rows.astype(np.float64) @ queries.astype(np.float64).T
    return rows @ queries.T


def _parts(rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    cuts = np.linspace(0, queries.shape[1], LISTS + 1).astype(int)
    return [_products(rows[:, a:b], queries[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _leading(shared, top: int):
    """Phase 1: per query the best ``top`` completed sums among the heads of the task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = np.full((top, len(queries)), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                parts = _parts(_matrix(batch.column("ints").slice(start, _ROWS), queries.shape[1]), queries)
                total = sum(parts)
                heads = []
                for part in parts:
                    head = min(HEAD, len(part))
                    at = np.argpartition(-part, head - 1, axis=0)[:head]
                    heads.append(at)
                at = np.sort(np.concatenate(heads), axis=0)
                found = np.take_along_axis(total, at, axis=0).astype(np.float64)
                found[1:][at[1:] == at[:-1]] = -np.inf
                both = np.concatenate([best, found])
                best = -np.sort(-both, axis=0)[:top]
        where, which = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(best[where, which])], names=["place", "score"])

    return run


def _sufficient(shared):
    """Phases 2 and 3: entries with a partial score of at least the share, completed, if they reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoff = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                parts = _parts(_matrix(piece.column("ints"), queries.shape[1]), queries)
                enough = np.logical_or.reduce([part >= cutoff / LISTS for part in parts])
                row, which = np.nonzero(enough)
                score = sum(part[row, which] for part in parts)
                keep = score >= cutoff[which]
                row, which, score = row[keep], which[keep], score[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which.astype(np.int32)), piece.column("ids").take(pa.array(row)), pa.array(score.astype(np.int64))], names=["place", "ids", "score"])

    return run


def exact_top(vectors: DataFrame, wanted: DataFrame, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``wanted(query_id, ints)`` against ``vectors(vec_id, ints)``.

    Equal vectors are one entry with its smallest ids, so any number of copies costs no more than one.
    The smaller vec_id wins a tie, a query never meets its own vec_id, and repeated rows of a vec_id
    with the same vector count once. A query with fewer candidates returns all of them. A shorter
    vector continues with zeros.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    copies = W.partitionBy("ints").orderBy("vec_id")
    entries = durable(vectors.select("vec_id", "ints").distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= top + 1)
                      .groupBy("ints").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    wanted = durable(wanted.select("query_id", "ints").distinct())
    blocks = max(-(-wanted.count() // QUERY_BLOCK), 1)
    found = None
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = sorted(collect_bounded(mine, 2 * QUERY_BLOCK, "a block of queries"))
        if not rows:
            continue
        queries = _matrix(pa.array([r["ints"] for r in rows], pa.list_(pa.int64())))
        reported = entries.select("ints").mapInArrow(_leading(spark.sparkContext.broadcast(queries), top + 1), "place int, score double")
        least = (reported.withColumn("n", F.row_number().over(W.partitionBy("place").orderBy(F.desc("score")))).where(F.col("n") == top + 1))
        cutoff = np.full(len(rows), -np.inf)
        for r in least.select("place", "score").collect():  # one number per query of the block
            cutoff[r["place"]] = r["score"]
        collected = entries.mapInArrow(_sufficient(spark.sparkContext.broadcast((queries, cutoff))), "place int, ids array<long>, score long")
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], "place int, query_id long")
        part = (collected.join(names, "place").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"))
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, score long, vec_id long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, ints``: components floor(256 x); rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return (embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~odd)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("ints")))


SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s QUALIFY rank <= {TOP}"""


@query("op6_exact_topk", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top(vectors, vectors.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id"))
