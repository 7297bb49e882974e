"""Mixing sources to target weights by Pfair scheduling (operator 9).

A source's documents, in a fixed shuffled order, are cut into blocks of equal bytes. With target
share ``w`` its block ``b`` (from 0) may not stand before slot ``floor(b / w)`` and must stand before
slot ``ceil((b + 1) / w)``; one block stands in each slot, of those released the one with the
earliest deadline. Every source then is less than one block away from its share at every slot, as
long as no source has run out.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import collect_bounded
from .common import query, table

BLOCK_BYTES = 64 << 10
#: The schedule repeats after the common denominator of the shares; one beyond this is rounded to it.
LONGEST_PERIOD = 1 << 20
#: Default shares follow the sources' bytes to this power, so large sources give way to small ones.
SMOOTHING = 0.7
MOST_SOURCES = 1 << 20
_CELL_ROWS = 20_000
_SHARES = pa.schema([("_key", pa.string()), ("_share", pa.int64()), ("_tail", pa.int64())])
_TURNS = pa.schema([("_key", pa.string()), ("_turn", pa.int64()), ("_slot", pa.int64())])


def shares(weights: dict[str, float | Fraction], longest: int = LONGEST_PERIOD) -> tuple[dict[str, int], int]:
    """``(slots of each source, period)``: exactly the weights' proportions, as their decimals state them.

    Only weights whose common denominator is beyond ``longest`` are rounded: by the largest remainders
    to whole slots of that period (16 slots a source at least), with one slot for each source.
    """
    exact = {k: v if isinstance(v, Fraction) else Fraction(str(v)) for k, v in weights.items()}
    if any(v <= 0 for v in exact.values()):
        raise ValueError("weights are above zero")
    total = sum(exact.values())
    parts = {k: v / total for k, v in exact.items()}
    period = 1
    for part in parts.values():
        period = lcm(period, part.denominator)
        if period > longest:
            break
    else:
        return {k: int(part * period) for k, part in parts.items()}, period
    period = max(longest, 16 * len(parts))
    slots = {k: max(1, int(part * period)) for k, part in parts.items()}
    order = sorted(parts, key=lambda k: (int(parts[k] * period) - parts[k] * period, k))
    rest = period - sum(slots.values())
    for k in order[: max(rest, 0)]:
        slots[k] += 1
    for k in sorted(slots, key=lambda k: (-slots[k], k))[: max(-rest, 0)]:
        slots[k] -= 1
    return slots, period


def period_schedule(slots: dict[str, int], period: int, length: int | None = None) -> list[tuple[str, int, int]]:
    """``(source, block, slot)`` of the first ``length`` slots of a period: earliest deadline first among the released blocks."""
    waiting = sorted((0, k) for k in slots)
    ready: list[tuple[int, str, int]] = []
    done = {k: 0 for k in slots}
    out = []
    for slot in range(min(period, length if length is not None else period) if slots else 0):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[k] + 1) * period // slots[k]), k, done[k]))
        deadline, k, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline is missed")
        out.append((k, block, slot))
        done[k] = block + 1
        if done[k] < slots[k]:
            heapq.heappush(waiting, (done[k] * period // slots[k], k))
    return out


def mixed(rows: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, longest: int = LONGEST_PERIOD,
          smoothing: float = SMOOTHING) -> DataFrame:
    """``row, block, release, deadline, slot, place`` of every row of ``rows(doc_id, source, size, ...)``; nothing is dropped or repeated.

    ``slot`` is the block's place in the mixture and ``place`` the document's place in its block, so
    ordering by both gives the mixture; slots of a source that has run out stay empty. A document
    belongs to the block in which it starts. Shares come from ``weights`` or from the sources' sizes; a
    source with no weight or a weight of zero follows behind all others, without release and deadline.
    A null source is a source of its own, a null size counts as nothing, a null doc_id has its place
    like any other; rows that repeat a doc_id stand next to each other only if they are equal.
    """
    spark = rows.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    bytes_ = F.coalesce(F.col("size").cast("long"), F.lit(0)) + 1
    placed = rows.select(row.alias("row"), key.alias("_key"), bytes_.alias("_bytes"), F.xxhash64(row).alias("_draw"))
    known = placed.groupBy("_key").agg(F.sum("_bytes").alias("total"), F.count("*").alias("n"))
    found = {r["_key"]: r for r in collect_bounded(known, MOST_SOURCES, "the table of sources")}
    if weights is not None:
        given = {k: weights.get(k[1:] if k else None) or 0 for k in found}
    else:
        given = {k: float(r["total"]) ** smoothing for k, r in found.items()}
    slots, period = shares({k: v for k, v in given.items() if v}, longest)
    blocks = {k: -(-r["total"] // block_bytes) for k, r in found.items()}
    length = max((-(-blocks[k] * period // n) for k, n in slots.items()), default=0)  # by then every source has run out
    tail, behind = -(-length // period) * period, []
    for k in sorted(set(found) - set(slots)):
        behind.append((k, tail))
        tail += blocks[k]
    share = pa.table({"_key": [*sorted(slots), *(k for k, _ in behind)], "_share": [*(slots[k] for k in sorted(slots)), *(None for _ in behind)],
                      "_tail": [*(None for _ in slots), *(at for _, at in behind)]}, _SHARES)
    share = F.broadcast(spark.createDataFrame(share))  # one row per source
    turns = period_schedule(slots, period, length)
    plan = pa.table({"_key": [t[0] for t in turns], "_turn": [t[1] for t in turns], "_slot": [t[2] for t in turns]}, _TURNS)
    plan = F.broadcast(spark.createDataFrame(plan))  # at most one row per slot of a period

    rank = max(max((r["n"] for r in found.values()), default=0) // _CELL_ROWS, 1).bit_length() + 4
    placed = placed.withColumn("_cell", F.shiftright("_draw", 64 - min(rank, 40)))
    cells = placed.groupBy("_key", "_cell").agg(F.sum("_bytes").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_key").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_key", "_cell", before.alias("_before"))  # a source has 2**rank cells, however many rows
    inside = W.partitionBy("_key", "_cell").orderBy("_draw", "row.doc_id", "_bytes")
    begun = F.coalesce(F.sum("_bytes").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_begun", begun).join(cells, ["_key", "_cell"]).withColumn("_at", F.col("_before") + F.col("_begun"))
    placed = placed.withColumn("block", F.expr(f"_at DIV {block_bytes}")).withColumn("place", F.col("_at") % block_bytes)
    placed = placed.join(share, "_key").withColumn("_turn", F.col("block") % F.col("_share")).join(plan, ["_key", "_turn"], "left")
    return placed.select(
        "row", "block", F.expr(f"block * {period} DIV _share").alias("release"),
        F.expr(f"((block + 1) * {period} + _share - 1) DIV _share").alias("deadline"),
        F.coalesce(F.expr(f"block DIV _share * {period} + _slot"), F.expr("_tail + block")).alias("slot"), "place")


@query("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    return mixed(docs).select("row.doc_id", "row.source", "block", "release", "deadline", "slot", "place")
