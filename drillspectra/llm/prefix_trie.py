"""Conversation prefix trie by a splitter skeleton (operator 11).

A conversation is a path of turns. Paths are range-partitioned into shards; the prefixes of the
splitter paths are the skeleton, a small trie that every task holds. All members of any other node
lie in one shard, which finishes that node alone; of skeleton nodes a shard gives partial aggregates,
which one reduction combines.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import crc32_sql, durable, narrow, query, ship_package, table

#: Bytes of a turn in a path: the first half of a SHA-256, so different turns do not meet.
TURN = 16
#: Paths of a shard, in bytes, with so much added for each conversation.
SHARD_BYTES = 16 << 20
ROW_BYTES = 64
#: Sampled paths per splitter, and the bytes all splitter paths may have together.
SAMPLE = 24
SKELETON_BYTES = 8 << 20
#: Ids in one piece of a long list of conversations that end at a skeleton node.
PIECE = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "skeleton long, parent_skeleton long, piece long, ends binary")


class Skeleton(NamedTuple):
    """The trie of splitter paths. Node 0 is the root; ``nodes[i][d]`` is splitter ``i``'s node at depth ``d``."""

    splitters: list[tuple[bytes, int]]
    nodes: list[np.ndarray]
    depth: np.ndarray
    parent: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(splitters: list[tuple[bytes, int, list[int]]]) -> Skeleton:
        """From ``(path, conv_id, sizes of the last texts)`` in order."""
        nodes, depth, parent, size = [], [0], [-1], [0]
        before, last = b"", np.zeros(1, np.int64)
        for path, _, sizes in splitters:
            shared = shared_turns(before, path)
            fresh = len(path) // TURN - shared
            new = np.arange(len(depth), len(depth) + fresh)
            parent += ([int(last[shared])] + new[:-1].tolist()) if fresh else []
            depth += range(shared + 1, shared + 1 + fresh)
            size += sizes[shared:]
            last = np.concatenate([last[: shared + 1], new])
            nodes.append(last)
            before = path
        return Skeleton([s[:2] for s in splitters], nodes, np.array(depth), np.array(parent), np.array(size))

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv))

    def facts(self) -> pa.Table:
        """Per node what its subtree's skeleton adds: one turn text is kept of each node, and its skeleton children."""
        kept, children = self.size.astype(np.int64), np.zeros(len(self.size), np.int64)
        for node in range(len(self.size) - 1, 0, -1):  # a child's number is above its parent's
            kept[self.parent[node]] += kept[node]
            children[self.parent[node]] += 1
        return pa.table({"skeleton": np.arange(len(self.size)), "depth": self.depth, "parent_skeleton": self.parent, "kept": kept, "branches": children})

    def above_ends(self) -> pa.Table:
        """``(tip, skeleton)``: each node without skeleton children, with itself and all nodes above it."""
        tips = np.setdiff1d(np.arange(len(self.size)), self.parent)
        rows, seen = [], set()
        for path in self.nodes:
            tip = int(path[-1])
            if tip in tips and tip not in seen:
                seen.add(tip)
                rows.append(np.column_stack([np.full(len(path), tip), path]))
        rows = np.concatenate(rows) if rows else np.zeros((1, 2), np.int64)
        return pa.table({"tip": rows[:, 0], "skeleton": rows[:, 1]})


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths have in common."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    differ = np.frombuffer(a, np.uint8, n * TURN) != np.frombuffer(b, np.uint8, n * TURN)
    return int(np.argmax(differ)) // TURN


class _Open:
    """A node whose members are still being read."""

    __slots__ = ("depth", "skeleton", "least", "convs", "children", "leaves", "saved", "size", "digest", "ends", "piece", "waiting")

    def __init__(self, depth: int, size: int, skeleton: int):
        self.depth, self.size, self.skeleton = depth, size, skeleton
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.digest, self.ends, self.piece, self.waiting = None, [], 0, []


class _Shard:
    """One shard's paths in order; ``rows`` gathers finished nodes, partial aggregates and pieces of end lists."""

    def __init__(self, number: int, skeleton: Skeleton):
        self.number = number
        #: The only skeleton nodes a shard can meet are those of the splitters on both sides of it.
        near = [i for i in (number - 1, number) if 0 <= i < len(skeleton.splitters)]
        self.sides = [(skeleton.splitters[i][0], skeleton.nodes[i]) for i in near]
        self.open = [_Open(0, 0, 0)]
        self.before = b""
        self.rows: list[tuple] = []

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        shared = shared_turns(self.before, path)
        self.close(shared)
        along = [(shared_turns(side, path), nodes) for side, nodes in self.sides] if self.open[-1].skeleton >= 0 else []
        for depth in range(shared + 1, len(path) // TURN + 1):
            self.open.append(_Open(depth, sizes[depth - 1], next((int(nodes[depth]) for common, nodes in along if depth <= common), -1)))
        top = self.open[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.skeleton >= 0:
            top.ends.append(conv)
            if len(top.ends) == PIECE:
                self._piece(top)
        elif top.digest is None:
            top.digest = hashlib.sha256(b"%d" % conv)
        else:
            top.digest.update(b",%d" % conv)
        self.before = path

    def _piece(self, node: _Open) -> None:
        self.rows.append((None,) * 8 + (node.skeleton, None, self.number << 32 | node.piece, ",".join(map(str, node.ends)).encode()))
        node.ends, node.piece = [], node.piece + 1

    def close(self, depth: int) -> None:
        """Finish all open nodes below ``depth``."""
        while len(self.open) > depth + 1:
            node, above = self.open.pop(), self.open[-1]
            self._finish(node)
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves += node.leaves
            above.saved += node.saved
            if node.skeleton < 0:
                above.children += 1
                self._wait(node, above)

    def _wait(self, node: _Open, above: _Open) -> None:
        """A row waits for its parent's smallest member, or names the skeleton node that will know it."""
        ends = node.digest.hexdigest() if node.digest else None
        if above.skeleton < 0:
            above.waiting.append((node.least, node.depth, node.convs, node.children, node.leaves, node.saved, ends))
        else:
            self.rows.append((node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, ends, None, above.skeleton, None, None))

    def _finish(self, node: _Open) -> None:
        if node.skeleton < 0:
            node.leaves += node.children == 0
            node.saved += (node.convs - 1) * node.size
            self.rows += [(least, depth, node.least, *rest, None, None, None, None) for least, depth, *rest in node.waiting]
        else:
            node.saved += node.convs * node.size
            if node.ends:
                self._piece(node)
            self.rows.append((node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, None, node.skeleton, None, None, None))

    def end(self) -> list[tuple]:
        self.close(0)
        self._finish(self.open[0])
        return self.take()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 3 + [pa.binary()]
    names = [f.split(" ")[0] for f in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _local(shared):
    """Finish what lies in one shard; a task reads its shards one after the other, each in path order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton, shard = shared.value, None
        for batch in batches:
            for number, path, conv, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "sizes"))):
                if shard is None or shard.number != number:
                    if shard is not None:
                        yield _emitted(shard.end())
                    shard = _Shard(number, skeleton)
                shard.add(path, conv, sizes)
                if len(shard.rows) >= 8192:
                    yield _emitted(shard.take())
        if shard is not None:
            yield _emitted(shard.end())

    return run


def _sharded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value
        for batch in batches:
            numbers = [skeleton.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per skeleton node over the pieces of its end list, which come in order and are not kept."""
    node, digest = None, None
    for batch in batches:
        done = []
        for skeleton, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends")):
            if skeleton != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = skeleton, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["skeleton", "hashed"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["skeleton", "hashed"])


def turn_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of ``turns(conv_id, turn, role, text)``: per turn its digest and text size, in order.

    Turns go by ``turn``, null first, then by digest, so repeated numbers have one order. A null role
    or text is empty. Rows without a conv_id take no part.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(F.encode(said, "UTF-8"), 256)), 1, TURN)
    one = F.struct(F.col("turn"), digest.alias("digest"), F.char_length(text).alias("size"))
    base = F.expr("conv_id - conv_id % 100")
    return (narrow(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").withColumn("conv_id", F.col("conv_id").cast("long")).select("conv_id", base.alias("base"), one.alias("one"))
            .repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns")))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation ``c`` begins with the first turns of conversation ``c - c % 100``, as many as a hash of ``c`` says (below 6)."""
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 5))).over(W.partitionBy("base"))  # up to 199 ids share a base
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    known = paths.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", h)
    return known.select("conv_id", F.expr("concat(slice(head, 1, h), slice(turns, h + 1, size(turns)))").alias("turns"))


def prefix_trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_bytes: int = SKELETON_BYTES) -> DataFrame:
    """All nodes of the trie of ``paths(conv_id, turns)``, ``turns`` an array of structs with ``digest`` and ``size``.

    Per node ``conv_id`` (the smallest of its conversations), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, ``ends_sha256`` of the conversations
    that end at it. A conversation without turns ends at the root; without any conversation there is
    no node. Ids must be distinct and not null.

    A group of equal conversations, however large, is cut by conv_id like any other range. Splitters
    are every ``SAMPLE``-th path of a bounded sample, and at most ``skeleton_bytes`` of them: with
    longer paths the shards grow instead. A shard is read as a stream; what a task holds are the open
    nodes of one path with their children's rows. A conversation's turns are one row, ``TURN`` + 4
    bytes each.
    """
    spark = paths.sparkSession
    ship_package(spark)
    digests = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    rows = durable(paths.select("conv_id", F.unhex(digests).alias("path"), F.col("turns.size").alias("sizes")))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("path") + ROW_BYTES), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-total["bytes"] // shard_bytes), min(total["n"] // 64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    chosen = []
    if shards > 1:
        share = min(1.0, SAMPLE * shards / total["n"])
        drawn = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(share * (1 << 40)))  # a sample of some SAMPLE * shards rows
        step = max(1, drawn.count() // shards)
        place = F.row_number().over(W.orderBy("path", "conv_id"))
        placed = drawn.select("conv_id", "path", "sizes", place.alias("place")).where(F.col("place") % step == 0)
        weight = F.sum(F.octet_length("path") + ROW_BYTES).over(W.partitionBy())
        placed = placed.withColumn("thin", F.ceil(weight / skeleton_bytes)).where(F.expr(f"(place DIV {step}) % thin = 0"))
        chosen = sorted((bytes(r["path"]), r["conv_id"], r["sizes"]) for r in placed.collect())
    skeleton = Skeleton.of(chosen)
    shared = spark.sparkContext.broadcast(skeleton)

    sharded = rows.mapInArrow(_sharded(shared), "shard long, conv_id long, path binary, sizes array<int>")
    found = durable(sharded.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_local(shared), _NODE))

    facts = F.broadcast(spark.createDataFrame(skeleton.facts()))  # within skeleton_bytes
    above = spark.createDataFrame(skeleton.above_ends())
    sums = (found.where("skeleton IS NOT NULL AND piece IS NULL").groupBy("skeleton")
            .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    sums = sums.join(facts, "skeleton").withColumn("n_children", F.col("n_children") + F.col("branches")).where("conv_id IS NOT NULL")
    tips = (above.join(sums.where("n_children = 0").select(F.col("skeleton").alias("tip")), "tip").groupBy("skeleton").agg(F.count("*").alias("tips")))
    ends = (found.where("piece IS NOT NULL").select("skeleton", "piece", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "piece")
            .mapInArrow(_hashed, "skeleton long, hashed string"))
    whole = sums.join(tips, "skeleton", "left").join(ends, "skeleton", "left")
    whole = durable(whole.select("skeleton", "conv_id", F.col("depth"), "parent_skeleton", "n_convs", "n_children",
                                 (F.col("n_leaves") + F.coalesce("tips", F.lit(0))).alias("n_leaves"),
                                 (F.col("saved_tokens") - F.col("kept")).alias("saved_tokens"), F.col("hashed").alias("ends_sha256")))
    names = F.broadcast(whole.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("known")))  # within skeleton_bytes
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = found.where("skeleton IS NULL").join(names, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "known"))
    upper = whole.join(names, "parent_skeleton", "left").withColumnRenamed("known", "parent_conv_id")
    return local.select(columns).union(upper.select(columns)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h,
    list(said ORDER BY turn NULLS FIRST, sha256(strlen(said.role) || ':' || said.role || said.text)) AS turns FROM turns GROUP BY conv_id
), again AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM again
), nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL
), children AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), grown AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.depth].text) END AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
), above AS (
  SELECT n_children, saved, path, unnest(range(depth + 1)) AS up FROM grown
), sums AS (
  SELECT up AS depth, path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON s.depth = g.depth AND s.path = g.path LEFT JOIN nodes p ON p.depth = g.depth - 1 AND p.path = g.path[1:g.depth - 1]
"""


@query("op11_prefix_trie", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_paths(table(spark, sf_dir, "conversations"))))
