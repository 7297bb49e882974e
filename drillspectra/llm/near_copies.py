"""MinHash near-dedup by fast similarity sketches, banding and exact verification (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import slices
from .common import durable, narrow, query, ship_package, table
from .components import components
from .shingles import WIDTH, band_keys, fast_sketches, fingerprints, shingle_sets

COORDINATES = 128
BANDS = 32
PERCENT = 75
#: Pairs whose sketches agree in fewer coordinates are not verified. At similarity 0.75 the share has
#: mean 0.75 and a deviation of at most 0.038, so 0.55 is more than five deviations away.
AGREE = int(0.55 * COORDINATES)
#: Buckets up to this size are unfolded into pairs; larger ones are compared inside block tasks.
PAIR_BUCKET = 32
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 2 << 20


def _sketched(width: int, coordinates: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                values, borders = shingle_sets(piece.column("text"), width)
                one, two = fingerprints(values, borders)
                sketch = fast_sketches(values, borders, coordinates)
                keys = band_keys(sketch, bands).view(np.int64).reshape(-1)
                short = (sketch & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(np.diff(borders)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), pa.array(keys)),
                ], names=["doc_id", "n_shingles", "fp1", "fp2", "sketch", "keys"])

    return run


def _stored_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                values, borders = shingle_sets(piece.column("text"), width)
                one, two = fingerprints(values, borders)
                yield pa.RecordBatch.from_arrays([
                    piece.column("rep"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array([values[s:e].tobytes() for s, e in zip(borders[:-1], borders[1:])], pa.binary()),
                ], names=["rep", "fp1", "fp2", "shingles"])

    return run


def _similar_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return run


def _block_links(percent: int):
    """Exact links inside one block or between two; only links that join different components leave."""

    def run(group: pa.Table) -> pa.Table:
        reps = group.column("rep").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        within = group.column("first")[0].as_py() == group.column("second")[0].as_py()
        side = group.column("block").to_numpy() == group.column("first")[0].as_py()
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(number) > 1
        column = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        use = shared[number]
        owner, place = owner[use], column[number[use]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for start in range(0, int(shared.sum()), width):
            lo, hi = np.searchsorted(place, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[lo:hi], place[lo:hi] - start] = 1
            common += part @ part.T
        x, y = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
        if not within:
            x, y = (v[side[x] != side[y]] for v in (x, y))
        parent = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        root = group.column("root").to_pylist()
        out = []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = find(root[i]), find(root[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(reps[i]), int(reps[j])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    1. One pass sketches each whole text. Rows with equal sets form a class; its smallest doc_id stands for it.
    2. Class sketches are cut into bands. In each bucket every class meets the smallest one; pairs whose
       sizes and sketches allow the similarity are verified on full sets.
    3. Buckets that still span several components go on: small ones unfold their remaining pairs,
       large ones are compared in blocks inside tasks, which emit only joining links. So no link is
       lost to a bucket's size and no bucket is turned into all of its pairs.

    A null, empty or word-free text has an empty set and is linked with nothing. Rows of one doc_id are
    one document. A null doc_id takes no part: its component is null and it is kept.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = durable(docs.mapInArrow(_sketched(width, coordinates, bands),
                                   "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary, keys array<long>"))
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = durable(full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    member = durable(full.select("doc_id", "fp1", "fp2", "n_shingles").join(classes, ["fp1", "fp2", "n_shingles"]).select("doc_id", "rep"))
    twice = (member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
             .where("a <> b").select("a", F.explode("reps").alias("b")))

    first = full.join(classes.select("rep", "fp1", "fp2"), (F.col("doc_id") == F.col("rep")) & (full.fp1 == classes.fp1) & (full.fp2 == classes.fp2), "left_semi") \
        .dropDuplicates(["doc_id", "fp1", "fp2"])
    spread = first.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    buckets = (spread.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("size"),
                                         F.sum("n").alias("total")).where("pivot <> last").drop("last"))
    inside = durable(spread.join(buckets, "key"))
    taking_part = inside.select("rep").distinct()
    texts = docs.join(taking_part, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = durable(texts.mapInArrow(_stored_sets(width), "rep long, fp1 long, fp2 long, shingles binary").dropDuplicates(["rep", "fp1", "fp2"]))
    sketches = durable(first.join(taking_part, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "sketch", "n_shingles"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate ``(a, b)``: size bound, sketch agreement, then full sets."""
        left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("na"))
        right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("nb"))
        near = (pairs.distinct().join(left, "a").join(right, "b")
                .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sketch_a", "sketch_b")
                .mapInArrow(_agreeing_rows(int(AGREE * coordinates / COORDINATES)), "a long, b long"))
        near = durable(near.distinct())
        return durable(near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
                       .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
                       .select("a", "b", "set_a", "set_b").mapInArrow(_similar_rows(percent), "a long, b long"))

    links = verified(inside.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))).union(twice)
    found = components(links)
    labelled = inside.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = durable(labelled.join(open_keys, "key"))

    small = rest.where(F.col("size") <= PAIR_BUCKET).select("key", "rep", "root", "n")
    pairs = (small.select("key", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
             .join(small.select("key", F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb")), "key")
             .where("a < b AND ra <> rb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    more = verified(pairs)

    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = (rest.where(F.col("size") > PAIR_BUCKET).withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep", "root"))
    dense = placed.join(sets.select("rep", "shingles"), "rep").groupBy("key", "first", "second").applyInArrow(_block_links(percent), "a long, b long")
    known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(known.union(more).union(dense))

    label = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    out = rows.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
