"""Benchmark decontamination by pigeonhole edit matching (operator 4)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import collect_bounded
from .arrays import slices
from .common import query, ship_package, table

#: Edits allowed per byte of a normalised item.
ERROR_RATE = 0.1
#: Normalised items below this many bytes say too little to allow edits; they are held as whole words only.
SHORTEST_ITEM = 24
#: Items matched in one pass; each pass broadcasts no more than these.
ITEM_BLOCK = 10_000

_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
MATCHES = "array<struct<item_id:long,distance:int>>"


def folded(text: str) -> bytes:
    """Lower case, with every run of other than letters and digits as one space; UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def pieces(item: bytes, budget: int) -> list[tuple[int, bytes]]:
    """``budget + 1`` pieces that cover the item; ``budget`` edits leave one of them untouched."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def masks_of(item: bytes) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for at, byte in enumerate(item):
        out[byte] |= 1 << at
    return out


def closest(masks: dict[int, int], size: int, window: bytes, stop_at: int = 0) -> int:
    """Least edit distance between the item and any part of the window (Myers' bit vectors).

    Columns are kept as vertical differences; the text may start anywhere, so no cost flows in from above.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, size
    get = masks.get
    for byte in window:
        equal = get(byte, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop_at:
                    return best
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best


class Matcher:
    """All items of a block: an automaton over their pieces, and Myers' distance around its hits.

    Items below SHORTEST_ITEM have an automaton of their own, of their words between spaces.

    A hit climbs a binary tree over the item's pieces. If the item is held with at most one edit less
    than it has pieces, the same is true of one half of its pieces, and so on down to an untouched
    piece; so a hit only goes on while the span above it is close enough, and few reach the item.
    """

    def __init__(self, items: list[tuple[object, bytes]], rate: float):
        import ahocorasick

        self.items = items
        self.cuts: list[list[int]] = []
        self.paths: list[list[list[tuple[int, int]]]] = []
        self.masks: dict[tuple[int, int, int], dict[int, int]] = {}
        where: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        short: dict[bytes, list[int]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            if len(text) < SHORTEST_ITEM:
                self.cuts.append([])
                self.paths.append([])
                if text:
                    short[b" " + text + b" "].append(number)
                continue
            parts = pieces(text, int(rate * len(text)))
            self.cuts.append([a for a, _ in parts] + [len(text)])
            self.paths.append(_paths(len(parts)))
            for leaf, (_, piece) in enumerate(parts):
                where[piece].append((number, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places))
        self.automaton.make_automaton()
        self.short = ahocorasick.Automaton()
        for words, numbers in short.items():
            self.short.add_word(words.decode("latin-1"), numbers)
        self.short.make_automaton()

    def find(self, text: bytes) -> dict[int, int]:
        """Number of each item within its budget of some part of the text, and its distance."""
        found: dict[int, int] = {}
        if len(self.short):
            for _, numbers in self.short.iter(f" {text.decode('latin-1')} "):
                found |= dict.fromkeys(numbers, 0)
        for end, (length, places) in self.automaton.iter(text.decode("latin-1")) if len(self.automaton) else ():
            for number, leaf in places:
                if found.get(number) != 0:
                    distance = self._climb(text, end + 1 - length, number, leaf)
                    if distance is not None:
                        found[number] = min(distance, found.get(number, distance))
        return found

    def _climb(self, text: bytes, at: int, number: int, leaf: int) -> int | None:
        item, cuts = self.items[number][1], self.cuts[number]
        begin = at - cuts[leaf]
        if begin >= 0 and text.startswith(item, begin):
            return 0
        distance = 0
        for lo, hi in self.paths[number][leaf]:
            budget, span = hi - lo - 1, item[cuts[lo] : cuts[hi]]
            key = (number, lo, hi)
            if key not in self.masks:
                self.masks[key] = masks_of(span)
            distance = closest(self.masks[key], len(span), text[max(0, begin + cuts[lo] - budget) : max(0, begin + cuts[hi] + budget)])
            if distance > budget:
                return None
        return distance


def _paths(leaves: int) -> list[list[tuple[int, int]]]:
    """For each leaf the spans of leaves above it, from its parent to the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(leaves)]

    def split(lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            split(lo, mid)
            split(mid, hi)
            for leaf in range(lo, hi):
                out[leaf].append((lo, hi))

    split(0, leaves)
    return out


def _matched(shared):
    cache = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache["matcher"] = Matcher(*shared.value)
        matcher = cache["matcher"]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
        for batch in batches:
            batch = batch.append_column("text", batch.column("row").field("text"))
            for piece in slices(batch):
                out = []
                for text, before in zip(piece.column("text").to_pylist(), piece.column("matches").to_pylist()):
                    found = matcher.find(folded(text)) if text else {}
                    least = {m["item_id"]: m["distance"] for m in before}
                    for number, distance in found.items():
                        for name in matcher.items[number][0]:
                            least[name] = min(distance, least.get(name, distance))
                    out.append([{"item_id": k, "distance": v} for k, v in sorted(least.items(), key=lambda kv: (kv[0] is None, kv[0]))])
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(out, kind)], names=["row", "matches"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``row, matches``: every row of ``docs`` whole, and the items of ``benchmark(item_id, text)`` it holds.

    An item is held if its normalised text is within ``rate`` times its bytes in edits of some part of
    the normalised document; one below SHORTEST_ITEM bytes if its words stand there unchanged. Items go
    round in blocks of a bounded number of different texts; each is broadcast. A null or empty document
    holds nothing; a null or empty item is held by nothing; an item_id that repeats is named once with
    its least distance.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    known = known.groupBy("item").agg(F.collect_set(F.struct("item_id")).alias("ids"))
    blocks = max(-(-known.count() // ITEM_BLOCK), 1)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array().cast(MATCHES).alias("matches"))
    schema = StructType([StructField("row", out.schema["row"].dataType), StructField("matches", out.schema["matches"].dataType)])
    for block in range(blocks):
        rows = collect_bounded(known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), 4 * ITEM_BLOCK, "a block of benchmark items")
        items = [([i["item_id"] for i in r["ids"]], folded(r["item"])) for r in rows]
        items = [(names, text) for names, text in items if text]
        if items:
            out = out.mapInArrow(_matched(spark.sparkContext.broadcast((items, rate))), schema)
    return out


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), (F.size("matches") > 0).alias("contaminated"),
                        F.col("matches.item_id").alias("item_ids"), F.col("matches.distance").alias("distances"))
