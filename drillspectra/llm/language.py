"""Language ID by prediction by partial matching with frozen per-language context trees (operator 7).

Every language has counts of bytes after contexts of up to three bytes. A byte is coded in the
longest context that the language knows: with counts ``c`` of the byte, ``n`` of all bytes and ``q``
distinct ones it costs ``-log2(c / (n + q))`` if it was seen there, else ``-log2(q / (n + q))`` for the
escape and then its code in the next shorter context, where bytes of the longer one are excluded;
below the empty context all remaining byte values are equally likely. Since the statistics are
frozen, the cost of a byte after a context is a constant: the trees become one table
(context node x byte x language) in 1/256 bit and a text's code length is a sum of table cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrays import flat_text, slices
from .common import narrow, query, ship_package, table
from .shingles import lower_ascii

#: Expected number of training texts per language; a language with fewer gives all of them.
TRAINING_TEXTS = 3000
#: Contexts of three bytes that get a node of their own, the most frequent ones.
DEEP_CONTEXTS = 8192
MOST_LANGUAGES = 64
UNDETERMINED = "und"
_UNIT = 256
_PIECE = 1 << 20


def _codes(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bytes and the three bytes before each; before a text's start stands byte 0."""
    now = lower_ascii(raw)
    starts = borders[:-1][borders[:-1] < borders[1:]]
    before = []
    last = now
    for _ in range(3):
        last = np.concatenate([np.zeros(1, np.uint8), last[:-1]])
        last[starts] = 0
        before.append(last)
    return now, before


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, limit=_PIECE):
            raw, borders = flat_text(piece.column("text"))
            langs = piece.column("lang").dictionary_encode()
            now, (b1, b2, b3) = _codes(raw, borders)
            gram = (b3.astype(np.int64) << 24) | (b2.astype(np.int64) << 16) | (b1.astype(np.int64) << 8) | now
            owner = np.repeat(langs.indices.to_numpy(), np.diff(borders)).astype(np.int64)
            keys, counts = np.unique((owner << 32) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["lang", "gram", "n"])


class ContextTrees:
    """The trees of all languages as one cost table."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, deep: int = DEEP_CONTEXTS):
        self.langs = langs
        seen = np.unique(gram & 255)
        seen = seen[seen > 0]
        width = self.width = len(seen) + 2
        self.letters = np.full(256, width - 1, np.int32)  # the last class: bytes never seen
        self.letters[0] = 0  # before the text
        self.letters[seen] = np.arange(1, len(seen) + 1)
        a, b1, b2, b3 = (self.letters[(gram >> shift) & 255] for shift in (0, 8, 16, 24))
        pair, triple = b2 * width + b1, (b3 * width + b2) * width + b1
        names, place = np.unique(triple, return_inverse=True)
        weight = np.bincount(place, weights=n)
        chosen = np.sort(names[np.lexsort((names, -weight))[:deep]])
        pairs = np.unique(pair)
        self.nodes = {1: np.arange(width), 2: pairs, 3: chosen}
        rows = np.concatenate([[0], 1 + np.arange(width), 1 + width + np.arange(len(pairs)), 1 + width + len(pairs) + np.arange(len(chosen))])
        parents = np.concatenate([[0], np.zeros(width, np.int64), 1 + pairs % width,
                                  1 + width + np.searchsorted(pairs, chosen % (width * width))])
        level = np.repeat([0, 1, 2, 3], [1, width, len(pairs), len(chosen)])
        at = np.clip(np.searchsorted(chosen, triple), 0, max(len(chosen) - 1, 0))
        cost = np.zeros((len(rows), width, len(langs)), np.uint16)
        for index in range(len(langs)):
            mine = lang == index
            count = np.zeros((len(rows), width), np.float64)
            np.add.at(count, (0, a[mine]), n[mine])
            np.add.at(count, (1 + b1[mine], a[mine]), n[mine])
            np.add.at(count, (1 + width + np.searchsorted(pairs, pair[mine]), a[mine]), n[mine])
            known = mine & (chosen[at] == triple) if len(chosen) else np.zeros(len(mine), bool)
            np.add.at(count, (1 + width + len(pairs) + at[known], a[known]), n[known])
            cost[:, :, index] = np.minimum(np.rint(self._bits(count, parents, level) * _UNIT), 65535)
        self.cost = cost.reshape(-1, len(langs))

    @staticmethod
    def _bits(count: np.ndarray, parents: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Code length of every byte after every context of one language."""
        seen = count > 0
        total, kinds = count.sum(axis=1), seen.sum(axis=1)
        beyond = np.zeros_like(count)  # code below this context, for bytes that it has not seen
        beyond[0] = np.log2(max(256 - int(kinds[0]), 1))
        bits = np.zeros_like(count)
        with np.errstate(divide="ignore", invalid="ignore"):
            for depth in range(4):
                at = np.flatnonzero(level == depth)
                if depth:
                    up = parents[at]
                    left_out = seen[at]
                    rest = np.where(left_out, 0, count[up])
                    n, q = rest.sum(axis=1)[:, None], (rest > 0).sum(axis=1)[:, None]
                    inside = -np.log2(rest / (n + q))
                    escape = np.where(n + q > 0, -np.log2(q / (n + q)), 0)
                    beyond[at] = np.where(rest > 0, inside, escape + beyond[up])
                n, q = total[at][:, None], kinds[at][:, None]
                own = np.where(seen[at], -np.log2(count[at] / (n + q)), -np.log2(q / (n + q)) + beyond[at])
                bits[at] = np.where(n > 0, own, bits[parents[at]] if depth else beyond[at])
        return bits

    def ready(self) -> np.ndarray:
        """Node of the longest known context for all triples of byte classes; made once per process."""
        if not hasattr(self, "_node"):
            width, pairs, deep = self.width, self.nodes[2], self.nodes[3]
            near = 1 + np.arange(width * width) % width
            near[pairs] = 1 + width + np.arange(len(pairs))
            node = np.tile(near.astype(np.int32), width)
            node[deep] = 1 + width + len(pairs) + np.arange(len(deep))
            self._node = node
        return self._node

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_node"}

    def code_lengths(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Code length of every row in every language, in 1/256 bit."""
        out = np.zeros((len(borders) - 1, len(self.langs)), np.int64)
        full = np.flatnonzero(borders[:-1] < borders[1:])
        if len(full):
            now, before = _codes(raw, borders)
            a, b1, b2, b3 = (self.letters[x] for x in (now, *before))
            cells = self.ready()[(b3 * self.width + b2) * self.width + b1] * np.int32(self.width) + a
            out[full] = np.add.reduceat(self.cost[cells], borders[:-1][full], axis=0, dtype=np.int64)
        return out


def held_out(doc_id="doc_id"):
    """Rows that are never learned from, to measure accuracy on; a null doc_id is not one of them (nor learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, texts: int = TRAINING_TEXTS, deep: int = DEEP_CONTEXTS) -> ContextTrees | None:
    """Trees from whole texts of rows that are not held out; None if there are none.

    Rows are drawn by a hash of doc_id so that about ``texts`` rows a language are read; counts are
    summed by Spark and the sums, bounded by the drawn text, build the table on the driver.
    """
    rows = narrow(docs, "doc_id", "lang", "text").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, texts / sizes[k]) * (1 << 30))))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < share[F.col("lang")])
    counts = (drawn.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    if counts.num_rows == 0:
        return None
    number = {k: i for i, k in enumerate(langs)}
    lang = np.array([number[k] for k in counts.column("lang").to_pylist()])
    return ContextTrees(langs, lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy(), deep)


def _has_letter(piece: pa.RecordBatch, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    low = lower_ascii(raw)
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = ascii_letter[borders[1:]] > ascii_letter[borders[:-1]]
    for row in np.flatnonzero(~out & (borders[1:] > borders[:-1])):
        out[row] = any(ch.isalpha() for ch in piece.column("text")[int(row)].as_py())
    return out


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field("text")], names=["row", "text"])
            for piece in slices(texts, limit=_PIECE):
                raw, borders = flat_text(piece.column("text"))
                letters = _has_letter(piece, raw, borders)
                if trees is None:
                    names, score, bits = [UNDETERMINED] * piece.num_rows, np.zeros(piece.num_rows), np.full(piece.num_rows, np.nan)
                else:
                    lengths = trees.code_lengths(raw, borders)
                    best = lengths.argmin(axis=1)
                    least = lengths.min(axis=1)
                    score = 1 / np.exp2(-np.minimum(lengths - least[:, None], 1 << 18) / _UNIT).sum(axis=1)
                    names = [trees.langs[i] if ok else UNDETERMINED for i, ok in zip(best, letters)]
                    score = np.where(letters, score, 0.0)
                    bits = least / _UNIT
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(names, pa.string()), pa.array(score), pa.array(bits, pa.float64())],
                                                 names=["row", "lang_pred", "score", "code_bits"])

    return run


def identified(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """``row, lang_pred, score, code_bits``: every row of ``docs`` whole, and the language of its ``text``.

    The language with the shortest code wins, ties go to the name that sorts first; the score is its
    probability against the other languages at equal odds. A null text, or one without a letter, is
    ``und`` with score 0, as is every text if there was nothing to learn from. Only the bytes of the
    text are looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("code_bits", DoubleType())])
    return rows.mapInArrow(_predicted(shared), schema)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), train(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "code_bits")
