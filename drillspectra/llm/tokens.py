"""Token ids of whole texts in wavelet-matrix shards (operator 3)."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .arrays import SLICE_BYTES, slices
from .common import durable, query, scratch_folder, ship_package, table
from .storage import reading, writing
from .wavelet import WaveletMatrix

END = 1
#: A shard is closed once it holds this many ids; one longer document is a shard of its own.
SHARD_TOKENS = 4 << 20
#: Encoded chunks and words that a worker keeps; the memory is emptied when it is full.
KEPT_WORDS = 900_000
#: Text encoded at once, where a worker has that much memory.
TEXT_SLICE = 4 << 20
#: Letters of Latin-1 and a run of plain marks, which the pre-tokenizer always parts.
_WORD_AND_MARK = re.compile(r"([a-zà-öø-ÿ]+)([.,;:!?&*%#]+)").fullmatch


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once per distinct word.

    The vocabulary's pre-tokenizer never joins anything across white space, so a text's ids are the
    ids of its white-space-separated chunks in order. That holds for lower-cased Latin-1 text, where
    normalisation is character by character; any other text, and one that may spell out a special token,
    goes to the library as a whole.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.kept_words = kept_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, chunks: list[str]) -> None:
        """Ask for the ids of new chunks; one of letters and a mark behind them is put together from both."""
        parts = [(m[1], m[2]) if (m := _WORD_AND_MARK(c)) else (c,) for c in chunks]
        asked = list({p for one in parts for p in one if p not in self.place})
        if asked:
            self._keep(asked, [f.ids for f in self.library.encode_batch_fast(asked, add_special_tokens=False)])
        joined = [c for c, one in zip(chunks, parts) if len(one) == 2]
        ends = [one for one in parts if len(one) == 2]
        if joined:
            self._keep(joined, [self._known(a) + self._known(b) for a, b in ends])

    def _known(self, part: str) -> list[int]:
        at = self.place[part]
        return self.flat[self.starts[at] : self.starts[at] + self.lengths[at]].tolist()

    def _keep(self, chunks: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(lengths.sum()))
        n = len(self.place)
        self.flat = _room(self.flat, self.used + len(flat))
        self.starts, self.lengths = _room(self.starts, n + len(ids)), _room(self.lengths, n + len(ids))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(ids)] = lengths
        self.used += len(flat)
        self.place.update(zip(chunks, range(n, n + len(ids))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        apart: dict[int, list[int]] = {}
        for row, text in enumerate(texts):
            if _plain(text):
                mine = text.lower().split()
                counts[row] = len(mine)
                words += mine
            else:
                apart[row] = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > self.kept_words and self.place:
            self._clear()
            new = set(words)
        if new:
            self._learn(sorted(new))
        which = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[which]
        stops = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[which] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        ends = np.concatenate([np.zeros(1, np.int64), stops])
        last = np.cumsum(counts)
        sizes = ends[last] - ends[last - counts]
        if not apart:
            return ids, sizes
        pieces, at = [], np.concatenate([[0], np.cumsum(sizes)])
        for row in range(len(texts)):
            pieces.append(np.array(apart[row], np.uint16) if row in apart else ids[at[row] : at[row + 1]])
        return np.concatenate(pieces), np.array([len(p) for p in pieces])


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str, kept_words: int = KEPT_WORDS) -> Encoder:
    """One encoder per worker process; ``vocabulary`` is a file, or a name the tokenizer package knows."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[vocabulary] = Encoder(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
    _ENCODERS[vocabulary].kept_words = kept_words
    return _ENCODERS[vocabulary]


def _shards_written(folder: str, vocabulary: str, shard_tokens: int, kept_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        ids, documents, lengths, held, number = [], [], [], 0, 0

        def close():
            uri = f"{folder}/part-{task.partitionId():08d}-{number:06d}-{task.taskAttemptId()}.wvlm"
            names = pa.chunked_array(documents).combine_chunks()
            sizes = np.concatenate(lengths)
            with writing(uri) as out:
                WaveletMatrix.build(np.concatenate(ids)).write(
                    out, names.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(names.is_null()), sizes)
            return pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([uri]),
                                               pa.array([int(sizes.sum())]), pa.array([len(sizes)])], names=["part", "number", "path", "tokens", "documents"])

        for batch in batches:
            for piece in slices(batch, limit=TEXT_SLICE if kept_words == KEPT_WORDS else SLICE_BYTES):
                texts = piece.column("text").fill_null("").to_pylist()
                found, sizes = encoder(vocabulary, kept_words).encode(texts)
                stops = np.cumsum(sizes)
                found = np.insert(found, stops, END)
                ids.append(found)
                documents.append(piece.column("doc_id"))
                lengths.append(sizes + 1)
                held += len(found)
                if held >= shard_tokens:
                    yield close()
                    ids, documents, lengths, held, number = [], [], [], 0, number + 1
        if held:
            yield close()
        if kept_words < KEPT_WORDS:  # memory is short, so the worker starts its next task without
            _ENCODERS.pop(vocabulary, None)

    return run


def write_shards(docs: DataFrame, folder: str, order: list[str] = ("doc_id",), vocabulary: str = "word_bpe_49k.json",
                 shard_tokens: int = SHARD_TOKENS, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Write ``docs(doc_id, text, *order)`` as shards; ``part, number, path, tokens, documents`` of each.

    Documents stand in ascending ``order`` (nulls first), ties by doc_id and text. Each ends with id 1;
    a null or empty text is that id alone. The shards in order of (part, number) hold the whole stream.
    ``kept_words`` bounds what a worker remembers of its encodings; it changes time and memory only.
    """
    keys = list(dict.fromkeys([*order, "doc_id"]))
    rows = docs.select(*[F.col(k) for k in keys], F.col("text"))
    rows = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in [*keys, "text"]])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_shards_written(folder, vocabulary, shard_tokens, kept_words), "part int, number int, path string, tokens long, documents long")


def _shards_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            with reading(path) as file:
                matrix, documents, known, lengths = WaveletMatrix.read(file)
            ids = matrix.decode().astype("<u4")
            stops = np.cumsum(lengths)
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * (stop - size) : 4 * stop]) for stop, size in zip(stops.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(documents, mask=~known), pa.array(start + stops - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a manifest."""
    order = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0)))  # one row per shard
    shards = max(manifest.count(), 1)
    return (placed.select("path", "start").repartition(shards, "path")
            .mapInArrow(_shards_read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def packed_tokens(docs: DataFrame, order: list[str] = ("doc_id",), vocabulary: str = "word_bpe_49k.json", kept_words: int = KEPT_WORDS) -> DataFrame:
    """Write shards into the shared folder and read every document back from them."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch_folder(spark, "tokens")
    return read_shards(durable(write_shards(docs, folder, order, vocabulary, kept_words=kept_words)))


@query("op3_token_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(table(spark, sf_dir, "documents"))
