"""Line dedup by winnowing over line hashes (operator 5).

A line ends at a line break or behind the space after a full stop, question or exclamation mark, so
that a passage is found in the middle of a paragraph too. Lines are compared without case (A-Z) and
outer white space; blank lines do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import flat_text, mix, slices, spans_hash
from .common import durable, query, ship_package, table
from .shingles import lower_ascii, word_spans

#: Every repeated run of at least this many lines is found, and shorter ones of RUN_WORDS words.
WINDOW = 3
#: A repeated run is deleted from this many words on.
RUN_WORDS = 40
_LAST = (1 << 63) - 1


class Lines:
    """Lines of all rows of a slice: hash, words, byte range, row and number in the row.

    ``short`` holds (lines, first lines, contents) of the shorter windows that have ``short_words`` words alone.
    """

    def __init__(self, column: pa.Array, window: int, short_words: int | None = None):
        self.raw, self.borders = raw, borders = flat_text(column)
        self.window = window
        low = lower_ascii(raw)
        mark = np.zeros(len(raw), bool)
        mark[1:] = (raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)
        mark[borders[:-1][borders[:-1] < len(raw)]] = False
        ends = np.union1d(np.flatnonzero((raw == 10) | ((raw == 32) & mark)) + 1, borders[1:][borders[1:] > borders[:-1]])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        word_start, word_stop, _ = word_spans(raw, borders) if len(raw) else (np.zeros(0, np.int64),) * 3
        owner = np.searchsorted(starts, word_start, side="right") - 1
        words = np.bincount(owner, minlength=len(starts))
        full = words > 0
        first = np.cumsum(words) - words
        self.start, self.stop, self.words = starts[full], ends[full], words[full]
        self.hash = spans_hash(low, word_start[first[full]], word_stop[(first + words - 1)[full]]) if full.any() else np.zeros(0, np.uint64)
        self.row = np.searchsorted(borders, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=len(borders) - 1)
        self.begin = np.cumsum(self.counts) - self.counts
        self.number = np.arange(len(self.row)) - self.begin[self.row]
        at = np.flatnonzero(self.number + window <= self.counts[self.row])
        self.at = at
        least, place, value = np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for step in range(window):
                line = self.hash[at + step]
                lower = line <= least  # of equal hashes the last one
                least, place = np.where(lower, line, least), np.where(lower, at + step, place)
                value = mix(value * np.uint64(0x2545F4914F6CDD1D) + line)
        self.least, self.value = least, value
        self.fresh = np.ones(len(at), bool)
        self.fresh[1:] = place[1:] != place[:-1]
        self.short = [self._short(size, short_words) for size in range(1, window)] if short_words is not None else []

    def _short(self, size: int, least_words: int) -> tuple[int, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.number + size <= self.counts[self.row])
        at = at[sum(self.words[at + step] for step in range(size)) >= least_words]
        value = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for step in range(size):
                value = mix(value * np.uint64(0x2545F4914F6CDD1D) + self.hash[at + step])
        return size, at, value


def _fingerprints(window: int, short_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                lines = Lines(piece.column("text"), window, short_words)
                marks = np.concatenate([lines.least[lines.fresh], *(value for _, _, value in lines.short)])
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64))], names=["mark"])

    return run


def _windows(window: int, short_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                lines = Lines(piece.column("text"), window, short_words)
                at = np.concatenate([lines.at, *(first for _, first, _ in lines.short)])
                mark = np.concatenate([lines.least, *(value for _, _, value in lines.short)])  # a short window is its own mark
                value = np.concatenate([lines.value, *(value for _, _, value in lines.short)])
                doc = piece.column("doc").to_numpy()[lines.row[at]] if piece.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark.view(np.int64)), pa.array(value.view(np.int64)), pa.array(doc), pa.array(lines.number[at].astype(np.int32))],
                    names=["mark", "content", "doc", "start"])

    return run


def _cleaned(window: int, run_words: int, short_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                lines = Lines(piece.column("text"), window, short_words)
                starts, contents = piece.column("starts"), piece.column("contents")
                texts, gone = [], []
                for row in range(piece.num_rows):
                    text = piece.column("text")[row].as_py()
                    begin, count = int(lines.begin[row]), int(lines.counts[row])
                    dead = np.zeros(count, bool)
                    if starts[row].is_valid and count:
                        repeated = np.array(starts[row].as_py()) + begin, np.array(contents[row].as_py(), np.int64)
                        for size, first, value in [(window, lines.at, lines.value), *lines.short]:
                            lo, hi = np.searchsorted(first, [begin, begin + count])
                            place = lo + np.searchsorted(first[lo:hi], repeated[0])
                            fits = np.flatnonzero(place < hi)
                            fits = fits[(first[place[fits]] == repeated[0][fits]) & (value[place[fits]].view(np.int64) == repeated[1][fits])]
                            for start in repeated[0][fits] - begin:
                                dead[start : start + size] = True
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], dead.astype(np.int8), [0]])))
                        for a, b in zip(edges[::2], edges[1::2]):
                            if lines.words[begin + a : begin + b].sum() < run_words:
                                dead[a:b] = False
                    if dead.any():
                        keep, last = [], int(lines.borders[row])
                        for n in np.flatnonzero(dead):
                            keep.append(lines.raw[last : lines.start[begin + n]])
                            last = int(lines.stop[begin + n])
                        keep.append(lines.raw[last : lines.borders[row + 1]])
                        text = np.concatenate(keep).tobytes().decode()
                    texts.append(text)
                    gone.append(int(dead.sum()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines.counts), pa.array(gone, pa.int64())],
                                                 names=["doc_id", "text", "n_lines", "n_removed"])

    return run


def drop_repeated_runs(docs: DataFrame, window: int = WINDOW, run_words: int = RUN_WORDS, by_words: bool = True) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row of ``docs(doc_id, text)``, without later repeats.

    1. Of each ``window`` consecutive lines the one with the smallest hash is a fingerprint; equal runs
       of that length choose the same one. Fingerprints at one place only are out.
    2. Positions of the others meet by fingerprint and by the content of the lines around it. The first
       position in order of (doc_id, line) stays, the others are repeats.
    3. Repeats that touch or overlap grow together into runs, however far they reach; runs of at least
       ``run_words`` words are deleted. All other bytes stay as they are.

    The words alone decide: runs of fewer than ``window`` lines with ``run_words`` words are found too, as
    windows of their own, unless ``by_words`` is off.

    Repeats inside one document count too. A null or empty text has no lines and stays. Rows with a
    null doc_id come last and, like rows that repeat a doc_id, are one document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"))
    short_words = run_words if by_words else None
    marks = (rows.select("text").mapInArrow(_fingerprints(window, short_words), "mark long").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    met = durable(rows.select("doc", "text").mapInArrow(_windows(window, short_words), "mark long, content long, doc long, start int")
                  .join(durable(marks), "mark", "left_semi").select("content", "doc", "start").distinct())
    # a written table keeps the join a plain one of two shuffles, which Spark may split at a hot passage
    first = durable(met.groupBy("content").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first"))
    repeats = met.join(first, "content").where(F.struct("doc", "start") != F.col("first"))
    per_doc = repeats.groupBy("doc").agg(F.collect_list(F.struct("start", "content")).alias("found"))
    per_doc = per_doc.select("doc", F.col("found.start").alias("starts"), F.col("found.content").alias("contents"))
    kind = dict(docs.dtypes)["doc_id"]
    return (rows.join(per_doc, "doc", "left").select("doc_id", "text", "starts", "contents")
            .mapInArrow(_cleaned(window, run_words, short_words), f"doc_id {kind}, text string, n_lines long, n_removed long"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""WITH cut AS (SELECT doc_id, generate_subscripts(u, 1) AS place, unnest(u) AS line FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(30), 'g'), chr(30)) AS u FROM documents)),
  norm AS (SELECT *, trim(translate(line, '{_UPPER}', lower('{_UPPER}')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS words FROM cut),
  num AS (SELECT doc_id, place, words, len(regexp_extract_all(words, '[^\s\x0b]+')) AS n,
      row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM norm WHERE words <> ''),
  win AS (SELECT doc_id, i, 3 AS size, words || chr(30) || lead(words) OVER d || chr(30) || lead(words, 2) OVER d AS content
      FROM num WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, i, 2, CASE WHEN n + lead(n) OVER d >= {RUN_WORDS} THEN words || chr(30) || lead(words) OVER d END
      FROM num WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, i, 1, words FROM num WHERE n >= {RUN_WORDS}),
  hit AS (SELECT doc_id, i, size FROM (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, content ORDER BY doc_id, i) AS r
      FROM win WHERE content IS NOT NULL) WHERE r > 1),
  cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM hit),
  run AS (SELECT c.doc_id, c.i, num.place, num.n, c.i - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS g
      FROM cover c JOIN num ON num.doc_id = c.doc_id AND num.i = c.i),
  dead AS (SELECT doc_id, place FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, g) AS total FROM run) WHERE total >= {RUN_WORDS})
  SELECT cut.doc_id, CAST(any_value(k.c) AS BIGINT) AS n_lines, count(dead.place) AS n_removed,
    md5(coalesce(string_agg(line, '' ORDER BY cut.place) FILTER (WHERE dead.place IS NULL), '')) AS text_md5
  FROM cut LEFT JOIN dead ON dead.doc_id = cut.doc_id AND dead.place = cut.place
  JOIN (SELECT doc_id, count(*) FILTER (WHERE words <> '') AS c FROM norm GROUP BY 1) k ON k.doc_id = cut.doc_id GROUP BY cut.doc_id"""


@query("op5_line_dedup", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))
