"""Periodic run detection by an online sparse diagonal DP (operator 13).

A run is a stretch of words that repeats itself with a smallest period ``q`` over at least ``PERIODS``
periods and ``LEAST`` words, as long as it can be. Words go by in order; a word that stands ``d``
words earlier too extends the diagonal of lag ``d``, and a diagonal that is not extended ends and, if
long enough, is a run at once. Of a word's earlier occurrences only those can belong to a run whose
last ``l`` words recur as well, where ``l`` is the power of two with ``l / 2 < d <= l``: a run of four
periods holds such places, and there the nearest recurrence of those ``l`` words has exactly the
smallest period as its lag. So each word meets at most one lag for each power of two, and no list of
all its occurrences is walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import slices
from .common import crc32_sql, narrow, query, ship_package, table

PERIODS = 4
LEAST = 6
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def recurrences(ids: np.ndarray, place: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (as positions in ``ids``) and the lags at which they may extend a run, in word order.

    ``ids`` tells words of different rows apart; ``place`` is a word's number in its row. Positions
    whose last ``l`` words stand nowhere else in the row are left behind, so later rounds see few.
    """
    found, lags = [], []
    at, gram, width = np.arange(len(ids)), ids, 1
    number = np.full(len(ids), -1, np.int64)
    while len(at) and width // 2 < longest:
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        lag = at[order[1:]] - at[order[:-1]]
        use = same & (2 * lag > width) & (lag <= width)
        found.append(at[order[1:]][use])
        lags.append(lag[use])
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        number[at] = np.where(again, gram, -1)
        at = at[again & (place[at] >= 2 * width - 1)]
        at = at[number[at - width] >= 0]
        _, wider = np.unique(number[at - width] * np.int64(len(ids) + 1) + number[at], return_inverse=True)
        number[:] = -1
        gram, width = wider.astype(np.int64), 2 * width
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, lags = np.concatenate(found), np.concatenate(lags)
    order = np.lexsort((lags, found))
    return found[order], lags[order]


def runs_of(words: list[int], lags: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one row, from its recurrences in word order."""
    out: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}
    now: dict[int, int] = {}
    last = -1

    def end(lag: int, matched: int, stop: int) -> None:
        if matched + lag >= max(LEAST, PERIODS * lag):
            out.append((stop - matched - lag + 1, matched + lag, lag))

    for word, lag in zip(words, lags):
        if word != last:
            for other, matched in active.items():
                if other not in now:
                    end(other, matched, last - 1)
            active, now = now, {}
            if word != last + 1:
                for other, matched in active.items():
                    end(other, matched, last)
                active = {}
            last = word
        # the first word of a diagonal comes with the words before it that recur at this lag
        now[lag] = active[lag] + 1 if lag in active else 1 << (lag - 1).bit_length()
    for other, matched in active.items():
        if other not in now:
            end(other, matched, last - 1)
    for other, matched in now.items():
        end(other, matched, last)
    return sorted(out)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            rows = [(t or "").encode().split() for t in piece.column("text").to_pylist()]
            counts = np.array([len(r) for r in rows], np.int64)
            begin = np.concatenate([[0], np.cumsum(counts)])
            numbers: dict[bytes, int] = {}
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for r in rows for w in r), np.int64, int(begin[-1]))
            owner = np.repeat(np.arange(len(rows)), counts)
            found, lags = recurrences(owner * (len(numbers) + 1) + flat, np.arange(len(flat)) - begin[owner], int(counts.max(initial=0)) // PERIODS)
            cut = np.searchsorted(found, begin)
            runs, texts = [], []
            for i, words in enumerate(rows):
                lo, hi = cut[i], cut[i + 1]
                got = runs_of((found[lo:hi] - begin[i]).tolist(), lags[lo:hi].tolist()) if hi > lo else []
                if got:
                    keep = np.ones(len(words), bool)
                    for start, length, period in got:
                        keep[start + period : start + length] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in got])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(counts), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id, text)``; one pass, no shuffle.

    ``runs`` holds ``start, length, period`` in words, by start and period. ``collapsed`` joins by one
    space the words that no run holds behind its first period. A null, empty or word-free text has no
    words, no runs and an empty ``collapsed``. Each row is judged alone: null and repeated doc_ids keep
    their rows. A text of any length is read whole, in memory that grows with its words. Other columns
    are not read.
    """
    ship_package(docs.sparkSession)
    return narrow(docs, "doc_id", "text").mapInArrow(
        _scanned, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in which every tenth row, by a hash of its doc_id, repeats itself from some word on."""
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')")
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = narrow(docs, "doc_id", "text").withColumn("words", F.when(crc % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(crc / 10))
    known = known.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    known = known.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    again = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[a + (i - a) % p])), ' ')")
    return known.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


SQL = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS raw, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), drawn AS (
  SELECT *, len(raw) AS n, CASE WHEN h % 10 = 0 AND len(raw) > 0 THEN (h // 10) % len(raw) END AS a, h // 10 AS g FROM texts
), rewritten AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN raw ELSE
    list_transform(range(n), lambda i: raw[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words FROM drawn
), tokens AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM rewritten
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS lag, y.i AS i FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
  WHERE 4 * (y.i - x.i) <= x.n
), diagonals AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs) GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM diagonals WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM tokens ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_periodic_runs", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    best = F.expr("reduce(slice(runs, 2, size(runs)), runs[0], (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
