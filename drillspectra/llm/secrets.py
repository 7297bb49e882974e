"""Secret scans by one combined deterministic automaton (operator 12)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import flat_text, slices
from .automata import matches
from .common import query, ship_package, table


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    A pattern is ASCII; its leftmost longest matches have to be its leftmost greedy ones, as in all of
    ``RULES``, where what follows a repeated set begins with a character outside of it.
    """

    kind: str
    pattern: str
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The base rules come first; the others add the fixed shapes of widely used credentials.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _scanned_pattern(rule: Rule) -> str:
    """The pattern the automaton reads; of a plain repeated set the least length is part of it."""
    whole = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{whole[1]}{{{rule.least},}}" if whole and rule.group == 0 else rule.pattern


def _scan(rules: tuple[Rule, ...]):
    patterns = tuple(_scanned_pattern(r) for r in rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [re.compile(r.pattern.encode()) for r in rules]
        for batch in batches:
            for piece in slices(batch):
                raw, borders = flat_text(piece.column("text"))
                found = []
                for row, start, stop, number in matches(patterns, raw, borders):
                    rule = rules[number]
                    whole = exact[number].fullmatch(raw[start:stop].tobytes())
                    if len(whole[rule.group]) >= rule.least:
                        found.append((row, start, stop, number))
                found.sort(key=lambda f: (f[1], f[3]))
                row, start, stop, number = np.array(found, np.int64).reshape(-1, 4).T
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                spans = pa.StructArray.from_arrays(
                    [pa.array([rules[n].kind for n in number.tolist()], pa.string()), pa.array(points[start] - points[borders[row]]),
                     pa.array(points[stop] - points[borders[row]])], names=["kind", "start", "stop"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=piece.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in piece.schema.names if c != "text"), pa.ListArray.from_arrays(ends, spans)],
                                                 names=[*(c for c in piece.schema.names if c != "text"), "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carried: list[str] | None = None) -> DataFrame:
    """``row, spans`` of every row of ``docs(text, ...)``: all its columns, or the ``carried`` ones, and its secrets.

    ``spans`` holds ``kind, start, stop`` in code points, the end exclusive, by start, then by the order
    of ``rules``. Of each rule the leftmost matches that do not overlap are taken, and then those that
    are too short are dropped. Every text is read whole, once; a null or empty text has no spans. Each
    row is judged alone, so null and repeated doc_ids keep their rows. One pass, no shuffle.
    """
    ship_package(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("row"), F.col("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema if f.name != "text")
    return whole.mapInArrow(_scan(tuple(rules)), f"{kept}, spans array<struct<kind: string, start: long, stop: long>>")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "*") -> DataFrame:
    """``docs`` with every character of a secret replaced by ``mark``; a null text stays null."""
    found = find_secrets(docs, rules)
    merged = F.expr("""reduce(array_sort(transform(spans, s -> struct(s.start, s.stop))), CAST(array() AS array<struct<start: long, stop: long>>),
      (a, s) -> IF(size(a) > 0 AND s.start <= a[size(a) - 1].stop,
        concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start AS start, greatest(a[size(a) - 1].stop, s.stop) AS stop))), concat(a, array(s))))""")
    found = found.withColumn("_cover", merged)
    text = F.expr("""concat(array_join(transform(_cover, (s, i) -> concat(
        substring(row.text, CAST(IF(i = 0, 0, _cover[i - 1].stop) AS INT) + 1, CAST(s.start - IF(i = 0, 0, _cover[i - 1].stop) AS INT)),
        repeat('{0}', CAST(s.stop - s.start AS INT)))), ''),
      substring(row.text, CAST(IF(size(_cover) > 0, _cover[size(_cover) - 1].stop, 0) AS INT) + 1))""".format(mark.replace("'", "\\'")))
    return found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _kind_sql(number: int, rule: Rule) -> str:
    """Spans of one kind in DuckDB: gaps and matches alternate, so their lengths add up to the places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {number} AS rule, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hits[k] AS hit, tail[k] AS part, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + list_sum(list_transform(hits[1:k], lambda g: length(g))) - length(hits[k]) AS start
    FROM (SELECT doc_id, hits, gaps, tail, unnest(range(1, len(hits) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS tail,
        string_split_regex(text, '{pattern}') AS gaps FROM whole))
  ) WHERE length(part) >= {rule.least}"""


SQL = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({' UNION ALL '.join(_kind_sql(i, r) for i, r in enumerate(RULES))}
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN joined USING (doc_id)
"""


@query("op12_secret_scan", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), carried=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *[counted(k) for k in BASE],
                        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
