"""Canonical digest lookup of whole texts among known licences (operator 2), in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, fits, query, table
from .license_texts import EQUIVALENT_SPELLINGS, LICENSE_TEXTS

#: A catalogue up to this many digests is broadcast, a larger one is joined by a shuffle.
BROADCAST_DIGESTS = 100_000
#: A line that only names a holder: marks of a comment, then the word or the sign.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%.-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Everything in ASCII but letters and digits; other characters stay.
BETWEEN_WORDS = r"[\x00-/:-`{-\x7f]+"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, words one space apart, equivalent spellings as one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), BETWEEN_WORDS, " "))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT_SPELLINGS, plain)


def license_digests(known: DataFrame) -> DataFrame:
    """``digest, license_id`` of ``known(license_id, text)``; of equal texts the id that sorts first.

    A null id or text and a text without words are left out.
    """
    words = canonical(F.col("text"))
    rows = known.where(F.col("license_id").isNotNull() & F.col("text").isNotNull()).select("license_id", words.alias("words"))
    return rows.where("words <> ''").groupBy(F.md5("words").alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, license_id`` of every row of ``docs(doc_id, text)``.

    The licence is null unless the whole text equals a known one in canonical form. A null text has no
    digest; a text without words has the digest of the empty text and no licence. Rows are never merged.
    """
    digests = durable(license_digests(known))
    if fits(digests, BROADCAST_DIGESTS):
        digests = F.broadcast(digests)
    rows = docs.select("doc_id", F.md5(canonical(F.col("text"))).alias("digest"))
    return rows.join(digests, "digest", "left").select("doc_id", "digest", "license_id")


def _sql() -> str:
    def words(column: str) -> str:
        plain = f"trim(regexp_replace(regexp_replace(lower({column}), '{COPYRIGHT_LINE}', '', 'g'), '{BETWEEN_WORDS}', ' ', 'g'))"
        return reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", EQUIVALENT_SPELLINGS, plain)

    known = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in LICENSE_TEXTS)
    return f"""WITH k AS (SELECT md5({words('t')}) AS digest, min(n) AS license_id FROM (VALUES {known}) v(n, t) GROUP BY 1),
      d AS (SELECT doc_id, md5({words('text')}) AS digest FROM documents)
      SELECT doc_id, d.digest, license_id FROM d LEFT JOIN k ON d.digest = k.digest"""


@query("op2_license_scan", _sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(LICENSE_TEXTS, "license_id string, text string")
    return scan_licenses(table(spark, sf_dir, "documents"), known)
