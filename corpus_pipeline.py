"""Corpus preparation from ``documents`` to packed token ids, stage by stage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from drillspectra.llm.common import durable, ship_package, table
from drillspectra.llm.edits import contamination
from drillspectra.llm.language import UNDETERMINED, identified, train
from drillspectra.llm.mixing import mixed
from drillspectra.llm.near_copies import near_copies
from drillspectra.llm.tokens import packed_tokens

#: The stages hold Python and numpy work, so no SQL states them; tests compare them with brute force.
ORACLE_SQL = None
#: Encodings a worker remembers; fewer than alone, as the stages share the memory of one executor.
KEPT_WORDS = 150_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; those without a text or a letter go.

    If nothing can be learned from, for want of rows with a language, all documents stay.
    """
    trees = train(docs)
    if trees is None:
        return docs
    return identified(docs, trees).where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Documents without a doc_id stay; rows that repeat a doc_id are one document.
    """
    gone = near_copies(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the allowed edits, go."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: it is the order of the written rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", "source", F.octet_length("text").alias("size"), whole)
    return mixed(rows).orderBy("slot", "place").select("row.row.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the kept documents in shards, one stream in the order of the rows as they were written.

    That order is the file name and row number of a file source; rows from elsewhere go by doc_id.
    """
    rows = docs.select("doc_id", "text")
    try:
        placed = docs.select(F.col("doc_id"), F.col("text"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return packed_tokens(rows, kept_words=KEPT_WORDS)
    return packed_tokens(placed, order=["_file", "_row"], kept_words=KEPT_WORDS)


STAGES = [
    ("language ID", keep_known_languages),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token shards", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
