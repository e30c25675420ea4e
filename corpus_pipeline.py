"""From raw documents to packed training sequences: quality, exact and near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.common import forget, stored, table
from tallgrass.llm.exact import drop_exact
from tallgrass.llm.packing import pack
from tallgrass.llm.quality import keep_quality
from tallgrass.llm.simhash import drop_near
from tallgrass.llm.substring import drop_repeated


# Every stage takes and returns rows with the columns of documents, whatever else they are called; the last returns pieces. An empty table gives
# an empty one. Texts are read whole, however long; null ids are kept apart from others as the stages' operators say.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts go; repeated rows stay or go together."""
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id; of rows that repeat it too, one. Null counts as the empty text."""
    return drop_exact(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest doc_id. Rows with a null id stay; texts without words are linked."""
    return drop_near(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that a document with a smaller doc_id has too; those that lose every word go. Null and empty texts,
    rows with a null id, and passages shared by rows of one id only, stay."""
    return drop_repeated(docs, chars_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, bin_group, bin_no. Repeated rows are packed each by itself; a text
    without words is one piece of length 0 without a bin."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("best-fit packing", packing)]

#: Fingerprints, suffix arrays and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        forget(docs)  # the table of the stage before
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
