"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays.
3. repeats: passages that an earlier document has too are cut from the text.
4. mix: sources are taken in the target proportions.
5. pack: pieces of the documents are placed in sequences.

Every stage but the last returns the columns of ``documents``, with whatever columns a user added
and whatever their names; only names that begin with two underscores are reserved. Between
stages the rows are stored as Parquet, so each stage works on all rows that its predecessor kept
and a lost executor never reaches further back than one stage. An empty table stays empty in
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import stored
from reachline.llm.mixing import mix_documents
from reachline.llm.near_dedup import drop_near_duplicates
from reachline.llm.packing import pack_documents
from reachline.llm.quality import THRESHOLD, fit_quality
from reachline.llm.repeats import remove_repeats

REPEATED_BYTES = 100
"""Strings of so many bytes are cut where a smaller doc_id has them: below the length of any
passage of 50 words, above that of a usual line."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of ``THRESHOLD`` or more; learned from the ``labels`` table.

    Null and empty texts are scored as empty, very long ones whole; repeated rows share their
    fate, with or without doc_id. No column of ``docs`` changes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs.select("doc_id", "text"), labels)
    return (docs.withColumn("__quality", model.score(F.col("text")))
            .where(F.col("__quality") >= THRESHOLD).drop("__quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Null and empty texts, and rows without doc_id, all stay; so do all rows that repeat the
    doc_id and the text of a row that stays.
    """
    return drop_near_duplicates(docs, size=5, similarity=(80, 100))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED_BYTES`` that a smaller doc_id has too.

    Every row stays, with an empty text if nothing is left; null texts stay null, rows without
    doc_id as they are. ``n_chars``, if there is one, is counted anew.
    """
    return remove_repeats(docs, REPEATED_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 1, 2, 3 in turn, at most three times.

    Null sources are a source, the last one. Texts without words are not taken.
    """
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with bin and offset; copies of one document never share a bin.

    The result has columns of its own (see ``pack_documents``); repeated rows are all packed.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("mix", mix), ("pack", pack)]

ORACLE_SQL = None  # a learned score has no SQL form; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
