"""Helpers that several operators share: stored tables, sorted blocks, words, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachline.session import new_work_path

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of characters other than ASCII white space."""


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written as Parquet below the shared folder and read back.

    This cuts the lineage: a lost executor costs no more than the stage that reads the table.
    """
    path = new_work_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def blocks(frame: DataFrame, keys: list, label: str) -> DataFrame:
    """Stored rows in sorted blocks: column ``__block`` rises with the sort keys.

    A block is one range partition. Rows with equal keys share a block, so the keys should
    be (nearly) unique.
    """
    ranged = frame.repartitionByRange(*keys).withColumn("__block", F.spark_partition_id())
    return stored(ranged, label)


def before(totals: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum of ``value`` over earlier blocks; ``totals`` has one row per block and ``by``.

    The window sees block totals only, whose number is that of the partitions.
    """
    earlier = (Window.partitionBy(*by).orderBy("__block")
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*by, "__block", F.coalesce(F.sum(value).over(earlier), F.lit(0))
                         .alias("__before"))


def whole_ids(frame: DataFrame) -> DataFrame:
    """doc_id as 0 with ``no_id`` true where it is null: pandas would turn a column of whole
    numbers with nulls into floats, which cannot tell large ids apart."""
    return frame.withColumns({
        "doc_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")),
        "no_id": F.col("doc_id").isNull()})


def with_null_ids(frame: DataFrame) -> DataFrame:
    """The other way round."""
    return frame.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")),
                      F.lit(0)).cast("bigint")


SPREAD = 256
"""Parts of a node's neighbours, which are dealt to different tasks."""


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): every edge with the smallest neighbour of its ``a``.

    The neighbours of a node are gathered in ``SPREAD`` parts by their hash, and only the parts
    meet the node's minimum, so a node with a third of all edges gives its join ``SPREAD`` rows.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).alias("part")
    parts = edges.groupBy("a", part).agg(F.collect_list("b").alias("all"),
                                         F.min("b").alias("least"))
    least = parts.groupBy("a").agg(F.min("least").alias("m"))
    return parts.join(least, "a").select("a", F.explode("all").alias("b"), "m")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b), numbers.

    The component is its smallest node. Star contraction in two alternating steps (towards the
    smallest neighbour among larger and among smaller nodes), each a grouping with a minimum and
    a join over parts of the neighbours, so no node's edges meet in one task. Every round is
    stored; the number of rounds grows with the logarithm of the path lengths.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), label)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .unionByName(now.select(F.col("b").alias("node"),
                                            F.col("b").alias("component")).distinct()))
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _with_least(large).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.*").where("a <> b").distinct()
        now = stored(small, label)
