"""Rows whose parent may arrive later: receipts before their message, conversions before their
customer. They wait in the state of a stream-stream join until it does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reachline.streaming import changes


def follow_children(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str,
                    root: str, every: str | None = None
                    ) -> tuple[StreamingQuery, StreamingQuery]:
    """Joins two streams in which either side may come first, and counts what arrived.

    Every child is stored once with the columns of its parent, in the micro-batch in which the
    later of the two arrives. Both sides stay in the state store for good, as there is no bound
    on how late a parent is; parents that are sent again count once. Children without a key
    wait like those whose parent never comes. A batch that runs again replaces its own folder.
    """
    once = parents.dropDuplicates([parent_key])
    found = children.join(once, F.col(child_key) == F.col(parent_key))
    arrived = children.groupBy().agg(F.count("*").alias("received"))
    return (changes.keep_changes(found, f"{root}/found", f"{root}/_found", mode="append",
                                 every=every),
            changes.keep_changes(arrived.withColumn("side", F.lit("children")),
                                 f"{root}/received", f"{root}/_received", every=every,
                                 keys=["side"]))


def found_children(spark: SparkSession, root: str) -> DataFrame:
    return changes.all_rows(spark, f"{root}/found").drop("batch")


def waiting_children(spark: SparkSession, root: str) -> DataFrame:
    """One row: how many children have arrived, found their parent and still wait for it."""
    received = changes.current(spark, f"{root}/received", ["side"]).agg(
        F.coalesce(F.max("received"), F.lit(0)).alias("received"))
    return (received.join(found_children(spark, root).agg(F.count("*").alias("found")))
            .withColumn("waiting", F.col("received") - F.col("found")))
