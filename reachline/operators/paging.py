"""Pages over a whole ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachline.session import shared_folder


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``position``, 1 to n in a total order, without bringing the rows together.

    Rows are range-partitioned and sorted, and the sorted table is checkpointed in the shared
    folder so that both uses below see the same partitions. Only the partition sizes, one row
    per partition, are summed in one place.
    """
    shared_folder(rows.sparkSession)
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id())
              .withColumn("place", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
              .checkpoint())
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = (Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (ranged.join(F.broadcast(starts), "part")
            .withColumn("position", F.col("start") + F.col("place") + 1)
            .drop("part", "place", "start"))


def with_pages(rows: DataFrame, *order: Column, per_page: int = 20) -> DataFrame:
    """Adds ``position``, ``page`` and the number of ``pages`` (at least 1)."""
    placed = numbered(rows, *order)
    total = placed.agg(F.greatest(F.ceil(F.count("*") / per_page), F.lit(1))).scalar()
    return (placed.withColumn("page", F.ceil(F.col("position") / per_page))
            .withColumn("pages", total))
