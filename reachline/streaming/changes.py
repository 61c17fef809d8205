"""Keyed changes of a stream, kept as one folder per micro-batch.

A batch folder is replaced as a whole, so a batch that runs again after a failure leaves the
same rows. Readers take the newest row of each key. From time to time the state is merged into
one folder beside the changes, and what an earlier merge holds is removed: at most twice as
many folders as batches between merges are there, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from reachline.sources.tables import complete_folders, remove_folders

BEFORE_STREAM = -1
MERGE_EVERY = 50


def write_batch(rows: DataFrame, root: str, batch_id: int,
                partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/batch={batch_id}")


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key. Earlier ones are dropped before the shuffle."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return (changes.withColumn("age", F.row_number().over(last)).where(F.col("age") == 1)
            .drop("age", "batch"))


def _read(spark: SparkSession, root: str, numbers: list[int], like: DataFrame | None
          ) -> DataFrame:
    reader = spark.read.option("basePath", root)
    if like is not None:
        # StructType.add would change the schema that ``like`` keeps.
        reader = reader.schema(StructType([*like.schema.fields, StructField("batch", LongType())]))
    return (reader.parquet(*[f"{root}/batch={n}" for n in numbers])
            .withColumn("batch", F.col("batch").cast("long")))


def state_before(spark: SparkSession, root: str, batch_id: int | None,
                 like: DataFrame | None) -> DataFrame:
    """The changes that make up the state before a batch (None: after all), with ``batch``: the
    newest merged state and the batches after it. ``like`` gives the columns; without it there
    must be some change.

    Two listings and a probe of each folder after the last merge, so neither the calls nor the
    files read grow with the batches passed.
    """
    merged = complete_folders(spark, f"{root}-merged", "batch", below=batch_id)[-1:]
    since = merged[0] if merged else BEFORE_STREAM - 1
    later = complete_folders(spark, root, "batch", above=since, below=batch_id)
    parts = [_read(spark, base, numbers, like)
             for base, numbers in ((f"{root}-merged", merged), (root, later)) if numbers]
    if not parts and like is not None:
        return like.where("false").withColumn("batch", F.lit(0).cast("long"))
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part)
    return state


def current(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    return newest(state_before(spark, root, None, None), keys)


def merge(spark: SparkSession, root: str, batch_id: int, keys: list[str], like: DataFrame,
          partition_by: list[str] | None = None) -> None:
    """Stores the state after a batch and removes what the merge before it holds.

    A merge that is cut short leaves no success marker and is not used. The merge before and
    the batches since stay, so this batch can run again and readers under way find their files.
    """
    rows = newest(state_before(spark, root, batch_id + 1, like), keys)
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    write_batch(rows, f"{root}-merged", batch_id, partition_by)
    earlier = complete_folders(spark, f"{root}-merged", "batch", below=batch_id)
    if earlier:
        remove_folders(spark, root, "batch", below=earlier[-1] + 1)
        remove_folders(spark, f"{root}-merged", "batch", below=earlier[-1])


def merges(batch_id: int, every: int) -> bool:
    """Whether the state is merged after this batch."""
    return batch_id % every == every - 1


def start(changes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Runs ``on_batch`` per micro-batch: on what is there now, or ``every`` interval."""
    writer = (changes.writeStream.outputMode(mode).foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def keep_changes(changes: DataFrame, root: str, checkpoint: str, mode: str = "update",
                 every: str | None = None, keys: list[str] | None = None,
                 merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Stores the changes of every micro-batch below ``root``; with ``keys`` they are merged."""
    spark = changes.sparkSession

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, root, batch_id)
        if keys and merges(batch_id, merge_every):
            merge(spark, root, batch_id, keys, rows.limit(0))

    return start(changes, on_batch, checkpoint, mode, every)


def all_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every stored row of changes that are never merged, with ``batch``."""
    return spark.read.option("basePath", root).parquet(root)
