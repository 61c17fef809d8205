"""Receipt streams: message statuses, live campaign counts, conversions, stage counters.

The operators are those of the batch jobs. State is one small row per message and is kept
for good, since a receipt may arrive at any time; use the RocksDB state store (it is set in
``reachline.session``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reachline.fixed import REACHED
from reachline.functions import count_in
from reachline.operators.campaigns import stage_counts
from reachline.operators.completion import (counter_changes, first_completions, first_moves,
                                            with_completion)
from reachline.operators.conversions import conversion_orders
from reachline.operators.receipts import (KEYS, changed_communications, progress,
                                          stage_event_counts, status_columns)
from reachline.streaming import changes

MESSAGE_COLUMNS = ["id", *KEYS, "recipient", "channel", "status", "events", "sent_at",
                   "updated_at"]
STATUS_COLUMNS = [*KEYS, "status", "sent_at", "updated_at"]


# Folders of a batch. Ids are columns of the files, so their type is kept as it is.
BUCKETS = 64


def bucket(*keys: str):
    """The folder of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _store(rows: DataFrame, columns: list[str], keys: list[str], path: str,
           batch_id: int) -> None:
    changes.write_batch(rows.select(*columns, bucket(*keys).alias("bucket"))
                        .hint("rebalance", "bucket"), path, batch_id, ["bucket"])


def _store_messages(rows: DataFrame, root: str, batch_id: int) -> None:
    _store(rows, STATUS_COLUMNS, ["campaign_id"], f"{root}/messages", batch_id)


def buckets_of(rows: DataFrame, keys: list[str]) -> list[int]:
    """The buckets of a batch, at most ``BUCKETS`` numbers."""
    return [r[0] for r in rows.select(bucket(*keys)).distinct().collect()]


def seed_messages(queued: DataFrame, root: str) -> None:
    """Stores the rows of a dispatch as the state before any receipt, and their counts."""
    _store_messages(queued, root, changes.BEFORE_STREAM)
    changes.write_batch(stage_counts(queued), f"{root}/counts", changes.BEFORE_STREAM)


MOVES = ["first_seq", "first_at", "moved_seq", "moved_at"]


def _fold_with_moves(receipts: DataFrame) -> DataFrame:
    """``fold_receipts`` with the receipts that add a message or end its waiting."""
    return (receipts.groupBy(*KEYS).agg(*progress(), *first_moves())
            .select(*KEYS, *status_columns(), *MOVES))


def _moves(rows: DataFrame, before: DataFrame) -> DataFrame:
    """What changed messages add to the counters of their campaigns; may be negative."""
    moved = rows.join(before.select(*KEYS, F.col("status").alias("was")), KEYS, "left")
    now, was = F.col("status"), F.col("was")
    return moved.groupBy("campaign_id").agg(
        F.count_if(was.isNull()).alias("messages"),
        *[(count_in(now, reached) - count_in(was, reached)).alias(stage)
          for stage, reached in REACHED.items()])


def follow_messages(receipts: DataFrame, root: str, campaigns: DataFrame,
                    every: str | None = None,
                    merge_every: int = changes.MERGE_EVERY) -> StreamingQuery:
    """Keeps message statuses and the counts and completion of the campaigns they touch.

    Per micro-batch the changed messages are compared with their state before it, which lies
    in the buckets of their campaigns; the differences are added to the campaigns' stored
    counters, so nothing is counted anew. Completion is tested after each receipt of the batch
    in order of arrival (``first_completions``) and lasts: a completed campaign keeps its status
    and time. Every ``merge_every`` batches the state is merged and older folders are removed.
    A batch that runs again finds the state before it.
    """
    spark = receipts.sparkSession
    messages, counts, heads_at = f"{root}/messages", f"{root}/counts", f"{root}/campaigns"

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select(*STATUS_COLUMNS, *MOVES,
                           bucket("campaign_id").alias("bucket")).persist()
        like = rows.drop(*MOVES).limit(0)
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]
        stored = changes.state_before(spark, messages, batch_id, like).where(
            F.col("bucket").isin(buckets))
        before = changes.newest(stored.join(rows.select(*KEYS), KEYS, "left_semi"), KEYS)
        moves = _moves(rows, before).persist()
        touched = moves.select("campaign_id")
        counted = changes.newest(
            changes.state_before(spark, counts, batch_id, moves.limit(0))
            .join(touched, "campaign_id", "left_semi"), ["campaign_id"])
        now = counted.unionByName(moves).groupBy("campaign_id").agg(
            *[F.sum(c).alias(c) for c in ("messages", *REACHED)])
        changes.write_batch(now, counts, batch_id)
        _store_messages(rows, root, batch_id)
        now = spark.read.schema(now.schema).parquet(f"{counts}/batch={batch_id}")

        heads = campaigns.join(touched.withColumnRenamed("campaign_id", "id"), "id",
                               "left_semi").select("id", "status", "total_sent")
        empty = with_completion(heads, now, _no_completions(heads)).limit(0)
        kept = changes.newest(changes.state_before(spark, heads_at, batch_id, empty),
                              ["campaign_id"])
        heads = heads.join(kept.where(F.col("status") == "completed").select(
            F.col("campaign_id").alias("id"), F.col("status").alias("kept"), "completed_at"),
            "id", "left").withColumn("status_before", F.col("status"))
        heads = heads.withColumn("status", F.coalesce("kept", "status")).drop("kept")
        met = first_completions(counter_changes(rows.drop("bucket"), before), counted, heads)
        changes.write_batch(with_completion(heads, now, met), heads_at, batch_id)
        if changes.merges(batch_id, merge_every):
            changes.merge(spark, messages, batch_id, KEYS, like, ["bucket"])
            changes.merge(spark, counts, batch_id, ["campaign_id"], moves.limit(0))
            changes.merge(spark, heads_at, batch_id, ["campaign_id"], empty)
        rows.unpersist()
        moves.unpersist()

    return changes.start(_fold_with_moves(receipts), on_batch, f"{root}/_progress", every=every)


def _no_completions(heads: DataFrame) -> DataFrame:
    return heads.where("false").select(F.col("id").alias("campaign_id"), F.lit(None).cast(
        "timestamp_ntz").alias("completed_at"))


def message_statuses(spark: SparkSession, root: str) -> DataFrame:
    return changes.current(spark, f"{root}/messages", KEYS).drop("bucket")


def live_campaigns(spark: SparkSession, root: str) -> DataFrame:
    """The newest counts and status of every campaign that has had a receipt."""
    return changes.current(spark, f"{root}/campaigns", ["campaign_id"])


def seed_communications(queued: DataFrame, root: str) -> None:
    """Stores whole message rows as they stand before the stream; may be empty."""
    _store(queued, MESSAGE_COLUMNS, KEYS, f"{root}/communications", changes.BEFORE_STREAM)


def follow_communications(receipts: DataFrame, root: str, every: str | None = None,
                          merge_every: int = changes.MERGE_EVERY) -> StreamingQuery:
    """Keeps whole message rows, event log included, after ``seed_communications``.

    The table itself is the state: each micro-batch folds its receipts onto the rows they
    name, as earlier batches left them in the buckets of their keys, and stores the changed
    rows. Every ``merge_every`` batches the table is merged, and later batches read from there.
    """
    spark = receipts.sparkSession
    path = f"{root}/communications"
    like = spark.read.parquet(f"{path}/batch={changes.BEFORE_STREAM}").limit(0)

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        earlier = (changes.state_before(spark, path, batch_id, like)
                   .where(F.col("bucket").isin(buckets_of(rows, KEYS))).drop("bucket"))
        named = rows.select(*KEYS).distinct()
        before = changes.newest(earlier.join(named, KEYS, "left_semi"), KEYS)
        changed = changed_communications(before, rows)
        _store(changed, MESSAGE_COLUMNS, KEYS, path, batch_id)
        if changes.merges(batch_id, merge_every):
            changes.merge(spark, path, batch_id, KEYS, like, ["bucket"])
        rows.unpersist()

    return changes.start(receipts, on_batch, f"{root}/_progress", mode="append", every=every)


def communications(spark: SparkSession, root: str) -> DataFrame:
    return changes.current(spark, f"{root}/communications", KEYS).drop("bucket")


def follow_conversions(receipts: DataFrame, customers: DataFrame, root: str,
                       every: str | None = None,
                       merge_every: int = changes.MERGE_EVERY) -> StreamingQuery:
    """Stores conversion orders. A repeated receipt stores the same order again, which
    ``changes.current`` by ``id`` merges."""
    return changes.keep_changes(conversion_orders(receipts, customers), f"{root}/orders",
                                f"{root}/_progress", every=every, keys=["id"],
                                merge_every=merge_every)


def follow_stages(receipts: DataFrame, root: str, every: str | None = None) -> StreamingQuery:
    """Stores running receipt counts per type."""
    return changes.keep_changes(stage_event_counts(receipts), f"{root}/stages",
                                f"{root}/_progress", every=every, keys=["event_type"])


def drop_repeats_within(receipts: DataFrame, horizon: str) -> DataFrame:
    """Drops receipts repeated within ``horizon`` of event time, with state that expires.

    Optional, in front of the fold: it bounds what repeats cost but not their effect, which
    is none either way.
    """
    timed = receipts.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("event_time", horizon)
            .dropDuplicatesWithinWatermark([*KEYS, "event_type"]).drop("event_time"))
