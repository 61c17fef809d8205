"""Order counters of customers, kept while conversion receipts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reachline.operators.conversions import conversion_orders
from reachline.operators.customers import MONEY
from reachline.streaming import changes
from reachline.streaming.receipts import bucket, buckets_of

COUNTERS = ["customer_id", "total_orders", "total_spent", "last_order_date"]


def _counters(rows: DataFrame) -> DataFrame:
    return rows.select("customer_id", F.col("total_orders").cast("bigint").alias("total_orders"),
                       F.col("total_spent").cast(MONEY).alias("total_spent"),
                       F.col("last_order_date").cast("timestamp_ntz").alias("last_order_date"),
                       bucket("customer_id").alias("bucket"))


def seed_customers(rollup: DataFrame, root: str) -> None:
    """Stores the counters of every customer as they stand before the stream."""
    rows = _counters(rollup.withColumnRenamed("id", "customer_id"))
    changes.write_batch(rows.hint("rebalance", "bucket"), f"{root}/customers",
                        changes.BEFORE_STREAM, ["bucket"])


def follow_customers(receipts: DataFrame, customers: DataFrame, root: str,
                     every: str | None = None,
                     merge_every: int = changes.MERGE_EVERY) -> StreamingQuery:
    """Raises the counters of customers by their conversion orders, each order once.

    A message makes one order, at its first conversion receipt; receipts arrive in order of
    ``seq``. Per micro-batch, orders whose id an earlier batch has are dropped; the others are
    added up per customer and put onto the counters as earlier batches left them. Both states
    lie in buckets by customer, and a batch reads the buckets of its own customers. A batch that
    runs again finds the state before it, so nothing counts twice. The last order date never
    moves back.
    """
    spark = receipts.sparkSession
    made, kept = f"{root}/orders", f"{root}/customers"

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select("id", "customer_id", F.col("amount").cast(MONEY).alias("amount"),
                           "created_at", bucket("customer_id").alias("bucket")).persist()
        like = rows.limit(0)
        near = F.col("bucket").isin(buckets_of(rows, ["customer_id"]))
        known = changes.state_before(spark, made, batch_id, like).where(near)
        new = rows.join(known.select("id"), "id", "left_anti").persist()
        raised = new.groupBy("customer_id").agg(
            F.count("*").alias("total_orders"), F.sum("amount").alias("total_spent"),
            F.max("created_at").alias("last_order_date"))
        shape = _counters(raised).limit(0)
        before = changes.newest(
            changes.state_before(spark, kept, batch_id, shape).where(near)
            .join(raised.select("customer_id"), "customer_id", "left_semi"), ["customer_id"])
        now = (before.select(*COUNTERS).unionByName(raised.select(*COUNTERS))
               .groupBy("customer_id").agg(
                   F.sum("total_orders").alias("total_orders"),
                   F.sum("total_spent").alias("total_spent"),
                   F.max("last_order_date").alias("last_order_date")))
        changes.write_batch(_counters(now).hint("rebalance", "bucket"), kept, batch_id,
                            ["bucket"])
        changes.write_batch(new.hint("rebalance", "bucket"), made, batch_id, ["bucket"])
        if changes.merges(batch_id, merge_every):
            changes.merge(spark, kept, batch_id, ["customer_id"], shape, ["bucket"])
            changes.merge(spark, made, batch_id, ["id"], like, ["bucket"])
        new.unpersist()
        rows.unpersist()

    return changes.start(conversion_orders(receipts, customers), on_batch, f"{root}/_progress",
                         every=every)


def customer_counters(spark: SparkSession, root: str) -> DataFrame:
    return changes.current(spark, f"{root}/customers", ["customer_id"]).drop("bucket")
