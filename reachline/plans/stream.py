"""Registered queries that run the receipt streams over the events table to their end.

Each run uses new folders below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.functions import stamp
from reachline.operators.conversions import conversion_orders
from reachline.operators.customers import customer_rollup
from reachline.operators.receipts import fold_receipts
from reachline.plans.campaign import MOMENTS_SQL
from reachline.plans.checks import over_tables
from reachline.plans.receipt import (COUNT_SQL, FOLD_SQL, MADE_SQL, MESSAGES_SQL, ORACLES as
                                     RECEIPT_ORACLES, flat_log, flat_orders,
                                     provider_receipts)
from reachline.session import new_work_path
from reachline.sources import retail
from reachline.sources.schemas import EVENTS
from reachline.streaming import changes, customers, pending, receipts


def _finish(*queries) -> None:
    for query in queries:
        query.awaitTermination()


def _receipts(spark: SparkSession, folder: str, late_strangers: bool = False) -> DataFrame:
    return retail.receipts_from(retail.event_stream(
        spark, folder, new_work_path(spark, "events"), late_strangers=late_strangers))


def receipt_fold_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = new_work_path(spark, "fold")
    _finish(receipts.follow_messages(_receipts(spark, folder), root,
                                     retail.campaigns(spark, folder)))
    return receipts.message_statuses(spark, root).select(
        "campaign_id", "customer_id", "status",
        stamp(F.col("sent_at")).alias("sent_at"),
        stamp(F.col("updated_at")).alias("updated_at"))


def communications_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = new_work_path(spark, "communications")
    queued = (retail.queued_communications(retail.receipts(spark, folder))
              .withColumn("id", F.col("id").cast("string"))
              .withColumn("recipient", F.lit(None).cast("string"))
              .withColumn("events", F.array().cast(EVENTS)))
    receipts.seed_communications(queued, root)
    _finish(receipts.follow_communications(
        retail.with_metadata(_receipts(spark, folder)), root))
    return receipts.communications(spark, root).select(
        "campaign_id", "customer_id", "channel", "status", flat_log().alias("events"),
        stamp(F.col("sent_at")).alias("sent_at"),
        stamp(F.col("updated_at")).alias("updated_at"))


def live_campaigns_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Completed campaigns stay completed when a stranger's receipt comes later."""
    root = new_work_path(spark, "live")
    receipts.seed_messages(retail.queued_communications(retail.receipts(spark, folder)), root)
    _finish(receipts.follow_messages(_receipts(spark, folder, late_strangers=True), root,
                                     retail.campaigns(spark, folder)))
    return receipts.live_campaigns(spark, root).select(
        "campaign_id", "total_sent", "messages", "queued", "status",
        stamp(F.col("completed_at")).alias("completed_at"))


def customer_counters_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = new_work_path(spark, "counters")
    people = retail.customers(spark, folder)
    customers.seed_customers(customer_rollup(people, retail.orders(spark, folder)), root)
    _finish(customers.follow_customers(_receipts(spark, folder), people, root))
    return customers.customer_counters(spark, root).select(
        F.col("customer_id").alias("id"), "total_orders",
        F.col("total_spent").cast("double").alias("total_spent"),
        stamp(F.col("last_order_date")).alias("last_order_date"))


def _share(key: str) -> Column:
    """A number from 0 to 1 that spreads keys evenly."""
    return F.pmod(F.xxhash64(key), F.lit(1000)) / 1000


def _provider_root(spark: SparkSession, folder: str) -> str:
    """Provider receipts and the messages they name as two streams, each in three parts; most
    messages arrive after some of their receipts."""
    root = new_work_path(spark, "provider")
    received = provider_receipts(spark, folder).drop("metadata")
    numbered = received.agg(F.max("seq")).scalar()
    messages = retail.queued_communications(retail.receipts(spark, folder)).select(
        "id", "campaign_id", "customer_id")
    _finish(*pending.follow_children(
        retail.table_stream(received, F.col("seq") / numbered, f"{root}/in-receipts"),
        retail.table_stream(messages, _share("id"), f"{root}/in-messages"),
        "external_id", "id", root))
    return root


def receipts_by_external_id_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Provider receipts that wait for their message, folded once all have arrived."""
    found = pending.found_children(spark, _provider_root(spark, folder))
    return fold_receipts(found).select(
        "campaign_id", "customer_id", "status", stamp(F.col("sent_at")).alias("sent_at"),
        stamp(F.col("updated_at")).alias("updated_at"))


def waiting_receipts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """How many provider receipts arrived, found their message and wait for one for good."""
    return pending.waiting_children(spark, _provider_root(spark, folder))


def late_customers_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Conversion orders where customers arrive in parts, before or after their receipts."""
    root = new_work_path(spark, "late-customers")
    people = retail.customers(spark, folder).select(F.col("id").alias("person"), "city")
    converted = _receipts(spark, folder).where(F.col("event_type") == "converted")
    _finish(*pending.follow_children(
        converted, retail.table_stream(people, _share("person"), f"{root}/in-customers"),
        "customer_id", "person", root))
    found = pending.found_children(spark, root)
    known = found.select(F.col("person").alias("id"), "city").distinct()
    return flat_orders(conversion_orders(found.drop("person", "city"), known))


def conversion_orders_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = new_work_path(spark, "orders")
    _finish(receipts.follow_conversions(_receipts(spark, folder),
                                        retail.customers(spark, folder), root))
    return flat_orders(changes.current(spark, f"{root}/orders", ["id"]))


def stage_event_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = new_work_path(spark, "stages")
    _finish(receipts.follow_stages(_receipts(spark, folder), root))
    return changes.current(spark, f"{root}/stages", ["event_type"])


QUERIES = {
    "receipt_fold_stream": receipt_fold_stream,
    "communications_stream": communications_stream,
    "live_campaigns_stream": live_campaigns_stream,
    "customer_counters_stream": customer_counters_stream,
    "receipts_by_external_id_stream": receipts_by_external_id_stream,
    "waiting_receipts_stream": waiting_receipts_stream,
    "late_customers_stream": late_customers_stream,
    "conversion_orders_stream": conversion_orders_stream,
    "stage_event_counts_stream": stage_event_counts_stream,
}

ORACLES = {
    "receipt_fold_stream": FOLD_SQL,
    "communications_stream": MESSAGES_SQL,
    "live_campaigns_stream": over_tables(f"""{MOMENTS_SQL}
      SELECT campaign_id, total_sent, messages, queued, status, completed_at FROM moments
      WHERE campaign_id IN (SELECT campaign_id FROM late)"""),
    "customer_counters_stream": RECEIPT_ORACLES["customer_rollup_with_conversions"],
    "receipts_by_external_id_stream": RECEIPT_ORACLES["receipts_by_external_id"],
    "waiting_receipts_stream": over_tables("""
      SELECT count(*) AS received, count(a.campaign_id) AS found,
        count(*) - count(a.campaign_id) AS waiting
      FROM receipts r LEFT JOIN audience a
        ON a.campaign_id = r.campaign_id AND a.customer_id = r.customer_id"""),
    "late_customers_stream": MADE_SQL,
    "conversion_orders_stream": MADE_SQL,
    "stage_event_counts_stream": COUNT_SQL,
}
