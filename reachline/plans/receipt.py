"""Registered queries about delivery receipts and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.functions import stamp
from reachline.operators import conversions, receipts as ops
from reachline.plans.checks import over_tables, stamped
from reachline.session import new_work_path
from reachline.sources import retail, tables
from reachline.sources.receipts import (parse_provider_receipts, parse_receipts,
                                        resolve_provider_receipts)
from reachline.sources.schemas import EVENTS

KEYS = ops.KEYS


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts as the JSON bodies a webhook would get."""
    rows = retail.with_metadata(retail.receipts(spark, folder))
    return rows.select("seq", F.to_json(F.struct(
        F.col("campaign_id").cast("string").alias("campaign_id"),
        F.col("customer_id").cast("string").alias("customer_id"), "event_type",
        F.concat(F.replace(stamp(F.col("ts")), F.lit(" "), F.lit("T")), F.lit("+00:00"))
        .alias("timestamp"), "metadata")).alias("body"))


def _provider_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The same receipts in the shape that names the message."""
    rows = retail.with_metadata(retail.receipts(spark, folder))
    message = F.col("campaign_id") * retail.ID_STEP + F.col("customer_id")
    return rows.select("seq", F.to_json(F.struct(
        message.cast("string").alias("external_id"), F.col("event_type").alias("status"),
        stamp(F.col("ts")).alias("timestamp"), "metadata")).alias("body"))


def _flat_fold(folded: DataFrame) -> DataFrame:
    return folded.select(*KEYS, "status", stamp(F.col("sent_at")).alias("sent_at"),
                         stamp(F.col("updated_at")).alias("updated_at"))


def flat_log(events: str = "events"):
    return F.array_join(F.transform(events, lambda e: F.concat(
        e.event_type, F.lit("@"), stamp(e.ts), F.lit("#"), F.coalesce(
            F.try_element_at(e.metadata, F.lit("order_value")), F.lit("")))), ",")


def receipts_parsed(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_receipts(_bodies(spark, folder), key_type="bigint")
    return parsed.select("seq", *KEYS, "event_type", stamp(F.col("ts")).alias("ts"),
                         F.col("order_value").cast("string").alias("order_value"),
                         F.try_element_at("metadata", F.lit("reason")).alias("reason"))


def receipts_deduped(spark: SparkSession, folder: str) -> DataFrame:
    firsts = ops.first_receipts(retail.receipts(spark, folder))
    return firsts.select("seq", *KEYS, "event_type", stamp(F.col("ts")).alias("ts"))


def receipt_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_fold(ops.fold_receipts(retail.receipts(spark, folder)))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = retail.with_metadata(retail.receipts(spark, folder))
    return ops.event_log(rows).select(*KEYS, flat_log().alias("events"))


def provider_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return parse_provider_receipts(_provider_bodies(spark, folder), key_type="bigint")


def receipts_by_external_id(spark: SparkSession, folder: str) -> DataFrame:
    """Provider receipts folded after finding their message."""
    parsed = provider_receipts(spark, folder)
    queued = retail.queued_communications(retail.receipts(spark, folder))
    return _flat_fold(ops.fold_receipts(resolve_provider_receipts(parsed, queued)))


def communications_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Messages holding each day's morning receipts, after the afternoon's arrive. The first
    upsert is stored as a version, which the second one reads."""
    received = retail.with_metadata(retail.receipts(spark, folder))
    morning = received.where(F.hour("ts") < 12)
    afternoon = received.where(F.hour("ts") >= 12)
    queued = (retail.queued_communications(received)
              .withColumn("recipient", F.lit(None).cast("string"))
              .withColumn("events", F.array().cast(EVENTS)))
    key = lambda campaign, customer: campaign * retail.ID_STEP + customer
    root = new_work_path(spark, "messages")
    tables.write_version(ops.upsert_communications(queued, morning, key), root, 1)
    current = ops.upsert_communications(tables.read_latest(spark, root), afternoon, key)
    return current.select("id", *KEYS, "channel", "status", flat_log().alias("events"),
                          stamp(F.col("sent_at")).alias("sent_at"),
                          stamp(F.col("updated_at")).alias("updated_at"))


def stage_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.stage_event_counts(retail.receipts(spark, folder))


def conversion_orders(spark: SparkSession, folder: str) -> DataFrame:
    return flat_orders(conversions.conversion_orders(retail.receipts(spark, folder),
                                                     retail.customers(spark, folder)))


def flat_orders(orders: DataFrame) -> DataFrame:
    item = F.col("items")[0]
    return orders.select(
        "id", *KEYS, "order_number", F.col("amount").cast("double").alias("amount"),
        F.concat_ws("|", item["name"], item["category"], item["quantity"].cast("string"),
                    item["price"].cast("string")).alias("items"),
        "channel", "status", "city", stamp(F.col("created_at")).alias("created_at"))


def customer_rollup_with_conversions(spark: SparkSession, folder: str) -> DataFrame:
    people = retail.customers(spark, folder)
    made = conversions.conversion_orders(retail.receipts(spark, folder), people)
    raised = conversions.rollup_with_conversions(people, retail.orders(spark, folder), made)
    return raised.select("id", "total_orders",
                         F.col("total_spent").cast("double").alias("total_spent"),
                         stamp(F.col("last_order_date")).alias("last_order_date"))


QUERIES = {
    "receipts_parsed": receipts_parsed,
    "receipts_deduped": receipts_deduped,
    "receipt_fold": receipt_fold,
    "event_log": event_log,
    "receipts_by_external_id": receipts_by_external_id,
    "communications_upsert": communications_upsert,
    "stage_event_counts": stage_event_counts,
    "conversion_orders": conversion_orders,
    "customer_rollup_with_conversions": customer_rollup_with_conversions,
}

LOG = f"""string_agg(event_type || '@' || {stamped('ts')} || '#'
   || coalesce(CAST(order_value AS VARCHAR), ''), ',' ORDER BY seq)"""

_MADE = """
  , made AS (
    SELECT f.campaign_id || '-' || f.customer_id AS id, f.campaign_id, f.customer_id,
      'ORD-' || upper(left(sha256(f.campaign_id || '-' || f.customer_id), 16)) AS order_number,
      f.order_value AS amount, p.city, f.ts AS created_at
    FROM firsts f JOIN crm_people p ON p.id = f.customer_id
    WHERE f.event_type = 'converted' AND f.order_value > 0)"""

FOLD_SQL = over_tables(f"""
  SELECT campaign_id, customer_id, status, {stamped('sent_at')} AS sent_at,
    {stamped('updated_at')} AS updated_at FROM folded""")
COUNT_SQL = over_tables(
    "SELECT event_type, count(*) AS receipts FROM receipts GROUP BY event_type")
MADE_SQL = over_tables(f"""{_MADE}
  SELECT id, campaign_id, customer_id, order_number, CAST(amount AS DOUBLE) AS amount,
    'Campaign Product|Marketing|1|' || amount AS items, 'online' AS channel,
    'completed' AS status, city, {stamped('created_at')} AS created_at FROM made""")

_LOGS = f"""
  , logs AS (
    SELECT campaign_id, customer_id, {LOG} AS events, max(ts) AS accepted_at
    FROM firsts GROUP BY campaign_id, customer_id)"""
_MESSAGE = f"""c.campaign_id, c.customer_id, c.channel, c.status,
    coalesce(l.events, '') AS events, {stamped('c.sent_at')} AS sent_at,
    {stamped('coalesce(l.accepted_at, c.updated_at)')} AS updated_at"""
_WITH_LOGS = """FROM comms c LEFT JOIN logs l
    ON l.campaign_id = c.campaign_id AND l.customer_id = c.customer_id"""
MESSAGES_SQL = over_tables(f"{_LOGS} SELECT {_MESSAGE} {_WITH_LOGS}")

ORACLES = {
    "receipts_parsed": over_tables(f"""
      SELECT seq, campaign_id, customer_id, event_type, {stamped('ts')} AS ts,
        CAST(order_value AS VARCHAR) AS order_value,
        CASE WHEN event_type = 'failed' THEN 'carrier_error' END AS reason FROM receipts"""),
    "receipts_deduped": over_tables(f"""
      SELECT seq, campaign_id, customer_id, event_type, {stamped('ts')} AS ts FROM firsts"""),
    "receipt_fold": FOLD_SQL,
    "event_log": over_tables(f"""
      SELECT campaign_id, customer_id, {LOG} AS events FROM firsts
      GROUP BY campaign_id, customer_id"""),
    "receipts_by_external_id": over_tables(f"""
      SELECT f.campaign_id, f.customer_id, f.status, {stamped('f.sent_at')} AS sent_at,
        {stamped('f.updated_at')} AS updated_at
      FROM folded f SEMI JOIN audience a
        ON a.campaign_id = f.campaign_id AND a.customer_id = f.customer_id"""),
    "communications_upsert": over_tables(f"""{_LOGS}
      SELECT c.id, {_MESSAGE} {_WITH_LOGS}"""),
    "stage_event_counts": COUNT_SQL,
    "conversion_orders": MADE_SQL,
    "customer_rollup_with_conversions": over_tables(f"""{_MADE}
      SELECT r.id, r.total_orders + coalesce(m.n, 0) AS total_orders,
        CAST(r.total_spent + coalesce(m.s, 0) AS DOUBLE) AS total_spent,
        {stamped('greatest(m.last, r.last_order_date)')} AS last_order_date
      FROM crm_rollup r LEFT JOIN (
        SELECT customer_id, count(*) AS n, sum(amount) AS s, max(created_at) AS last
        FROM made GROUP BY customer_id) m ON m.customer_id = r.id"""),
}
