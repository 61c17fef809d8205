"""Delivery receipts, as files or as a stream, with one shape for both.

``seq`` is the arrival order: the broker offset or an ingest counter. It must be unique
within a message. It is not the event time, which may be out of order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.sources.schemas import PROVIDER_RECEIPT, RECEIPT


def order_value(metadata: Column) -> Column:
    """The order value of a conversion receipt, null without a usable one."""
    return F.try_element_at(metadata, F.lit("order_value")).try_cast("decimal(18,2)")


def _moment(text: Column) -> Column:
    """ISO 8601 text with or without an offset, as UTC."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def parse_receipts(bodies: DataFrame, body: str = "body", key_type: str = "string") -> DataFrame:
    """Webhook bodies (a JSON text column next to ``seq``) to typed receipts."""
    parsed = bodies.select("seq", F.from_json(body, RECEIPT).alias("r"))
    return parsed.select(
        "seq",
        F.col("r.campaign_id").cast(key_type).alias("campaign_id"),
        F.col("r.customer_id").cast(key_type).alias("customer_id"),
        F.col("r.event_type").alias("event_type"),
        _moment(F.col("r.timestamp")).alias("ts"),
        F.col("r.metadata").alias("metadata"),
        order_value(F.col("r.metadata")).alias("order_value"))


def parse_provider_receipts(bodies: DataFrame, body: str = "body",
                            key_type: str = "string") -> DataFrame:
    """Provider bodies, still keyed by the message id."""
    parsed = bodies.select("seq", F.from_json(body, PROVIDER_RECEIPT).alias("r"))
    return parsed.select(
        "seq",
        F.col("r.external_id").cast(key_type).alias("external_id"),
        F.col("r.status").alias("event_type"),
        _moment(F.col("r.timestamp")).alias("ts"),
        F.col("r.metadata").alias("metadata"),
        order_value(F.col("r.metadata")).alias("order_value"))


def resolve_provider_receipts(receipts: DataFrame, communications: DataFrame) -> DataFrame:
    """Provider receipts with campaign and customer found through the message id."""
    messages = communications.select(F.col("id").alias("external_id"), "campaign_id",
                                     "customer_id")
    return receipts.join(messages, "external_id").drop("external_id")


def stream_bodies(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON-lines files carrying ``seq`` and ``body``."""
    return (spark.readStream.schema("seq bigint, body string")
            .option("maxFilesPerTrigger", max_files).json(path))


def kafka_bodies(spark: SparkSession, servers: str, topic: str, per_trigger: int = 5_000_000,
                 **options: str) -> DataFrame:
    """A stream of webhook bodies from a topic keyed by campaign and customer.

    All receipts of a message then share one partition, so the offset is their arrival order.
    Needs the Kafka connector on the cluster.
    """
    records = (spark.readStream.format("kafka")
               .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic,
                           "maxOffsetsPerTrigger": str(per_trigger), **options})
               .load())
    return records.select(F.col("offset").alias("seq"),
                          F.col("value").cast("string").alias("body"))
