"""Orders that follow from conversion receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachline.fixed import CONVERSION_ITEM_CATEGORY, CONVERSION_ITEM_NAME
from reachline.operators.customers import MONEY, customer_rollup
from reachline.operators.receipts import KEYS, message_id


def order_number(campaign_id: Column, customer_id: Column) -> Column:
    """``ORD-`` and sixteen hex digits of the message key, so a replay gives the same number."""
    return F.concat(F.lit("ORD-"), F.upper(F.left(
        F.sha2(message_id(campaign_id, customer_id), 256), F.lit(16))))


def conversion_orders(receipts: DataFrame, customers: DataFrame) -> DataFrame:
    """One order per message: from its first conversion receipt, if that carries a positive
    value and the customer exists. The status of the message plays no part.

    ``id`` is the message key and unique; ``order_number`` is its short form.
    """
    first = (receipts.where(F.col("event_type") == "converted").groupBy(*KEYS)
             .agg(F.min_by("order_value", "seq").alias("amount"),
                  F.min_by("ts", "seq").alias("created_at"))
             .where(F.col("amount") > 0))
    cities = customers.select(F.col("id").alias("customer_id"), "city")
    campaign, customer = map(F.col, KEYS)
    return first.join(cities, "customer_id").select(
        message_id(campaign, customer).alias("id"), *KEYS,
        order_number(campaign, customer).alias("order_number"), "amount",
        F.array(F.struct(F.lit(CONVERSION_ITEM_NAME).alias("name"),
                         F.lit(CONVERSION_ITEM_CATEGORY).alias("category"),
                         F.lit(1).alias("quantity"), F.col("amount").alias("price")))
        .alias("items"),
        F.lit("online").alias("channel"), F.lit("completed").alias("status"),
        "city", "created_at")


def rollup_with_conversions(customers: DataFrame, orders: DataFrame,
                            conversions: DataFrame) -> DataFrame:
    """The order rollup raised by conversion orders; tags are not touched.

    The last order date is that of the newest order or conversion; it never moves back.
    """
    raised = conversions.groupBy(F.col("customer_id").alias("id")).agg(
        F.count("*").alias("more_orders"), F.sum("amount").alias("more_spent"),
        F.max("created_at").alias("converted_at"))
    return (customer_rollup(customers, orders).join(raised, "id", "left")
            .withColumn("total_orders",
                        F.col("total_orders") + F.coalesce("more_orders", F.lit(0)))
            .withColumn("total_spent", (F.col("total_spent") + F.coalesce(
                "more_spent", F.lit(0))).cast(MONEY))
            .withColumn("last_order_date", F.greatest("converted_at", "last_order_date"))
            .drop("more_orders", "more_spent", "converted_at"))
