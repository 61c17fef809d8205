"""Customer rollups, behaviour tags, search and population statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachline.functions import days_before, time_ago, whole_days_since
from reachline.functions.contact import filled
from reachline.functions.dates import AsOf

MONEY = "decimal(18,2)"


def order_rollup(orders: DataFrame) -> DataFrame:
    """Completed orders per customer. Partial sums keep one busy customer cheap."""
    return (orders.where(F.col("status") == "completed")
            .groupBy("customer_id")
            .agg(F.count("*").alias("total_orders"),
                 F.sum("amount").cast(MONEY).alias("total_spent"),
                 F.max("created_at").alias("last_order_date")))


def customer_rollup(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with its rollup; zero, zero and null without completed orders."""
    totals = order_rollup(orders).withColumnRenamed("customer_id", "id")
    return (customers.join(totals, "id", "left")
            .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
            .withColumn("total_spent", F.coalesce("total_spent", F.lit(0).cast(MONEY))))


def behaviour_tags(as_of: AsOf, vip_spent: float = 15000, churned_days: int = 60,
                   churned_orders: int = 1, new_days: int = 30, new_orders: int = 1,
                   loyal_orders: int = 5) -> Column:
    """Tags in the order vip, churned, new, loyal."""
    spent, orders = F.col("total_spent"), F.col("total_orders")
    idle = whole_days_since(F.col("last_order_date"), as_of)
    age = whole_days_since(F.col("created_at"), as_of)
    return F.array_compact(F.array(
        F.when(spent > vip_spent, F.lit("vip")),
        F.when((idle > churned_days) & (orders > churned_orders), F.lit("churned")),
        F.when((age < new_days) & (orders <= new_orders), F.lit("new")),
        F.when(orders >= loyal_orders, F.lit("loyal"))))


def customer_profiles(customers: DataFrame, orders: DataFrame, as_of: AsOf,
                      **thresholds: float) -> DataFrame:
    """Rollup plus tags."""
    return (customer_rollup(customers, orders)
            .withColumn("tags", behaviour_tags(as_of, **thresholds)))


def search_customers(customers: DataFrame, city: str | None = None, gender: str | None = None,
                     tag: str | None = None, min_spent: float | None = None,
                     max_spent: float | None = None, search: str | None = None,
                     limit: int = 500, offset: int = 0,
                     after: tuple[object, object] | None = None) -> DataFrame:
    """Active customers by spend, best first. The search term is plain text, any case.

    ``offset`` + ``limit`` rows pass through one task, so for pages far down give ``after``, the
    spend and id of the last row shown; the rows before it are then filtered out where they
    are read.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must lie in 1..1000 and offset must not be negative")
    found = customers.where("is_active")
    if city:
        found = found.where(F.col("city") == city)
    if gender:
        found = found.where(F.col("gender") == gender)
    if tag:
        found = found.where(F.array_contains("tags", tag))
    if min_spent is not None:
        found = found.where(F.col("total_spent") >= F.lit(float(min_spent)))
    if max_spent is not None:
        found = found.where(F.col("total_spent") <= F.lit(float(max_spent)))
    if search:
        term = F.lower(F.lit(search))
        found = found.where(F.contains(F.lower("name"), term)
                            | F.contains(F.lower("email"), term))
    if after:
        spent, key = (F.lit(value) for value in after)
        found = found.where((F.col("total_spent") < spent)
                            | ((F.col("total_spent") == spent) & (F.col("id") > key)))
    return found.orderBy(F.desc("total_spent"), "id").offset(offset).limit(limit)


def customer_stats(customers: DataFrame, as_of: AsOf, new_days: int = 30) -> DataFrame:
    """Totals over all customers, active or not."""
    spent, orders = F.sum("total_spent"), F.sum("total_orders")
    return customers.agg(
        F.count("*").alias("total_customers"),
        F.coalesce(F.round(spent, 2).cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.when(orders > 0, F.round(spent.cast("double") / orders, 2))
        .otherwise(F.lit(0.0)).alias("avg_order_value"),
        F.count_if(F.col("created_at") >= days_before(as_of, new_days)).alias("new_this_month"))


def city_breakdown(customers: DataFrame) -> DataFrame:
    """Customers per city; missing and empty cities are left out."""
    return (customers.where(filled(F.col("city")).isNotNull())
            .groupBy("city").agg(F.count("*").alias("customers")))


def tag_breakdown(customers: DataFrame) -> DataFrame:
    """Customers per tag."""
    return (customers.select(F.explode("tags").alias("tag"))
            .groupBy("tag").agg(F.count("*").alias("customers")))


def tag_share(customers: DataFrame) -> DataFrame:
    """Each tag's share of all tag assignments, in whole percent."""
    total = customers.agg(F.sum(F.size("tags"))).scalar()
    return tag_breakdown(customers).withColumn(
        "share_pct", F.round(F.lit(100.0) * F.col("customers") / total, 0))


def filter_facets(customers: DataFrame) -> DataFrame:
    """Distinct cities and tags of active customers, found in one pass."""
    entries = F.concat(
        F.array(F.struct(F.lit("city").alias("facet"), F.col("city").alias("value"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return (customers.where("is_active").select(F.explode(entries).alias("e"))
            .select("e.facet", "e.value").distinct())


def recent_orders(customers: DataFrame, orders: DataFrame, n: int = 10) -> DataFrame:
    """Every customer with up to ``n`` newest orders, numbered from the newest.

    The rank filter lets Spark keep only ``n`` rows per customer before the shuffle.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = (orders.withColumn("position", F.row_number().over(newest))
              .where(F.col("position") <= n)
              .select(F.col("customer_id"), F.col("id").alias("order_id"), "order_number",
                      "amount", F.col("status").alias("order_status"),
                      F.col("created_at").alias("ordered_at"), "position"))
    return (customers.select(F.col("id").alias("customer_id"), "name")
            .join(ranked, "customer_id", "left"))


def last_active(customers: DataFrame, as_of: AsOf) -> DataFrame:
    """How long ago each customer last ordered, in words."""
    return customers.select("id", "name",
                            time_ago(F.col("last_order_date"), as_of).alias("last_active"))


def population_profile(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row describing the customer base; the city part is ``city_breakdown``."""
    dates = orders.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    first = F.date_format("first", "yyyy-MM-dd")
    last = F.date_format("last", "yyyy-MM-dd")
    date_range = dates.select(
        F.coalesce(F.concat(first, F.lit(" to "), last), F.lit("unknown"))).scalar()
    return customers.agg(
        F.count("*").alias("total_customers"),
        F.coalesce(F.round(F.sum("total_spent").cast("double") / F.count("total_spent"), 2),
                   F.lit(0.0)).alias("avg_spent"),
        F.coalesce(F.max("total_spent").cast("double"), F.lit(0.0)).alias("max_spent"),
        ).withColumn("order_dates", date_range)


def population_context(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The customer base in words, as it is put before a model that writes rules.

    The list has one entry per city, in alphabetical order.
    """
    cities = city_breakdown(customers).agg(F.sort_array(F.collect_list(
        F.format_string("'%s': %d", "city", "customers"))).alias("cities"))
    whole = lambda c: F.format_number(F.col(c), 0)
    return population_profile(customers, orders).select(F.concat(
        F.lit("Total customers: "), F.col("total_customers").cast("string"),
        F.lit("\nCities: {"), F.array_join(cities.scalar(), ", "), F.lit("}"),
        F.lit("\nAvg total_spent: ₹"), whole("avg_spent"),
        F.lit(", Max: ₹"), whole("max_spent"),
        F.lit("\nOrder date range: "), F.col("order_dates")).alias("context"))


def built_in_segment_counts(customers: DataFrame, as_of: AsOf, high_value: float = 10000,
                            lapsed_days: int = 45) -> DataFrame:
    """Sizes of the two built-in segments, which use strict bounds."""
    idle = whole_days_since(F.col("last_order_date"), as_of)
    counts = customers.agg(
        F.count_if(F.col("total_spent") > high_value).alias("high"),
        F.count_if(idle > lapsed_days).alias("lapsed"))
    return counts.selectExpr(
        "stack(2, 'High Value Customers', high, 'Lapsed Customers', lapsed) "
        "AS (segment, customers)")


def revenue_by_month(orders: DataFrame) -> DataFrame:
    """Order count and revenue per month, over all orders and over completed ones."""
    completed = F.when(F.col("status") == "completed", F.col("amount"))
    return (orders.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
            .agg(F.count("*").alias("orders"),
                 F.sum("amount").cast("double").alias("revenue"),
                 F.coalesce(F.sum(completed).cast("double"), F.lit(0.0))
                 .alias("completed_revenue")))


def nest_order_items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with their lines as an array and the total the lines add up to.

    A line list belongs to one order and is bounded by it.
    """
    items = (lines.groupBy("order_id")
             .agg(F.sort_array(F.collect_list(
                 F.struct("line_number", "name", "category", "quantity", "price")))
                 .alias("items")))
    worth = F.aggregate(
        "items", F.lit(0).cast("decimal(38,2)"),
        lambda total, item: (total + item.price * item.quantity).cast("decimal(38,2)"))
    return (orders.join(items, orders.id == items.order_id, "left").drop("order_id")
            .withColumn("items_total", F.coalesce(worth, F.lit(0)).cast(MONEY))
            .withColumn("amount_matches", F.col("items_total") == F.col("amount")))
