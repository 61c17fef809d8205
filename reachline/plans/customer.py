"""Registered queries about customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.functions import stamp
from reachline.operators import customers as ops
from reachline.operators.maintenance import constraint_violations
from reachline.operators.paging import with_pages
from reachline.plans.checks import over_tables, stamped
from reachline.sources import retail
from reachline.sources.retail import AS_OF, HIGH_VALUE


def src_customers(spark: SparkSession, folder: str) -> DataFrame:
    return retail.customers(spark, folder).withColumn("created_at", stamp(F.col("created_at")))


def src_orders(spark: SparkSession, folder: str) -> DataFrame:
    return (retail.orders(spark, folder).withColumn("amount", F.col("amount").cast("double"))
            .withColumn("created_at", stamp(F.col("created_at"))))


def order_items_nested(spark: SparkSession, folder: str) -> DataFrame:
    nested = ops.nest_order_items(retail.orders(spark, folder),
                                  retail.order_lines(spark, folder))
    text = F.transform("items", lambda i: F.concat_ws(
        "|", i.line_number.cast("string"), i["name"], i.category, i.quantity.cast("string"),
        i.price.cast("string")))
    return nested.select("id", F.coalesce(F.array_join(text, ";"), F.lit("")).alias("items"),
                         F.col("items_total").cast("double").alias("items_total"),
                         "amount_matches")


def customer_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = ops.customer_rollup(retail.customers(spark, folder), retail.orders(spark, folder))
    return rolled.select("id", "total_orders",
                         F.col("total_spent").cast("double").alias("total_spent"),
                         stamp(F.col("last_order_date")).alias("last_order_date"))


def customer_tags(spark: SparkSession, folder: str) -> DataFrame:
    return retail.profiles(spark, folder).select("id", F.array_join("tags", ",").alias("tags"))


def customer_search(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.search_customers(retail.profiles(spark, folder), gender="F", tag="churned",
                                 min_spent=100000, max_spent=5000000, search="CUSTOMER.0",
                                 limit=200, offset=5)
    return found.select("id", "name", "email",
                        F.col("total_spent").cast("double").alias("total_spent"))


def customer_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.customer_stats(retail.profiles(spark, folder), AS_OF)


def city_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return ops.city_breakdown(retail.customers(spark, folder))


def tag_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tag_breakdown(retail.profiles(spark, folder))


def tag_share(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tag_share(retail.profiles(spark, folder))


def filter_facets(spark: SparkSession, folder: str) -> DataFrame:
    return ops.filter_facets(retail.profiles(spark, folder))


def recent_orders(spark: SparkSession, folder: str) -> DataFrame:
    recent = ops.recent_orders(retail.customers(spark, folder), retail.orders(spark, folder))
    return (recent.withColumn("amount", F.col("amount").cast("double"))
            .withColumn("ordered_at", stamp(F.col("ordered_at"))))


def customer_last_active(spark: SparkSession, folder: str) -> DataFrame:
    return ops.last_active(retail.profiles(spark, folder), AS_OF)


def population_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ops.population_profile(retail.profiles(spark, folder), retail.orders(spark, folder))


def population_context(spark: SparkSession, folder: str) -> DataFrame:
    return ops.population_context(retail.profiles(spark, folder), retail.orders(spark, folder))


def seed_segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.built_in_segment_counts(retail.profiles(spark, folder), AS_OF, HIGH_VALUE)


def revenue_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return ops.revenue_by_month(retail.orders(spark, folder))


def customer_pages(spark: SparkSession, folder: str) -> DataFrame:
    active = retail.profiles(spark, folder).where("is_active").select("id", "total_spent")
    return with_pages(active, F.desc("total_spent"), F.col("id")).select(
        "id", "position", "page", "pages")


def constraints(spark: SparkSession, folder: str) -> DataFrame:
    """The derived tables with faults put in by rule, checked."""
    key = F.col("id")
    people = retail.customers(spark, folder)
    faulty_people = people.select(
        "id", F.when(key % 97 != 0, F.col("name")).alias("name"),
        F.when(key % 89 == 0, F.lit(None)).when(key % 83 == 0, "no-at-sign.example.com")
        .when(key % 79 == 0, F.concat(F.floor(key / 790).cast("string"), F.lit("@shared.org")))
        .otherwise(F.col("email")).alias("email"))
    faulty_orders = retail.orders(spark, folder).select(
        "id", F.when(key % 211 == 0, -F.col("customer_id") - 1)
        .otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(key % 199 == 0, F.lit("NO-0")).otherwise(F.col("order_number"))
        .alias("order_number"),
        F.when(key % 197 != 0, F.col("amount")).alias("amount"))
    messages = retail.with_recipient(retail.communications(spark, folder), people)
    messages = messages.withColumns({
        c: F.when(F.col("id") % modulus != 0, F.col(c))
        for c, modulus in (("campaign_id", 193), ("customer_id", 191))})
    heads = retail.campaign_heads(spark).withColumn(
        "segment_id", F.when(key != 31, F.when(key == 30, 77).otherwise(F.col("segment_id"))))
    return constraint_violations(faulty_people, faulty_orders, messages,
                                 heads, retail.segments(spark))


QUERIES = {
    "src_customers": src_customers,
    "src_orders": src_orders,
    "order_items_nested": order_items_nested,
    "customer_rollup": customer_rollup,
    "customer_tags": customer_tags,
    "customer_search": customer_search,
    "customer_stats": customer_stats,
    "city_breakdown": city_breakdown,
    "tag_breakdown": tag_breakdown,
    "tag_share": tag_share,
    "filter_facets": filter_facets,
    "recent_orders": recent_orders,
    "customer_last_active": customer_last_active,
    "population_profile": population_profile,
    "population_context": population_context,
    "seed_segment_counts": seed_segment_counts,
    "revenue_by_month": revenue_by_month,
    "customer_pages": customer_pages,
    "constraint_violations": constraints,
}

_AGE = "date_diff('second', last_order_date, TIMESTAMP '2001-08-02 00:00:00')"

ORACLES = {name: over_tables(sql) for name, sql in {
    "src_customers": f"""
      SELECT id, name, email, phone, city, gender, age, is_active,
        {stamped('created_at')} AS created_at FROM crm_people""",
    "src_orders": f"""
      SELECT id, customer_id, order_number, CAST(amount AS DOUBLE) AS amount, channel, status,
        {stamped('created_at')} AS created_at FROM crm_orders""",
    "order_items_nested": """
      , halved AS (
        SELECT l_orderkey, l_linenumber, p_name, p_type, CAST(l_quantity AS INTEGER) AS q,
          -- half-up in whole cents, as ties occur
          CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + q) // (2 * q)
            AS DECIMAL(18,2)) / 100 AS cents
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
      priced AS (SELECT * EXCLUDE (cents), CAST(cents AS DECIMAL(18,2)) AS price FROM halved),
      nested AS (
        SELECT l_orderkey,
          string_agg(concat_ws('|', l_linenumber, p_name, p_type, q, price), ';'
                     ORDER BY l_linenumber, p_name, p_type, q, price) AS items,
          CAST(sum(price * q) AS DECIMAL(18,2)) AS total
        FROM priced GROUP BY l_orderkey)
      SELECT o.id, coalesce(n.items, '') AS items,
        CAST(coalesce(n.total, 0) AS DOUBLE) AS items_total,
        coalesce(n.total, 0) = o.amount AS amount_matches
      FROM crm_orders o LEFT JOIN nested n ON n.l_orderkey = o.id""",
    "customer_rollup": f"""
      SELECT id, total_orders, CAST(total_spent AS DOUBLE) AS total_spent,
        {stamped('last_order_date')} AS last_order_date FROM crm_rollup""",
    "customer_tags": "SELECT id, array_to_string(tags, ',') AS tags FROM crm_customers",
    "customer_search": """
      SELECT id, name, email, CAST(total_spent AS DOUBLE) AS total_spent FROM (
        SELECT * FROM crm_customers
        WHERE is_active AND gender = 'F' AND list_contains(tags, 'churned')
          AND total_spent BETWEEN 100000 AND 5000000
          AND (name ILIKE '%CUSTOMER.0%' OR email ILIKE '%CUSTOMER.0%')
        ORDER BY crm_customers.total_spent DESC, id LIMIT 200 OFFSET 5)""",
    "customer_stats": """
      SELECT count(*) AS total_customers, CAST(sum(total_spent) AS DOUBLE) AS total_revenue,
        round(CAST(sum(total_spent) AS DOUBLE) / sum(total_orders), 2) AS avg_order_value,
        count(*) FILTER (created_at >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 30 DAY)
          AS new_this_month
      FROM crm_customers""",
    "city_breakdown": """
      SELECT city, count(*) AS customers FROM crm_people
      WHERE city IS NOT NULL AND city <> '' GROUP BY city""",
    "tag_breakdown": """
      SELECT tag, count(*) AS customers FROM (SELECT unnest(tags) AS tag FROM crm_customers)
      GROUP BY tag""",
    "tag_share": """
      SELECT tag, count(*) AS customers,
        round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS share_pct
      FROM (SELECT unnest(tags) AS tag FROM crm_customers) GROUP BY tag""",
    "filter_facets": """
      SELECT DISTINCT 'city' AS facet, city AS value FROM crm_customers WHERE is_active
      UNION ALL
      SELECT DISTINCT 'tag' AS facet, tag AS value
      FROM (SELECT unnest(tags) AS tag FROM crm_customers WHERE is_active)""",
    "recent_orders": f"""
      SELECT p.id AS customer_id, p.name, r.id AS order_id, r.order_number,
        CAST(r.amount AS DOUBLE) AS amount, r.status AS order_status,
        {stamped('r.created_at')} AS ordered_at, CAST(r.rn AS INTEGER) AS position
      FROM crm_people p LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY customer_id
                                     ORDER BY created_at DESC, id DESC) AS rn
        FROM crm_orders) r ON r.customer_id = p.id AND r.rn <= 10""",
    "customer_last_active": f"""
      SELECT id, name, CASE WHEN last_order_date IS NULL THEN 'Never'
        WHEN {_AGE} > 31536000 THEN ({_AGE} // 31536000) || ' years ago'
        WHEN {_AGE} > 2592000 THEN ({_AGE} // 2592000) || ' months ago'
        WHEN {_AGE} > 86400 THEN ({_AGE} // 86400) || ' days ago'
        WHEN {_AGE} > 3600 THEN ({_AGE} // 3600) || ' hours ago'
        WHEN {_AGE} > 60 THEN ({_AGE} // 60) || ' minutes ago'
        ELSE {_AGE} || ' seconds ago' END AS last_active
      FROM crm_customers""",
    "population_profile": """
      SELECT count(*) AS total_customers,
        round(CAST(sum(total_spent) AS DOUBLE) / count(*), 2) AS avg_spent,
        CAST(max(total_spent) AS DOUBLE) AS max_spent,
        (SELECT strftime(min(created_at), '%Y-%m-%d') || ' to '
           || strftime(max(created_at), '%Y-%m-%d') FROM crm_orders) AS order_dates
      FROM crm_customers""",
    "population_context": """
      SELECT 'Total customers: ' || count(*) || chr(10) || 'Cities: {'
        || (SELECT string_agg(chr(39) || city || chr(39) || ': ' || n, ', ' ORDER BY city)
            FROM (SELECT city, count(*) AS n FROM crm_people WHERE city <> '' GROUP BY city))
        || '}' || chr(10) || 'Avg total_spent: ₹'
        || format('{:,.0f}', round(CAST(sum(total_spent) AS DOUBLE) / count(*), 2))
        || ', Max: ₹' || format('{:,.0f}', CAST(max(total_spent) AS DOUBLE)) || chr(10)
        || 'Order date range: ' || (SELECT strftime(min(created_at), '%Y-%m-%d') || ' to '
           || strftime(max(created_at), '%Y-%m-%d') FROM crm_orders) AS context
      FROM crm_customers""",
    "seed_segment_counts": """
      SELECT 'High Value Customers' AS segment,
        count(*) FILTER (total_spent > 2000000) AS customers FROM crm_customers
      UNION ALL
      SELECT 'Lapsed Customers', count(*) FILTER (
        date_sub('day', last_order_date, TIMESTAMP '2001-08-02 00:00:00') > 45)
      FROM crm_customers""",
    "revenue_by_month": """
      SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS orders,
        CAST(sum(amount) AS DOUBLE) AS revenue,
        CAST(coalesce(sum(amount) FILTER (status = 'completed'), 0) AS DOUBLE)
          AS completed_revenue
      FROM crm_orders GROUP BY 1""",
    "customer_pages": """
      SELECT id, rn AS position, CAST((rn + 19) // 20 AS BIGINT) AS page,
        CAST(greatest((n + 19) // 20, 1) AS BIGINT) AS pages
      FROM (SELECT id, row_number() OVER (ORDER BY total_spent DESC, id) AS rn,
              count(*) OVER () AS n FROM crm_customers WHERE is_active)""",
    "constraint_violations": """
      , people AS (
        SELECT id, CASE WHEN id % 97 = 0 THEN NULL ELSE name END AS name,
          CASE WHEN id % 89 = 0 THEN NULL WHEN id % 83 = 0 THEN 'no-at-sign.example.com'
               WHEN id % 79 = 0 THEN (id // 790) || '@shared.org' ELSE email END AS email
        FROM crm_people),
      sales AS (
        SELECT id, CASE WHEN id % 211 = 0 THEN -customer_id - 1 ELSE customer_id END
            AS customer_id,
          CASE WHEN id % 199 = 0 THEN 'NO-0' ELSE order_number END AS order_number,
          CASE WHEN id % 197 = 0 THEN NULL ELSE amount END AS amount
        FROM crm_orders)
      SELECT 'customers' AS table_name, 'name missing' AS violation,
        CAST(id AS VARCHAR) AS row_key FROM people WHERE name IS NULL
      UNION ALL SELECT 'customers', 'email missing', CAST(id AS VARCHAR) FROM people
        WHERE email IS NULL
      UNION ALL SELECT 'customers', 'email malformed', CAST(id AS VARCHAR) FROM people
        WHERE email NOT LIKE '%@%.%'
      UNION ALL SELECT 'customers', 'email repeated', email FROM people
        WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
      UNION ALL SELECT 'orders', 'amount missing', CAST(id AS VARCHAR) FROM sales
        WHERE amount IS NULL
      UNION ALL SELECT 'orders', 'order_number repeated', order_number FROM sales
        GROUP BY order_number HAVING count(*) > 1
      UNION ALL SELECT 'orders', 'customer_id unknown', CAST(id AS VARCHAR) FROM sales
        WHERE customer_id NOT IN (SELECT id FROM people)
      UNION ALL SELECT 'campaigns', 'segment_id missing', '31'
      UNION ALL SELECT 'campaigns', 'segment_id unknown', '30'
      UNION ALL SELECT 'campaigns', 'segment_id unknown', '34'
      UNION ALL SELECT 'communications', 'campaign_id missing', CAST(id AS VARCHAR) FROM comms
        WHERE id % 193 = 0
      UNION ALL SELECT 'communications', 'customer_id missing', CAST(id AS VARCHAR) FROM comms
        WHERE id % 191 = 0
      UNION ALL SELECT 'communications', 'recipient missing', CAST(id AS VARCHAR) FROM comms
        WHERE channel = 'unknown'
      UNION ALL SELECT 'communications', 'customer_id unknown', CAST(id AS VARCHAR) FROM comms
        WHERE id % 191 <> 0 AND customer_id NOT IN (SELECT id FROM people)
      UNION ALL SELECT 'communications', 'campaign_id unknown', CAST(id AS VARCHAR) FROM comms
        WHERE id % 193 <> 0 AND campaign_id NOT IN (SELECT id FROM campaigns)""",
}.items()}
