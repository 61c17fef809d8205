"""Marketing tables derived from the retail tables (see FIXTURES.md).

Every column is a deterministic expression. ``folder`` holds one parquet file per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.fixed import UNKNOWN_CHANNEL
from reachline.functions import as_timestamp, days_before, recipient
from reachline.operators.customers import customer_profiles
from reachline.operators.receipts import fold_receipts

AS_OF = "2001-08-02 00:00:00"
FIRST_CAMPAIGN_DAY = "2000-01-01 00:00:00"
THRESHOLDS = {"vip_spent": 2000000, "new_orders": 6}
HIGH_VALUE = 2000000
SENT_CAMPAIGNS = 30
ID_STEP = 10 ** 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders")
    return raw.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("NO-"), F.col("o_orderkey").cast("string")).alias("order_number"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderkey") % 2 == 0, "online").otherwise("in-store").alias("channel"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "completed")
        .when(F.col("o_orderpriority") < "3", "returned")
        .otherwise("cancelled").alias("status"),
        F.col("o_orderdate").alias("created_at"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey, "left").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                / F.col("l_quantity").cast("decimal(18,0)"), 2)
        .cast("decimal(18,2)").alias("price"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Identity and contact columns, before any rollup."""
    raw = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return raw.join(nations, raw.c_nationkey == nations.n_nationkey, "left").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                 F.lit("@example.com")).alias("email"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, "")
        .otherwise(F.concat(F.lit("+91"), (key + 9000000000).cast("string"))).alias("phone"),
        F.when(key % 37 != 0, F.col("n_name")).alias("city"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        (key % 38 + 18).cast("int").alias("age"),
        (key % 20 != 19).alias("is_active"),
        days_before(AS_OF, key * 7 % 365 + 1).alias("created_at"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with order rollup and behaviour tags."""
    return customer_profiles(customers(spark, folder), orders(spark, folder), AS_OF,
                             **THRESHOLDS)


def _receipt_type(event_type: Column, event_id: Column) -> Column:
    even = event_id % 2 == 0
    return (F.when(event_type == "signup", F.when(even, "sent").otherwise("delivered"))
            .when(event_type == "view", F.when(even, "opened").otherwise("read"))
            .when(event_type == "click", "clicked")
            .when(event_type == "purchase", "converted")
            .when(event_type == "error", "failed"))


def receipts_from(events: DataFrame) -> DataFrame:
    """Receipts from an events table or stream."""
    value = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))
    return events.select(
        F.col("event_id").alias("seq"),
        (F.dayofmonth("ts") - 1).cast("bigint").alias("campaign_id"),
        F.col("user_id").alias("customer_id"),
        _receipt_type(F.col("event_type"), F.col("event_id")).alias("event_type"),
        (F.col("ts") - F.make_ym_interval(F.lit(24))).alias("ts"),
        value.alias("order_value"))


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return receipts_from(table(spark, folder, "events"))


def with_late_strangers(events: DataFrame) -> DataFrame:
    """The events and, after all of them, one view per sent campaign by someone it was not sent
    to: a message that comes once a campaign is over."""
    last = events.agg(F.coalesce(F.max("event_id"), F.lit(0))).scalar()
    columns = {"event_id": last + 1 + F.col("id"), "user_id": -1 - F.col("id"),
               "ts": as_timestamp("2024-12-01 09:00:00") + F.make_dt_interval(
                   F.col("id").cast("int")),
               "event_type": F.lit("view")}
    late = events.sparkSession.range(SENT_CAMPAIGNS).select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return events.unionByName(late)


def write_in_parts(rows: DataFrame, number: Column, parts: int, path: str) -> int:
    """Writes rows to ``path`` in ``parts`` runs by a number from 0 to 1; files are read in
    that order. Returns the files of a run on average."""
    part = F.least(F.floor(number * parts), F.lit(parts - 1))
    for n in range(parts):
        rows.where(F.coalesce(part, F.lit(parts - 1)) == n).write.mode("append").parquet(path)
    files = rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles()
    return -(-len(files) // parts)


def table_stream(rows: DataFrame, number: Column, path: str, parts: int = 3) -> DataFrame:
    """Any table as a stream of about ``parts`` micro-batches, in order of ``number``."""
    per_batch = write_in_parts(rows, number, parts, path)
    return (rows.sparkSession.readStream.schema(rows.schema)
            .option("maxFilesPerTrigger", max(per_batch, 1)).parquet(path))


def event_stream(spark: SparkSession, folder: str, path: str, parts: int = 3,
                 late_strangers: bool = False) -> DataFrame:
    """The events table as a stream of ``parts`` micro-batches, written below ``path`` in order
    of arrival; events without event_id come last, in a batch of their own.

    Each part is dealt to the same number of files, which is what a batch takes; a part with too
    few rows for that gets empty files. So no batch holds events of the next part while others of
    its own part are still to come.
    """
    events = table(spark, folder, "events")
    files = max(len(events.inputFiles()), spark.sparkContext.defaultParallelism)
    if late_strangers:
        events = with_late_strangers(events)
    last, unnumbered = events.agg(F.max("event_id"),
                                  F.count_if(F.col("event_id").isNull())).first()
    part = F.floor(F.col("event_id") * parts / ((last or 0) + 1))
    chosen = [part == n for n in range(parts)]
    if unnumbered:
        chosen.append(F.col("event_id").isNull())
    for done, rows in enumerate(chosen, 1):
        events.where(rows).repartition(files).write.mode("append").parquet(path)
        written = len(spark.read.schema(events.schema).parquet(path).inputFiles())
        for _ in range(files * done - written):
            events.where("false").write.mode("append").parquet(path)
    return (spark.readStream.schema(events.schema)
            .option("maxFilesPerTrigger", files).parquet(path))


def with_metadata(receipts: DataFrame) -> DataFrame:
    """Receipts with the metadata map their bodies carry."""
    return receipts.withColumn(
        "metadata",
        F.when(F.col("order_value").isNotNull(),
               F.create_map(F.lit("order_value"), F.col("order_value").cast("string")))
        .when(F.col("event_type") == "failed",
              F.create_map(F.lit("reason"), F.lit("carrier_error"))))


def channel_of(campaign_id: Column) -> Column:
    kind = campaign_id % 4
    return (F.when(kind == 0, "whatsapp").when(kind == 1, "sms")
            .when(kind == 2, "email").otherwise("rcs"))


def campaign_start(campaign_id: Column) -> Column:
    return (as_timestamp(FIRST_CAMPAIGN_DAY)
            + F.make_dt_interval(campaign_id.cast("int")))


def _addressed() -> Column:
    """Whether a campaign was sent to a customer it has receipts of, or knows of.

    Odd campaigns went to everyone with a receipt, every sixth to the day's customers but
    for one in ten, the other even ones to all of the day's customers.
    """
    campaign, customer = F.col("campaign_id"), F.col("customer_id")
    return (campaign % 2 == 1) | (campaign % 6 != 0) | (customer % 10 != 0)


def _with_everyone(receipts: DataFrame) -> DataFrame:
    """Receipts, and an empty row for every odd campaign and customer with any receipt."""
    everyone = receipts.select("customer_id").distinct().select(
        F.explode(F.sequence(F.lit(1), F.lit(SENT_CAMPAIGNS - 1), F.lit(2))
                  .cast("array<bigint>")).alias("campaign_id"), "customer_id")
    return receipts.unionByName(everyone, allowMissingColumns=True)


def audience(receipts: DataFrame) -> DataFrame:
    """Who each sent campaign was addressed to."""
    return (_with_everyone(receipts.select("campaign_id", "customer_id"))
            .where(_addressed()).distinct())


def queued_communications(receipts: DataFrame) -> DataFrame:
    """The message rows as they stood right after dispatch."""
    campaign = F.col("campaign_id")
    return audience(receipts).select(
        (campaign * ID_STEP + F.col("customer_id")).alias("id"),
        "campaign_id", "customer_id",
        channel_of(campaign).alias("channel"),
        F.lit("queued").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        campaign_start(campaign).alias("updated_at"))


def communications(spark: SparkSession, folder: str) -> DataFrame:
    """The message rows after all receipts."""
    campaign = F.col("campaign_id")
    return fold_receipts(_with_everyone(receipts(spark, folder))).select(
        (campaign * ID_STEP + F.col("customer_id")).alias("id"),
        "campaign_id", "customer_id",
        F.when(_addressed(), channel_of(campaign)).otherwise(UNKNOWN_CHANNEL).alias("channel"),
        "status", "sent_at",
        F.coalesce("updated_at", campaign_start(campaign)).alias("updated_at"))


def with_recipient(communications: DataFrame, customers: DataFrame) -> DataFrame:
    """Message rows with the address chosen at dispatch; unknown rows have none."""
    contacts = customers.select(F.col("id").alias("customer_id"), "email", "phone")
    return (communications.join(contacts, "customer_id", "left")
            .withColumn("recipient", F.when(
                F.col("channel") != UNKNOWN_CHANNEL,
                recipient(F.col("channel"), F.col("email"), F.col("phone"))))
            .drop("email", "phone"))


def campaign_heads(spark: SparkSession) -> DataFrame:
    """Campaign rows without counters."""
    campaign = F.col("id")
    sent = campaign < SENT_CAMPAIGNS
    start = campaign_start(campaign)
    return spark.range(SENT_CAMPAIGNS + 5).select(
        campaign,
        F.concat(F.lit("Campaign "), campaign.cast("string")).alias("name"),
        F.when(campaign == 32, 5).when(campaign == 33, 6).when(campaign == 34, 99)
        .otherwise(campaign % 4).cast("bigint").alias("segment_id"),
        channel_of(campaign).alias("channel"),
        F.lit("Hi {{name}}!").alias("message_template"),
        F.when(sent, "sending").otherwise("draft").alias("status"),
        start.alias("created_at"),
        F.when(sent, start).alias("sent_at"))


def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns with the stored number of messages sent."""
    sizes = (audience(receipts(spark, folder)).groupBy(F.col("campaign_id").alias("id"))
             .agg(F.count("*").alias("n")))
    return (campaign_heads(spark).join(sizes, "id", "left")
            .withColumn("total_sent", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n"))


def segments(spark: SparkSession) -> DataFrame:
    """The saved audience rules."""
    return spark.sql("""
        SELECT cast(id AS bigint) AS id, name, description, filter_logic, created_at
        FROM VALUES
          (0, 'High value', 'Spent the most', '{"min_spent":2000000}',
           timestamp_ntz'2000-01-01 00:00:00'),
          (1, 'Lapsed', 'No order lately', '{"days_since_last_order":45}',
           timestamp_ntz'2000-01-02 00:00:00'),
          (2, 'Two cities', 'Women in two cities',
           '{"cities":["NATION_1","NATION_2"],"gender":"F"}',
           timestamp_ntz'2000-01-03 00:00:00'),
          (3, 'Tagged', 'Tagged and of some age',
           '{"tags":["vip","new"],"min_age":25,"max_age":40}',
           timestamp_ntz'2000-01-04 00:00:00'),
          (4, 'Everyone', 'All customers', '{}', timestamp_ntz'2000-01-05 00:00:00'),
          (5, 'Nobody', 'Nobody spends this much', '{"min_spent":1e12}',
           timestamp_ntz'2000-01-06 00:00:00'),
          (6, 'Unreadable', 'No number', '{"min_spent":"1e9 rupees"}',
           timestamp_ntz'2000-01-07 00:00:00')
        AS t(id, name, description, filter_logic, created_at)""")
