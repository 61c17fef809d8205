"""Campaign creation, dispatch, funnel counts, completion, revenue and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachline.fixed import GAUGE_TARGETS, OPEN_CAMPAIGN_STATUSES, REACHED
from reachline.functions import (as_timestamp, count_in, display_recipient, percent, recipient,
                                 render_message, whole_percent)
from reachline.functions.dates import AsOf
from reachline.operators.receipts import message_id
from reachline.operators.segments import match_rules, parse_rules
from reachline.sources.schemas import EVENTS


def create_campaigns(requests: DataFrame, segments: DataFrame, as_of: AsOf) -> DataFrame:
    """Draft campaigns for the requests whose segment exists."""
    known = segments.select(F.col("id").alias("segment_id"))
    zero = F.lit(0)
    return requests.join(known, "segment_id", "left_semi").select(
        "id", "name", "segment_id", "channel", "message_template",
        F.lit("draft").alias("status"), zero.alias("total_sent"),
        zero.alias("total_delivered"), zero.alias("total_failed"), zero.alias("total_opened"),
        zero.alias("total_clicked"), as_timestamp(as_of).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"))


def dispatch_plan(campaigns: DataFrame, segments: DataFrame, customers: DataFrame,
                  as_of: AsOf, message_key=message_id) -> DataFrame:
    """One queued message per draft campaign and customer of its audience.

    Draft campaigns and their rules meet the customers directly, so only audiences that are
    about to be sent are evaluated.
    """
    drafts = (campaigns.where(F.col("status") == "draft")
              .select(F.col("id").alias("campaign_id"), "segment_id", "channel",
                      "message_template"))
    rules = (parse_rules(segments).select(F.col("id").alias("segment_id"), "rule"))
    addressed = match_rules(customers, drafts.join(rules, "segment_id"), as_of,
                            keep=["id", "name", "email", "phone"])
    return addressed.select(
        message_key(F.col("campaign_id"), F.col("customer_id")).alias("external_id"),
        "campaign_id", "customer_id", "channel",
        recipient(F.col("channel"), F.col("email"), F.col("phone")).alias("recipient"),
        render_message(F.col("message_template"), F.col("name")).alias("message"),
        F.lit("queued").alias("status"))


def queued_communications(plan: DataFrame, as_of: AsOf) -> DataFrame:
    """The message rows a plan creates."""
    return plan.select(
        F.col("external_id").alias("id"), "campaign_id", "customer_id", "recipient", "channel",
        "status", F.array().cast(EVENTS).alias("events"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        as_timestamp(as_of).alias("updated_at"))


def dispatch_summary(campaigns: DataFrame, plan: DataFrame, as_of: AsOf) -> DataFrame:
    """The campaigns a plan sends, with recipients, new status and send time."""
    sizes = plan.groupBy("campaign_id").agg(F.count("*").alias("total_sent"))
    return (campaigns.select(F.col("id").alias("campaign_id"), "name")
            .join(sizes, "campaign_id")
            .select("campaign_id", "name", "total_sent", F.lit("sending").alias("status"),
                    as_timestamp(as_of).alias("sent_at")))


def dispatch_rejects(campaigns: DataFrame, segments: DataFrame, plan: DataFrame) -> DataFrame:
    """The campaigns that cannot be sent, with the reason."""
    known = parse_rules(segments).select(F.col("id").alias("segment_id"),
                                         F.col("rule.valid").alias("known"))
    served = plan.select("campaign_id").distinct().withColumn("served", F.lit(True))
    reason = (F.when(F.col("status") != "draft", "not a draft")
              .when(F.col("known").isNull(), "segment not found")
              .when(~F.col("known"), "rule unreadable")
              .when(F.col("served").isNull(), "no customers match"))
    return (campaigns.select(F.col("id").alias("campaign_id"), "segment_id", "status")
            .join(known, "segment_id", "left").join(served, "campaign_id", "left")
            .select("campaign_id", "status", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def status_histogram(communications: DataFrame) -> DataFrame:
    """Messages per campaign and status."""
    return (communications.groupBy("campaign_id", "status")
            .agg(F.count("*").alias("messages")))


def stage_counts(communications: DataFrame) -> DataFrame:
    """Messages per campaign that reached each stage, and their total, in one pass."""
    status = F.col("status")
    return communications.groupBy("campaign_id").agg(
        F.count("*").alias("messages"),
        *[count_in(status, reached).alias(stage) for stage, reached in REACHED.items()])


def _with_counts(campaigns: DataFrame, communications: DataFrame) -> DataFrame:
    """Campaigns (as ``campaign_id``) with stage counts, 0 where there are none."""
    return _joined_counts(campaigns, stage_counts(communications))


def _joined_counts(campaigns: DataFrame, counts: DataFrame) -> DataFrame:
    counted = campaigns.withColumnRenamed("id", "campaign_id").join(counts, "campaign_id", "left")
    return counted.fillna(0, ["messages", *REACHED])


def campaign_facts(campaigns: DataFrame, communications: DataFrame, orders: DataFrame,
                   known: DataFrame | None = None) -> DataFrame:
    """(campaign_id, messages, counts of each stage, revenue) of campaigns with messages.

    Revenue: orders that a campaign's converted customers placed since it was created. An order
    counts once per campaign and may count for several campaigns. With ``known`` (customers, as
    ``id``) only their messages are counted; revenue comes from all.

    Messages and orders are read once. Messages are grouped by campaign and customer and meet
    the orders in one union: a running sum within a customer's day, newest first, gives what
    was earned later on the starting day; then one row per day and the messages are left, and a
    running sum over the days adds the later ones. So a window is bounded by one customer's day,
    or by days and campaigns, and orders are never paired with campaigns.
    """
    day = F.datediff(F.to_date("created_at"), F.lit("1970-01-01")).alias("day")
    status, counted = F.col("status"), F.col("status")
    if known is not None:
        communications = communications.join(
            known.select(F.col("id").alias("customer_id"), F.lit(True).alias("known")),
            "customer_id", "left")
        counted = F.when(F.col("known"), status)
    totals = ["messages", *REACHED]
    sent = communications.groupBy("campaign_id", "customer_id").agg(
        F.count(counted).alias("messages") if known is not None
        else F.count("*").alias("messages"),
        *[count_in(counted, reached).alias(stage) for stage, reached in REACHED.items()],
        F.max(F.coalesce(status == "converted", F.lit(False))
              & F.col("customer_id").isNotNull()).alias("earns"))
    starts = campaigns.select(F.col("id").alias("campaign_id"), "created_at")
    sent = sent.join(starts, "campaign_id").select("*", day)
    placed = (orders.where(F.col("customer_id").isNotNull())
              .where(F.col("created_at") >= starts.agg(F.min("created_at")).scalar())
              .select("customer_id", "created_at", "amount", day))
    rows = sent.unionByName(placed, allowMissingColumns=True)
    within = Window.partitionBy("customer_id", "day").orderBy(F.desc("created_at"))
    so_far = within.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"same_day": F.sum("amount").over(so_far),
                             "ends_day": F.lead(F.lit(1)).over(within).isNull()})
    rows = (rows.where(F.col("campaign_id").isNotNull() | F.col("ends_day"))
            .withColumn("whole_day", F.when(F.col("ends_day"), F.col("same_day"))))
    later = (Window.partitionBy("customer_id").orderBy(F.desc("day"))
             .rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("later", F.sum("whole_day").over(later))
    earned = F.when(F.col("earns"), F.coalesce("later", F.lit(0)) + F.coalesce(
        "same_day", F.lit(0)))
    return (rows.where(F.col("campaign_id").isNotNull()).groupBy("campaign_id")
            .agg(*[F.sum(c).alias(c) for c in totals], F.sum(earned).alias("revenue")))


def _with_facts(campaigns: DataFrame, facts: DataFrame) -> DataFrame:
    """Campaigns (as ``campaign_id``) with counts and revenue, 0 where there are none."""
    return _joined_counts(campaigns, facts).withColumn(
        "total_revenue_attributed", F.coalesce("revenue", F.lit(0)).cast("decimal(38,2)")
        .cast("double"))


def attributed_revenue(campaigns: DataFrame, communications: DataFrame,
                       orders: DataFrame) -> DataFrame:
    """Revenue per campaign, see ``campaign_facts``."""
    heads = campaigns.select("id", "created_at")
    return _with_facts(heads, campaign_facts(heads, communications, orders)).select(
        "campaign_id", "total_revenue_attributed")


def campaign_performance(campaigns: DataFrame, communications: DataFrame,
                         orders: DataFrame) -> DataFrame:
    """Funnel counts, rates and revenue per campaign; clicks are rated against reads."""
    c = F.col
    return (_with_facts(campaigns, campaign_facts(campaigns, communications, orders))
            .select("campaign_id", "name", "status", c("total_sent").alias("total_recipients"),
                    "sent", "delivered", "failed", "opened", "read", "clicked", "converted",
                    percent(c("delivered"), c("sent")).alias("delivery_rate"),
                    percent(c("opened"), c("delivered")).alias("open_rate"),
                    percent(c("clicked"), c("read")).alias("click_rate"),
                    percent(c("converted"), c("clicked")).alias("conversion_rate"),
                    "total_revenue_attributed"))


def campaign_stats(campaigns: DataFrame, communications: DataFrame, customers: DataFrame,
                   orders: DataFrame) -> DataFrame:
    """The live view: messages of known customers only; clicks are rated against opens."""
    c = F.col
    sent = F.when(c("stored") > 0, c("stored")).otherwise(c("messages"))
    facts = campaign_facts(campaigns, communications, orders, customers)
    return (_with_facts(campaigns.withColumnRenamed("total_sent", "stored"), facts)
            .withColumn("total_sent", sent)
            .select("campaign_id", "name", "status", "channel", "sent_at", "total_sent",
                    c("delivered").alias("total_delivered"), c("opened").alias("total_opened"),
                    c("clicked").alias("total_clicked"), "converted",
                    c("failed").alias("total_failed"),
                    percent(c("delivered"), c("total_sent")).alias("delivery_rate"),
                    percent(c("opened"), c("delivered")).alias("open_rate"),
                    percent(c("clicked"), c("opened")).alias("click_rate"),
                    percent(c("converted"), c("clicked")).alias("conversion_rate"),
                    "total_revenue_attributed"))


def campaign_funnel(stats: DataFrame) -> DataFrame:
    """One row per campaign and stage of ``campaign_stats``, with its share of the sent."""
    stages = [("Sent", "total_sent"), ("Delivered", "total_delivered"),
              ("Opened", "total_opened"), ("Clicked", "total_clicked"),
              ("Converted", "converted")]
    rows = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(label).alias("stage"),
                 F.col(column).cast("bigint").alias("messages"),
                 (F.lit(100.0) if label == "Sent"
                  else whole_percent(F.col(column), F.col("total_sent"))).alias("pct_of_sent"))
        for i, (label, column) in enumerate(stages, 1)])
    return stats.select("campaign_id", F.inline(rows))


def campaign_list(campaigns: DataFrame, communications: DataFrame) -> DataFrame:
    """All campaigns, newest first, with counters and card rates.

    The stored number sent wins unless it is 0; delivered and clicked are counted afresh.
    """
    c = F.col
    listed = _with_counts(campaigns.withColumnRenamed("total_sent", "stored"), communications)
    total = F.when(c("stored") > 0, c("stored")).otherwise(c("sent"))
    return (listed.withColumn("total_sent", total)
            .select("campaign_id", "name", "segment_id", "channel", "status", "created_at",
                    "total_sent", c("delivered").alias("total_delivered"),
                    c("opened").alias("total_opened"), c("clicked").alias("total_clicked"),
                    whole_percent(c("delivered"), c("total_sent")).alias("delivered_pct"),
                    whole_percent(c("opened"), c("total_sent")).alias("opened_pct"),
                    whole_percent(c("clicked"), c("total_sent")).alias("clicked_pct"))
            .orderBy(F.desc("created_at"), F.desc("campaign_id")))


def campaign_completion(campaigns: DataFrame, communications: DataFrame,
                        as_of: AsOf) -> DataFrame:
    """Campaigns with the status after the completion rule.

    An open campaign is complete once no message is queued and there are exactly as many
    messages as were sent, and at least one.
    """
    return completion_of(campaigns, stage_counts(communications), as_of)


def completion_of(campaigns: DataFrame, counts: DataFrame, as_of: AsOf) -> DataFrame:
    """The same from the campaigns' counters (``stage_counts``)."""
    c = F.col
    done = (c("status").isin(OPEN_CAMPAIGN_STATUSES) & (c("queued") == 0)
            & (c("messages") == c("total_sent")) & (c("total_sent") > 0))
    return (_joined_counts(campaigns, counts)
            .select("campaign_id", c("status").alias("status_before"), "total_sent",
                    "messages", "queued",
                    F.when(done, "completed").otherwise(c("status")).alias("status"),
                    F.when(done, as_timestamp(as_of)).alias("completed_at")))


def campaign_communications(communications: DataFrame, customers: DataFrame,
                            campaigns: DataFrame) -> DataFrame:
    """Message rows of known customers: text, status, first time of each receipt type and
    why a message failed.

    The stored event log has one entry per type, so the times need no further grouping.
    """
    def first_of(kind: str) -> Column:
        of_kind = F.filter("events", lambda e: e.event_type == kind)
        return F.try_element_at(of_kind, F.lit(1))

    people = customers.select(F.col("id").alias("customer_id"),
                              F.col("name").alias("customer_name"), "email", "phone")
    templates = campaigns.select(F.col("id").alias("campaign_id"), "message_template")
    shown = (communications.join(people, "customer_id")
             .join(templates, "campaign_id", "left"))
    return shown.select(
        "id", "campaign_id", "customer_id", "customer_name",
        display_recipient(F.col("recipient"), F.col("email"), F.col("phone"))
        .alias("recipient"),
        "channel", "status",
        render_message(F.col("message_template"), F.col("customer_name")).alias("message"),
        "sent_at",
        *[first_of(kind).ts.alias(f"{kind}_at")
          for kind in ("delivered", "opened", "clicked", "read", "failed")],
        F.try_element_at(first_of("failed").metadata, F.lit("reason")).alias("failed_reason"))


def dashboard_stats(customers: DataFrame, campaigns: DataFrame, communications: DataFrame,
                    orders: DataFrame) -> DataFrame:
    """One row of totals over the whole installation."""
    engaged = communications.where(F.col("status").isin(REACHED["clicked"]))
    money = orders.agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))
    revenue = F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    average = F.when(F.col("n") > 0, F.round(F.col("total").cast("double") / F.col("n"), 2)) \
        .otherwise(F.lit(0.0))
    campaign_row = campaigns.agg(F.count("*").alias("n"),
                                 F.coalesce(F.sum("total_sent"), F.lit(0)).alias("sent"))
    return money.select(
        customers.agg(F.count("*")).scalar().alias("total_customers"),
        campaign_row.select("n").scalar().alias("total_campaigns"),
        campaign_row.select("sent").scalar().alias("total_messages_sent"),
        engaged.agg(F.count("*")).scalar().alias("total_engagements"),
        revenue.alias("revenue_generated"), average.alias("avg_order_value"))


def dashboard_targets(stats: DataFrame, targets: dict[str, int] = GAUGE_TARGETS) -> DataFrame:
    """How far each dashboard total is towards its target, 0 to 100."""
    def gauge(name: str, target: int) -> Column:
        return F.least(F.lit(100.0), F.round(F.col(name) / target * 100)).cast("double")
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("gauge"), gauge(name, target).alias("value"))
        for name, target in targets.items()])))


def communications_page(communications: DataFrame, limit: int = 50,
                        offset: int = 0) -> DataFrame:
    """One page of messages per campaign, last changed first, with the total; an empty page is
    one row with the total.

    The rank filter lets each task keep only the head of every campaign before the shuffle.
    """
    order = Window.partitionBy("campaign_id").orderBy(F.desc("updated_at"), F.desc("id"))
    page = (communications.withColumn("position", F.row_number().over(order))
            .where((F.col("position") <= offset + limit) & (F.col("position") > offset)))
    totals = communications.groupBy("campaign_id").agg(F.count("*").alias("total"))
    number = offset // limit + 1 if limit else 1
    return (totals.join(page, "campaign_id", "left")
            .withColumn("page", F.lit(number)).withColumn("page_size", F.lit(limit)))
