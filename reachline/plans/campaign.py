"""Registered queries about campaigns and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.functions import stamp
from reachline.operators import campaigns as ops
from reachline.operators import maintenance, receipts
from reachline.operators.completion import completion_moments
from reachline.plans.checks import over_tables, rate, stamped
from reachline.sources import retail
from reachline.sources.retail import AS_OF


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """A campaign request per document; some name a segment that does not exist."""
    key = F.col("doc_id")
    return retail.table(spark, folder, "documents").select(
        key.alias("id"), F.concat(F.lit("Campaign "), key.cast("string")).alias("name"),
        (key % 8).alias("segment_id"), retail.channel_of(key).alias("channel"),
        F.concat(F.lit("Hi {{name}}! "), F.col("text")).alias("message_template"))


def campaign_create(spark: SparkSession, folder: str) -> DataFrame:
    made = ops.create_campaigns(_requests(spark, folder), retail.segments(spark), AS_OF)
    return made.select("id", "name", "segment_id", "channel",
                       F.length("message_template").alias("template_length"), "status",
                       "total_sent", "total_delivered", "total_failed", "total_opened",
                       "total_clicked", stamp(F.col("created_at")).alias("created_at"),
                       stamp(F.col("sent_at")).alias("sent_at"))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dispatch_plan(retail.campaign_heads(spark), retail.segments(spark),
                             retail.profiles(spark, folder), AS_OF)


def dispatch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)


def dispatch_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = ops.dispatch_summary(retail.campaign_heads(spark), _plan(spark, folder), AS_OF)
    return summary.withColumn("sent_at", stamp(F.col("sent_at")))


def dispatch_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dispatch_rejects(retail.campaign_heads(spark), retail.segments(spark),
                                _plan(spark, folder))


def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.status_histogram(retail.communications(spark, folder))


def attributed_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return ops.attributed_revenue(retail.campaign_heads(spark),
                                  retail.communications(spark, folder),
                                  retail.orders(spark, folder))


def campaign_performance(spark: SparkSession, folder: str) -> DataFrame:
    return ops.campaign_performance(retail.campaigns(spark, folder),
                                    retail.communications(spark, folder),
                                    retail.orders(spark, folder))


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.campaign_stats(retail.campaigns(spark, folder),
                              retail.communications(spark, folder),
                              retail.customers(spark, folder), retail.orders(spark, folder))


def campaign_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder).withColumn("sent_at", stamp(F.col("sent_at")))


def campaign_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return ops.campaign_funnel(_stats(spark, folder))


def campaign_list(spark: SparkSession, folder: str) -> DataFrame:
    listed = ops.campaign_list(retail.campaigns(spark, folder),
                               retail.communications(spark, folder))
    return listed.withColumn("created_at", stamp(F.col("created_at")))


def campaign_completion(spark: SparkSession, folder: str) -> DataFrame:
    checked = ops.campaign_completion(retail.campaigns(spark, folder),
                                      retail.communications(spark, folder), AS_OF)
    return checked.withColumn("completed_at", stamp(F.col("completed_at")))


def campaign_completed_at(spark: SparkSession, folder: str) -> DataFrame:
    """The receipt that completed each campaign, before strangers' receipts came."""
    received = retail.receipts_from(retail.with_late_strangers(
        retail.table(spark, folder, "events")))
    known = retail.receipts(spark, folder)
    moments = completion_moments(retail.campaigns(spark, folder),
                                 retail.queued_communications(known), received)
    return moments.withColumn("completed_at", stamp(F.col("completed_at")))


def campaign_communications(spark: SparkSession, folder: str) -> DataFrame:
    people = retail.customers(spark, folder)
    received = retail.with_metadata(retail.receipts(spark, folder))
    messages = retail.with_recipient(retail.communications(spark, folder), people)
    with_log = messages.join(receipts.event_log(received), receipts.KEYS, "left")
    shown = ops.campaign_communications(with_log, people, retail.campaign_heads(spark))
    times = [c for c in shown.columns if c.endswith("_at")]
    return shown.withColumns({c: stamp(F.col(c)) for c in times})


def communications_page(spark: SparkSession, folder: str) -> DataFrame:
    page = ops.communications_page(retail.communications(spark, folder), limit=50, offset=50)
    return page.select("id", "campaign_id", "customer_id", "status", "position", "total",
                       "page", "page_size")


def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dashboard_stats(retail.customers(spark, folder), retail.campaigns(spark, folder),
                               retail.communications(spark, folder),
                               retail.orders(spark, folder))


def dashboard_targets(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dashboard_targets(dashboard_stats(spark, folder))


def _remaining(campaigns: DataFrame, messages: DataFrame) -> DataFrame:
    left = messages.groupBy("campaign_id").agg(F.count("*").alias("messages"))
    return (campaigns.select(F.col("id").alias("campaign_id"), "status")
            .join(left, "campaign_id", "full_outer").fillna(0, "messages"))


def campaign_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes every campaign of one channel, with its messages."""
    heads = retail.campaign_heads(spark)
    return _remaining(*maintenance.delete_campaigns(
        heads, retail.communications(spark, folder), heads.where(F.col("channel") == "rcs")))


def purge_unfinished(spark: SparkSession, folder: str) -> DataFrame:
    """Purges what the completion rule leaves unfinished."""
    messages = retail.communications(spark, folder)
    checked = ops.campaign_completion(retail.campaigns(spark, folder), messages, AS_OF)
    return _remaining(*maintenance.purge_unfinished(
        checked.withColumnRenamed("campaign_id", "id"), messages))


QUERIES = {
    "campaign_create": campaign_create,
    "dispatch_plan": dispatch_plan,
    "dispatch_summary": dispatch_summary,
    "dispatch_rejects": dispatch_rejects,
    "status_histogram": status_histogram,
    "attributed_revenue": attributed_revenue,
    "campaign_performance": campaign_performance,
    "campaign_stats": campaign_stats,
    "campaign_funnel": campaign_funnel,
    "campaign_list": campaign_list,
    "campaign_completion": campaign_completion,
    "campaign_completed_at": campaign_completed_at,
    "campaign_communications": campaign_communications,
    "communications_page": communications_page,
    "dashboard_stats": dashboard_stats,
    "dashboard_targets": dashboard_targets,
    "campaign_cascade_delete": campaign_cascade_delete,
    "purge_unfinished": purge_unfinished,
}

_NOW = "'2001-08-02 00:00:00.000000'"

# Draft campaign 30 goes to segment 2, 31 to segment 3, 32 to the empty segment 5,
# 33 to the unreadable segment 6, 34 to none.
_ADDRESSED = """
  FROM campaigns c JOIN members m ON m.segment_id = c.segment_id AND c.status = 'draft'
  JOIN crm_people p ON p.id = m.customer_id"""

_DONE = """status IN ('sending','running') AND queued = 0 AND messages = total_sent
  AND total_sent > 0"""

# Every customer of the fixture exists, so the live view counts all messages.
_STATS = f"""
  SELECT k.id AS campaign_id, name, status, channel, {stamped('sent_at')} AS sent_at,
    CASE WHEN total_sent > 0 THEN total_sent ELSE messages END AS total_sent,
    delivered AS total_delivered, opened AS total_opened, clicked AS total_clicked, converted,
    failed AS total_failed,
    {rate('delivered', 'CASE WHEN total_sent > 0 THEN total_sent ELSE messages END')}
      AS delivery_rate,
    {rate('opened', 'delivered')} AS open_rate, {rate('clicked', 'opened')} AS click_rate,
    {rate('converted', 'clicked')} AS conversion_rate, revenue AS total_revenue_attributed
  FROM counted k JOIN revenue r ON r.campaign_id = k.id"""

_DASHBOARD = """
  SELECT (SELECT count(*) FROM crm_people) AS total_customers,
    (SELECT count(*) FROM campaigns) AS total_campaigns,
    (SELECT CAST(sum(total_sent) AS BIGINT) FROM campaigns) AS total_messages_sent,
    (SELECT count(*) FROM comms WHERE status IN ('clicked','converted')) AS total_engagements,
    (SELECT CAST(sum(amount) AS DOUBLE) FROM crm_orders) AS revenue_generated,
    (SELECT round(CAST(sum(amount) AS DOUBLE) / count(amount), 2) FROM crm_orders)
      AS avg_order_value"""

# Every known type of receipt ends the waiting of its message; strangers come after all others.
MOMENTS_SQL = f"""
  , late AS (
    SELECT seq, campaign_id, customer_id, ts FROM receipts
    UNION ALL
    SELECT (SELECT coalesce(max(event_id), 0) FROM events) + 1 + n, n, -1 - n,
      TIMESTAMP '2000-12-01 09:00:00' + to_days(CAST(n AS INTEGER))
    FROM (SELECT unnest(range(0, 30)) AS n)),
  arrivals AS (
    SELECT l.campaign_id, min(l.seq) AS seq, arg_min(l.ts, l.seq) AS ts,
      CASE WHEN any_value(a.customer_id) IS NULL THEN 1 ELSE 0 END AS messages,
      CASE WHEN any_value(a.customer_id) IS NULL THEN 0 ELSE -1 END AS queued
    FROM late l LEFT JOIN audience a
      ON a.campaign_id = l.campaign_id AND a.customer_id = l.customer_id
    GROUP BY l.campaign_id, l.customer_id),
  running AS (
    SELECT a.campaign_id, a.seq, a.ts, c.total_sent,
      c.total_sent + sum(a.messages) OVER w AS messages,
      c.total_sent + sum(a.queued) OVER w AS queued
    FROM arrivals a JOIN campaigns c ON c.id = a.campaign_id
    WINDOW w AS (PARTITION BY a.campaign_id ORDER BY a.seq)),
  firsts_done AS (
    SELECT campaign_id, arg_min(ts, seq) AS ts FROM running
    WHERE queued = 0 AND messages = total_sent AND total_sent > 0 GROUP BY campaign_id),
  after_all AS (
    SELECT campaign_id, CAST(sum(messages) AS BIGINT) AS messages,
      CAST(sum(queued) AS BIGINT) AS queued FROM arrivals GROUP BY campaign_id),
  moments AS (
    SELECT c.id AS campaign_id, c.status AS status_before, c.total_sent,
      c.total_sent + coalesce(z.messages, 0) AS messages,
      c.total_sent + coalesce(z.queued, 0) AS queued,
      CASE WHEN c.status IN ('sending','running') AND d.ts IS NOT NULL THEN 'completed'
        ELSE c.status END AS status,
      CASE WHEN c.status IN ('sending','running') THEN {stamped('d.ts')} END AS completed_at
    FROM campaigns c LEFT JOIN after_all z ON z.campaign_id = c.id
    LEFT JOIN firsts_done d ON d.campaign_id = c.id)"""

_LEFT = "LEFT JOIN (SELECT campaign_id, count(*) AS n FROM comms GROUP BY campaign_id) m"

ORACLES = {name: over_tables(sql) for name, sql in {
    "campaign_create": f"""
      SELECT doc_id AS id, 'Campaign ' || doc_id AS name, doc_id % 8 AS segment_id,
        ['whatsapp','sms','email','rcs'][doc_id % 4 + 1] AS channel,
        CAST(length('Hi {{{{name}}}}! ' || text) AS INTEGER) AS template_length,
        'draft' AS status, 0 AS total_sent, 0 AS total_delivered, 0 AS total_failed,
        0 AS total_opened, 0 AS total_clicked, {_NOW} AS created_at,
        CAST(NULL AS VARCHAR) AS sent_at
      FROM documents WHERE doc_id % 8 IN (SELECT id FROM segments)""",
    "dispatch_plan": f"""
      SELECT c.id || '-' || p.id AS external_id, c.id AS campaign_id, p.id AS customer_id,
        c.channel, CASE WHEN c.channel = 'email' OR p.phone IS NULL OR p.phone = ''
          THEN p.email ELSE p.phone END AS recipient,
        'Hi ' || p.name || '!' AS message, 'queued' AS status {_ADDRESSED}""",
    "dispatch_summary": f"""
      SELECT c.id AS campaign_id, c.name, count(*) AS total_sent, 'sending' AS status,
        {_NOW} AS sent_at {_ADDRESSED} GROUP BY c.id, c.name""",
    "dispatch_rejects": """
      SELECT id AS campaign_id, status, CASE WHEN status <> 'draft' THEN 'not a draft'
        WHEN segment_id = 99 THEN 'segment not found' WHEN segment_id = 6 THEN 'rule unreadable'
        ELSE 'no customers match' END AS reason
      FROM campaigns WHERE status <> 'draft'
        OR segment_id NOT IN (SELECT segment_id FROM members)""",
    "status_histogram": """
      SELECT campaign_id, status, count(*) AS messages FROM comms
      GROUP BY campaign_id, status""",
    "attributed_revenue": """
      SELECT campaign_id, revenue AS total_revenue_attributed FROM revenue""",
    "campaign_performance": f"""
      SELECT k.id AS campaign_id, name, status, total_sent AS total_recipients, sent,
        delivered, failed, opened, read, clicked, converted,
        {rate('delivered', 'sent')} AS delivery_rate,
        {rate('opened', 'delivered')} AS open_rate, {rate('clicked', 'read')} AS click_rate,
        {rate('converted', 'clicked')} AS conversion_rate,
        revenue AS total_revenue_attributed
      FROM counted k JOIN revenue r ON r.campaign_id = k.id""",
    "campaign_stats": _STATS,
    "campaign_funnel": f"""
      , stats AS ({_STATS}), stages AS (
        SELECT campaign_id, total_sent, unnest([1, 2, 3, 4, 5]) AS stage_no,
          unnest(['Sent','Delivered','Opened','Clicked','Converted']) AS stage,
          unnest([total_sent, total_delivered, total_opened, total_clicked, converted])
            AS messages FROM stats)
      SELECT campaign_id, stage_no, stage, CAST(messages AS BIGINT) AS messages,
        CASE WHEN stage_no = 1 THEN 100::DOUBLE ELSE {rate('messages', 'total_sent', 0)} END
          AS pct_of_sent FROM stages""",
    "campaign_list": f"""
      , listed AS (SELECT *, CASE WHEN total_sent > 0 THEN total_sent ELSE sent END AS shown
                   FROM counted)
      SELECT id AS campaign_id, name, segment_id, channel, status,
        {stamped('created_at')} AS created_at, shown AS total_sent,
        delivered AS total_delivered, opened AS total_opened, clicked AS total_clicked,
        {rate('delivered', 'shown', 0)} AS delivered_pct,
        {rate('opened', 'shown', 0)} AS opened_pct,
        {rate('clicked', 'shown', 0)} AS clicked_pct FROM listed""",
    "campaign_completion": f"""
      SELECT id AS campaign_id, status AS status_before, total_sent, messages, queued,
        CASE WHEN {_DONE} THEN 'completed' ELSE status END AS status,
        CASE WHEN {_DONE} THEN {_NOW} END AS completed_at FROM counted""",
    "campaign_completed_at": MOMENTS_SQL + " SELECT * FROM moments",
    "campaign_communications": f"""
      , times AS (
        SELECT campaign_id, customer_id,
          min(ts) FILTER (event_type = 'delivered') AS delivered_at,
          min(ts) FILTER (event_type = 'opened') AS opened_at,
          min(ts) FILTER (event_type = 'clicked') AS clicked_at,
          min(ts) FILTER (event_type = 'read') AS read_at,
          min(ts) FILTER (event_type = 'failed') AS failed_at
        FROM firsts GROUP BY campaign_id, customer_id)
      SELECT c.id, 'Hi ' || p.name || '!' AS message,
        CASE WHEN t.failed_at IS NOT NULL THEN 'carrier_error' END AS failed_reason,
        c.campaign_id, c.customer_id, p.name AS customer_name,
        CASE WHEN c.channel IN ('email','unknown') OR p.phone IS NULL OR p.phone = ''
          THEN p.email ELSE p.phone END AS recipient,
        c.channel, c.status, {stamped('c.sent_at')} AS sent_at,
        {', '.join(f"{stamped(f't.{k}_at')} AS {k}_at"
                   for k in ('delivered', 'opened', 'clicked', 'read', 'failed'))}
      FROM comms c JOIN crm_people p ON p.id = c.customer_id
      LEFT JOIN times t ON t.campaign_id = c.campaign_id AND t.customer_id = c.customer_id""",
    "communications_page": """
      SELECT p.id, t.campaign_id, p.customer_id, p.status, CAST(rn AS INTEGER) AS position,
        t.total, 2 AS page, 50 AS page_size
      FROM (SELECT campaign_id, count(*) AS total FROM comms GROUP BY campaign_id) t
      LEFT JOIN (SELECT *, row_number() OVER (
              PARTITION BY campaign_id ORDER BY updated_at DESC, id DESC) AS rn FROM comms) p
        ON p.campaign_id = t.campaign_id AND rn > 50 AND rn <= 100""",
    "dashboard_stats": _DASHBOARD,
    "dashboard_targets": f"""
      , totals AS ({_DASHBOARD})
      SELECT 'total_customers' AS gauge,
        least(100::DOUBLE, round(total_customers / 500::DOUBLE * 100)) AS value FROM totals
      UNION ALL SELECT 'total_messages_sent',
        least(100::DOUBLE, round(total_messages_sent / 5000::DOUBLE * 100)) FROM totals
      UNION ALL SELECT 'revenue_generated',
        least(100::DOUBLE, round(revenue_generated / 100000000::DOUBLE * 100)) FROM totals""",
    "campaign_cascade_delete": f"""
      SELECT c.id AS campaign_id, c.status, coalesce(m.n, 0) AS messages
      FROM campaigns c {_LEFT} ON m.campaign_id = c.id WHERE c.channel <> 'rcs'""",
    "purge_unfinished": f"""
      , done AS (SELECT id FROM counted WHERE {_DONE})
      SELECT d.id AS campaign_id, 'completed' AS status, coalesce(m.n, 0) AS messages
      FROM done d {_LEFT} ON m.campaign_id = d.id""",
}.items()}
