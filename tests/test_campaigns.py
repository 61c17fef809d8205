import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reachline.operators import campaigns as ops
from reachline.operators import maintenance

DAY = datetime(2000, 1, 1)
CAMPAIGN = """id bigint, name string, segment_id bigint, channel string,
              message_template string, status string, created_at timestamp_ntz,
              sent_at timestamp_ntz, total_sent bigint"""
MESSAGE = """id string, campaign_id bigint, customer_id bigint, status string,
             updated_at timestamp_ntz"""
ORDER = "customer_id bigint, amount decimal(18,2), status string, created_at timestamp_ntz"


def campaign(id, status="sending", total=0, created=DAY, segment=1, channel="sms"):
    return (id, f"c{id}", segment, channel, "Hi {{name}}", status, created, created, total)


def messages(spark, statuses):
    """``statuses`` maps a campaign to the statuses of its customers 0, 1, ..."""
    return spark.createDataFrame(
        [(f"{c}-{i}", c, i, s, DAY) for c, many in statuses.items()
         for i, s in enumerate(many)], MESSAGE)


@pytest.mark.parametrize("seed", range(4))
def test_attribution_equals_range_join(spark, seed):
    rng = random.Random(seed)
    moment = lambda: DAY + timedelta(hours=rng.randint(0, 24 * 6))
    heads = [campaign(i, created=moment()) for i in range(12)] + [
        campaign(90, created=DAY + timedelta(days=99)), campaign(91, created=DAY)]
    rows = [(f"{c[0]}-{p}", c[0], p, rng.choice(["converted", "clicked"]), DAY)
            for c in heads for p in range(8) if rng.random() < 0.6]
    rows += rows[:3]  # a repeated row must not count twice
    orders = [(rng.choice([0, 0, 0, *range(10)]), Decimal(rng.randint(1, 10 ** 6)) / 100,
               rng.choice(["completed", "returned"]), moment()) for _ in range(600)]
    # orders at the very moment a campaign starts
    orders += [(p, Decimal("3.00"), "cancelled", c[6]) for c in heads for p in (0, 1)]
    found = {r.campaign_id: r.total_revenue_attributed for r in ops.attributed_revenue(
        spark.createDataFrame(heads, CAMPAIGN), spark.createDataFrame(rows, MESSAGE),
        spark.createDataFrame(orders, ORDER)).collect()}
    for c in heads:
        converted = {r[2] for r in rows if r[1] == c[0] and r[3] == "converted"}
        wanted = sum(o[1] for o in orders if o[0] in converted and o[3] >= c[6])
        assert found[c[0]] == pytest.approx(float(wanted), abs=1e-6)
    assert len(found) == len(heads)


def test_performance_and_stats_rate_clicks_differently(spark):
    heads = spark.createDataFrame([campaign(1, total=10), campaign(2, total=0),
                                   campaign(3, "draft")], CAMPAIGN)
    sent = messages(spark, {1: ["sent", "delivered", "opened", "opened", "read", "clicked",
                                "converted", "failed", "queued"], 2: ["failed", "queued"]})
    no_orders = spark.createDataFrame([], ORDER)
    rows = {r.campaign_id: r for r in ops.campaign_performance(heads, sent, no_orders).collect()}
    one = rows[1]
    assert (one.total_recipients, one.sent, one.delivered, one.failed, one.opened, one.read,
            one.clicked, one.converted) == (10, 8, 6, 1, 5, 3, 2, 1)
    assert (one.delivery_rate, one.open_rate, one.click_rate, one.conversion_rate) == (
        75.0, 83.3, 66.7, 50.0)
    assert tuple(rows[3])[3:] == (0, 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)

    people = spark.createDataFrame([(i,) for i in range(8)], "id bigint")  # 8 is unknown
    stats = {r.campaign_id: r
             for r in ops.campaign_stats(heads, sent, people, no_orders).collect()}
    assert (stats[1].total_sent, stats[1].delivery_rate, stats[1].click_rate) == (10, 60.0, 40.0)
    assert (stats[2].total_sent, stats[2].total_failed) == (2, 1)
    funnel = [(r.stage, r.messages, r.pct_of_sent) for r in ops.campaign_funnel(
        ops.campaign_stats(heads, sent, people, no_orders)).where("campaign_id = 1")
        .orderBy("stage_no").collect()]
    assert funnel == [("Sent", 10, 100.0), ("Delivered", 6, 60.0), ("Opened", 5, 50.0),
                      ("Clicked", 2, 20.0), ("Converted", 1, 10.0)]


def test_list_prefers_stored_total_and_is_newest_first(spark):
    heads = spark.createDataFrame(
        [campaign(1, total=4), campaign(2, created=DAY + timedelta(days=1))], CAMPAIGN)
    sent = messages(spark, {1: ["delivered", "queued"], 2: ["failed", "clicked", "queued"]})
    rows = ops.campaign_list(heads, sent).collect()
    assert [(r.campaign_id, r.total_sent, r.total_delivered, r.clicked_pct) for r in rows] == [
        (2, 2, 1, 50.0), (1, 4, 1, 0.0)]


@pytest.mark.parametrize("status, total, statuses, after", [
    ("sending", 2, ["sent", "failed"], "completed"),
    ("running", 1, ["converted"], "completed"),
    ("sending", 2, ["sent", "queued"], "sending"),
    ("sending", 3, ["sent", "failed"], "sending"),
    ("sending", 1, ["sent", "failed"], "sending"),
    ("draft", 1, ["sent"], "draft"),
    ("sending", 0, [], "sending"),
])
def test_completion(spark, status, total, statuses, after):
    heads = spark.createDataFrame([campaign(1, status, total)], CAMPAIGN)
    row = ops.campaign_completion(heads, messages(spark, {1: statuses}), DAY).first()
    assert row.status == after
    assert row.completed_at == (DAY if after == "completed" else None)


PEOPLE = """id bigint, name string, email string, phone string, city string, gender string,
            age int, is_active boolean, total_spent decimal(18,2), total_orders bigint,
            last_order_date timestamp_ntz, tags array<string>"""


def test_dispatch(spark):
    people = spark.createDataFrame(
        [(1, "Ann A", "a@x", "", "Pune", "F", 30, True, Decimal(9), 1, None, None),
         (2, "Bob B", "b@x", "+91", "Pune", "M", 30, True, Decimal(1), 1, None, None),
         (3, "Cy C", "c@x", "+92", "Pune", "M", 30, False, Decimal(9), 1, None, None)], PEOPLE)
    segments = spark.createDataFrame([(1, '{"min_spent":5}'), (2, "{}"), (3, '{"min_age":99}')],
                                     "id bigint, filter_logic string")
    heads = spark.createDataFrame(
        [campaign(1, "draft"), campaign(2, "draft", segment=2, channel="email"),
         campaign(3, "draft", segment=3), campaign(4, "draft", segment=9),
         campaign(5, "sending", segment=2)], CAMPAIGN)
    plan = ops.dispatch_plan(heads, segments, people, DAY)
    rows = sorted(tuple(r) for r in plan.collect())
    assert rows == [("1-1", 1, 1, "sms", "a@x", "Hi Ann A", "queued"),
                    ("2-1", 2, 1, "email", "a@x", "Hi Ann A", "queued"),
                    ("2-2", 2, 2, "email", "b@x", "Hi Bob B", "queued")]
    queued = ops.queued_communications(plan, DAY)
    assert {(r.id, r.status, len(r.events), r.sent_at, r.updated_at)
            for r in queued.collect()} == {(r[0], "queued", 0, None, DAY) for r in rows}
    summary = {r.campaign_id: r.total_sent
               for r in ops.dispatch_summary(heads, plan, DAY).collect()}
    assert summary == {1: 1, 2: 2}
    rejects = {r.campaign_id: r.reason
               for r in ops.dispatch_rejects(heads, segments, plan).collect()}
    assert rejects == {3: "no customers match", 4: "segment not found", 5: "not a draft"}


def test_create_needs_a_segment(spark):
    requests = spark.createDataFrame([(1, "a", 7, "sms", "Hi"), (2, "b", 8, "sms", "Hi")],
                                     "id bigint, name string, segment_id bigint, "
                                     "channel string, message_template string")
    segments = spark.createDataFrame([(7,)], "id bigint")
    rows = ops.create_campaigns(requests, segments, DAY).collect()
    assert [(r.id, r.status, r.total_sent, r.created_at, r.sent_at) for r in rows] == [
        (1, "draft", 0, DAY, None)]


def test_page_of_a_crowded_campaign(spark):
    rows = spark.range(1200).selectExpr(
        "cast(id AS string) AS id", "if(id < 1150, 1L, id) AS campaign_id", "id AS customer_id",
        "'sent' AS status",
        "timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(cast(id % 9 AS int)) "
        "AS updated_at")
    page = ops.communications_page(rows, limit=50, offset=100)
    assert "WindowGroupLimit" in page._jdf.queryExecution().executedPlan().toString()
    order = sorted(range(1150), key=lambda i: (i % 9, str(i)), reverse=True)[100:150]
    rows = page.collect()
    got = sorted((r for r in rows if r.campaign_id == 1), key=lambda r: r.position)
    assert [r.customer_id for r in got] == order
    assert {(r.total, r.page, r.page_size) for r in got} == {(1150, 3, 50)}
    # campaigns with fewer messages have an empty page, with their total
    assert {(r.id, r.position, r.total, r.page) for r in rows if r.campaign_id != 1} == {
        (None, None, 1, 3)}


def test_revenue_of_many_campaigns_on_one_day(spark):
    """What is sorted per customer are days, campaigns and one day's orders, never pairs."""
    orders = spark.range(2000).selectExpr(
        "id % 7 AS customer_id", "cast(1 AS decimal(18,2)) AS amount", "'completed' AS status",
        "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 40) AS created_at")
    heads = spark.range(3000).selectExpr(
        "id", "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 20) "
        "AS created_at")
    sent = heads.selectExpr("id AS campaign_id", "id % 9 AS customer_id", "'converted' AS status")
    found = {r.campaign_id: r.total_revenue_attributed
             for r in ops.attributed_revenue(heads, sent, orders).collect()}
    for c in (0, 1, 7, 8, 500, 2999):
        assert found[c] == sum(o % 7 == c % 9 and o * 40 >= c * 20 for o in range(2000))
    assert len(found) == 3000


def test_unreadable_rules_are_rejected_not_sent(spark):
    heads = spark.createDataFrame([(1, 1, "draft", "sms", "Hi"), (2, 2, "draft", "sms", "Hi")],
                                  "id bigint, segment_id bigint, status string, channel string, "
                                  "message_template string")
    rules = spark.createDataFrame([(1, '{"min_spent":1e9'), (2, "{}")],
                                  "id bigint, filter_logic string")
    people = spark.createDataFrame(
        [(5, "N", "e@x.org", None, True, "Pune", "F", 30, 1.0, 1, None, None)],
        "id bigint, name string, email string, phone string, is_active boolean, city string, "
        "gender string, age int, total_spent double, total_orders bigint, "
        "last_order_date timestamp_ntz, tags array<string>")
    plan = ops.dispatch_plan(heads, rules, people, "2001-01-01 00:00:00")
    assert [r.campaign_id for r in plan.collect()] == [2]
    rejects = ops.dispatch_rejects(heads, rules, plan).collect()
    assert [(r.campaign_id, r.reason) for r in rejects] == [(1, "rule unreadable")]


def test_message_rows_show_first_times(spark):
    rows = spark.createDataFrame(
        [("m", 1, 1, "", "sms", "clicked",
          [(0, "delivered", DAY, None), (1, "clicked", DAY + timedelta(1), None),
           (2, "failed", DAY, {"reason": "opted_out"})], DAY),
         ("n", 1, 2, "kept", "sms", "queued", None, None),
         ("o", 1, 3, "kept", "sms", "queued", None, None)],
        "id string, campaign_id bigint, customer_id bigint, recipient string, channel string, "
        "status string, events array<struct<seq: bigint, event_type: string, "
        "ts: timestamp_ntz, metadata: map<string,string>>>, sent_at timestamp_ntz")
    people = spark.createDataFrame([(1, "A", "", "+91"), (2, "B", "b@x", None)],
                                   "id bigint, name string, email string, phone string")
    heads = spark.createDataFrame([campaign(1)], CAMPAIGN)
    got = {r.id: r for r in ops.campaign_communications(rows, people, heads).collect()}
    assert (got["m"].message, got["m"].failed_reason) == ("Hi A", "opted_out")
    assert got["n"].failed_reason is None
    assert set(got) == {"m", "n"}
    assert (got["m"].recipient, got["m"].delivered_at, got["m"].clicked_at,
            got["m"].opened_at) == ("+91", DAY, DAY + timedelta(1), None)
    assert (got["n"].recipient, got["n"].delivered_at) == ("kept", None)


def test_dashboard_of_an_empty_installation(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    stats = ops.dashboard_stats(none("id bigint"), none(CAMPAIGN), none(MESSAGE), none(ORDER))
    assert tuple(stats.first()) == (0, 0, 0, 0, 0.0, 0.0)
    assert {r.gauge: r.value for r in ops.dashboard_targets(stats).collect()} == {
        "total_customers": 0.0, "total_messages_sent": 0.0, "revenue_generated": 0.0}


def test_gauges_stop_at_100(spark):
    stats = spark.createDataFrame([(600, 1234, 5e5)], "total_customers bigint, "
                                  "total_messages_sent bigint, revenue_generated double")
    assert [r.value for r in ops.dashboard_targets(stats).collect()] == [100.0, 25.0, 1.0]


def test_deletes(spark):
    heads = spark.createDataFrame([campaign(1), campaign(2, "completed"), campaign(3, "draft")],
                                  CAMPAIGN)
    sent = messages(spark, {1: ["sent"], 2: ["sent", "sent"], 3: ["queued"]})
    left, rows = maintenance.purge_unfinished(heads, sent)
    assert [r.id for r in left.collect()] == [2] and rows.count() == 2
    left, rows = maintenance.delete_campaigns(
        heads, sent, spark.createDataFrame([(2,), (2,)], "id bigint"))
    assert sorted(r.id for r in left.collect()) == [1, 3] and rows.count() == 2


def test_violations(spark):
    people = spark.createDataFrame(
        [(1, "A", "a@x.org"), (2, None, "a@x.org"), (3, "C", None), (4, "D", "no mail@x.org"),
         (5, "E", "e@localhost")], "id bigint, name string, email string")
    orders = spark.createDataFrame(
        [(1, 1, "O1", Decimal(1)), (2, 9, "O1", None), (3, None, None, Decimal(1))],
        "id bigint, customer_id bigint, order_number string, amount decimal(18,2)")
    heads = spark.createDataFrame([(1, "n", 1, "sms", ""), (2, None, 2, "sms", "Hi"),
                                   (3, "n", None, "sms", "Hi")],
                                  "id bigint, name string, segment_id int, channel string, "
                                  "message_template string")
    segments = spark.createDataFrame([(1,)], "id int")
    sent = spark.createDataFrame([(1, 1, 1, ""), (2, 7, 8, "x")], "id bigint, "
                                 "campaign_id bigint, customer_id bigint, recipient string")
    found = sorted(map(tuple, maintenance.constraint_violations(
        people, orders, sent, heads, segments).collect()))
    assert found == [
        ("campaigns", "message_template missing", "1"), ("campaigns", "name missing", "2"),
        ("campaigns", "segment_id missing", "3"), ("campaigns", "segment_id unknown", "2"),
        ("communications", "campaign_id unknown", "2"),
        ("communications", "customer_id unknown", "2"),
        ("communications", "recipient missing", "1"),
        ("customers", "email malformed", "4"), ("customers", "email malformed", "5"),
        ("customers", "email missing", "3"), ("customers", "email repeated", "a@x.org"),
        ("customers", "name missing", "2"),
        ("orders", "amount missing", "2"), ("orders", "customer_id missing", "3"),
        ("orders", "customer_id unknown", "2"), ("orders", "order_number missing", "3"),
        ("orders", "order_number repeated", "O1")]
