from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reachline.functions import (display_recipient, percent, recipient, render_message,
                                 time_ago, whole_days_since)
from reachline.operators import customers as ops
from reachline.operators.paging import with_pages

NOW = datetime(2001, 8, 2, 12)
PROFILE = """id bigint, name string, email string, city string, gender string,
             is_active boolean, total_spent decimal(18,2), total_orders bigint,
             last_order_date timestamp_ntz, created_at timestamp_ntz, tags array<string>"""


def profile(id, spent="0", orders=0, last=None, created=NOW - timedelta(days=100), tags=(),
            name="Ann", city="Pune", active=True):
    return (id, name, f"{name.lower()}{id}@x.org", city, "F", active, Decimal(spent), orders,
            last, created, list(tags))


@pytest.mark.parametrize("ago, days", [
    (timedelta(days=1, seconds=-1), 0), (timedelta(days=1), 1), (timedelta(minutes=20), 0),
    (timedelta(seconds=-1), -1), (timedelta(days=-1), -1),
    (timedelta(days=-1, seconds=-1), -2),
])
def test_days_are_elapsed_days_rounded_down(spark, ago, days):
    row = spark.range(1).select(whole_days_since(F.lit(NOW - ago).cast("timestamp_ntz"), NOW)
                                .alias("d")).first()
    assert row.d == days == ago.days


@pytest.mark.parametrize("given, tags", [
    (dict(spent="15000"), []), (dict(spent="15000.01"), ["vip"]),
    (dict(orders=2, last=NOW - timedelta(days=60, hours=23)), []),
    (dict(orders=2, last=NOW - timedelta(days=61)), ["churned"]),
    (dict(orders=1, last=NOW - timedelta(days=61)), []),
    (dict(orders=1, created=NOW - timedelta(days=29, hours=23)), ["new"]),
    (dict(orders=1, created=NOW - timedelta(days=30)), []),
    (dict(orders=2, created=NOW - timedelta(days=3)), []),
    (dict(orders=4), []), (dict(orders=5), ["loyal"]),
    (dict(spent="20000", orders=9, last=NOW - timedelta(days=90)),
     ["vip", "churned", "loyal"]),
])
def test_default_tags(spark, given, tags):
    row = spark.createDataFrame([profile(1, **given)], PROFILE).select(
        ops.behaviour_tags(NOW).alias("t")).first()
    assert row.t == tags


def test_rollup_counts_completed_orders_only(spark):
    people = spark.createDataFrame([(1,), (2,)], "id bigint")
    orders = spark.createDataFrame(
        [(1, Decimal("10.10"), "completed", NOW), (1, Decimal("5.05"), "completed", datetime(2000, 1, 1)),
         (1, Decimal("7.00"), "returned", NOW + timedelta(days=1)),
         (2, Decimal("7.00"), "cancelled", NOW)],
        "customer_id bigint, amount decimal(18,2), status string, created_at timestamp_ntz")
    rows = {r.id: tuple(r) for r in ops.customer_rollup(people, orders).collect()}
    assert rows == {1: (1, 2, Decimal("15.15"), NOW), 2: (2, 0, Decimal("0.00"), None)}


def test_search(spark):
    people = spark.createDataFrame(
        [profile(1, "50", name="Ann"), profile(2, "70", name="Joann", tags=["vip"]),
         profile(3, "60", name="Bob"), profile(4, "90", name="Anna", active=False),
         profile(5, "70", name="A%b", city="Delhi")], PROFILE)
    ids = lambda **kw: [r.id for r in ops.search_customers(people, **kw).collect()]
    assert ids() == [2, 5, 3, 1]
    assert ids(search="ANN") == [2, 1]
    assert ids(search="%") == [5]
    assert ids(tag="vip") == [2]
    assert ids(city="Delhi", gender="F") == [5]
    assert ids(min_spent=60, max_spent=70) == [2, 5, 3]
    assert ids(limit=2, offset=1) == [5, 3]
    second = ops.search_customers(people, limit=2).collect()[-1]
    assert ids(limit=2, after=(second.total_spent, second.id)) == [3, 1]
    assert ids(min_spent=0) == [2, 5, 3, 1]
    with pytest.raises(ValueError):
        ids(limit=1001)
    plan = ops.search_customers(people, limit=2)._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject" in plan.toString()


def test_stats_without_customers(spark):
    row = ops.customer_stats(spark.createDataFrame([], PROFILE), NOW).first()
    assert tuple(row) == (0, 0.0, 0.0, 0)


def test_breakdowns(spark):
    people = spark.createDataFrame(
        [profile(1, city="", tags=["vip", "new"]), profile(2, city=None, tags=["vip"]),
         profile(3, tags=["loyal"], active=False)], PROFILE)
    assert [tuple(r) for r in ops.city_breakdown(people).collect()] == [("Pune", 1)]
    assert {r.tag: (r.customers, r.share_pct) for r in ops.tag_share(people).collect()} == {
        "vip": (2, 50.0), "new": (1, 25.0), "loyal": (1, 25.0)}
    assert {(r.facet, r.value) for r in ops.filter_facets(people).collect()} == {
        ("city", ""), ("city", None), ("tag", "vip"), ("tag", "new")}


def test_built_in_segments_use_strict_bounds(spark):
    people = spark.createDataFrame(
        [profile(1, "10000", last=NOW - timedelta(days=45, hours=23)),
         profile(2, "10000.01", last=NOW - timedelta(days=46)), profile(3)], PROFILE)
    assert {r.segment: r.customers
            for r in ops.built_in_segment_counts(people, NOW).collect()} == {
        "High Value Customers": 1, "Lapsed Customers": 1}


def test_recent_orders_of_a_busy_customer(spark):
    people = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, name string")
    orders = spark.range(500).selectExpr(
        "id", "1L AS customer_id", "'o' AS order_number", "1.00 AS amount", "'x' AS status",
        "timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(cast(id % 7 AS int)) "
        "AS created_at")
    rows = ops.recent_orders(people, orders).collect()
    newest = sorted(range(500), key=lambda i: (i % 7, i), reverse=True)[:10]
    assert [r.order_id for r in sorted(rows, key=lambda r: (r.customer_id, r.position or 0))
            ] == newest + [None]


@pytest.mark.parametrize("ago, text", [
    (timedelta(seconds=60), "60 seconds ago"), (timedelta(seconds=61), "1 minutes ago"),
    (timedelta(hours=1), "60 minutes ago"), (timedelta(hours=25), "1 days ago"),
    (timedelta(days=30), "30 days ago"), (timedelta(days=31), "1 months ago"),
    (timedelta(days=365), "12 months ago"), (timedelta(days=800), "2 years ago"),
])
def test_time_ago(spark, ago, text):
    row = spark.range(1).select(time_ago(F.lit(NOW - ago).cast("timestamp_ntz"), NOW)
                                .alias("t")).first()
    assert row.t == text


def test_time_ago_never(spark):
    assert spark.range(1).select(time_ago(F.lit(None).cast("timestamp_ntz"), NOW)
                                 .alias("t")).first().t == "Never"


def test_contact_functions(spark):
    rows = spark.createDataFrame(
        [("email", "e", "p"), ("sms", "e", "p"), ("sms", "e", ""), ("rcs", "e", None)],
        "channel string, email string, phone string")
    got = rows.select(recipient(F.col("channel"), F.col("email"), F.col("phone")).alias("r"),
                      display_recipient(F.lit(""), F.col("email"), F.col("phone")).alias("d"),
                      render_message(F.lit("{{name}}, hi {{name}} {name}"), F.lit("A B"))
                      .alias("m"))
    assert [r.r for r in got.collect()] == ["e", "p", "e", "e"]
    assert {r.d for r in got.collect()} == {"e"}
    assert got.first().m == "A B, hi A B {name}"


def test_percent_guards_zero(spark):
    row = spark.range(1).select(percent(F.lit(1), F.lit(0)).alias("z"),
                                percent(F.lit(1), F.lit(None)).alias("n"),
                                percent(F.lit(1), F.lit(3)).alias("t")).first()
    assert tuple(row) == (0.0, 0.0, 33.3)


def test_pages_number_every_row_once(spark):
    rows = spark.range(1005).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS spent")
    paged = with_pages(rows, F.desc("spent"), F.col("id")).collect()
    wanted = sorted(((0 if i % 3 == 0 else i % 50), i) for i in range(1005))
    wanted = [i for _, i in sorted(((-s, i) for s, i in wanted))]
    assert [r.id for r in sorted(paged, key=lambda r: r.position)] == wanted
    assert all(r.page == (r.position + 19) // 20 and r.pages == 51 for r in paged)


def test_line_totals(spark):
    orders = spark.createDataFrame([(1, Decimal("7.50")), (2, Decimal("1.00"))],
                                   "id bigint, amount decimal(18,2)")
    lines = spark.createDataFrame(
        [(1, 2, "b", "y", 1, Decimal("2.50")), (1, 1, "a", "x", 2, Decimal("2.50"))],
        "order_id bigint, line_number int, name string, category string, quantity int, "
        "price decimal(18,2)")
    rows = {r.id: r for r in ops.nest_order_items(orders, lines).collect()}
    assert [i["name"] for i in rows[1]["items"]] == ["a", "b"]
    assert rows[1].amount_matches and not rows[2].amount_matches


def test_facets_keep_cities_of_customers_without_tags(spark):
    rows = spark.createDataFrame([(True, "Pune", None), (True, "Delhi", ["vip"])],
                                 "is_active boolean, city string, tags array<string>")
    from reachline.operators.customers import filter_facets
    assert sorted(map(tuple, filter_facets(rows).collect())) == [
        ("city", "Delhi"), ("city", "Pune"), ("tag", "vip")]
