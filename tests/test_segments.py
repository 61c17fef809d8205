import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reachline.operators.segments import (filter_segment, match_rules, parse_rules,
                                          prompt_context, rule_chips, segment_list,
                                          segment_samples, segment_sizes)

NOW = datetime(2001, 8, 2)
PEOPLE = """id bigint, name string, is_active boolean, city string, gender string, age int,
            total_spent decimal(18,2), total_orders bigint, last_order_date timestamp_ntz,
            tags array<string>"""


def person(id, **given):
    row = {"name": f"N{id}", "is_active": True, "city": "Pune", "gender": "F", "age": 30,
           "total_spent": Decimal("100.00"), "total_orders": 2,
           "last_order_date": NOW - timedelta(days=10), "tags": ["vip"], **given}
    return (id, *row.values())


def holds(p, rule):
    """The filter, plainly."""
    (_, _, active, city, gender, age, spent, orders, last, tags) = p

    def number(key):
        value = rule.get(key)
        return None if value is None else float(value)

    def whole(key):
        value = number(key)
        return None if value is None else int(value)

    tests = [active]
    for key, value in (("spent", spent), ("orders", orders), ("age", age)):
        read = number if key == "spent" else whole
        low, high = read(f"min_{key}"), read(f"max_{key}")
        tests.append(low is None or (value is not None and value >= low))
        tests.append(high is None or (value is not None and value <= high))
    for key in ("days_since_last_order", "days_since_last_order_min"):
        days = whole(key)
        tests.append(days is None or (last is not None and last <= NOW - timedelta(days)))
    days = whole("days_since_last_order_max")
    tests.append(days is None or (last is not None and last >= NOW - timedelta(days)))
    if isinstance(rule.get("cities"), list) and rule["cities"]:
        tests.append(city is not None and city in rule["cities"])
    if rule.get("gender"):
        tests.append(gender == rule["gender"])
    if isinstance(rule.get("tags"), list) and rule["tags"]:
        tests.append(tags is not None and bool((set(tags) & set(rule["tags"])) - {None}))
    return all(tests)


def crowd(rng, n):
    people = []
    for i in range(n):
        people.append(person(
            i, is_active=rng.random() > 0.1, city=rng.choice(["Pune", "Delhi", "", None]),
            gender=rng.choice(["F", "M", None]), age=rng.choice([None, *range(18, 56)]),
            total_spent=Decimal(rng.choice([0, 1, 1023, 1024, rng.randint(0, 10 ** 6)])),
            total_orders=rng.randint(0, 30),
            last_order_date=rng.choice([None, NOW - timedelta(days=rng.randint(0, 200)),
                                        NOW - timedelta(days=45, seconds=-1),
                                        NOW + timedelta(days=1)]),
            tags=rng.choice([None, [], ["vip"], ["new", "vip"], ["loyal", "churned", "vip"]])))
    return people


def some_rules(rng, n):
    fields = {
        "min_spent": lambda: rng.choice([0, 1024, 5000.5, "20000", 1e12, -5]),
        "max_spent": lambda: rng.choice([0, 1023, 1e5, "5e5"]),
        "min_orders": lambda: rng.choice([0, 5, 5.7]), "max_orders": lambda: rng.choice([0, 9]),
        "days_since_last_order": lambda: rng.choice([0, 45]),
        "days_since_last_order_min": lambda: rng.choice([0, 30]),
        "days_since_last_order_max": lambda: rng.choice([0, 90]),
        "cities": lambda: rng.choice([["Pune"], ["Pune", "Delhi", "Pune"], [], "Pune", [None]]),
        "gender": lambda: rng.choice(["F", ""]),
        "min_age": lambda: rng.choice([18, 30]), "max_age": lambda: rng.choice([40, 20]),
        "tags": lambda: rng.choice([["vip", "new"], ["churned", "vip", "vip"], [], "vip"]),
        "min_spend": lambda: 10 ** 9,
    }
    rules = [{}, None]
    for key, make in fields.items():
        rules.append({key: make()})
    while len(rules) < n:
        keys = rng.sample(list(fields), rng.randint(1, 4))
        rules.append({k: (None if rng.random() < 0.1 else fields[k]()) for k in keys})
    return rules


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_all_rules_against_all_customers(spark, monkeypatch, broadcast):
    rng = random.Random(3)
    people, rules = crowd(rng, 150), some_rules(rng, 60)
    people += [person(900, tags=["all", None, "city=Pune", "vip"]), person(901, tags=[None])]
    rules += [{"tags": ["all"]}, {"tags": ["city=Pune"]}, {"tags": [None]}, {"cities": [None]}]
    customers = spark.createDataFrame(people, PEOPLE)
    documents = spark.createDataFrame(
        [(i, None if r is None else json.dumps(r)) for i, r in enumerate(rules)],
        "segment_id int, filter_logic string")
    parsed = parse_rules(documents).select("segment_id", "rule")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = sorted((r.segment_id, r.customer_id)
                       for r in match_rules(customers, parsed, NOW).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = sorted((i, p[0]) for i, rule in enumerate(rules) for p in people
                    if holds(p, rule or {}))
    assert found == wanted


def test_single_rule_filter(spark):
    rng = random.Random(5)
    people = crowd(rng, 150)
    customers = spark.createDataFrame(people, PEOPLE)
    for rule in some_rules(rng, 25):
        found = sorted(r.id for r in filter_segment(
            customers, json.dumps(rule) if rule else rule, NOW).collect())
        assert found == [p[0] for p in people if holds(p, rule or {})], rule


def test_large_rule_tables_join_on_keys_without_a_nested_loop(spark):
    customers = spark.createDataFrame([person(1)], PEOPLE)
    rules = parse_rules(spark.range(50).select(
        F.col("id").alias("segment_id"), F.lit('{"min_age":20}').alias("filter_logic")))
    plan = match_rules(customers, rules.select("segment_id", "rule"), NOW)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert plan.count() == 50


@pytest.mark.parametrize("document", [
    '{"min_spent":"1e9 rupees"}', '{"min_spent":1e9', '"hello"', "[1]", "7", "",
    '{"min_orders":"12.9"}', '{"max_orders":"abc"}', '{"max_age":"NaN"}', '{"min_age":[1]}',
    '{"days_since_last_order":200000000}', '{"days_since_last_order_max":-1e9}'])
def test_unreadable_rules_match_nobody(spark, document):
    customers = spark.createDataFrame([person(1)], PEOPLE)
    rules = parse_rules(spark.createDataFrame([(1, document)],
                                              "segment_id int, filter_logic string"))
    assert not rules.first().rule.valid
    assert match_rules(customers, rules, NOW).count() == 0
    assert filter_segment(customers, document, NOW).count() == 0


@pytest.mark.parametrize("document, hit", [
    (None, True), ("{}", True), ("null", True), ('{"min_orders":1e12}', False),
    ('{"max_orders":1e30}', True), ('{"min_orders":"2"}', True), ('{"min_orders":true}', True),
    ('{"min_spent":" 99.5 "}', True), ('{"max_spent":"inf"}', True), ('{"other":"x"}', True)])
def test_readable_rules_of_odd_form(spark, document, hit):
    customers = spark.createDataFrame([person(1)], PEOPLE)
    rules = parse_rules(spark.createDataFrame([(1, document)],
                                              "segment_id int, filter_logic string"))
    assert match_rules(customers, rules, NOW).count() == hit
    assert filter_segment(customers, document, NOW).count() == hit


@pytest.mark.parametrize("count", [6, 8, 9, 1000])
def test_any_number_of_rules_gives_the_same_rows(spark, count):
    rng = random.Random(8)
    people = crowd(rng, 40)
    rules = some_rules(rng, 40) * 25
    documents = spark.createDataFrame(
        [(i, None if r is None else json.dumps(r)) for i, r in enumerate(rules[:count])],
        "segment_id int, filter_logic string")
    found = match_rules(spark.createDataFrame(people, PEOPLE), parse_rules(documents).select(
        "segment_id", "rule"), NOW).collect()
    assert sorted((r.segment_id, r.customer_id) for r in found) == sorted(
        (i, p[0]) for i, rule in enumerate(rules[:count]) for p in people if holds(p, rule or {}))


def test_empty_rule_table_matches_nobody(spark):
    customers = spark.createDataFrame([person(1)], PEOPLE)
    rules = parse_rules(spark.createDataFrame([], "segment_id int, filter_logic string"))
    assert match_rules(customers, rules.select("segment_id", "rule"), NOW).count() == 0


def test_rule_columns_must_not_clash(spark):
    customers = spark.createDataFrame([person(1)], PEOPLE)
    rules = parse_rules(spark.createDataFrame([("x", "{}")],
                                              "name string, filter_logic string"))
    with pytest.raises(ValueError):
        match_rules(customers, rules.select("name", "rule"), NOW, keep=["id", "name"])


def segments(spark):
    return spark.createDataFrame(
        [(1, "a", '{"min_orders":1}', datetime(2000, 1, 1)),
         (2, "b", '{"min_orders":99}', datetime(2000, 1, 3)),
         (3, "c", None, datetime(2000, 1, 2))],
        "id bigint, name string, filter_logic string, created_at timestamp_ntz")


def test_sizes_samples_and_context(spark):
    people = [person(i, city=None if i == 1 else "Pune") for i in range(1, 9)]
    customers = spark.createDataFrame(people, PEOPLE)
    saved = segments(spark)
    members = match_rules(customers, parse_rules(saved).select(
        F.col("id").alias("segment_id"), "rule"), NOW)
    sizes = {r.segment_id: r.customer_count for r in segment_sizes(saved, members).collect()}
    assert sizes == {1: 8, 2: 0, 3: 8}
    samples = segment_samples(customers, saved, NOW)
    assert sorted(((r.segment_id, r.customer_id, r.position) for r in samples.collect()),
                  key=repr) == \
        sorted([(s, i, i) for s in (1, 3) for i in range(1, 6)] + [(2, None, None)],
               key=repr)
    context = {r.segment_id: r for r in prompt_context(samples).collect()}
    assert context[1].message_context.split("\n") == [
        "  - N1 from None, tags: ['vip']", "  - N2 from Pune, tags: ['vip']",
        "  - N3 from Pune, tags: ['vip']"]
    assert len(context[1].channel_context.split("\n")) == 5
    assert context[2].message_context == context[2].channel_context == ""
    assert context[1].channel_context.startswith("  - N1, age ?, None, tags: ['vip']")


def test_list_is_newest_first(spark):
    assert [r.id for r in segment_list(segments(spark)).collect()] == [2, 3, 1]


@pytest.mark.parametrize("document, chips", [
    (None, ["All customers"]), ("{}", ["All customers"]),
    ('{"min_spent":1e12,"cities":["Pune","Delhi"],"gender":null,"min_age":20,"max_age":30}',
     ["min spent: 1000000000000", "cities: Pune,Delhi", "min age: 20"]),
    ('{"gender":null}', []), ('{"min_orders":5.5}', ["min orders: 5.5"]),
])
def test_chips(spark, document, chips):
    rows = spark.createDataFrame([(document,)], "filter_logic string")
    assert rule_chips(rows).first().chips == chips
