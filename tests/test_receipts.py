import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from reachline.fixed import STATUS_RANK
from reachline.operators.conversions import conversion_orders, rollup_with_conversions
from reachline.operators.receipts import (event_log, first_receipts, fold_receipts,
                                          message_states, upsert_communications)
from reachline.sources.receipts import (parse_provider_receipts, parse_receipts,
                                        resolve_provider_receipts)
from reachline.sources.schemas import COMMUNICATIONS

START = datetime(2000, 1, 1)
SCHEMA = """seq bigint, campaign_id string, customer_id string, event_type string,
            ts timestamp_ntz, metadata map<string,string>, order_value decimal(18,2)"""


def frame(spark, sequences, values=None):
    """One message per sequence of types; receipt times run against arrival order."""
    rows = []
    for number, types in enumerate(sequences):
        for seq, kind in enumerate(types):
            value = (values or {}).get((number, seq))
            rows.append((seq, "c", str(number), kind, START - timedelta(minutes=seq),
                         {"order_value": str(value)} if value is not None else None,
                         Decimal(str(value)) if value is not None else None))
    return spark.createDataFrame(rows, SCHEMA)


def one_by_one(types):
    """The rule as the webhook applies it."""
    status, sent, seen = "queued", None, []
    for seq, kind in enumerate(types):
        if kind in seen:
            continue
        seen.append(kind)
        if status != "failed" and STATUS_RANK.get(kind, 0) > STATUS_RANK[status]:
            status = kind
            if kind in ("sent", "delivered") and sent is None:
                sent = START - timedelta(minutes=seq)
    return status, sent, seen


@pytest.mark.parametrize("types, status, sent_at", [
    (["sent", "delivered", "opened"], "opened", 0),
    (["delivered", "sent"], "delivered", 0),
    (["opened", "delivered"], "opened", None),
    (["sent", "failed", "delivered", "clicked"], "failed", 0),
    (["delivered", "failed"], "delivered", 0),
    (["failed", "converted"], "failed", None),
    (["bogus"], "queued", None),
    (["delivered", "delivered"], "delivered", 0),
    (["converted"], "converted", None),
])
def test_known_sequences(spark, types, status, sent_at):
    row = fold_receipts(frame(spark, [types])).first()
    assert row.status == status
    assert row.sent_at == (None if sent_at is None else START - timedelta(minutes=sent_at))


def test_fold_equals_one_by_one_rule(spark):
    rng = random.Random(7)
    kinds = ["sent", "delivered", "failed", "opened", "read", "clicked", "converted", "bogus"]
    sequences = [[rng.choice(kinds) for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    receipts = frame(spark, sequences)
    folded = {int(r.customer_id): (r.status, r.sent_at)
              for r in fold_receipts(receipts.orderBy("ts")).collect()}
    logs = {int(r.customer_id): [e.event_type for e in r.events]
            for r in event_log(receipts.orderBy("ts")).collect()}
    for number, types in enumerate(sequences):
        status, sent, seen = one_by_one(types)
        assert folded[number] == (status, sent), types
        assert logs[number] == seen, types


def test_first_receipts_keep_the_whole_first_row(spark):
    receipts = frame(spark, [["converted", "converted"]], {(0, 0): 5, (0, 1): 9})
    row = first_receipts(receipts).first()
    assert (row.seq, row.order_value, row.metadata) == (0, Decimal("5.00"),
                                                        {"order_value": "5"})


def test_upsert_in_steps_equals_fold_of_all(spark):
    rng = random.Random(11)
    kinds = ["sent", "delivered", "failed", "opened", "read", "clicked", "converted"]
    sequences = [[rng.choice(kinds) for _ in range(9)] for _ in range(200)]
    receipts = frame(spark, sequences)
    table = spark.createDataFrame(
        [("m0", "c", "0", "a@b.cd", "sms", "queued", [], None, START),
         ("m-idle", "c", "idle", "a@b.cd", "sms", "queued", [], None, START)],
        COMMUNICATIONS)
    for low in (0, 3, 6):
        part = receipts.where(f"seq >= {low} AND seq < {low + 3}")
        table = upsert_communications(table, part).checkpoint()
    rows = {r.customer_id: r for r in table.collect()}
    assert len(rows) == 201
    assert rows["0"].channel == "sms" and rows["0"].id == "m0"
    assert rows["1"].channel == "unknown" and rows["1"].id == "c-1"
    assert rows["idle"].status == "queued" and rows["idle"].recipient == "a@b.cd"
    for number, types in enumerate(sequences):
        status, sent, seen = one_by_one(types)
        row = rows[str(number)]
        assert (row.status, row.sent_at) == (status, sent)
        assert [e.event_type for e in row.events] == seen


def test_upsert_of_late_receipts_equals_fold_of_all(spark):
    """Receipts with smaller numbers than those stored, repeats and receipts without a type."""
    rng = random.Random(6)
    kinds = ["sent", "delivered", "failed", "opened", "clicked", "strange", None]
    everything = frame(spark, [[rng.choice(kinds) for _ in range(8)] for _ in range(60)])
    none = spark.createDataFrame([], COMMUNICATIONS)
    table = none
    for part in (everything.where("seq % 3 = 2"), everything.where("seq % 3 <> 1"),
                 everything.where("seq % 3 <> 2")):
        table = upsert_communications(table, part).checkpoint()
    wanted = upsert_communications(none, everything).select(table.columns)
    key = lambda r: r.customer_id
    assert sorted(table.collect(), key=key) == sorted(wanted.collect(), key=key)


def test_conversion_orders(spark):
    receipts = frame(
        spark,
        [["failed", "converted"], ["converted", "converted"], ["converted"], ["converted"],
         ["sent"]],
        {(0, 1): 100, (1, 0): 0, (1, 1): 50, (3, 0): 70})
    people = spark.createDataFrame(
        [("0", "Pune"), ("1", "Pune"), ("2", "Pune"), ("4", "Pune")],
        "id string, city string")
    made = conversion_orders(receipts, people).collect()
    # 1 converted first with nothing, 2 carries no value, 3 is not a customer
    assert [(r.customer_id, float(r.amount)) for r in made] == [("0", 100.0)]
    again = conversion_orders(receipts.unionByName(receipts), people).collect()
    assert made == again
    assert made[0].order_number.startswith("ORD-") and len(made[0].order_number) == 20
    assert made[0]["items"][0].asDict() == {
        "name": "Campaign Product", "category": "Marketing", "quantity": 1,
        "price": Decimal("100.00")}


def test_rollup_with_conversions(spark):
    people = spark.createDataFrame([("a",), ("b",)], "id string")
    orders = spark.createDataFrame(
        [("a", Decimal("10.00"), "completed", datetime(2001, 1, 1)),
         ("a", Decimal("99.00"), "returned", datetime(2001, 1, 2))],
        "customer_id string, amount decimal(18,2), status string, created_at timestamp_ntz")
    made = spark.createDataFrame(
        [("a", Decimal("5.00"), datetime(2000, 1, 1))],
        "customer_id string, amount decimal(18,2), created_at timestamp_ntz")
    rows = {r.id: r for r in rollup_with_conversions(people, orders, made).collect()}
    assert (rows["a"].total_orders, rows["a"].total_spent) == (2, Decimal("15.00"))
    assert rows["a"].last_order_date == datetime(2001, 1, 1)  # never moves back
    assert (rows["b"].total_orders, rows["b"].total_spent) == (0, Decimal("0.00"))
    assert rows["b"].last_order_date is None


def test_duplicates_do_not_move_the_time_of_change(spark):
    day = lambda n: datetime(2000, 1, n)
    rows = [(1, "c", "x", "delivered", day(1)), (2, "c", "x", "delivered", day(5)),
            (3, "c", "y", "odd", day(2)), (4, "c", "y", "odd", day(6)),
            (5, "c", "y", "opened", day(3)), (6, "c", "z", "opened", day(4)),
            (7, "c", "z", "sent", day(2))]
    receipts = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    folded = {r.customer_id: r.updated_at for r in fold_receipts(receipts).collect()}
    assert folded == {"x": day(1), "y": day(3), "z": day(4)}
    whole = message_states(receipts.drop("order_value"))
    assert {r.customer_id: r.updated_at for r in whole.collect()} == folded


def test_bodies_are_parsed(spark):
    bodies = spark.createDataFrame([
        (1, '{"campaign_id":"c","customer_id":"x","event_type":"converted",'
            '"timestamp":"2000-01-01T05:30:00+05:30","metadata":{"order_value":12.5}}'),
        (2, '{"campaign_id":"c","customer_id":"x","event_type":"failed",'
            '"timestamp":"2000-01-01T00:00:00","metadata":{"reason":"simulated"}}'),
        (3, '{"campaign_id":"c","customer_id":"x","event_type":"converted",'
            '"timestamp":"2000-01-01T00:00:00Z","metadata":{"order_value":"junk"}}'),
        (4, '{"campaign_id":"c","customer_id":"x","event_type":"opened",'
            '"timestamp":"2000-01-01T00:00:00Z","metadata":null}'),
    ], "seq bigint, body string")
    rows = {r.seq: r for r in parse_receipts(bodies).collect()}
    assert {r.ts for r in rows.values()} == {START}
    assert rows[1].order_value == Decimal("12.50")
    assert rows[2].metadata == {"reason": "simulated"}
    assert rows[3].order_value is None and rows[4].order_value is None


def test_provider_receipts_find_their_message(spark):
    bodies = spark.createDataFrame([
        (1, '{"external_id":"m1","status":"sent","timestamp":"2000-01-01T00:00:00Z",'
            '"metadata":{}}'),
        (2, '{"external_id":"gone","status":"sent","timestamp":"2000-01-01T00:00:00Z",'
            '"metadata":{}}'),
    ], "seq bigint, body string")
    messages = spark.createDataFrame([("m1", "c", "x")],
                                     "id string, campaign_id string, customer_id string")
    rows = resolve_provider_receipts(parse_provider_receipts(bodies), messages).collect()
    assert [(r.campaign_id, r.customer_id, r.event_type) for r in rows] == [("c", "x", "sent")]
