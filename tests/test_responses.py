import json

import pytest
from pyspark.sql import functions as F

from reachline.operators.responses import (message_drafts, message_lengths,
                                           normalise_channel, segment_replies,
                                           segments_from_replies, with_json)
from reachline.sources.tables import append_rows


@pytest.mark.parametrize("text, found", [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('```\n{"a": 1}\n```  \n', {"a": 1}),
    ('Sure!\n```json\n{"a":\n 1}\n```\nBye.', {"a": 1}),
    ('Here it is: {"a": {"b": [1, 2]}} as asked', {"a": {"b": [1, 2]}}),
    ('\n\t {"a": "é {x} \\n"} \n', {"a": "é {x} \n"}),
    ('{"a": 1} and {"b": 2}', None),       # the widest {...} is not JSON
    ('{"a": 1', None), ("no json", None), ("", None), (None, None),
    ("{'a': 1}", None),
])
def test_extraction(spark, text, found):
    rows = spark.createDataFrame([(text,)], "t string")
    row = with_json(rows, "t").select(F.to_json("answer").alias("j")).first()
    assert (json.loads(row.j) if row.j is not None else None) == found


@pytest.mark.parametrize("reply", [
    '"hello"', "[1]", "7", '{"filters":[1]}', '{"filters":null}', '{"filters":"x"}',
    '{"a":1,"a":2}', '{"filters":{"min_spent":NaN}}', "{note} {}"])
def test_replies_that_are_no_objects_are_unusable(spark, reply):
    rows = spark.createDataFrame([(1, reply, "sms")], "id int, reply string, channel string")
    row = segment_replies(rows).first()
    assert (row.parsed, row.segment_name, row.filter_logic) == (False, None, None)
    draft = message_drafts(rows, "Acme").first()
    assert draft.stock and "Acme" in draft.body


def test_generated_segments_are_stored(spark, tmp_path):
    replies = spark.createDataFrame(
        [(1, "big", '{"segment_name":"B","filters":{"min_spent":50}}'), (2, "all", "so: {}"),
         (3, "bad", '{"filters":{"min_spent":"much"}}'), (4, "none", "sorry")],
        "id int, natural_language_query string, reply string").withColumn(
            "created_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    people = spark.createDataFrame(
        [(n, True, "Pune", "F", 30, float(n), 1, None, None) for n in range(100)],
        "id bigint, is_active boolean, city string, gender string, age int, total_spent double, "
        "total_orders bigint, last_order_date timestamp_ntz, tags array<string>")
    path = str(tmp_path / "segments")
    append_rows(segments_from_replies(replies, people, "2001-01-02 00:00:00"), path)
    append_rows(segments_from_replies(replies.where("id = 1"), people.where("id > 90"),
                                      "2001-01-02 00:00:00"), path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.name, r.natural_language_query, r.customer_count, r.created_by)
                  for r in rows) == [("B", "big", 9, "ai"), ("B", "big", 50, "ai"),
                                     ("Untitled Segment", "all", 100, "ai")]


def test_segment_defaults(spark):
    rows = spark.createDataFrame([
        (1, '{"segment_name": "S", "description": "d", "filters": {"min_spent": 5}}'),
        (2, "{}"), (3, "nothing")], "id int, reply string")
    got = {r.id: (r.parsed, r.segment_name, r.description, r.filter_logic)
           for r in segment_replies(rows).collect()}
    assert got == {1: (True, "S", "d", '{"min_spent":5}'),
                   2: (True, "Untitled Segment", "", "{}"), 3: (False, None, None, None)}


def test_stock_drafts(spark):
    rows = spark.createDataFrame([
        (1, "sms", '{"message": {"subject": null, "body": "B"}, "channel_recommendation": "r"}'),
        (2, "sms", "oops"), (3, "email", "oops")], "id int, channel string, reply string")
    got = {r.id: (r.stock, r.subject, r.body, r.channel_note)
           for r in message_drafts(rows, "Acme").collect()}
    body = "Hey {{name}}, we've got something special for you at Acme! Check it out 🛍️"
    assert got == {
        1: (False, None, "B", "r"),
        2: (True, None, body, "sms is a good fit for this audience"),
        3: (True, "Something special for you", body, "email is a good fit for this audience")}


@pytest.mark.parametrize("said, channel", [
    ("SMS", "sms"), ('  "Email"\n', "email"), ("'rcs'", "rcs"), ("I pick rcs", "rcs"),
    ("email, or sms", "sms"), ("pigeon", "whatsapp"), ("", "whatsapp"), (None, "whatsapp"),
    ("WhatsApp.", "whatsapp"),
])
def test_channels(spark, said, channel):
    assert spark.createDataFrame([(said,)], "t string").select(
        normalise_channel(F.col("t")).alias("c")).first().c == channel


def test_lengths(spark):
    rows = spark.createDataFrame(
        [("sms", "x" * 157 + "{{name}}", "Ann"), ("sms", "x" * 157 + "{{name}}", "Anna"),
         ("rcs", "x" * 157 + "{{name}}", "Anna")],
        "channel string, message_template string, name string")
    assert [(r.message_length, r.too_long) for r in message_lengths(rows).collect()] == [
        (160, False), (161, True), (161, False)]
