"""Tables of replies from a writing model: tolerant parsing, defaults, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachline.fixed import (CHANNELS, DEFAULT_BODY, DEFAULT_CHANNEL, DEFAULT_SEGMENT_NAME,
                             DEFAULT_SUBJECT, SMS_LIMIT)
from reachline.functions import render_message
from reachline.functions.dates import AsOf
from reachline.operators.segments import match_rules, parse_rules

# Patterns of a fenced block.
FENCE_OPEN = r"(?m)^```(?:json)?\s*"
FENCE_CLOSE = r"(?m)```\s*$"

# Fixed value: the characters that count as space around a reply.
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _parsed(text: Column) -> Column:
    """The text as the first item of an array, so that left-over text is an error."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))


def _single(parsed: Column) -> Column:
    """Whether exactly one value was parsed."""
    return F.coalesce((F.try_variant_get(parsed, "$[1]", "int") == 0)
                      & F.try_variant_get(parsed, "$[2]", "int").isNull(), F.lit(False))


def _embedded(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without both."""
    begin = F.instr(text, "{")
    size = F.length(text) - F.instr(F.reverse(text), "}") + 2 - begin
    inside = (begin > 0) & F.contains(text, F.lit("}")) & (size > 1)
    return F.when(inside, F.substring(text, begin, size)).otherwise(F.lit(""))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def with_json(replies: DataFrame, reply: str, answer: str = "answer") -> DataFrame:
    """Adds the JSON a reply holds, null without any: the reply without code fences, else the
    widest ``{...}`` in it.

    Each step is a column of its own, so that none is worked out more than once.
    """
    text = F.col(reply)
    unfenced = F.when(F.contains(text, F.lit("```")), F.regexp_replace(
        F.regexp_replace(text, FENCE_OPEN, ""), FENCE_CLOSE, "")).otherwise(text)
    value = lambda c: F.try_variant_get(c, "$[0]", "variant")
    return (replies
            .withColumn("_text", F.btrim(unfenced, F.lit(SPACE)))
            .withColumn("_whole", _parsed(F.col("_text")))
            .withColumn("_is_whole", _single(F.col("_whole")))
            .withColumn("_inner", F.when(~F.col("_is_whole"), _parsed(_embedded(F.col("_text")))))
            .withColumn(answer, F.when(F.col("_is_whole"), value(F.col("_whole")))
                        .when(_single(F.col("_inner")), value(F.col("_inner"))))
            .drop("_text", "_whole", "_is_whole", "_inner"))


def segment_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Segment name, description and rule document of each reply, with defaults.

    ``parsed`` tells usable replies from unusable ones, which get no rule document. A reply is
    usable if it is an object whose filters, if it has any, are an object too; repeated keys and
    NaN make it unusable.
    """
    answer = F.col("answer")
    text = lambda path: F.try_variant_get(answer, path, "string")
    filters = F.try_variant_get(answer, "$.filters", "variant")
    usable = is_object(answer) & (filters.isNull() | is_object(filters))
    rule = F.coalesce(F.to_json(filters), F.lit("{}"))
    return (with_json(replies, reply)
            .withColumn("parsed", usable)
            .withColumn("segment_name", F.when(usable, F.coalesce(
                text("$.segment_name"), F.lit(DEFAULT_SEGMENT_NAME))))
            .withColumn("description", F.when(usable, F.coalesce(
                text("$.description"), F.lit(""))))
            .withColumn("filter_logic", F.when(usable, rule))
            .drop("answer"))


def segments_from_replies(replies: DataFrame, customers: DataFrame, as_of: AsOf,
                          created_by: str = "ai") -> DataFrame:
    """The segments to store for usable replies, with their present number of customers.

    ``replies`` has id, natural_language_query, reply and created_at. A reply whose rule cannot
    be read gives no segment. ``sources.tables.append_rows`` stores the rows.
    """
    row = F.struct("id", F.col("segment_name").alias("name"), "description", "filter_logic",
                   "natural_language_query", "created_at", "rule", "parsed")
    # Chosen within an array: a filter would work out the parsed reply once per use of it.
    rows = (parse_rules(segment_replies(replies)).select(F.inline(F.filter(
        F.array(row), lambda r: r["parsed"] & r["rule"]["valid"]))).drop("parsed"))
    sizes = (match_rules(customers, rows.select(F.col("id").alias("segment_id"), "rule"), as_of)
             .groupBy(F.col("segment_id").alias("id"))
             .agg(F.count("*").alias("customer_count")))
    return (rows.drop("rule").join(sizes, "id", "left")
            .withColumn("customer_count", F.coalesce("customer_count", F.lit(0)))
            .withColumn("created_by", F.lit(created_by)))


def message_drafts(replies: DataFrame, brand: str, reply: str = "reply") -> DataFrame:
    """Subject, body and channel note of each reply; a stock draft where it is unusable.

    ``replies`` has a ``channel`` column. Only e-mail gets a stock subject. A reply is usable
    if it is an object with an object ``message``; a missing body is the stock one.
    """
    answer = F.col("answer")
    text = lambda path: F.try_variant_get(answer, path, "string")
    usable = is_object(answer) & is_object(F.try_variant_get(answer, "$.message", "variant"))
    channel = F.col("channel")
    return (with_json(replies, reply)
            .withColumn("stock", ~usable)
            .withColumn("subject", F.when(usable, text("$.message.subject"))
                        .when(channel == "email", F.lit(DEFAULT_SUBJECT)))
            .withColumn("body", F.coalesce(F.when(usable, text("$.message.body")),
                                           F.lit(DEFAULT_BODY % brand)))
            .withColumn("channel_note", F.when(usable, text("$.channel_recommendation"))
                        .otherwise(F.concat(channel, F.lit(" is a good fit for this audience"))))
            .drop("answer"))


def normalise_channel(text: Column) -> Column:
    """The channel a reply names: alone, else the first known name inside it, else the default."""
    word = F.lower(F.btrim(text, F.lit(SPACE)))
    word = F.translate(word, "\"'", "")
    channel = F.when(word.isin(CHANNELS), word)
    for name in CHANNELS:
        channel = channel.when(F.contains(word, F.lit(name)), name)
    return channel.otherwise(DEFAULT_CHANNEL)


def message_lengths(messages: DataFrame) -> DataFrame:
    """Rendered messages with their length and whether they exceed one SMS.

    ``messages`` has ``message_template``, ``name`` and ``channel``.
    """
    return (messages.withColumn("message", render_message(F.col("message_template"),
                                                          F.col("name")))
            .withColumn("message_length", F.length("message"))
            .withColumn("too_long", (F.col("channel") == "sms")
                        & (F.col("message_length") > SMS_LIMIT)))
