"""Registered queries about replies of a writing model, derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.operators import responses as ops
from reachline.operators.segments import parse_rules
from reachline.functions import as_timestamp, stamp
from reachline.plans.checks import over_tables
from reachline.sources import retail
from reachline.sources.retail import AS_OF

BRAND = "Acme"
FENCE = "```"


def _dressed(json, key, text):
    """The JSON fenced, plain, after prose (some of it with braces), or cut short."""
    form = key % 4
    prose = F.concat(text, F.when(key % 16 == 2, " {note}").otherwise(""))
    return (F.when(form == 0, F.concat(F.lit(f"{FENCE}json\n"), json, F.lit(f"\n{FENCE}")))
            .when(form == 1, json)
            .when(form == 2, F.concat(prose, F.lit(" "), json))
            .otherwise(F.left(json, F.length(json) - 1)))


def _segment_replies(spark: SparkSession, folder: str) -> DataFrame:
    """A reply per document, which describes the segment by its text."""
    key = F.col("doc_id")
    json = F.to_json(F.struct(
        F.when(key % 3 > 0, F.concat(F.lit("S"), key.cast("string"))).alias("segment_name"),
        F.when(key % 5 > 0, F.col("text")).alias("description"),
        F.struct((key * 1000).alias("min_spent")).alias("filters")))
    return retail.table(spark, folder, "documents").select(
        "doc_id", "text", _dressed(json, key, F.col("text")).alias("reply"))


def segment_responses(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_rules(ops.segment_replies(_segment_replies(spark, folder)))
    return parsed.select("doc_id", "parsed", "segment_name",
                         F.md5("description").alias("description_md5"), "filter_logic",
                         F.col("rule.min_spent").cast("decimal(18,2)").cast("string")
                         .alias("min_spent"))


def segment_saved(spark: SparkSession, folder: str) -> DataFrame:
    replies = _segment_replies(spark, folder).select(
        F.col("doc_id").alias("id"), F.col("text").alias("natural_language_query"), "reply",
        as_timestamp(AS_OF).alias("created_at"))
    saved = ops.segments_from_replies(replies, retail.profiles(spark, folder), AS_OF)
    return saved.select("id", "name", F.md5("description").alias("description_md5"),
                        "filter_logic", F.md5("natural_language_query").alias("query_md5"),
                        "customer_count", "created_by",
                        stamp(F.col("created_at")).alias("created_at"))


def message_drafts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    message = F.struct(
        F.when(key % 8 < 4, F.concat(F.lit("Offer "), key.cast("string"))).alias("subject"),
        F.concat(F.lit("Hi {{name}}, "), F.col("text")).alias("body"))
    json = F.to_json(F.struct(message.alias("message"),
                              F.lit("fits the audience").alias("channel_recommendation")))
    replies = retail.table(spark, folder, "documents").select(
        "doc_id", retail.channel_of(F.floor(key / 4)).alias("channel"),
        _dressed(json, key, F.col("text")).alias("reply"))
    return ops.message_drafts(replies, BRAND).drop("reply")


def channel_normalised(spark: SparkSession, folder: str) -> DataFrame:
    key, text = F.col("doc_id"), F.col("text")
    form = key % 6
    said = (F.when(form == 0, F.concat(F.lit('"WhatsApp" '), text))
            .when(form == 1, F.concat(F.lit("  SMS \n"), text))
            .when(form == 2, F.concat(text, F.lit(" So use email, not rcs.")))
            .when(form == 3, text).when(form == 4, F.concat(text, F.lit(" 'rcs'")))
            .otherwise(F.concat(F.lit("Best: RCS. "), text)))
    return retail.table(spark, folder, "documents").select(
        "doc_id", ops.normalise_channel(said).alias("channel"))


def message_length_check(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a template, rendered for a customer: numbers go round."""
    key = F.col("doc_id")
    people = retail.customers(spark, folder).select(F.col("id").alias("number"), "name")
    many = people.agg(F.count("*")).scalar()
    templates = retail.table(spark, folder, "documents").select(
        "doc_id", retail.channel_of(key).alias("channel"), (key % many).alias("number"),
        F.concat(F.lit("Hi {{name}}! "), F.col("text"), F.lit(" Bye, {{name}}."))
        .alias("message_template"))
    checked = ops.message_lengths(templates.join(people, "number"))
    return checked.select("doc_id", "channel", "message_length", "too_long",
                          F.md5("message").alias("message_md5"))


QUERIES = {
    "segment_responses": segment_responses,
    "segment_saved": segment_saved,
    "message_drafts": message_drafts,
    "channel_normalised": channel_normalised,
    "message_length_check": message_length_check,
}

# Replies are put together and read again here, by JSON functions on the reply's text.
_READ = f"""
  made AS (
    SELECT *, '{{' || CASE WHEN doc_id % 3 > 0 THEN '"segment_name":"S' || doc_id || '",'
        ELSE '' END || CASE WHEN doc_id % 5 > 0 THEN '"description":' || to_json(text) || ','
        ELSE '' END || '"filters":{{"min_spent":' || doc_id * 1000 || '}}}}' AS json
    FROM documents),
  said AS (
    SELECT doc_id, text, CASE doc_id % 4
      WHEN 0 THEN '{FENCE}json' || chr(10) || json || chr(10) || '{FENCE}' WHEN 1 THEN json
      WHEN 2 THEN text || CASE WHEN doc_id % 16 = 2 THEN ' {{note}}' ELSE '' END || ' ' || json
      ELSE left(json, length(json) - 1) END AS reply FROM made),
  bare AS (
    SELECT doc_id, text, trim(regexp_replace(regexp_replace(reply, '(?m)^```(?:json)?\\s*', '',
      'g'), '(?m)```\\s*$', '', 'g')) AS reply FROM said),
  read AS (
    SELECT doc_id, text, CASE WHEN json_valid(reply) THEN reply
      WHEN json_valid(inner_part) THEN inner_part END AS found
    FROM (SELECT *, substr(reply, strpos(reply, '{{'), length(reply) + 2
        - strpos(reverse(reply), '}}') - strpos(reply, '{{')) AS inner_part FROM bare)),
  parsed AS (
    SELECT doc_id, text, found IS NOT NULL AS parsed,
      CASE WHEN found IS NOT NULL THEN coalesce(json_extract_string(found, '$.segment_name'),
        'Untitled Segment') END AS segment_name,
      CASE WHEN found IS NOT NULL THEN coalesce(json_extract_string(found, '$.description'),
        '') END AS description,
      CAST(json_extract(found, '$.filters') AS VARCHAR) AS filter_logic,
      CAST(json_extract_string(found, '$.filters.min_spent') AS BIGINT) AS least
    FROM read)"""
_LOW = """lower(CASE doc_id % 6 WHEN 0 THEN '"WhatsApp" ' || text
  WHEN 1 THEN '  SMS ' || text WHEN 4 THEN text || ' ' || chr(39) || 'rcs' || chr(39) WHEN 2 THEN text || ' So use email, not rcs.' WHEN 3 THEN text
  WHEN 5 THEN 'Best: RCS. ' || text ELSE '' END)"""
_SHOWN = """'Hi ' || c_name || '! ' || replace(text, '{{name}}', c_name) || ' Bye, '
  || c_name || '.'"""

ORACLES = {
    "segment_responses": f"""
      WITH {_READ}
      SELECT doc_id, parsed, segment_name, md5(description) AS description_md5, filter_logic,
        CASE WHEN parsed THEN least || '.00' END AS min_spent FROM parsed""",
    "segment_saved": over_tables(f"""
      , {_READ}
      SELECT p.doc_id AS id, any_value(p.segment_name) AS name,
        md5(any_value(p.description)) AS description_md5,
        any_value(p.filter_logic) AS filter_logic, md5(any_value(p.text)) AS query_md5,
        count(c.id) AS customer_count, 'ai' AS created_by,
        '2001-08-02 00:00:00.000000' AS created_at
      FROM parsed p LEFT JOIN crm_customers c ON c.is_active AND c.total_spent >= p.least
      WHERE p.parsed GROUP BY p.doc_id"""),
    "message_drafts": f"""
      WITH c AS (SELECT *, ['whatsapp','sms','email','rcs'][doc_id // 4 % 4 + 1] AS channel
                   , doc_id % 4 = 3 OR doc_id % 16 = 2 AS unread FROM documents)
      SELECT doc_id, channel, unread AS stock,
        CASE WHEN unread THEN CASE WHEN channel = 'email'
               THEN 'Something special for you' END
             WHEN doc_id % 8 < 4 THEN 'Offer ' || doc_id END AS subject,
        CASE WHEN unread THEN 'Hey {{{{name}}}}, we''ve got something special for you '
               || 'at {BRAND}! Check it out 🛍️'
             ELSE 'Hi {{{{name}}}}, ' || text END AS body,
        CASE WHEN unread THEN channel || ' is a good fit for this audience'
             ELSE 'fits the audience' END AS channel_note
      FROM c""",
    "channel_normalised": f"""
      WITH c AS (SELECT doc_id, translate({_LOW}, '"''', '') AS said FROM documents)
      SELECT doc_id, CASE
        WHEN said LIKE '%whatsapp%' THEN 'whatsapp' WHEN said LIKE '%sms%' THEN 'sms'
        WHEN said LIKE '%email%' THEN 'email' WHEN said LIKE '%rcs%' THEN 'rcs'
        ELSE 'whatsapp' END AS channel FROM c""",
    "message_length_check": f"""
      SELECT doc_id, ['whatsapp','sms','email','rcs'][doc_id % 4 + 1] AS channel,
        CAST(length({_SHOWN}) AS INTEGER) AS message_length,
        doc_id % 4 = 1 AND length({_SHOWN}) > 160 AS too_long, md5({_SHOWN}) AS message_md5
      FROM documents JOIN customer ON c_custkey = doc_id % (SELECT count(*) FROM customer)""",
}
