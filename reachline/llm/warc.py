"""WARC records in a content-addressed archive: headers apart, every payload stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.session import new_work_path

LEAST_SHARED = 1000
"""Payloads below so many bytes are never made revisits."""

LINE = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(LINE))) \
        .otherwise(F.lit(""))


def _one_line(value: Column) -> Column:
    """Line breaks would end the header, so they are written as in a URL."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def write_archive(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z",
                  least_shared: int = LEAST_SHARED) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) below ``path``.

    ``payloads`` has each distinct payload once: sha256, the bytes, payload_bytes. ``records``
    has every record's exact header text and the sha256 of its payload. Of the records with
    equal payloads of ``least_shared`` bytes or more, that with the largest page_id is a
    response and the others are revisits that refer to it; smaller payloads are all responses.

    A null html is an empty payload and a null url gives a record without target. Rows without
    page_id count as the smallest. Rows that repeat the largest page_id are all responses.
    Other columns of ``pages`` are not read. Both groupings combine before the shuffle, so a
    payload that a third of the pages share costs one row per task.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    read = pages.select("page_id", "url", body.alias("payload"))
    read = read.withColumn("sha256", F.sha2("payload", 256))
    (read.groupBy("sha256").agg(F.first("payload").alias("payload"))
     .withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
     .write.parquet(f"{path}/payloads"))

    records = read.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"),
                          F.octet_length("payload").cast("bigint").alias("bytes"))
    owners = (records.where(F.col("bytes") >= least_shared).groupBy("sha256")
              .agg(F.max("page_id").alias("owner")))
    records = records.join(owners, "sha256", "left")
    revisit = (F.col("bytes") >= least_shared) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    head = F.when(revisit, F.lit("")).otherwise(
        F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(LINE * 2)))
    size = F.when(revisit, 0).otherwise(F.length(head) + F.col("bytes"))
    identity = lambda key: F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", identity(F.coalesce(F.col("page_id").cast("string"),
                                                    F.lit("none")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, identity(F.col("owner")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")), F.lit(LINE), head)
    records.select("sha256", header.alias("header")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``, each with its fields and the exact bytes of the record.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload and
    record (header, payload of a response, two line breaks). Each stored payload is verified
    against its key, once, before the join; a payload that does not match ends the read with
    an error, as does a record whose digest is not that of its payload. What a caller does not
    select is not moved: without record and payload only lengths and digests are joined.
    """
    key = F.sha2("payload", 256)
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.when(key == F.col("sha256"), key)
        .otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("sha256"),
        "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"))
    records = spark.read.parquet(f"{path}/records")
    field = lambda name: F.nullif(
        F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    number = lambda name: F.regexp_extract(
        field(name), "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    kind = field("WARC-Type")
    digest = F.col("payload_digest")
    shown = F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([0-9a-f]{40})", 1)
    joined = records.join(payloads, "sha256")
    return joined.select(
        number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        "payload_bytes",
        F.when(shown == digest, digest)
        .otherwise(F.raise_error(F.lit("record does not match its payload")))
        .alias("payload_digest"), "payload",
        F.concat(F.encode("header", "UTF-8"),
                 F.when(kind == "response", F.col("payload")).otherwise(F.encode(F.lit(""),
                                                                                 "UTF-8")),
                 F.encode(F.lit(LINE * 2), "UTF-8")).alias("record"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_work_path(spark, "archive")
    write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
  WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages),
  sized AS (
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
      sha1(payload) AS payload_digest,
      CASE WHEN strlen(payload) >= {LEAST_SHARED}
        THEN max(page_id) OVER (PARTITION BY payload) END AS owner
    FROM payloads)
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN owner <> page_id THEN owner END AS refers_to
  FROM sized"""
