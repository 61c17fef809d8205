"""Deletes and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachline.fixed import UNFINISHED_CAMPAIGN_STATUSES
from reachline.functions.contact import filled

# Fixed value: one @, no spaces, a dotted domain.
EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def delete_campaigns(campaigns: DataFrame, communications: DataFrame,
                     doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campaigns and messages that remain once the campaigns in ``doomed`` (``id``) are gone."""
    gone = doomed.select("id").distinct()
    return (campaigns.join(gone, "id", "left_anti"),
            communications.join(gone.withColumnRenamed("id", "campaign_id"), "campaign_id",
                                "left_anti"))


def purge_unfinished(campaigns: DataFrame,
                     communications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes every campaign that has not been completed, with its messages."""
    unfinished = campaigns.where(F.col("status").isin(UNFINISHED_CAMPAIGN_STATUSES))
    return delete_campaigns(campaigns, communications, unfinished)


FAILED, REPEATABLE, CHILD, PARENT = range(4)
"""What a key of the tagged union is: a row that fails a check, a value of a unique column, a
reference, or the row it refers to."""


def _tagged(rows: DataFrame, table: str, checks: dict[str, Column], unique: list[str],
            refers: list[str], referred: list[tuple[str, str]]) -> DataFrame:
    """(table_name, violation, key, tag): everything one scan of a table has to say.

    ``refers`` are its columns that name a parent, ``referred`` the (table, column) pairs that
    name its rows.
    """
    def entry(of: str, violation: str, key: Column, tag: int) -> Column:
        return F.struct(F.lit(of).alias("table_name"), F.lit(violation).alias("violation"),
                        key.cast("string").alias("key"), F.lit(tag).alias("tag"))

    def valued(of: str, violation: str, key: Column, tag: int) -> Column:
        return F.when(key.isNotNull(), entry(of, violation, key, tag))

    entries = [F.when(F.coalesce(failing, F.lit(False)),
                      entry(table, name, F.col("id"), FAILED)) for name, failing in checks.items()]
    entries += [valued(table, f"{c} repeated", F.col(c), REPEATABLE) for c in unique]
    entries += [valued(table, f"{c} unknown", F.col(c), CHILD) for c in refers]
    entries += [valued(of, f"{c} unknown", F.col("id"), PARENT) for of, c in referred]
    return rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def _references(rows: DataFrame, table: str, refers: list[str]) -> DataFrame:
    """(table_name, violation, key, row_key): the rows behind the references of a table."""
    return rows.select(F.explode(F.array(*[F.struct(
        F.lit(table).alias("table_name"), F.lit(f"{c} unknown").alias("violation"),
        F.col(c).cast("string").alias("key"), F.col("id").cast("string").alias("row_key"))
        for c in refers])).alias("e")).select("e.*").where("key is not null")


def constraint_violations(customers: DataFrame, orders: DataFrame, communications: DataFrame,
                          campaigns: DataFrame, segments: DataFrame) -> DataFrame:
    """Everything the tables' constraints and the send requests forbid, in one table.

    A tagged union of all tables, with parents as marker rows, is grouped once by key: unique
    values that occur twice, references without a marker and failed checks remain. The rows
    behind unknown references come from a second scan of the tables that have references, in
    an inner join on the unknown keys, which Spark broadcasts while they are few; crowded keys
    can be split. So a table is read at most twice. Keys are compared as text.
    """
    missing = lambda c: F.col(c).isNull()
    parts = [
        _tagged(customers, "customers", {
            "name missing": missing("name"), "email missing": missing("email"),
            "email malformed": ~F.rlike("email", F.lit(EMAIL))}, ["email"], [],
            [("orders", "customer_id"), ("communications", "customer_id")]),
        _tagged(orders, "orders", {
            "customer_id missing": missing("customer_id"),
            "order_number missing": missing("order_number"),
            "amount missing": missing("amount")}, ["order_number"], ["customer_id"], []),
        _tagged(campaigns, "campaigns", {
            f"{c} missing": filled(F.col(c).cast("string")).isNull()
            for c in ("name", "segment_id", "channel", "message_template")}, [],
            ["segment_id"], [("communications", "campaign_id")]),
        _tagged(communications, "communications", {
            "campaign_id missing": missing("campaign_id"),
            "customer_id missing": missing("customer_id"),
            "recipient missing": filled(F.col("recipient")).isNull()}, [],
            ["customer_id", "campaign_id"], []),
        _tagged(segments, "segments", {}, [], [], [("campaigns", "segment_id")]),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    key = ["table_name", "violation", "key"]
    judged = union.groupBy(*key).agg(F.count("*").alias("n"), F.min("tag").alias("least"),
                                     F.max("tag").alias("most"))
    unknown = F.col("most") == CHILD
    bad = judged.where((F.col("least") == FAILED) | unknown
                       | ((F.col("least") == REPEATABLE) & (F.col("n") > 1)))
    copies = F.when(F.col("least") == FAILED, F.col("n").cast("int")).otherwise(1)
    bad = bad.select(*key, unknown.alias("unknown"),
                     F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    # What needs no second scan meets one row of its own instead.
    met = bad.select(*[F.when(F.col("unknown"), F.col(c)).otherwise("").alias(f"__{c}")
                       for c in key], "table_name", "violation", "key", "unknown")
    behind = _references(orders, "orders", ["customer_id"])
    for rows, table, refers in ((communications, "communications",
                                 ["customer_id", "campaign_id"]),
                                (campaigns, "campaigns", ["segment_id"])):
        behind = behind.unionByName(_references(rows, table, refers))
    itself = customers.sparkSession.range(1).select(
        *[F.lit("").alias(c) for c in key], F.lit(None).cast("string").alias("row_key"))
    behind = behind.unionByName(itself).withColumnsRenamed({c: f"__{c}" for c in key})
    return met.join(behind, [f"__{c}" for c in key]).select(
        "table_name", "violation",
        F.when(F.col("unknown"), F.col("row_key")).otherwise(F.col("key")).alias("row_key"))
