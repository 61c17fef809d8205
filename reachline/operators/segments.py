"""Audience rules: parsing, evaluation of one rule, evaluation of many rules at once."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachline.functions import as_timestamp, whole_days_since
from reachline.functions.dates import AsOf

AMOUNTS = ["min_spent", "max_spent"]
DAYS = ["days_since_last_order", "days_since_last_order_min", "days_since_last_order_max"]
WHOLE_NUMBERS = ["min_orders", "max_orders", *DAYS, "min_age", "max_age"]
LISTS = ["cities", "tags"]

# Days before the as-of moment that stay within the years 1 to 9999 from the year 2000 on.
EARLIEST_DAY, LATEST_DAY = 730_000, -2_800_000
WIDEST = 9_000_000_000_000_000_000


def _typed_sql() -> str:
    """SQL for the typed struct of a parsed rule ``w``; ``valid`` tells whether all of its fields
    can be read. One text is parsed in one step, where hundreds of column calls take seconds."""
    part = lambda key, kind: f"try_variant_get(w, '$.{key}', '{kind}')"
    kind_of = lambda key: f"schema_of_variant({part(key, 'variant')})"
    text = lambda key: f"btrim({part(key, 'string')})"

    def amount(key: str) -> str:
        return (f"coalesce(try_cast({text(key)} AS double), "
                f"CAST({part(key, 'boolean')} AS double))")

    def number(key: str) -> str:
        """Truncated as a number; as text it must be a whole number."""
        # least and greatest pass over nulls
        return (f"CASE WHEN ({kind_of(key)} <> 'STRING' OR {text(key)} RLIKE '^[+-]?[0-9]+$') "
                f"AND {amount(key)} IS NOT NULL THEN "
                f"CAST(least(greatest({amount(key)}, -{WIDEST}D), {WIDEST}D) AS bigint) END")

    def listed(key: str) -> str:
        items = part(key, "array<string>")
        return f"CASE WHEN size({items}) > 0 THEN array_compact({items}) END"

    read = {**{key: amount(key) for key in AMOUNTS}, **{k: number(k) for k in WHOLE_NUMBERS}}
    fields = {**read, **{key: listed(key) for key in LISTS},
              "gender": f"nullif({part('gender', 'string')}, '')"}
    sound = ["coalesce(startswith(schema_of_variant(w), 'OBJECT') "
             "OR schema_of_variant(w) = 'VOID', false)"]
    for key, value in read.items():
        fits = (f"coalesce(r.{key} BETWEEN {LATEST_DAY} AND {EARLIEST_DAY}, false)"
                if key in DAYS else f"r.{key} IS NOT NULL")
        sound.append(f"(coalesce({kind_of(key)}, 'VOID') = 'VOID' OR {fits})")
    struct = ", ".join(f"'{key}', {value}" for key, value in fields.items())
    again = ", ".join(f"'{key}', r.{key}" for key in fields)
    return (f"get(transform(array(named_struct({struct})), r -> "
            f"named_struct({again}, 'valid', {' AND '.join(sound)})), 0)")


def _parsed(document: str) -> Column:
    """A rule document as a typed struct. The document is bound to a lambda variable, so it is
    parsed once and plans stay small."""
    return F.expr(f"get(transform(array(try_parse_json(coalesce({document}, '{{}}'))), "
                  f"w -> {_typed_sql()}), 0)")


def parse_rules(segments: DataFrame, document: str = "filter_logic") -> DataFrame:
    """Adds ``rule``, a typed struct. A field that does not count is null.

    Missing documents are empty rules, which mean everyone. ``rule.valid`` is false, and the
    rule means nobody, if the document is no JSON object (or repeats a key), if an amount
    or number cannot be read, or if days leave the calendar. Numbers drop their fraction;
    as text they must be whole. Unknown keys, empty lists, lists given as something else
    and empty genders do not count; nulls within a list equal nothing.
    """
    return segments.withColumn("rule", _parsed(document))


def _matches() -> str:
    """SQL for all conditions of the struct ``rule`` on a customer, at the moment ``__as_of``."""
    before = lambda key: (
        f"__as_of - make_dt_interval(CAST(CASE WHEN rule.{key} BETWEEN {LATEST_DAY} AND "
        f"{EARLIEST_DAY} THEN rule.{key} END AS int))")
    conditions = {
        "min_spent": "total_spent >= rule.min_spent",
        "max_spent": "total_spent <= rule.max_spent",
        "min_orders": "total_orders >= rule.min_orders",
        "max_orders": "total_orders <= rule.max_orders",
        "days_since_last_order": f"last_order_date <= {before('days_since_last_order')}",
        "days_since_last_order_min": f"last_order_date <= {before('days_since_last_order_min')}",
        "days_since_last_order_max": f"last_order_date >= {before('days_since_last_order_max')}",
        "cities": "array_contains(rule.cities, city)",
        "gender": "gender = rule.gender",
        "min_age": "age >= rule.min_age",
        "max_age": "age <= rule.max_age",
        "tags": "arrays_overlap(tags, rule.tags)",
    }
    return " AND ".join(["rule.valid", *[f"(rule.{key} IS NULL OR {condition})"
                                         for key, condition in conditions.items()]])


def filter_segment(customers: DataFrame, rule: dict | str | None, as_of: AsOf) -> DataFrame:
    """Active customers that satisfy one rule, read as ``parse_rules`` reads it.

    The one rule becomes constants, so that the filter reaches the scan.
    """
    document = rule if rule is None or isinstance(rule, str) else json.dumps(rule)
    spark = customers.sparkSession
    known = parse_rules(spark.createDataFrame([(document,)], "filter_logic string"))
    values = known.first()["rule"]
    kinds = known.schema["rule"].dataType
    literal = lambda key: (
        F.array(*map(F.lit, values[key])) if isinstance(values[key], list)
        else F.lit(values[key])).cast(kinds[key].dataType)
    held = customers.withColumns({
        "rule": F.struct(*[literal(key).alias(key) for key in kinds.names]),
        "__as_of": as_timestamp(as_of)})
    return held.where(F.expr(f"is_active AND {_matches()}")).select(*customers.columns)


def matched_columns(customers: DataFrame) -> DataFrame:
    """The columns shown for a matched customer."""
    return customers.select("id", "name", "email", "phone", "city", "total_spent",
                            "total_orders", "last_order_date",
                            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


# Ranges a rule is filed under, with the rule fields that bound them from below and above.
RANGES = {
    "spent": (["min_spent"], ["max_spent"]),
    "idle": (["days_since_last_order", "days_since_last_order_min"],
             ["days_since_last_order_max"]),
    "orders": (["min_orders"], ["max_orders"]),
    "age": (["min_age"], ["max_age"]),
}
TOP_BAND = 63


def _band(value: Column, kind: str) -> Column:
    """Band of a number, 0 to 63; never falls as the number grows. Ages go by four years,
    others by magnitude."""
    number = F.greatest(value.cast("double"), F.lit(0.0))
    band = F.floor(number / 4) if kind == "age" else F.floor(F.log2(number + 1))
    return F.least(band, F.lit(TOP_BAND)).cast("int")


def _rule_keys(rule: str) -> Column:
    """Lookup keys of a rule: its tags, else its cities, else one of its ranges in bands, else
    its gender. Only a rule that means everyone has the key of every customer, and one that
    cannot be read has none."""
    field = lambda key: F.col(f"{rule}.{key}")
    label = lambda kind: (lambda v: F.concat(F.lit(f"{kind}="), v.cast("string")))
    keys = (F.when(~field("valid"), F.array().cast("array<string>"))
            .when(field("tags").isNotNull(),
                  F.transform(F.array_distinct(field("tags")), label("tag")))
            .when(field("cities").isNotNull(),
                  F.transform(F.array_distinct(field("cities")), label("city"))))
    for kind, (lows, highs) in RANGES.items():
        low = F.greatest(F.lit(None), *map(field, lows)).cast("double")
        high = F.least(F.lit(None), *map(field, highs)).cast("double")
        first = _band(F.coalesce(low, F.lit(0.0)), kind)
        last = F.when(high.isNull(), TOP_BAND).otherwise(_band(high, kind))
        bands = F.when(first <= last, F.sequence(first, last)).otherwise(
            F.array().cast("array<int>"))
        keys = keys.when(low.isNotNull() | high.isNotNull(), F.transform(bands, label(kind)))
    return (keys.when(field("gender").isNotNull(), F.array(label("gender")(field("gender"))))
            .otherwise(F.array(F.lit("all"))))


def _customer_keys(as_of: AsOf) -> tuple[list[Column], Column]:
    """Lookup keys of a customer: one or none of each kind, and the tags."""
    numbers = {"spent": F.col("total_spent"), "orders": F.col("total_orders"),
               "idle": whole_days_since(F.col("last_order_date"), as_of), "age": F.col("age")}
    single = [F.lit("all"), F.concat(F.lit("city="), F.col("city")),
              F.concat(F.lit("gender="), F.col("gender"))]
    for kind, number in numbers.items():
        band = F.when(number.isNotNull(), _band(number, kind))
        single.append(F.concat(F.lit(f"{kind}="), band.cast("string")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                       lambda t: F.concat(F.lit("tag="), t))
    return single, tags


def match_rules(customers: DataFrame, rules: DataFrame, as_of: AsOf,
                keep: Iterable[str] = ("id",)) -> DataFrame:
    """Every (rule row, active customer) match, for any number of rules.

    ``rules`` has a ``rule`` struct and any further columns; ``keep`` names the customer
    columns wanted besides, and ``id`` becomes ``customer_id``. Rules and customers meet on
    lookup keys and the pairs that meet are tested. A rule is filed under its most telling
    condition only, a customer under all that hold for it; only rules that mean everyone meet
    everyone. Spark broadcasts the rules while their size allows it; beyond that both sides
    are joined on the key, and crowded keys are split at run time.
    """
    keep = list(keep)
    clash = {c for c in (*keep, "customer_id") if c in rules.columns} - {"id"}
    if clash:
        raise ValueError(f"rename the rule columns {sorted(clash)}; customers have them too")
    used = ["is_active", "city", "gender", "age", "total_spent", "total_orders",
            "last_order_date", "tags"]
    filed = rules.withColumn("key", F.explode(_rule_keys("rule")))
    single, tags = _customer_keys(as_of)
    looked_up = (customers.where("is_active").select(
        *[F.col(c).alias("customer_id") if c == "id" else F.col(c)
          for c in dict.fromkeys(used + keep)],
        as_timestamp(as_of).alias("__as_of"),
        F.posexplode(F.concat(F.array(*single), tags)).alias("place", "key"))
        .where(F.col("key").isNotNull()))
    field = lambda key: F.col(f"rule.{key}")
    # A rule with tags meets a customer at the first wanted tag only, others not at tags.
    first_wanted = F.try_element_at(F.array_intersect(field("tags"), F.col("tags")), F.lit(1))
    once = (F.when(field("tags").isNull(), F.col("place") < len(single))
            .otherwise(F.col("place") == len(single) - 1
                       + F.array_position("tags", first_wanted)))
    matched = filed.join(looked_up, "key").where(F.expr(_matches())).where(once)
    return matched.select(*[c for c in rules.columns if c != "rule"],
                          *["customer_id" if c == "id" else c for c in keep])


def segment_membership(customers: DataFrame, segments: DataFrame, as_of: AsOf) -> DataFrame:
    """(segment_id, customer_id) for every saved segment and every customer in it."""
    rules = parse_rules(segments).select(F.col("id").alias("segment_id"), "rule")
    return match_rules(customers, rules, as_of)


def segment_sizes(segments: DataFrame, membership: DataFrame) -> DataFrame:
    """Saved segments with their current size; empty ones count 0."""
    sizes = membership.groupBy("segment_id").agg(F.count("*").alias("customer_count"))
    return (segments.drop("customer_count").withColumnRenamed("id", "segment_id")
            .join(sizes, "segment_id", "left")
            .withColumn("customer_count", F.coalesce("customer_count", F.lit(0))))


def segment_samples(customers: DataFrame, segments: DataFrame, as_of: AsOf,
                    n: int = 5) -> DataFrame:
    """Up to ``n`` customers per segment, lowest ids first; a segment without any has one row
    without customer."""
    rules = parse_rules(segments).select(F.col("id").alias("segment_id"), "rule")
    matches = match_rules(customers, rules, as_of, keep=["id", "name", "city", "age", "tags"])
    by_id = Window.partitionBy("segment_id").orderBy("customer_id")
    first = (matches.withColumn("position", F.row_number().over(by_id))
             .where(F.col("position") <= n))
    return rules.select("segment_id").join(first, "segment_id", "left")


def prompt_context(samples: DataFrame) -> DataFrame:
    """Sample lines of a segment as they are put before a writing model.

    ``message_context`` takes the first three samples, ``channel_context`` all of them; both
    are empty for a segment without customers.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    listed = F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.concat(F.lit("["), F.array_join(
        F.transform(listed, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    for_message = F.concat(F.lit("  - "), shown("name"), F.lit(" from "), shown("city"),
                           F.lit(", tags: "), tags)
    for_channel = F.concat(F.lit("  - "), shown("name"), F.lit(", age ?, "), shown("city"),
                           F.lit(", tags: "), tags)
    lines = samples.select("segment_id", F.when(F.col("position").isNotNull(), F.struct(
        "position", for_message.alias("m"), for_channel.alias("c"))).alias("line"))
    gathered = lines.groupBy("segment_id").agg(
        F.sort_array(F.collect_list("line")).alias("lines"))
    return gathered.select(
        "segment_id",
        F.array_join(F.transform(F.slice("lines", 1, 3), lambda x: x.m), "\n")
        .alias("message_context"),
        F.array_join(F.transform("lines", lambda x: x.c), "\n").alias("channel_context"))


def segment_list(segments: DataFrame) -> DataFrame:
    """Saved segments, newest first."""
    return segments.orderBy(F.desc("created_at"), F.desc("id"))


UNREADABLE_CHIP = "No customers: unreadable rule"


def _shown_value(text: Column) -> Column:
    """A JSON value the way a page prints it: lists joined by commas, plain numbers."""
    number = text.try_cast("double")
    plain = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string"))
    return (F.when(F.startswith(text, F.lit("[")),
                   F.array_join(F.from_json(text, "array<string>"), ","))
            .otherwise(F.coalesce(plain, text)))


def rule_chips(segments: DataFrame, first: int = 3, document: str = "filter_logic") -> DataFrame:
    """The first conditions of each rule in short, in document order; a rule that cannot be read
    means nobody and says so."""
    entries = F.map_entries(F.from_json(document, "map<string,string>"))
    given = F.filter(entries, lambda e: e.value.isNotNull())
    chips = F.transform(
        F.slice(given, 1, first),
        lambda e: F.concat(F.replace(e.key, F.lit("_"), F.lit(" ")), F.lit(": "),
                           _shown_value(e.value)))
    nothing = F.coalesce(F.size(entries) <= 0, F.lit(True))
    return parse_rules(segments, document).withColumn(
        "chips", F.when(~F.col("rule.valid"), F.array(F.lit(UNREADABLE_CHIP)))
        .when(nothing, F.array(F.lit("All customers"))).otherwise(chips)).drop("rule")
