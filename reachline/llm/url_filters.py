"""URL filters: a sorted sweep over reversed-host keys with a stack of nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachline.llm.common import before, blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, action string"
START, PROBE, END = 0, 1, 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    """The labels of a host, the last one first."""
    return F.reverse(F.split(host, r"\."))


def _reversed_host(host: Column) -> Column:
    """``a.b.net`` gives net.b.a."""
    return F.array_join(_labels(host), ".")


def _reversed_hosts(labels: Column) -> Column:
    """net, b, a gives net, net.b, net.b.a: the host of these labels and the domains above it."""
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))


def _key(reversed_host: Column, path: Column) -> Column:
    """Bytes in which every rule is a prefix, and so an interval of the sort order."""
    return F.encode(F.concat(reversed_host, F.lit("."), path), "UTF-8")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of every row's ``url``.

    ``rules`` has host, path and action. A rule fits its host and all hosts below it, if the
    path begins with the rule's path. The longest rule (host and path together, then the
    longer host) wins; without one the rule is null and the verdict ``default``.

    Method. A key is the reversed host, a dot and the path, as bytes. A rule's key is the prefix
    of all keys it fits, an interval that ends at the prefix followed by byte FF; two rules are
    nested or apart. The stack nests rules of one host, by path; rules of a host and of domains
    above it meet by looking up every distinct address under each of these domains that is no
    deeper than the deepest rule, and taking the longest rule found. Interval starts, ends and
    lookups are range-partitioned by key and swept in order: the running sum of starts less ends
    is the height of the stack, and the rule on top at height h is the last one pushed at height
    h. What lies on the stack where a block begins comes from the blocks before it, one row per
    block and height.

    Null urls, and urls without ``://``, have empty host and path, and no rule unless a rule's
    host is empty. Rules with a null host or path, or with one that no url can have, are left
    out; of rules with one host and path, ``block`` wins over ``allow``. Repeated rows are all
    kept. Columns host, path, rule and verdict of ``pages`` are replaced; names that begin with
    two underscores are reserved.
    """
    pages = (pages.withColumn("__host", url_host(F.col(url)))
             .withColumn("__path", url_path(F.col(url))))
    # No url has a host with one of /?# or a path that does not begin with a slash.
    rules = (rules.where(~F.col("host").rlike("[/?#]")
                         & ((F.col("path") == "") | F.col("path").startswith("/")))
             .groupBy("host", "path").agg(F.max("action").alias("action")))
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("hosts"),
        F.concat("host", "path").alias("rule"), F.col("action").alias("verdict"))
    prefix = _key(_reversed_host(F.col("host")), F.col("path"))
    starts = rules.select(prefix.alias("key"), F.lit(START).alias("kind"), rule.alias("top"))
    ends = starts.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"),
                         F.lit(END).alias("kind"), "top")

    addresses = pages.select("__host", "__path").distinct()
    # No domain with more labels than any rule's host can have a rule.
    deepest = rules.agg(F.coalesce(F.max(F.size(_labels(F.col("host")))), F.lit(1))).scalar()
    # The labels are a column of their own, as a lambda cannot hold the subquery.
    looked = (addresses.withColumn("__labels", F.slice(_labels(F.col("__host")), F.lit(1), deepest))
              .select("__host", "__path",
                      F.explode(_reversed_hosts(F.col("__labels"))).alias("above")))
    ruled = rules.select(
        _reversed_host(F.col("host")).alias("above")).distinct()
    looked = (looked.join(ruled, "above", "left_semi")
              .withColumn("key", _key(F.col("above"), F.col("__path"))))
    keys = looked.select("key").distinct().select(
        "key", F.lit(PROBE).alias("kind"), F.lit(None).cast(starts.schema["top"].dataType)
        .alias("top"))

    swept = _sweep(blocks(starts.unionByName(ends).unionByName(keys),
                          [F.col("key"), F.col("kind")], "url-sweep"))
    best = (looked.join(swept, "key").groupBy("__host", "__path")
            .agg(F.max("top").alias("__top")))
    replaced = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    return (pages.drop(*replaced).join(best, ["__host", "__path"], "left")
            .withColumn("host", F.col("__host")).withColumn("path", F.col("__path"))
            .withColumn("rule", F.col("__top.rule"))
            .withColumn("verdict", F.coalesce("__top.verdict", F.lit(default)))
            .drop("__host", "__path", "__top"))


def _sweep(events: DataFrame) -> DataFrame:
    """(key, top) of the lookups below at least one rule: the top of the stack there."""
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    rules = events.where(F.col("kind") != PROBE).withColumn("step", step)
    heights = before(rules.groupBy("__block").agg(F.sum("step").alias("step"))
                     .unionByName(events.select("__block").distinct()
                                  .withColumn("step", F.lit(0).cast("bigint")))
                     .groupBy("__block").agg(F.sum("step").alias("step")), [], "step")

    def levelled(frame: DataFrame) -> DataFrame:
        running = (Window.partitionBy("__block").orderBy("key", "kind")
                   .rowsBetween(Window.unboundedPreceding, 0))
        return (frame.withColumn("level", F.sum(step).over(running))
                .join(heights, "__block")
                .withColumn("level", F.col("level") + F.col("__before")))

    pushed = (levelled(rules).where(F.col("kind") == START)
              .groupBy("level", "__block")
              .agg(F.max_by("top", "key").alias("last")))
    needed = (levelled(events).where((F.col("kind") == PROBE) & (F.col("level") > 0))
              .select("level", "__block").distinct()
              .withColumn("last", F.lit(None).cast(pushed.schema["last"].dataType)))
    held = pushed.select("level", "__block", "last").unionByName(needed)
    held = held.groupBy("level", "__block").agg(F.max("last").alias("last"))
    earlier = (Window.partitionBy("level").orderBy("__block")
               .rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("level", "__block",
                       F.last("last", ignorenulls=True).over(earlier).alias("held"))
    latest = (Window.partitionBy("__block", "level").orderBy("key", "kind")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (levelled(events).where("level > 0 and kind <> 2")
            .withColumn("top", F.last("top", ignorenulls=True).over(latest))
            .where(F.col("kind") == PROBE)
            .join(held, ["__block", "level"], "left")
            .select("key", F.coalesce("top", "held").alias("top")))


CONTRACT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
                  ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(CONTRACT_RULES, RULE_SCHEMA)
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(host: str, path: str) -> str:
    return (f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')")


_LONGEST = sorted(CONTRACT_RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL = f"""
  WITH parts AS (
    SELECT page_id,
      coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')
        AS host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages)
  SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {_rule_sql(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
    CASE {' '.join(f"WHEN {_rule_sql(h, p)} THEN '{a}'" for h, p, a in _LONGEST)}
      ELSE 'allow' END AS verdict
  FROM parts"""
