"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachline.llm.common import WORD, before, blocks, word_count

MOST_COPIES = 3
STEPS = 1024  # the offset is a multiple of 1/1024, so sums stay exact


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3),
                   share: float = 1.0) -> DataFrame:
    """Target words of every source; ``sizes`` has one row (source, source_size) per source.

    Sources by code point, null last, take the ``weights`` in turn. Together the targets are
    ``share`` of all words, each at most ``MOST_COPIES`` times its source; what lies above is
    shared anew by weight. That is one level for all sources below their bound: a source is at
    its bound where bound / weight is below the level of those after it in that order. The
    windows run over sources, not over documents.
    """
    listed = F.array(*map(F.lit, weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    bound = F.col("source_size") * MOST_COPIES
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    goal = total if share == 1.0 else total * F.lit(share)
    full_bound = F.when(F.col("full"), F.col("bound")).otherwise(0)
    full_weight = F.when(F.col("full"), F.col("weight")).otherwise(0)
    level = ((F.col("goal") - F.sum(full_bound).over(everything))
             / (F.sum("weight").over(everything) - F.sum(full_weight).over(everything)))
    return (sizes
            .withColumn("weight", F.element_at(
                listed, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
                .cast("int")).cast("bigint"))
            .withColumn("bound", bound).withColumn("goal", goal)
            .withColumn("full", F.col("bound") / F.col("weight") <
                        (F.col("goal") - F.coalesce(F.sum("bound").over(filled), F.lit(0)))
                        / (F.sum("weight").over(everything)
                           - F.coalesce(F.sum("weight").over(filled), F.lit(0))))
            .withColumn("level", level)
            .withColumn("target", F.when(F.col("full"), F.col("bound").cast("double"))
                        .otherwise(F.least(F.col("weight") * F.col("level"),
                                           F.col("bound").cast("double"))))
            .select("source", "source_size", "target"))


def offset(source: Column) -> Column:
    """The random offset of a source, fixed by its name: reruns agree."""
    digits = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 4)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(STEPS)) / F.lit(float(STEPS))


def mix_copies(rows: DataFrame, order: list, **targets) -> DataFrame:
    """``rows`` (source, size and others) with source_size, target and copies.

    A document of a source is expected target / source_size times. Within the source, larger
    documents first, then by ``order``, the expected copies are summed up, one offset per source
    is added, and a document is taken once for every whole number that its part of the sum
    reaches. So the words taken differ from the target by less than the largest document, and no
    document is taken more than ``MOST_COPIES`` times. Ranks come from sorted blocks: the
    place in the block and the number of rows of the source in the blocks before it, so a
    source with most of the rows is spread over many tasks.

    Null sources form one source. Documents of size 0 take part and add no words. A source
    without words has target 0 and no copies. Rows that are equal in ``order`` too are told
    apart arbitrarily, which changes no sum.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, **targets)
    keys = [F.col("source").asc_nulls_last(), F.col("size").desc(), *order]
    split = blocks(rows, keys, "mix")
    earlier = before(split.groupBy("source", "__block").agg(F.count("*").alias("n")),
                     ["source"], "n")
    inside = Window.partitionBy("__block", "source").orderBy(*keys)
    ranked = split.withColumn("__rank", F.row_number().over(inside))
    same = ["source", "__block"]
    ranked = (ranked.join(earlier.select(F.col("source").alias("__s"),
                                         F.col("__block").alias("__b"), "__before"),
                          F.col("source").eqNullSafe(F.col("__s"))
                          & (F.col("__block") == F.col("__b")))
              .drop("__s", "__b", *same[1:]))
    ranked = ranked.join(
        goals.select(F.col("source").alias("__s"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("__before") + F.col("__rank")
    reached = lambda n: F.floor(n * each + offset(F.col("source")))
    return (ranked.withColumn("copies", reached(rank) - reached(rank - 1))
            .drop("__before", "__rank"))


def mix_documents(docs: DataFrame, **targets) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Only a key of each row passes through the sort; the rows themselves are joined to the plan
    once. Rows with the same doc_id, source and text are planned as one and share the number of
    copies. Null texts count as empty. Names that begin with two underscores are reserved.
    """
    keyed = docs.withColumns({
        "__size": word_count(F.col("text")), "__text": F.xxhash64("text")})
    plan = (keyed.groupBy("doc_id", "source", F.col("__size").alias("size"),
                          F.col("__text").alias("hash")).agg(F.count("*").alias("n")))
    plan = plan.withColumn("one", F.col("size")).withColumn("size", F.col("size") * F.col("n"))
    taken = mix_copies(plan, [F.col("doc_id").asc_nulls_last(), F.col("hash")], **targets)
    taken = taken.where("copies > 0").select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("hash").alias("__h"),
        F.col("copies").cast("int").alias("__copies"))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__d"))
                        & F.col("source").eqNullSafe(F.col("__s"))
                        & (F.col("__text") == F.col("__h")))
    return (joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*docs.columns))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_copies(docs, [F.col("doc_id").asc_nulls_last()])
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


ORACLE_SQL = rf"""
  WITH sized AS (
    SELECT doc_id, source,
      CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
    FROM documents),
  sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
  weighed AS (
    SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
      3 * source_size AS bound, sum(source_size) OVER () AS total FROM sources),
  ordered AS (
    SELECT *, bound / weight < (total - coalesce(sum(bound) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS filled
    FROM weighed WINDOW before AS (ORDER BY bound / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  goals AS (
    SELECT source, source_size, CASE WHEN filled THEN CAST(bound AS DOUBLE) ELSE least(
      weight * ((total - sum(CASE WHEN filled THEN bound ELSE 0 END) OVER ())
        / (sum(weight) OVER () - sum(CASE WHEN filled THEN weight ELSE 0 END) OVER ())),
      CAST(bound AS DOUBLE)) END AS target,
      (CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS BIGINT) % {STEPS})
        / {float(STEPS)} AS shift
    FROM ordered),
  ranked AS (
    SELECT doc_id, size, source_size, target, shift,
      CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
      row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS LAST) AS n
    FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
  SELECT doc_id, size, source_size, target, CAST(size * (
    floor(n * each + shift) - floor((n - 1) * each + shift)) AS BIGINT) AS taken
  FROM ranked"""
