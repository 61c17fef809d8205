"""When campaigns complete: message counters swept in arrival order.

The rule is tested after every accepted receipt and holds for good: an open campaign is
completed by the first receipt after which no message is queued and there are as many messages
as were sent, whatever comes later. A final state cannot show this, as strangers' receipts add
messages after that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachline.fixed import OPEN_CAMPAIGN_STATUSES
from reachline.operators.receipts import KEYS, rank_of

BLOCKS = 4096
"""Ranges of arrival numbers that are swept apart from each other."""


def first_moves() -> list[Column]:
    """Per message the first receipt and the first one that ends its waiting, with times."""
    seq, ts = F.col("seq"), F.col("ts")
    moves = rank_of(F.col("event_type")) >= 1
    return [F.min(seq).alias("first_seq"), F.min_by(ts, seq).alias("first_at"),
            F.min(F.when(moves, seq)).alias("moved_seq"),
            F.min_by(ts, F.when(moves, seq)).alias("moved_at")]


def counter_changes(moves: DataFrame, before: DataFrame) -> DataFrame:
    """(campaign_id, customer_id, seq, ts, messages, queued): what receipts add to the counters
    of their campaign, at most twice per message.

    ``before`` has the messages as they stood. A message without a row is added by its first
    receipt. The first receipt of any other changes nothing but is a moment of the test too.
    """
    was = before.select(*KEYS, F.col("status").alias("was"))
    joined = moves.join(was, KEYS, "left")
    new, waiting = F.col("was").isNull(), F.coalesce(F.col("was"), F.lit("queued")) == "queued"
    leaves = waiting & F.col("moved_seq").isNotNull()
    at_once = leaves & (F.col("moved_seq") == F.col("first_seq"))
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0))
    first = F.struct(F.col("first_seq").alias("seq"), F.col("first_at").alias("ts"),
                     one(new).alias("messages"), (one(new) - one(at_once)).alias("queued"))
    second = F.when(leaves & ~at_once, F.struct(
        F.col("moved_seq").alias("seq"), F.col("moved_at").alias("ts"),
        F.lit(0).alias("messages"), F.lit(-1).alias("queued")))
    return (joined.select(*KEYS, F.explode(F.array_compact(F.array(first, second))).alias("e"))
            .select(*KEYS, "e.*"))


def first_completions(changes: DataFrame, counters: DataFrame, campaigns: DataFrame
                      ) -> DataFrame:
    """(campaign_id, completed_at): the time of the receipt that first completes a campaign.

    ``counters`` (campaign_id, messages, queued) are those before the changes, ``campaigns``
    has id and total_sent. Running sums in order of arrival, of equal numbers by customer: the
    changes are dealt to ranges of arrival numbers; sums of earlier ranges come from one row
    per campaign and range, and only what lies in one range is sorted together. So neither a
    crowded campaign nor a long history lands in one task.
    """
    bounds = changes.agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    low = bounds.select("low").scalar()
    width = bounds.select(F.greatest(
        F.ceil((F.col("high") - F.col("low") + 1) / BLOCKS), F.lit(1))).scalar()
    dealt = changes.withColumn("block", F.floor((F.col("seq") - low) / width))
    totals = dealt.groupBy("campaign_id", "block").agg(
        F.sum("messages").alias("messages"), F.sum("queued").alias("queued"))
    earlier = (Window.partitionBy("campaign_id").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(
        "campaign_id", "block",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_in") for c in
          ("messages", "queued")])
    heads = (campaigns.select(F.col("id").alias("campaign_id"), "total_sent")
             .where(F.col("total_sent") > 0)
             .join(counters.select("campaign_id", F.col("messages").alias("messages_base"),
                                   F.col("queued").alias("queued_base")), "campaign_id", "left")
             .fillna(0, ["messages_base", "queued_base"]))
    within = (Window.partitionBy("campaign_id", "block").orderBy("seq", "customer_id")
              .rowsBetween(Window.unboundedPreceding, 0))
    swept = (dealt.withColumns({f"{c}_now": F.sum(c).over(within)
                                for c in ("messages", "queued")})
             .join(starts, ["campaign_id", "block"]).join(heads, "campaign_id"))
    total = lambda c: F.col(f"{c}_base") + F.col(f"{c}_in") + F.col(f"{c}_now")
    met = swept.where((total("queued") == 0) & (total("messages") == F.col("total_sent")))
    return met.groupBy("campaign_id").agg(
        F.min_by("ts", F.struct("seq", "customer_id")).alias("completed_at"))


def with_completion(campaigns: DataFrame, counts: DataFrame, completions: DataFrame
                    ) -> DataFrame:
    """Campaigns (id, status, total_sent and, if known, completed_at) with their counters and
    the status after the rule. What is completed stays so, with its time. ``status_before`` of
    the result is that of the campaigns if they have it, else their status."""
    known = (F.col("was_at") if "completed_at" in campaigns.columns
             else F.lit(None).cast("timestamp_ntz"))
    first = "status_before" if "status_before" in campaigns.columns else "status"
    heads = campaigns.select(F.col("id").alias("campaign_id"), F.col(first).alias("status_before"),
                             F.col("status").alias("status_now"), "total_sent",
                             *[F.col("completed_at").alias("was_at")
                               for c in campaigns.columns if c == "completed_at"])
    done = (F.col("status_now").isin(OPEN_CAMPAIGN_STATUSES)
            & F.col("completed_at").isNotNull())
    return (heads.join(counts.select("campaign_id", "messages", "queued"), "campaign_id", "left")
            .fillna(0, ["messages", "queued"]).join(completions, "campaign_id", "left")
            .select("campaign_id", "status_before", "total_sent", "messages", "queued",
                    F.when(done, "completed").otherwise(F.col("status_now")).alias("status"),
                    F.when(done, F.col("completed_at")).otherwise(known).alias("completed_at")))


def completion_moments(campaigns: DataFrame, communications: DataFrame, receipts: DataFrame
                       ) -> DataFrame:
    """Every campaign with its status after all ``receipts`` and the moment it was completed.

    ``communications`` are the messages before the receipts, which are in the order of ``seq``.
    """
    moves = receipts.groupBy(*KEYS).agg(*first_moves())
    changes = counter_changes(moves, communications)
    before = communications.groupBy("campaign_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("status") == "queued").alias("queued"))
    after = (before.unionByName(changes.groupBy("campaign_id").agg(
        F.sum("messages").alias("messages"), F.sum("queued").alias("queued")))
        .groupBy("campaign_id").agg(F.sum("messages").alias("messages"),
                                    F.sum("queued").alias("queued")))
    return with_completion(campaigns, after, first_completions(changes, before, campaigns))
