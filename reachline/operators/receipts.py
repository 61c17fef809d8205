"""Delivery receipts: first occurrences, the status of a message, its event log, upserts.

A message is one (campaign, customer) pair. Its status is what the one-by-one rule gives:
in arrival order, skip a type already seen; unless the message has failed, move to the new
type when it ranks higher. The same result follows from a few minima and maxima:

* if the first receipt of rank 2 or more is ``failed``, the message has failed;
* otherwise its status is the highest-ranking type seen other than ``failed``;
* it was sent at the time of its first receipt of rank 1 or more, if that is ``sent`` or
  ``delivered``;
* it changed last at the latest time among the first receipts of its types; duplicates change
  nothing, and all unknown types count as one.

Minima and maxima combine before the shuffle, so a campaign, a customer or even a message
with most of the receipts costs no more than any other, and they run unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachline.fixed import STATUS_RANK, UNKNOWN_CHANNEL

KEYS = ["campaign_id", "customer_id"]


def rank_of(event_type: Column) -> Column:
    rank = None
    for name, value in STATUS_RANK.items():
        match = event_type == name
        rank = F.when(match, value) if rank is None else rank.when(match, value)
    return rank.otherwise(0)


def _status_named(rank: Column) -> Column:
    names = {value: name for name, value in STATUS_RANK.items() if name != "failed"}
    status = F.when(rank == 0, names.pop(0))
    for value, name in names.items():
        status = status.when(rank == value, name)
    return status


def first_receipts(receipts: DataFrame) -> DataFrame:
    """The first receipt of each type of each message; later ones are duplicates.

    A grouped minimum: repeats are dropped before the shuffle. With fixed-width columns only
    (no metadata) it runs as a hash aggregate.
    """
    others = [c for c in receipts.columns if c not in (*KEYS, "event_type", "seq")]
    return receipts.groupBy(*KEYS, "event_type").agg(
        F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in others])


def progress() -> list[Column]:
    """What the status of a message depends on, as combinable aggregates."""
    kind, seq, ts = F.col("event_type"), F.col("seq"), F.col("ts")
    rank = rank_of(kind)
    failed = F.coalesce(kind == "failed", F.lit(False))
    handed_over = kind.isin("sent", "delivered")
    known = kind.isin(list(STATUS_RANK))
    of_kind = {name: kind == name for name in STATUS_RANK}
    of_kind["other"] = ~F.coalesce(known, F.lit(False))
    return [
        *[F.min_by(ts, F.when(is_kind, seq)).alias(f"first_{name}")
          for name, is_kind in of_kind.items()],
        F.min(F.when(rank >= 2, seq)).alias("settled"),
        F.min(F.when(failed, seq)).alias("failed"),
        F.max(F.when(~failed, rank)).alias("top"),
        F.min(F.when(rank >= 1, seq)).alias("moved"),
        F.min(F.when(handed_over, seq)).alias("handed"),
        F.min_by(ts, F.when(handed_over, seq)).alias("handed_at"),
    ]


def _by_arrival(a: Column, b: Column) -> Column:
    """Order of log entries; those without a number come first."""
    return (F.when(a.seq.isNull(), F.when(b.seq.isNull(), 0).otherwise(-1))
            .when(b.seq.isNull() | (a.seq > b.seq), 1).when(a.seq < b.seq, -1).otherwise(0))


def _log() -> Column:
    entry = F.struct("seq", "event_type", "ts", "metadata")
    return F.array_sort(F.collect_list(entry), _by_arrival).alias("events")


def status_columns() -> list[Column]:
    """Status and send time from the aggregates of ``progress``."""
    return [
        F.when(F.col("failed") == F.col("settled"), "failed")
        .otherwise(_status_named(F.coalesce("top", F.lit(0)))).alias("status"),
        F.when(F.col("handed") == F.col("moved"), F.col("handed_at")).alias("sent_at"),
        F.greatest(*[F.col(f"first_{name}") for name in (*STATUS_RANK, "other")])
        .alias("updated_at"),
    ]


def fold_receipts(receipts: DataFrame) -> DataFrame:
    """Status, send time and last receipt time of each message. Batch or stream."""
    return receipts.groupBy(*KEYS).agg(*progress()).select(*KEYS, *status_columns())


def event_log(receipts: DataFrame) -> DataFrame:
    """Accepted receipts of each message in arrival order, one per type."""
    return first_receipts(receipts).groupBy(*KEYS).agg(_log())


def message_states(receipts: DataFrame) -> DataFrame:
    """Status columns together with the event log, from one grouping of accepted receipts."""
    return (first_receipts(receipts).groupBy(*KEYS).agg(*progress(), _log())
            .select(*KEYS, *status_columns(), "events"))


def stage_event_counts(receipts: DataFrame) -> DataFrame:
    """Receipts per type. Batch or stream."""
    return receipts.groupBy("event_type").agg(F.count("*").alias("receipts"))


def message_id(campaign_id: Column, customer_id: Column) -> Column:
    """The same id on every run, so that a repeated dispatch or replay adds no rows."""
    return F.concat_ws("-", campaign_id.cast("string"), customer_id.cast("string"))


def _merged_log(stored: Column, new: Column) -> Column:
    """The first receipt of each type among the stored log and the new ones, in order of
    arrival. Stored receipts without a number come before all others."""
    unseen = lambda among, met: F.filter(among, lambda e: ~met(e))
    same = lambda a, b: a.event_type.eqNullSafe(b.event_type)
    kept = unseen(stored, lambda e: F.exists(
        new, lambda n: same(n, e) & F.coalesce(n.seq < e.seq, F.lit(False))))
    added = unseen(new, lambda e: F.exists(
        stored, lambda s: same(s, e) & F.coalesce(s.seq <= e.seq, F.lit(True))))
    return F.array_sort(F.concat(kept, added), _by_arrival)


def _of_log(events: Column) -> dict[str, Column]:
    """Status, send time and last change of a message from its log, as ``status_columns``."""
    rank = lambda e: rank_of(e.event_type)
    first = lambda found: F.get(found, F.lit(0))
    failed = lambda e: F.coalesce(e.event_type == "failed", F.lit(False))
    known = lambda e: F.coalesce(
        e.event_type.isin(list(STATUS_RANK)), F.lit(False))
    settled = first(F.filter(events, lambda e: rank(e) >= 2))
    moved = first(F.filter(events, lambda e: rank(e) >= 1))
    top = F.array_max(F.transform(F.filter(events, lambda e: ~failed(e)), rank))
    odd = first(F.filter(events, lambda e: ~known(e)))
    return {
        "status": F.when(settled.event_type == "failed", "failed").otherwise(
            _status_named(F.coalesce(top, F.lit(0)))),
        "sent_at": F.when(moved.event_type.isin("sent", "delivered"), moved.ts),
        "updated_at": F.greatest(odd.ts, F.array_max(F.transform(
            F.filter(events, known), lambda e: e.ts)))}


def _upserted(communications: DataFrame, receipts: DataFrame, how: str, new_id) -> DataFrame:
    """Message rows joined to the logs of new receipts; rows without any stay as they are."""
    columns = ["seq", *KEYS, "event_type", "ts", "metadata"]
    new = (first_receipts(receipts.select(columns)).groupBy(*KEYS).agg(_log())
           .withColumnRenamed("events", "new_events"))
    named = F.col("new_events").isNotNull()
    merged = (communications.join(new, KEYS, how)
              .withColumn("stored", F.coalesce("events", F.array().cast(
                  communications.schema["events"].dataType)))
              .withColumn("log", F.when(named, _merged_log(F.col("stored"), F.col("new_events")))
                          .otherwise(F.col("stored"))))
    changed = {c: F.when(named, value).otherwise(F.col(c))
               for c, value in _of_log(F.col("log")).items()}
    return merged.select(
        F.coalesce("id", new_id(*map(F.col, KEYS))).alias("id"), *KEYS, "recipient",
        F.when(named, F.coalesce("channel", F.lit(UNKNOWN_CHANNEL)))
        .otherwise(F.col("channel")).alias("channel"),
        changed["status"].alias("status"), F.col("log").alias("events"),
        changed["sent_at"].alias("sent_at"), changed["updated_at"].alias("updated_at"))


def changed_communications(communications: DataFrame, receipts: DataFrame,
                           new_id=message_id) -> DataFrame:
    """The message rows that new receipts name, as they are afterwards.

    The log keeps the first receipt of each type in order of arrival, whether stored or new, and
    the status follows from the log: receipts that come late leave the same rows as in time. A
    receipt without a row makes one with an unknown channel and an id from ``new_id``.
    """
    return _upserted(communications, receipts, "right", new_id)


def upsert_communications(communications: DataFrame, receipts: DataFrame,
                          new_id=message_id) -> DataFrame:
    """The whole message table after new receipts: one full outer join of the table with the
    grouped receipts, each read once. Rows the receipts do not name pass through."""
    return _upserted(communications, receipts, "full", new_id)
