"""Who is due, when the next run is, and which slot a run may claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schedule as S
from ..functions.text import first_truthy
from ..schema import DEFAULT_TIMES, DEFAULT_TIMEZONE, MAX_CATCHUP_LAG_MINUTES, SLOT_TTL_HOURS
from .state import timestamp


def with_effective_schedule(preferences: DataFrame, timezone: str = DEFAULT_TIMEZONE,
                            times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    """Add ``zone`` and ``times``: the user's own, else the configured ones given here."""
    configured = F.array(*[F.lit(t) for t in times])
    return preferences.withColumns({
        "zone": S.valid_timezone(F.coalesce(first_truthy("timezone"), F.lit(timezone))),
        "times": S.times_or_default(F.coalesce("notification_times", configured)),
    })


def next_times(preferences: DataFrame, now, timezone: str = DEFAULT_TIMEZONE,
               times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    return with_effective_schedule(preferences, timezone, times).withColumn(
        "next_time", S.next_notification(timestamp(now), F.col("zone"), F.col("times"))
    )


def due_users(preferences: DataFrame, now, timezone: str = DEFAULT_TIMEZONE,
              times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    return with_effective_schedule(preferences, timezone, times).where(
        S.is_due(timestamp(now), F.col("zone"), F.col("times"))
    ).drop("zone", "times")


def distinct_schedules(preferences: DataFrame) -> DataFrame:
    """Every (timezone, notification_times) once, for slots, which depend on nothing else of a user.

    The times hang on the count, so that a filter on the slot stays above the aggregate and isn't worked out for every user.
    """
    found = preferences.groupBy("timezone", "notification_times").agg(F.count(F.lit(1)).alias("n_users"))
    return found.withColumn("notification_times", F.when(F.col("n_users") > 0, F.col("notification_times")))


def latest_slots(preferences: DataFrame, now) -> DataFrame:
    """Add ``slot`` struct (key, lag_minutes); unlike the others it does not default an empty list."""
    return preferences.withColumn(
        "slot",
        S.latest_due_slot(timestamp(now), S.valid_timezone("timezone"), F.col("notification_times")),
    )


def earliest_run(preferences: DataFrame, now, timezone: str = DEFAULT_TIMEZONE,
                 times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    """One row: the earliest next slot over the global schedule and every user."""
    at = timestamp(now)
    overall = S.next_notification(
        at, S.valid_timezone(F.lit(timezone)), S.times_or_default(F.array(*[F.lit(t) for t in times]))
    )
    return next_times(preferences, now, timezone, times).agg(
        F.least(F.min("next_time"), overall).alias("next_run")
    )


def global_slot(spark, now, timezone: str = DEFAULT_TIMEZONE, times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    """One row (slot_key, lag_minutes) of the latest global slot; empty when there is none."""
    slot = S.latest_due_slot(timestamp(now), S.valid_timezone(F.lit(timezone)), F.array(*[F.lit(t) for t in times]))
    return (
        spark.range(1)
        .select(slot.alias("slot"))
        .where("slot is not null")
        .select(F.col("slot.key").alias("slot_key"), "slot.lag_minutes")
    )


def claimable(slots: DataFrame, ledger: DataFrame, now, forced: bool = False) -> DataFrame:
    """Ledger rows (slot_key, mode, claimed_at) a run may append.

    A scheduled run needs a slot at most 300 minutes old that no run claimed in the last 36 hours; a
    forced run always claims.
    """
    at = timestamp(now)
    if forced:
        return slots.select("slot_key", F.lit("forced").alias("mode"), at.alias("claimed_at")).distinct()
    held = ledger.where(
        (F.col("claimed_at") <= at) & (F.col("claimed_at") > at - F.make_dt_interval(hours=F.lit(SLOT_TTL_HOURS)))
    )
    return (
        slots.where(F.col("lag_minutes") <= MAX_CATCHUP_LAG_MINUTES)
        .join(held.select("slot_key"), "slot_key", "left_anti")
        .select("slot_key", F.lit("scheduled").alias("mode"), at.alias("claimed_at"))
        .distinct()
    )
