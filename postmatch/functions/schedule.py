"""Notification arithmetic over local wall-clock times.

All expressions take ``now`` as an argument and assume a UTC session time zone: a value returned by
``from_utc_timestamp`` is then a plain wall clock on which intervals can be added before going back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_TIMES, DEFAULT_TIMEZONE
from .text import clean_trim, col


def valid_timezone(c) -> Column:
    """The zone itself when the JVM knows it, else the default zone (an unknown one would fail the job)."""
    z = F.nullif(col(c), F.lit(""))
    known = F.concat(F.lit("2000-01-01 00:00:00 "), z).try_cast("timestamp").isNotNull()
    return F.when(known, z).otherwise(F.lit(DEFAULT_TIMEZONE))


def times_or_default(c) -> Column:
    t = col(c)
    return F.when(F.array_size(t) > 0, t).otherwise(F.array(*[F.lit(x) for x in DEFAULT_TIMES]))


def local_clock(now: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(now, zone)


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n)


def _number_or(text: Column, default: int) -> Column:
    """Missing or blank counts as 0, text that is not a number as ``default``."""
    t = clean_trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.coalesce(t.try_cast("int"), F.lit(default)))


def next_notification(now: Column, zone: Column, times: Column) -> Column:
    """Earliest coming slot; a bad hour counts as 9, a bad minute as 0."""
    clock = local_clock(now, zone)
    day = F.date_trunc("day", clock)

    def slot(t: Column) -> Column:
        parts = F.split(t, ":")
        at = day + _minutes(_number_or(F.get(parts, 0), 9) * 60 + _number_or(F.get(parts, 1), 0))
        passed = F.to_utc_timestamp(at, zone) <= now
        return F.to_utc_timestamp(F.when(passed, at + F.make_dt_interval(days=F.lit(1))).otherwise(at), zone)

    return F.array_min(F.transform(times, slot))


def is_due(now: Column, zone: Column, times: Column) -> Column:
    return F.array_contains(times, F.date_format(local_clock(now, zone), "HH:mm"))


def latest_due_slot(now: Column, zone: Column, times: Column) -> Column:
    """Struct (key, lag_minutes) of the latest slot not after ``now``, today or yesterday; else null.

    Entries that are not a time of day are skipped.
    """
    clock = local_clock(now, zone)
    day = F.date_trunc("day", clock)
    trimmed = F.transform(times, clean_trim)
    valid = F.filter(trimmed, lambda t: t.rlike(r"^(?:[01]?\d|2[0-3]):[0-5]\d$"))

    def slot(t: Column, offset: int) -> Column:
        minutes = F.substring_index(t, ":", 1).cast("int") * 60 + F.substring_index(t, ":", -1).cast("int")
        return F.to_utc_timestamp(day + _minutes(minutes + offset * 1440), zone)

    slots = F.concat(F.transform(valid, lambda t: slot(t, 0)), F.transform(valid, lambda t: slot(t, -1)))
    last = F.array_max(F.filter(slots, lambda s: s <= now))
    lag = F.floor((F.unix_micros(now) - F.unix_micros(last)) / F.lit(60_000_000)).cast("int")
    key = F.date_format(local_clock(last, zone), "yyyy-MM-dd-HHmm")
    return F.when(last.isNotNull(), F.struct(key.alias("key"), lag.alias("lag_minutes")))
