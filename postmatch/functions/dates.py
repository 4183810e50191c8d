"""Dates as sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_trim, col


def parse_date(c) -> Column:
    """ISO dates, mail-style dates (with or without weekday) and ``Month d, yyyy``; else null.

    A value without offset counts as UTC.
    """
    s = clean_trim(c)
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3,9},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.when(s.rlike(r"^\d{4}"), s.try_cast("timestamp")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy")),
        F.try_to_timestamp(s, F.lit("MMM d, yyyy")),
    )


def date_or(c, now: Column) -> Column:
    return F.coalesce(parse_date(c), now)


def epoch_or_date(number: Column, text: Column, now: Column) -> Column:
    """Epoch seconds when the value is a number (0 counts as missing), a date text otherwise."""
    seconds = F.when(number != 0, F.timestamp_seconds(number))
    return F.coalesce(seconds, parse_date(text), now)
