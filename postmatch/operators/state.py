"""Keyed state with expiry, as append-only version tables.

A version row is ``key columns, value columns, written_at, expires_at, deleted``. Writers only append;
a reader folds the versions of a key to the latest one and then asks whether that one is still live.
Two versions written at the same instant are ordered by ``version`` where the table has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestamp(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _version_order(log: DataFrame) -> Column:
    return F.struct(*[c for c in ("written_at", "version") if c in log.columns])


def upserts(rows: DataFrame, now, ttl_seconds: int | None = None) -> DataFrame:
    """Version rows to append for ``rows`` written at ``now``."""
    at = timestamp(now)
    expires = F.lit(None).cast("timestamp") if ttl_seconds is None else at + F.make_dt_interval(
        secs=F.lit(ttl_seconds))
    return rows.withColumns({"written_at": at, "expires_at": expires, "deleted": F.lit(False)})


def tombstones(keys: DataFrame, values: Sequence[tuple[str, str]], now) -> DataFrame:
    """Version rows that delete ``keys``; ``values`` lists (name, type) of the value columns."""
    nulls = {name: F.lit(None).cast(kind) for name, kind in values}
    return keys.withColumns({
        **nulls,
        "written_at": timestamp(now),
        "expires_at": F.lit(None).cast("timestamp"),
        "deleted": F.lit(True),
    })


def latest(log: DataFrame, key: Sequence[str], now) -> DataFrame:
    """Latest version per key as of ``now``, live or not."""
    values = [c for c in log.columns if c not in key]
    return (
        log.where(F.col("written_at") <= timestamp(now))
        .groupBy(*key)
        .agg(F.max_by(F.struct(*values), _version_order(log)).alias("v"))
        .select(*key, "v.*")
    )


def live(log: DataFrame, key: Sequence[str], now) -> DataFrame:
    """Keys whose latest version is neither deleted nor expired. An older version never comes back."""
    unexpired = F.col("expires_at").isNull() | (F.col("expires_at") > timestamp(now))
    return latest(log, key, now).where(~F.coalesce(F.col("deleted"), F.lit(False)) & unexpired)


def insert_if_absent(log: DataFrame, candidates: DataFrame, key: Sequence[str], order: Column, now,
                     ttl_seconds: int | None = None) -> DataFrame:
    """Version rows for the candidates whose key has no live value; the first per key wins.

    Appending the result is safe for one writer at a time.
    """
    values = [c for c in candidates.columns if c not in key]
    first = (
        candidates.groupBy(*key)
        .agg(F.min_by(F.struct(*values), order).alias("v"))
        .select(*key, "v.*")
    )
    return upserts(first.join(live(log, key, now).select(*key), list(key), "left_anti"), now, ttl_seconds)


def patch(current: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merge non-null patch fields over current rows.

    Returns (merged rows, rejected patches); a patch for an absent key is rejected.
    """
    p = patches.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    merged = current.join(p, key).select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns]
    )
    rejected = patches.join(current.select(key), key, "left_anti").withColumn(
        "error", F.lit("User preferences not found")
    )
    return merged, rejected


def active_subscribers(log: DataFrame) -> DataFrame:
    """Users whose latest action is ``add``."""
    order = F.struct(*[c for c in ("ts", "seq") if c in log.columns])
    return (
        log.groupBy("user_id")
        .agg(F.max_by("action", order).alias("action"))
        .where(F.col("action") == "add")
        .select("user_id")
    )


# --- fixed values: textual state keys, for export to a key-value store ---
STATE_KEYS = {
    "job": "job:{}",
    "analysis": "job:analysis:{}",
    "jobs": "jobs:{}",
    "preferences": "preferences:{}",
    "fingerprint": "fingerprint:{}",
    "subscription": "subscription:{}",
    "sent": "user:{}:sent:{}",
    "slot": "pipeline:slot:{}",
}
# --- end of fixed values ---


def state_key(kind: str, *parts) -> Column:
    """Textual key of a row, e.g. ``state_key("sent", "user_id", "fingerprint")``."""
    pieces = STATE_KEYS[kind].split("{}")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"{kind} needs {len(pieces) - 1} parts")
    out: list[Column] = []
    for text, part in zip(pieces, [*parts, None]):
        if text:
            out.append(F.lit(text))
        if part is not None:
            out.append(F.col(part).cast("string"))
    return F.concat(*out)
