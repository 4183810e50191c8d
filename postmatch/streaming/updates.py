"""Drop repeats of a bot update.

The rule: an update is dropped when an update with the same key was *kept* less than the window before it.
That is sequential per key, so the batch form cuts each key into time chunks, describes what a chunk does
to the time of the last kept update, passes that time along the chunks of a key, and then marks the rows
of every chunk independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import UPDATE_DEDUP_SECONDS

CHUNK_SECONDS = 3600


def dedup_key() -> Column:
    """``msg:chat:message`` or ``cb:chat:message:data``; null for other kinds, which always pass."""
    return F.when(
        F.col("kind") == "msg", F.concat_ws(":", F.lit("msg"), "chat_id", "message_id")
    ).when(
        F.col("kind") == "cb",
        F.concat_ws(":", F.lit("cb"), "chat_id", "message_id", F.coalesce("data", F.lit(""))),
    )


def _next_kept(times: np.ndarray, window: int) -> np.ndarray:
    """For each row, the position of the first row at least one window later."""
    return np.searchsorted(times, times + window, side="left")


def _effect(times: np.ndarray, window: int, width: int) -> tuple[list[int], list[int]]:
    """Step function of one chunk: first row that can be kept (up to ``entry``) -> last row kept (``exit``).

    Only rows in the first window of the chunk, and the first row after it, can be the first kept.
    """
    start = (times[0] // width) * width
    entries = np.arange(min(np.searchsorted(times, start + window, side="left") + 1, len(times)))
    following = _next_kept(times, window)
    last = entries.copy()
    alive = following[last] < len(times)
    while alive.any():
        last[alive] = following[last[alive]]
        alive = following[last] < len(times)
    final = np.append(last[1:] != last[:-1], True)  # exits never decrease: keep the last entry of each
    return times[entries[final]].tolist(), times[last[final]].tolist()


def _effects(batches: Iterator[pd.DataFrame], window: int, width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        steps = [_effect(np.asarray(times), window, width) for times in batch["times"]]
        yield batch[["key", "chunk", "chain"]].assign(
            entries=[s[0] for s in steps], exits=[s[1] for s in steps]
        )


def _pass_along(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Time of the last kept row before each chunk of a chain."""
    for batch in batches:
        out = []
        for key, steps in zip(batch["key"], batch["steps"]):
            state = None
            for step in steps:
                out.append((key, step["chunk"], state))
                at = 0 if state is None else int(np.searchsorted(step["entries"], state + window, side="left"))
                if at < len(step["entries"]):
                    state = int(step["exits"][at])
        yield pd.DataFrame(out, columns=["key", "chunk", "before"]).astype({"before": "Int64"})


def _marks(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Kept times of each chunk given the last kept time before it."""
    for batch in batches:
        keys, kept = [], []
        for key, before, times in zip(batch["key"], batch["before"], batch["times"]):
            times = np.asarray(times)
            at = 0 if pd.isna(before) else int(np.searchsorted(times, int(before) + window, side="left"))
            following = _next_kept(times, window)
            while at < len(times):
                keys.append(key)
                kept.append(times[at])
                at = following[at]
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "us": pd.Series(kept, dtype="int64")})


def kept_times(rows: DataFrame, window: int, width: int) -> DataFrame:
    """Distinct (key, us) that are kept, for rows (key, us) in microseconds; batch only.

    A chunk of a key becomes one row with its sorted times, so that Python sees whole Arrow batches of
    chunks. A chunk of one row, with a whole window free before it, needs no Python at all.
    """
    chunks = (
        rows.select("key", "us", F.floor(F.col("us") / width).cast("long").alias("chunk"))
        .groupBy("key", "chunk")
        .agg(F.array_sort(F.collect_set("us")).alias("times"))
    )
    in_order = Window.partitionBy("key").orderBy("chunk")
    spans = (
        chunks.select("key", "chunk", F.get("times", 0).alias("low"), F.element_at("times", -1).alias("high"))
        .withColumn("link", F.coalesce(F.col("low") - F.lag("high").over(in_order) < window, F.lit(False)))
        .withColumn("chain", F.sum(F.when(F.col("link"), 0).otherwise(1)).over(in_order))
        .withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("key", "chain")))
        .select("key", "chunk", "chain", "chunks")
    )
    placed = chunks.join(spans, ["key", "chunk"])
    single = (F.col("chunks") == 1) & (F.size("times") == 1)

    effects = placed.where("chunks > 1").select("key", "chunk", "chain", "times").mapInPandas(
        partial(_effects, window=window, width=width),
        "key string, chunk long, chain long, entries array<long>, exits array<long>",
    )
    before = (
        effects.groupBy("key", "chain")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "entries", "exits"))).alias("steps"))
        .select("key", "steps")
        .mapInPandas(partial(_pass_along, window=window), "key string, chunk long, before long")
    )
    marked = (
        placed.where(~single)
        .join(before, ["key", "chunk"], "left")
        .select("key", "before", "times")
        .mapInPandas(partial(_marks, window=window), "key string, us long")
    )
    return placed.where(single).select("key", F.get("times", 0).alias("us")).unionByName(marked)


def dedup_updates(updates: DataFrame, key: Column | None = None, order: str = "message_id",
                  window_seconds: float = UPDATE_DEDUP_SECONDS, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Kept updates of a finite table. Of several at one instant the lowest ``order`` is kept.

    ``chunk_seconds`` must be at least the window. Rows with a null key pass.
    """
    window, width = int(window_seconds * 1_000_000), int(chunk_seconds * 1_000_000)
    if width < window:
        raise ValueError("a chunk must not be shorter than the window")
    keyed = updates.withColumns({"key": dedup_key() if key is None else key, "us": F.unix_micros("ts")})
    rows = keyed.where(F.col("key").isNotNull())
    first = rows.groupBy("key", "us").agg(
        F.min_by(F.struct(*updates.columns), F.col(order)).alias("row")
    )
    kept = first.join(kept_times(rows, window, width), ["key", "us"]).select("row.*")
    return kept.unionByName(keyed.where(F.col("key").isNull()).select(*updates.columns))


def _stream_keys(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: int,
                 columns: list[str]) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    times = pd.concat(list(batches)).sort_values(["us"], kind="stable")
    kept = []
    for position, us in enumerate(times["us"]):
        if last is None or us >= last + window:
            kept.append(position)
            last = int(us)
    state.update((last,))
    state.setTimeoutTimestamp(max((last + window) // 1000, state.getCurrentWatermarkMs()) + 1)
    if kept:
        yield times.iloc[kept][columns]


def dedup_update_stream(updates: DataFrame, window_seconds: float = UPDATE_DEDUP_SECONDS) -> DataFrame:
    """Kept updates of a stream, by the same rule as :func:`dedup_updates`.

    The state of a key is the time of its last kept update; it is dropped once the watermark, one window
    behind the newest update, has passed the end of its window. Within a micro-batch updates are taken in time order; an update older than the last kept one of its key
    is dropped as a repeat.
    """
    window = int(window_seconds * 1_000_000)
    keyed = updates.withColumns({"key": dedup_key(), "us": F.unix_micros("ts")})
    kept = (
        keyed.where(F.col("key").isNotNull())
        .withWatermark("ts", f"{window} microseconds")
        .groupBy("key")
        .applyInPandasWithState(
            partial(_stream_keys, window=window, columns=updates.columns),
            outputStructType=updates.schema,
            stateStructType="last long",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )
    return kept.unionByName(updates.where(dedup_key().isNull()))


def dedup_update_stream_builtin(updates: DataFrame, window_seconds: int = UPDATE_DEDUP_SECONDS) -> DataFrame:
    """JVM-only stream variant; a repeat is dropped until the watermark passes, so for longer than the window.

    Keyed rows behind the watermark are dropped; rows with a null key go around the state.
    """
    kept = (
        updates.withColumn("key", dedup_key())
        .where(F.col("key").isNotNull())
        .withWatermark("ts", f"{window_seconds} seconds")
        .dropDuplicatesWithinWatermark(["key"])
        .drop("key")
    )
    return kept.unionByName(updates.where(dedup_key().isNull()))
