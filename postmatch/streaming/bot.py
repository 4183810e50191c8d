"""The bot's update chain as one stateful stream, keyed by chat.

Repeated deliveries go first. What is left drives the chat's preference session, and its commands the subscriptions of its users. One operator
holds all three states of a chat, so an update is looked at once, and the two logs (preferences, subscriptions) and the status answers come
out of one stream. Timers forget delivery keys once their window has passed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import UPDATE_DEDUP_SECONDS, WIZARD_STEPS
from .subscriptions import STATUS_TEXTS
from .wizard import ANSWERS, replay

#: What the chain says: ``kind`` is preferences (the answers are set), subscription (``action`` is set) or status (``subscribed`` is set).
EVENTS = (
    "kind string, chat_id long, user_id long, ts timestamp, message_id long, job_title string, work_type string, experience_level string, "
    "location string, skills string, action string, subscribed boolean"
)
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
_SET = {"subscribe": "add", "unsubscribe": "remove"}
_COMMAND = re.compile(r"^/(subscribe|unsubscribe|subscription)(?:@\w+)?(?:\s|$)")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def delivery_key(u: Row) -> str | None:
    """The key under which a repeated delivery is known; null for kinds that are never dropped."""
    if u["kind"] == "msg":
        return f"msg:{u['message_id']}"
    return f"cb:{u['message_id']}:{u['data'] or ''}" if u["kind"] == "cb" else None


def event(kind: str, u: Row, **values) -> Row:
    row = {"kind": kind, "chat_id": u["chat_id"], "user_id": u["user_id"], "ts": u["ts"], "message_id": u["message_id"], **values}
    return Row(**{name: row.get(name) for name in _NAMES})


class BotChat(StatefulProcessor):
    """State of a chat: delivery key -> time of its last kept update (microseconds), session (step, answers), user -> subscribed.

    Every access to the state is a call out of the Python process. So a chat's state is read and written once in a micro-batch, not once per
    update, and one timer per chat and micro-batch forgets the delivery keys.
    """

    def __init__(self, window_seconds: float = UPDATE_DEDUP_SECONDS):
        self.window = int(window_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("deliveries", "last string")
        self.session = handle.getValueState("session", "step string, answers string")
        self.subscribed = handle.getMapState("subscribed", "user_id long", "active boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Subscriptions (chat_id, user_id, active) that were made before the stream began."""
        if initialState["user_id"] is not None:
            self.subscribed.updateValue((initialState["user_id"],), (bool(initialState["active"]),))

    def _last(self) -> dict[str, int]:
        held = self.seen.get()
        return json.loads(held[0]) if held is not None else {}

    def _repeated(self, u: Row, last: dict[str, int]) -> bool:
        key = delivery_key(u)
        if key is None:
            return False
        if key in last and u["us"] - last[key] < self.window:
            return True
        last[key] = u["us"]
        return False

    def _active(self, u: Row, active: dict[int, bool]) -> bool:
        if u["user_id"] not in active:
            held = self.subscribed.getValue((u["user_id"],))
            active[u["user_id"]] = bool(held and held[0])
        return active[u["user_id"]]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, answers = self.session.get() or (WIZARD_STEPS[0], "{}")
        answers, before = json.loads(answers), (step, answers)
        last, active, changed = self._last(), {}, set()
        known = dict(last)

        def set_to(u: Row, action: str) -> Row:
            active[u["user_id"]] = action == "add"
            changed.add(u["user_id"])
            return event("subscription", u, action=action)

        # The updates of one chat in one micro-batch, whose size the source's limits bound.
        for u in sorted(rows, key=lambda r: (r["us"], r["message_id"] or 0, r["kind"] or "", r["text"] or "", r["data"] or "")):
            if self._repeated(u, last):
                continue
            step, answers, _, confirmed = replay([u.asDict()], step, answers)
            if u["user_id"] is None:
                continue
            for row in confirmed:
                yield event("preferences", u, **dict(zip(ANSWERS, row[1:], strict=True)))
                yield set_to(u, "add")
            command = _COMMAND.match(u["text"] or "") if u["kind"] == "msg" else None
            if command and command[1] in _SET:
                yield set_to(u, _SET[command[1]])
            elif command or (u["kind"] == "msg" and u["text"] in STATUS_TEXTS):
                yield event("status", u, subscribed=self._active(u, active))
        if (step, answers) != (before[0], json.loads(before[1])):
            self.session.update((step, json.dumps(answers)))
        for user in changed:
            self.subscribed.updateValue((user,), (active[user],))
        if last != known:
            # Updates older than the watermark are dropped, so keys whose window ended before it can't be met again.
            self._hold(last, timerValues.getCurrentWatermarkInMs() * 1000 - self.window)
            self.handle.registerTimer((max(last.values()) + self.window) // 1000 + 1)

    def _hold(self, last: dict[str, int], until: int) -> None:
        left = {name: us for name, us in last.items() if us >= until}
        if left:
            self.seen.update((json.dumps(left),))
        else:
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._hold(self._last(), expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window)
        return iter(())

    def close(self) -> None:
        pass


def bot_events(updates: DataFrame, subscriptions: DataFrame | None = None, window_seconds: float = UPDATE_DEDUP_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Rows of :data:`EVENTS` for a stream of updates (chat_id, user_id, message_id, kind, text, data, ts).

    Updates of a chat are taken in time order within a micro-batch; those older than the watermark, ``delay`` behind the newest update, are
    dropped. ``subscriptions`` (chat_id, user_id, active), at most one row each, is what was set before the stream began. Updates without a
    user drive the session of their chat but change no log; updates without a chat or time take no part. A text command is also an answer to
    the session's current question. The session needs the RocksDB state store, see :func:`start_bot`.
    """
    rows = updates.where(F.col("chat_id").isNotNull() & F.col("ts").isNotNull()).select(
        "chat_id", "user_id", "message_id", "kind", "text", "data", "ts", F.unix_micros("ts").alias("us"))
    before = None if subscriptions is None else subscriptions.select("chat_id", "user_id", "active").groupBy("chat_id")
    return rows.withWatermark("ts", delay).groupBy("chat_id").transformWithState(
        BotChat(window_seconds), EVENTS, outputMode="Append", timeMode="EventTime", initialState=before)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """A query keeps the settings it starts with: one that starts in here has the RocksDB state store; the session gets its own setting back."""
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if held is None else spark.conf.set(PROVIDER, held)


def start_bot(updates: DataFrame, folder: str, subscriptions: DataFrame | None = None, available_now: bool = False, **options) -> StreamingQuery:
    """Run the chain into two tables and the answers below ``folder``: preferences, subscriptions, status.

    Every micro-batch writes folders of its own number, so a batch that runs again after a failure replaces its rows: nothing is lost or doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, columns in LOGS.items():
                batch.where(F.col("kind") == kind).select(*columns).write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        finally:
            batch.unpersist()

    writer = bot_events(updates, subscriptions, **options).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    with rocksdb_state(updates.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


#: The tables :func:`start_bot` writes.
LOGS = {
    "preferences": ["chat_id", "user_id", "ts", *ANSWERS],
    "subscription": ["chat_id", "user_id", "message_id", "action", "ts"],
    "status": ["chat_id", "user_id", "ts", "subscribed"],
}
