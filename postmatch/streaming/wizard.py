"""Preference wizard: a state machine over the updates of each user.

One transition function serves the stream and the batch form. The next step depends only on the current
step and the update, never on earlier answers. The batch form uses that: a chunk of a user's updates is
described by where it leads from each step and which answers it sets, these descriptions are combined along
the user's chunks, and every chunk is then replayed on its own from its known start.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import WHITESPACE
from ..operators.preferences import create_preferences
from ..schema import EXPERIENCE_LEVELS, WIZARD_STEPS, WORK_TYPES

CHUNK = "1 day"

# --- fixed values: texts and button data that drive the wizard ---
START_TEXTS = {"🚀 Start Job Search", "Start Job Search", "Start", "/start"}
START_DATA = "start_search"
CONFIRM_DATA = "preferences:confirm"
RESTART_DATA = "preferences:restart"
UPDATE_DATA = "preferences:update"
WORK_TYPE_DATA = "work-type:"
LEVEL_DATA = "experience:"
# --- end of fixed values ---

_START_COMMAND = re.compile(r"^/start(?:@\w+)?(?:\s|$)")
_SPACES = re.compile(f"[{WHITESPACE}]+")
ANSWERS = ("job_title", "work_type", "experience_level", "location", "skills")
CONFIRMED = (
    "user_id long, ts timestamp, job_title string, work_type string, experience_level string, "
    "location string, skills string"
)
_FIRST = WIZARD_STEPS[0]


def _squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def _answer(step: str, text: str) -> dict | None:
    """The field set by a text in this step, or None when it is not accepted."""
    if step == "job-title":
        title = _squeeze(text)
        return {"job_title": title} if 2 <= len(title.encode("utf-16-le")) // 2 <= 100 else None
    if step == "location":
        place = _squeeze(text)
        return {"location": None if place.lower() in ("", "any") else place}
    if step == "skills":
        skills = [s for s in (part.strip(WHITESPACE) for part in text.split(",")) if s]
        return {"skills": ",".join(skills)} if skills else None
    return None


def transition(step: str, kind: str, text: str | None, data: str | None) -> tuple[str, dict, bool, bool]:
    """(next step, answers set, whether all answers are cleared first, whether preferences are confirmed)."""
    stay = (step, {}, False, False)
    if kind == "msg" and text is not None:
        if text in START_TEXTS or _START_COMMAND.match(text):
            return (_FIRST, {}, True, False)
        answer = _answer(step, text)
        return stay if answer is None else (WIZARD_STEPS[WIZARD_STEPS.index(step) + 1], answer, False, False)
    if kind != "cb" or data is None:
        return stay
    if data in (START_DATA, RESTART_DATA):
        return (_FIRST, {}, True, False)
    if data == UPDATE_DATA:
        return (_FIRST, {}, False, False)
    if data == CONFIRM_DATA:
        return (step, {}, False, step == "confirmation")
    for prefix, at, field, allowed in (
        (WORK_TYPE_DATA, "work-type", "work_type", WORK_TYPES),
        (LEVEL_DATA, "experience-level", "experience_level", EXPERIENCE_LEVELS),
    ):
        if data.startswith(prefix) and step == at and data[len(prefix):] in allowed:
            return (WIZARD_STEPS[WIZARD_STEPS.index(at) + 1], {field: data[len(prefix):]}, False, False)
    return stay


def replay(updates: Iterable[dict], step: str, answers: dict) -> tuple[str, dict, bool, list[tuple]]:
    """Run updates in order. Returns (step, answers, whether the start was cleared, confirmed rows)."""
    cleared, confirmed, answers = False, [], dict(answers)
    for u in updates:
        step, fields, clear, confirm = transition(step, u["kind"], u["text"], u["data"])
        if clear:
            answers, cleared = {}, True
        answers.update(fields)
        if confirm and all(answers.get(a) for a in ANSWERS[:3]):
            confirmed.append((u["ts"], *[answers.get(a) for a in ANSWERS]))
    return step, answers, cleared, confirmed


def _rows(confirmed: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(confirmed, columns=["user_id", "ts", *ANSWERS])


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each chunk does, from every step it may start in."""
    for batch in batches:
        out = []
        for updates in batch["updates"]:
            effects = {start: replay(updates, start, {})[:3] for start in WIZARD_STEPS}
            out.append(json.dumps(effects))
        yield batch[["user_id", "chunk"]].assign(effects=out)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step and answers at the start of each chunk of a user."""
    for batch in batches:
        out = []
        for user, chunks in zip(batch["user_id"], batch["chunks"]):
            step, answers = _FIRST, {}
            for c in chunks:
                out.append((user, c["chunk"], step, json.dumps(answers)))
                step, fields, cleared = json.loads(c["effects"])[step]
                answers = {**({} if cleared else answers), **fields}
        yield pd.DataFrame(out, columns=["user_id", "chunk", "step", "answers"])


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for user, updates, step, answers in zip(*(batch[c] for c in ("user_id", "updates", "step", "answers"))):
            rows = replay(updates, step or _FIRST, json.loads(answers) if answers else {})[3]
            out.extend((user, *row) for row in rows)
        yield _rows(out)


def confirmed_preferences(updates: DataFrame, chunk: str = CHUNK) -> DataFrame:
    """Raw preference rows (skills as a comma list) confirmed in a finite table of updates.

    A chunk of a user becomes one row with its updates in order, so that Python sees whole Arrow
    batches of chunks. Users with a single chunk are replayed directly.
    """
    order = F.struct("ts", "message_id", "kind", "text", "data")
    chunks = (
        updates.withColumn("chunk", F.window("ts", chunk)["start"])
        .groupBy("user_id", "chunk")
        .agg(F.array_sort(F.collect_list(order)).alias("updates"))
    )
    several = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id")
    effects = chunks.join(several, "user_id", "left_semi").mapInPandas(
        _effects, "user_id long, chunk timestamp, effects string"
    )
    starts = (
        effects.groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "effects"))).alias("chunks"))
        .mapInPandas(_starts, "user_id long, chunk timestamp, step string, answers string")
    )
    return (
        chunks.join(starts, ["user_id", "chunk"], "left")
        .select("user_id", "updates", "step", "answers")
        .mapInPandas(_confirmed, CONFIRMED)
    )


def _stream_user(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    step, answers = state.get if state.exists else (_FIRST, "{}")
    rows = pd.concat(list(batches)).sort_values(["ts", "message_id"], kind="stable")
    step, answers, _, confirmed = replay(rows.to_dict("records"), step, json.loads(answers))
    state.update((step, json.dumps(answers)))
    if confirmed:
        yield _rows([(key[0], *row) for row in confirmed])


def confirmed_preference_stream(updates: DataFrame) -> DataFrame:
    """Stream form: the state of a user is the step and the answers so far."""
    rows = updates.select("user_id", "message_id", "kind", "text", "data", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(
        _stream_user,
        outputStructType=CONFIRMED,
        stateStructType="step string, answers string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def wizard_outputs(confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(preference rows to save, subscription log rows) for confirmed answers."""
    raw = confirmed.withColumns({
        "timezone": F.lit(None).cast("string"),
        "notification_times": F.lit(None).cast("array<string>"),
    })
    saved = create_preferences(raw.select(*[c for c in raw.columns if c != "ts"])).where(F.col("error").isNull())
    return saved.drop("error"), confirmed.select("user_id", F.lit("add").alias("action"), "ts")
