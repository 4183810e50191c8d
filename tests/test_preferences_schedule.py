from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from helpers import preferences, values
from postmatch.functions import preferences as P
from postmatch.operators import schedule, state
from postmatch.operators.preferences import create_preferences, live_preferences, preference_versions
from postmatch.schema import SLOT_LEDGER


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def test_preference_forms(spark):
    assert values(spark, ["   Senior   Backend    Engineer   "], P.normalize_job_title("c")) == ["Senior Backend Engineer"]
    assert values(spark, ["", "a", "ab", "x" * 100, "x" * 101, " a ", "💻", None], P.valid_job_title("c")) == [
        False, False, True, True, False, False, True, False]
    assert values(spark, ["remote", "Remote", "remote_work", ""], P.valid_work_type("c")) == [True, False, False, False]
    assert values(spark, ["any", "expert", ""], P.valid_experience_level("c")) == [True, False, False]
    assert values(spark, ["", "  ", "any", "ANY", "  Any  ", "  Gaza  , Palestine "], P.normalize_location("c")) == [
        None, None, None, None, None, "Gaza , Palestine"]
    assert values(spark, ["Node.js, TypeScript, , Redis,   Docker  , "], P.normalize_skills("c")) == [
        ["Node.js", "TypeScript", "Redis", "Docker"]]


RAW = "user_id long, job_title string, work_type string, experience_level string, location string, skills string, timezone string, notification_times array<string>"


def test_create_save_patch(spark):
    raw = spark.createDataFrame([
        (1, "  Backend   Dev ", "remote", "junior", " any ", "a, ,b", None, None), (2, "A", "remote", "junior", None, None, None, None),
        (3, "Dev", "invalid", "junior", None, None, None, None), (4, "Dev", "remote", "invalid", None, "", "X/Y", ["1:00"]),
    ], RAW)
    rows = create_preferences(raw).orderBy("user_id").collect()
    assert rows[0][1:] == ("Backend Dev", "remote", "junior", None, ["a", "b"], "Asia/Gaza", ["09:00", "21:00"], None)
    assert [r["error"] for r in rows[1:]] == ["Invalid job title", "Invalid work type", "Invalid experience level"]
    saved = create_preferences(raw).where("error is null").drop("error")
    log = preference_versions(saved, F.lit(utc("2026-01-01")))
    assert live_preferences(log, F.lit(utc("2026-03-31"))).count() == 1
    assert live_preferences(log, F.lit(utc("2026-04-01"))).count() == 0
    patches = spark.createDataFrame([(1, "mid"), (9, "lead")], "user_id long, experience_level string")
    merged, rejected = state.patch(saved, patches, "user_id", ["experience_level"])
    assert [(r["job_title"], r["experience_level"]) for r in merged.collect()] == [("Backend Dev", "mid")]
    assert [(r["user_id"], r["error"]) for r in rejected.collect()] == [(9, "User preferences not found")]


@pytest.mark.parametrize("now, zone, times, expected", [
    ("2026-09-05T15:00", "Asia/Gaza", ["09:00", "21:00"], "2026-09-05T18:00"),
    ("2026-09-05T20:00", "Asia/Gaza", ["09:00", "21:00"], "2026-09-06T06:00"),
    ("2026-09-05T06:00", "Asia/Riyadh", ["09:00", "21:00"], "2026-09-05T18:00"),
    ("2026-09-05T15:00", "No/Zone", [], "2026-09-05T18:00"),
    ("2026-09-05T15:00", "", ["bad"], "2026-09-06T06:00"),
    ("2026-09-05T15:00", "UTC", ["20:xx"], "2026-09-05T20:00"),
    ("2026-09-05T15:00", "UTC", [""], "2026-09-06T00:00"),
])
def test_next_notification(spark, now, zone, times, expected):
    df = preferences(spark, {"timezone": zone, "notification_times": times})
    row = schedule.next_times(df, F.lit(utc(now))).first()
    assert row["next_time"] == datetime.fromisoformat(expected)


def test_due_and_earliest(spark):
    df = preferences(spark, {}, {"user_id": 2, "timezone": "UTC", "notification_times": ["15:30"]})
    assert [r["user_id"] for r in schedule.due_users(df, F.lit(utc("2026-09-05T06:00"))).collect()] == [1]
    assert schedule.due_users(df, F.lit(utc("2026-09-05T07:00"))).count() == 0
    assert schedule.earliest_run(df, F.lit(utc("2026-09-05T15:00"))).first()[0] == datetime(2026, 9, 5, 15, 30)
    assert schedule.earliest_run(df.limit(0), F.lit(utc("2026-09-05T15:00"))).first()[0] == datetime(2026, 9, 5, 18, 0)


@pytest.mark.parametrize("now, times, expected", [
    ("2026-01-15T07:30", ["09:00", "21:00"], ("2026-01-15-0900", 30)),
    ("2026-01-15T11:00", ["09:00", "21:00"], ("2026-01-15-0900", 240)),
    ("2026-01-15T19:05", ["09:00", "21:00"], ("2026-01-15-2100", 5)),
    ("2026-01-15T22:30", ["09:00", "21:00"], ("2026-01-15-2100", 210)),
    ("2026-01-15T05:00", ["09:00", "21:00"], ("2026-01-14-2100", 600)),
    ("2026-01-15T05:00", ["bad", "", "24:00", "12:60"], None),
])
def test_latest_slot(spark, now, times, expected):
    row = schedule.latest_slots(preferences(spark, {"notification_times": times}), F.lit(utc(now))).first()
    assert (tuple(row["slot"]) if row["slot"] else None) == expected


def test_claims(spark):
    at = utc("2026-01-15T11:00")
    slots = schedule.global_slot(spark, F.lit(at))
    assert tuple(slots.first()) == ("2026-01-15-0900", 240)

    def ledger(*claimed):
        return spark.createDataFrame([("2026-01-15-0900", "scheduled", utc(c)) for c in claimed], SLOT_LEDGER)

    assert schedule.claimable(slots, ledger(), F.lit(at)).count() == 1
    assert schedule.claimable(slots, ledger("2026-01-15T08:00"), F.lit(at)).count() == 0
    assert schedule.claimable(slots, ledger("2026-01-13T22:59"), F.lit(at)).count() == 1
    assert schedule.claimable(slots, ledger("2026-01-15T08:00"), F.lit(at), forced=True).first()["mode"] == "forced"
    late = utc("2026-01-15T12:01")
    assert schedule.claimable(schedule.global_slot(spark, F.lit(late)), ledger(), F.lit(late)).count() == 0


def test_versioned_state(spark):
    t0, t1, t2 = (F.lit(utc(f"2026-01-0{d}")) for d in (1, 2, 4))
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    log = state.upserts(rows, t0, 10 * 86400)
    log = log.unionByName(state.upserts(rows.where("k = 'a'").withColumn("v", F.lit(2)), t1, 86400))
    log = log.unionByName(state.tombstones(rows.where("k = 'b'").select("k"), [("v", "int")], t1))
    # a's newer version has expired, and the older one must not come back; b is deleted
    assert [tuple(r)[:2] for r in state.live(log, ["k"], t2).collect()] == [("c", 1)]
    assert sorted(tuple(r)[:2] for r in state.live(log, ["k"], t0).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    new = spark.createDataFrame([("c", 9), ("d", 2), ("d", 1)], "k string, v int")
    added = state.insert_if_absent(log, new, ["k"], F.col("v"), t2, 60)
    assert [tuple(r)[:2] for r in added.collect()] == [("d", 1)]


def test_subscribers_and_keys(spark):
    log = spark.createDataFrame([(1, "add", utc("2026-01-01")), (2, "add", utc("2026-01-01")), (2, "remove", utc("2026-01-02")),
                                 (3, "remove", utc("2026-01-01"))], "user_id long, action string, ts timestamp")
    assert [r[0] for r in state.active_subscribers(log).collect()] == [1]
    df = spark.createDataFrame([(123, "fp")], "u long, f string")
    assert df.select(state.state_key("sent", "u", "f")).first()[0] == "user:123:sent:fp"
    assert df.select(state.state_key("analysis", "f")).first()[0] == "job:analysis:fp"
