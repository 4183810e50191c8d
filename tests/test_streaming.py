from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import NOW, postings, preferences
from postmatch.functions.fingerprint import with_fingerprints
from postmatch.operators.state import active_subscribers
from postmatch.plans import pipeline
from postmatch.schema import ANALYSIS, SENT_LOG, SENT_LOG_BY_DATE, SUBSCRIPTION_LOG, UPDATE
from postmatch.streaming import bot, continuous, subscriptions, updates, wizard

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def table(spark, rows):
    base = {"chat_id": 1, "user_id": 1, "message_id": 0, "kind": "msg", "text": None, "data": None, "ts": T0}
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in UPDATE.fields) for r in rows], UPDATE)


def kept(rows, window):
    """Row by row: (key, second) pairs that are not repeats."""
    last, out = {}, []
    for key, second in sorted(rows, key=lambda r: r[1]):
        if key not in last or second - last[key] >= window:
            last[key] = second
            out.append((key, second))
    return sorted(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 120)), min_size=1, max_size=60), st.sampled_from([10, 13, 40]))
def test_update_dedup_equals_sequential_rule(spark, rows, chunk):
    df = table(spark, [{"kind": "cb", "data": k, "message_id": 7, "ts": T0 + timedelta(seconds=s)} for k, s in rows])
    got = updates.dedup_updates(df, window_seconds=10, chunk_seconds=chunk).collect()
    assert sorted((r["data"], int((r["ts"] - T0.replace(tzinfo=None)).total_seconds())) for r in got) == kept(set(rows), 10)


def test_other_kinds_pass(spark):
    df = table(spark, [{"kind": "poll"}, {"kind": "poll"}, {"message_id": 1}, {"message_id": 1, "ts": T0 + timedelta(seconds=9)}])
    assert updates.dedup_updates(df).count() == 3


def drain(df, tmp_path, name):
    q = (df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name))
         .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_update_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = [("a", 0), ("a", 9), ("b", 9), ("a", 10), ("a", 19), ("b", 18), ("a", 25), ("b", 40)]
    made = [{"kind": "cb", "data": k, "ts": T0 + timedelta(seconds=s)} for k, s in rows] + [{"kind": "poll"}] * 2
    for i in range(0, len(made), 4):
        table(spark, made[i:i + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(updates.dedup_update_stream(stream), tmp_path, "kept")
    got = sorted((r["data"], int((r["ts"] - T0.replace(tzinfo=None)).total_seconds())) for r in out.where("kind = 'cb'").collect())
    assert got == kept(rows, 10)
    assert out.where("kind = 'poll'").count() == 2
    built = drain(updates.dedup_update_stream_builtin(spark.readStream.schema(UPDATE).parquet(str(tmp_path / "in"))), tmp_path, "built")
    assert built.where("kind = 'cb'").count() == 2 and built.where("kind = 'poll'").count() == 2


SCRIPT = [("msg", "x", None), ("msg", "  Backend   Dev ", None), ("cb", None, "experience:mid"), ("cb", None, "work-type:odd"), ("cb", None, "work-type:remote"),
          ("cb", None, "experience:mid"), ("msg", " any ", None), ("msg", " , ", None), ("msg", "sql, ,spark", None), ("cb", None, "preferences:confirm")]


def script(steps, user=1, gap=timedelta(seconds=1)):
    return [{"user_id": user, "message_id": i, "kind": k, "text": t, "data": d, "ts": T0 + gap * i} for i, (k, t, d) in enumerate(steps)]


def test_wizard_script(spark):
    (row,) = wizard.confirmed_preferences(table(spark, script(SCRIPT))).collect()
    assert tuple(row)[2:] == ("Backend Dev", "remote", "mid", None, "sql,spark")
    saved, subs = wizard.wizard_outputs(wizard.confirmed_preferences(table(spark, script(SCRIPT))))
    assert saved.first()["skills"] == ["sql", "spark"] and saved.first()["timezone"] == "Asia/Gaza"
    assert [(r["user_id"], r["action"]) for r in subs.collect()] == [(1, "add")]


def test_update_keeps_answers_and_restart_clears():
    def run(steps):
        return wizard.replay([{"kind": k, "text": t, "data": d, "ts": i} for i, (k, t, d) in enumerate(steps)], "job-title", {})

    step, answers, _, confirmed = run([*SCRIPT, ("cb", None, "preferences:update"), ("msg", "New", None)])
    assert step == "work-type" and answers["job_title"] == "New" and answers["skills"] == "sql,spark" and len(confirmed) == 1
    assert run([*SCRIPT, ("cb", None, "preferences:restart")])[:3] == ("job-title", {}, True)
    assert run([*SCRIPT, ("msg", "/start now", None)])[0] == "job-title"
    assert len(run([*SCRIPT, ("cb", None, "preferences:confirm")])[3]) == 2


STEPS = st.sampled_from([*SCRIPT, ("cb", None, "preferences:restart"), ("cb", None, "preferences:update"), ("msg", "/start", None), ("msg", None, None)])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.just(None), STEPS), min_size=1, max_size=12), st.sampled_from(["2 seconds", "5 seconds", "1 day"]))
def test_wizard_chunks_equal_one_replay(spark, picks, chunk):
    steps = [s for p in picks for s in (SCRIPT if p is None else [p])]
    rows = [{"kind": k, "text": t, "data": d, "ts": i} for i, (k, t, d) in enumerate(steps)]
    want = [(i, *rest) for i, *rest in wizard.replay(rows, "job-title", {})[3]]
    got = wizard.confirmed_preferences(table(spark, script(steps)), chunk).collect()
    assert sorted((int((r["ts"] - T0.replace(tzinfo=None)).total_seconds()), *tuple(r)[2:]) for r in got) == want


def test_wizard_stream_over_several_batches(spark, tmp_path):
    rows = script(SCRIPT) + script(SCRIPT[:5], user=2)
    for i in range(0, len(rows), 6):
        table(spark, rows[i:i + 6]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (row,) = drain(wizard.confirmed_preference_stream(stream), tmp_path, "out").collect()
    assert tuple(row)[2:] == ("Backend Dev", "remote", "mid", None, "sql,spark")


def test_subscription_commands(spark):
    texts = ["/subscribe", "/unsubscribe@bot x", "/subscription", "Subscription Status", "/subscriber"]
    df = table(spark, [{"user_id": i, "text": t} for i, t in enumerate(texts)])
    assert [(r["user_id"], r["action"]) for r in subscriptions.subscription_actions(df).collect()] == [(0, "add"), (1, "remove")]
    log = spark.createDataFrame([(3, "add", T0)], SUBSCRIPTION_LOG)
    assert sorted((r["user_id"], r["subscribed"]) for r in subscriptions.subscription_status(df, log).collect()) == [(2, False), (3, True)]
    assert active_subscribers(log).count() == 1


def test_continuous_match_sends_each_posting_once(spark, tmp_path):
    good = {"skills": ["Node.js"], "work_type": "remote", "experience_level": "junior"}
    copies = postings(spark, good, {**good, "application_url": "https://example.com/jobs/2", "title": "Backend Developer II"})
    for _ in range(2):
        copies.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(copies.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    data = pipeline.RunInputs(
        subscription_log=spark.createDataFrame([(1, "add", T0)], SUBSCRIPTION_LOG), preferences=preferences(spark),
        collector=lambda p: copies, analyses=spark.createDataFrame([], ANALYSIS), sent_log=spark.createDataFrame([], SENT_LOG))
    store = pipeline.RunStore(spark, str(tmp_path / "store"))
    query = continuous.start_continuous_match(stream, data, store, str(tmp_path / "cp"), lambda: NOW, available_now=True)
    assert query.awaitTermination(180)
    box = store.read("outbox", "user_id long, kind string, fingerprint string, run_id string")
    assert box.where("kind = 'match'").count() == 2
    assert store.read("run_stats", "subscribers long").count() == 2


def test_a_batch_concerns_its_own_users(spark, tmp_path):
    good = {"skills": ["Node.js"], "work_type": "remote", "experience_level": "junior"}
    for user in (1, 2):
        postings(spark, {**good, "user_id": user}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(postings(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    data = pipeline.RunInputs(
        subscription_log=spark.createDataFrame([(1, "add", T0), (2, "add", T0)], SUBSCRIPTION_LOG),
        preferences=preferences(spark, {"user_id": 1}, {"user_id": 2}), collector=None,
        analyses=spark.createDataFrame([], ANALYSIS), sent_log=spark.createDataFrame([], SENT_LOG))
    store = pipeline.RunStore(spark, str(tmp_path / "store"))
    query = continuous.start_continuous_match(stream, data, store, str(tmp_path / "cp"), lambda: NOW, available_now=True)
    assert query.awaitTermination(180)
    box = store.read("outbox", "user_id long, kind string, run_id string").collect()
    assert sorted((r["user_id"], r["kind"]) for r in box) == [(1, "match"), (2, "match")]
    log = store.read("sent_log", SENT_LOG_BY_DATE)
    plan = log.where("sent_date >= DATE'2026-09-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sent_date" in plan and log.count() == 2


# --- the bot's chain ---

def run_bot(spark, tmp_path, waves, subscriptions=None, **options):
    for rows in waves:
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(UPDATE).parquet(str(tmp_path / "in"))
        query = bot.start_bot(stream, str(tmp_path / "bot"), subscriptions, available_now=True, **options)
        assert query.awaitTermination(180)
    return {k: [r.asDict() for r in spark.read.parquet(str(tmp_path / "bot" / k)).orderBy("ts", "chat_id").collect()] for k in bot.LOGS}


def at(rows, seconds):
    return [{**r, "ts": r["ts"] + timedelta(seconds=seconds)} for r in rows]


def test_bot_chain_drops_repeats_keeps_sessions_and_answers(spark, tmp_path):
    chat = [{**r, "chat_id": 5} for r in script(SCRIPT)]
    ask = {"chat_id": 5, "message_id": 90, "text": "/subscription", "ts": T0 + timedelta(seconds=20)}
    other = {"chat_id": 6, "message_id": 1, "text": "/unsubscribe", "ts": T0 + timedelta(seconds=3)}
    first = chat[:6] + at(chat[:6], 2)[::-1] + [other, {**other, "ts": T0 + timedelta(seconds=12)}]  # a repeat within ten seconds of the kept one
    second = chat[6:] + [ask, {**ask, "user_id": 2, "message_id": 91}, {**ask, "user_id": None, "message_id": 92}, {**ask, "chat_id": None}]
    later = [{**other, "ts": T0 + timedelta(seconds=200)}, {**ask, "chat_id": 6, "user_id": 7, "message_id": 5, "ts": T0 + timedelta(seconds=201)}]
    before = spark.createDataFrame([(5, 2, True), (6, 7, True), (6, None, True)], "chat_id long, user_id long, active boolean")
    said = run_bot(spark, tmp_path, [first, second, later], before)
    (saved,) = said["preferences"]
    assert (saved["chat_id"], saved["job_title"], saved["location"], saved["skills"]) == (5, "Backend Dev", None, "sql,spark")
    assert [(r["chat_id"], r["action"]) for r in said["subscription"]] == [(6, "remove"), (5, "add"), (6, "remove")]
    assert sorted((r["chat_id"], r["user_id"], r["subscribed"]) for r in said["status"]) == [(5, 1, True), (5, 2, True), (6, 7, True)]


def test_bot_chain_equals_its_parts_on_private_chats(spark, tmp_path):
    """Where a chat has one user, the chain is update dedup, then the wizard and the commands."""
    rows = [r for u in range(4) for r in [{**r, "chat_id": u} for r in script(SCRIPT, user=u)]]
    rows += at(rows[::2], 3) + at(rows[::5], 11) + [{"chat_id": 2, "user_id": 2, "message_id": 77, "text": "/subscribe", "ts": T0 + timedelta(seconds=40)}]
    said = run_bot(spark, tmp_path, [rows])
    kept_rows = updates.dedup_updates(table(spark, rows))
    confirmed = wizard.confirmed_preferences(kept_rows).collect()
    assert sorted((r["user_id"], r["ts"], r["job_title"], r["skills"]) for r in said["preferences"]) == sorted(
        (r["user_id"], r["ts"], r["job_title"], r["skills"]) for r in confirmed) != []
    want = [(r["user_id"], r["action"]) for r in subscriptions.subscription_actions(kept_rows).collect()] + [(r["user_id"], "add") for r in confirmed]
    assert sorted((r["user_id"], r["action"]) for r in said["subscription"]) == sorted(want)



# --- matching with the sent log as state ---

def test_match_stream_remembers_what_was_sent(spark, tmp_path):
    good = {"skills": ["Node.js"], "work_type": "remote", "experience_level": "junior"}
    second = {**good, "application_url": "https://example.com/jobs/2", "title": "Backend Developer II"}
    third = {**good, "application_url": "https://example.com/jobs/3", "title": "Backend Developer III"}
    rows = [postings(spark, good, {**good, "description": "a longer text than the other copy has"}, second, {"title": "Chef"}), postings(spark, good, second, third)]
    keys = {r["title"]: r["fingerprint"] for r in with_fingerprints(rows[1]).collect()}
    log = [(1, keys[second["title"]], NOW - timedelta(days=29), second["title"], "Stripe"), (1, keys[third["title"]], NOW - timedelta(days=30), third["title"], "Stripe"),
           (2, keys[good.get("title", "Backend Developer")], NOW - timedelta(days=1), "Backend Developer", "Stripe")]
    data = pipeline.RunInputs(
        subscription_log=spark.createDataFrame([(1, "add", T0)], SUBSCRIPTION_LOG), preferences=preferences(spark),
        collector=None, analyses=spark.createDataFrame([], ANALYSIS), sent_log=spark.createDataFrame(log, SENT_LOG))
    store, box = pipeline.RunStore(spark, str(tmp_path / "store")), "user_id long, fingerprint string, run_id string"
    told = []
    for wave in rows:
        wave.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows[0].schema).parquet(str(tmp_path / "in"))
        query = continuous.start_match_stream(stream, data, store, str(tmp_path / "cp"), F.lit(NOW).cast("timestamp"), available_now=True)
        assert query.awaitTermination(180)
        told.append({r["fingerprint"] for r in store.read("outbox", box).collect()})
    # The first wave sends the new posting once; the second only what the log holds no longer.
    assert told == [{keys["Backend Developer"]}, {keys["Backend Developer"], keys[third["title"]]}]
    assert store.read("outbox", box).count() == 2 == store.read("sent_log", SENT_LOG_BY_DATE).count()


def test_sent_memory_makes_the_semantic_key(spark):
    rows = with_fingerprints(postings(spark, {}, {"title": "Other"}))
    log = rows.select("user_id", "fingerprint", F.lit(NOW).cast("timestamp").alias("sent_at"), F.col("title").alias("job_title"), "company")
    made = continuous.sent_memory(log.unionByName(log), F.lit(NOW).cast("timestamp")).collect()
    assert sorted((r["semantic_key"], r["fingerprint"]) for r in made) == sorted((r["semantic_key"], r["fingerprint"]) for r in rows.collect())
