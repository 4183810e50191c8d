"""State as snapshot and later versions equals the fold of all versions, wherever the cuts lie."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmatch.operators import state
from postmatch.operators.folded import FoldedState

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
KIND = "k long, part string, value string, version long, written_at timestamp, expires_at timestamp, deleted boolean"


def at(hours):
    return T0 + timedelta(hours=hours)


def rows(spark, made):
    return spark.createDataFrame(
        [(k, "p", f"v{i}", i, at(h), None if ttl is None else at(h + ttl), gone) for i, (k, h, ttl, gone) in enumerate(made)], KIND)


def seen(df):
    return sorted((r["k"], r["value"], r["version"]) for r in df.collect())


VERSION = st.tuples(st.integers(0, 4), st.integers(0, 60), st.sampled_from([None, 5, 10, 24]), st.sampled_from([False, False, True, None]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VERSION, max_size=25), st.lists(st.integers(0, 60), max_size=3))
def test_any_cuts_give_the_full_fold(spark, tmp_path_factory, made, cuts):
    log, cuts = rows(spark, made).cache(), sorted(cuts)
    held = FoldedState(spark, str(tmp_path_factory.mktemp("state")), ["k", "part"], log.schema, buckets=3)
    before = -1
    for cut in [*cuts, 1000]:
        held.append(log.where((log.written_at > at(before)) & (log.written_at <= at(cut))), f"n{before}-{cut}")
        if cut < 1000:
            assert held.fold(at(cut))
        for now in (cut, cut + 5, cut + 10) if cut < 1000 else (60, 70, 90):  # also when versions expire to the minute
            known = log.where(log.written_at <= at(cut))
            assert seen(held.read(state.timestamp(at(now)))) == seen(state.live(known, ["k", "part"], at(now)))
        before = cut
    log.unpersist()


def test_snapshot_is_not_shuffled_and_folds_go_forward(spark, tmp_path):
    log = rows(spark, [(i, i % 7, None, False) for i in range(300)])
    held = FoldedState(spark, str(tmp_path), ["k", "part"], log.schema)
    held.append(log, "a")
    held.append(log, "a")  # again under the same name
    held.fold(at(10))
    held.append(rows(spark, [(5, 20, None, True), (6, 21, None, False)]), "b")
    again = FoldedState(spark, str(tmp_path), ["k", "part"], log.schema)
    assert len(seen(again.read(state.timestamp(at(30))))) == 299
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = again.read(state.timestamp(at(30)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    snapshot = text[text.index("LeftAnti"):].split("folded_")[0]
    assert "Exchange" not in snapshot and "Bucketed: true" in text
    with pytest.raises(ValueError):
        held.fold(at(9))
