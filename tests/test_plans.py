"""What the physical plans must and must not contain."""

from __future__ import annotations

import contextlib
import io

import pytest

from postmatch.plans.registered import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["keyword_search_top20", "rule_scores", "request_table", "source_adzuna", "subscription_status"])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text


def test_keyword_search_shuffles_hits_only(spark):
    """Texts pass the automaton where they are read; what is exchanged are users' keywords and (item, keyword) rows."""
    text = plan(spark, "keyword_search_pages")
    assert text.count("MapInArrow") >= 1 and "body" not in "".join(line for line in text.splitlines() if "hashpartitioning" in line)


@pytest.mark.parametrize("name", ["rule_scores", "analysis_scores", "unsent_matches"])
def test_pairs_of_users_and_postings_are_not_shuffled(spark, name):
    moved = [line for line in plan(spark, name).splitlines() if "hashpartitioning" in line]
    assert any("keyword" in line and "_block" in line for line in moved)
    assert not any("user_id" in line and "arrival_idx" in line for line in moved)


def test_requests_are_counted_without_sorting(spark):
    assert "SortAggregate" not in plan(spark, "request_table")


def test_slots_are_worked_out_per_schedule(spark):
    """Clocks are turned above the aggregate over schedules, the filter on the slot included."""
    text = plan(spark, "slot_claims")
    assert -1 < text.find("Functions [1]: [count(1)]") < text.find("from_utc_timestamp")


def test_survivors_aggregate_before_the_shuffle(spark):
    text = plan(spark, "dedup_survivors")
    assert "partial_max_by" in text and "Window" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(spark, "normalized_titles")
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_page_parser_is_the_only_python(spark):
    assert plan(spark, "navigation_listings").count("MapInPandas") >= 1
