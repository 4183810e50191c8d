"""What belongs to an item is worked out before the item goes to its users, and users with the same keywords are one search."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from postmatch.functions.text import clean_html
from postmatch.operators import collect
from postmatch.sources import collect as sources
from postmatch.sources.common import query_columns, with_own_fields
from postmatch.sources.registry import SOURCES

PEOPLE = "user_id long, job_title string, work_type string, experience_level string, location string, skills array<string>"


def now():
    return F.lit("2026-01-01").cast("timestamp")


@pytest.mark.parametrize("name", list(SOURCES))
def test_fields_without_query_columns_are_own(spark, name):
    spec = SOURCES[name]
    payloads = spark.createDataFrame([], "request_id string, source string, payload_no long, payload string")
    items = spec.items(payloads)
    own = with_own_fields(items, spec, now())  # fails where a field reads a query column without being named
    assert set(own.columns) - set(items.columns) == {f"own_{f}" for f in spec.fields(now()) if f not in spec.query_fields}


def test_items_are_cleaned_below_the_join(spark):
    payload = '{"jobs":[{"title":"a","description":"<p>b</p>","url":"c"}]}'
    items = SOURCES["remotive"].items(spark.createDataFrame([("r", "remotive", 0, payload)], "request_id string, source string, payload_no long, payload string"))
    people = spark.createDataFrame([(1, "a", None, None, None, None)], PEOPLE)
    asked = people.select("user_id", F.lit("r").alias("request_id"))
    made = sources.requested_postings(items, asked, people, SOURCES["remotive"], now())
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in str(clean_html("body")) and "regexp_replace" in text
    assert text.index("regexp_replace") > text.index("Join")


@pytest.mark.parametrize("block", [64, 2])
def test_found_by_users_equals_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(collect, "USERS_PER_BLOCK", block)
    rows = [(i, t, None, None, None, s) for i, t, s in [
        (1, "red", ["ring"]), (2, "red", ["ring"]), (3, "ring", ["red", None]), (4, None, None), (5, "", []), (6, "none", None),
        (7, "red", None), (7, "rod", None), (8, "rod", ["red"]), (None, "red", None), *[(20 + k, "red", None) for k in range(9)]]]
    people = spark.createDataFrame(rows, PEOPLE)
    feed = spark.createDataFrame([(0, "red ring"), (1, "rod"), (1, "rod red"), (2, None), (3, "a ring"), (4, "x")], "ordinal long, body string")
    pairs = collect.keyword_search(feed, "body", people, True)
    old = pairs.join(query_columns(people), "user_id").join(feed, "ordinal")
    new = collect.found_by_users(feed, "body", feed, people, query_columns(people), True)
    columns = ["user_id", "ordinal", "body", "q_title"]
    count = lambda df: sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert count(new) == count(old) and len(count(old)) > 30


@pytest.mark.parametrize("block", [256, 2])
@pytest.mark.parametrize("name", ["bayt", "tanqeeb", "adzuna", "firecrawl"])
def test_items_are_finished_before_they_go_to_users(spark, monkeypatch, name, block):
    """Same rows as with a join per user; whatever reads text is worked out below the step to the users."""
    monkeypatch.setattr(sources, "ASKERS_PER_BLOCK", block)
    spec = SOURCES[name]
    pages = {
        "bayt": '<ul><li data-js-job="1"><h2><a href="/en/1">a</a></h2></li><li data-js-job="2"><h2><a href="/2">b</a></h2><span class="t-mute">Remote</span></li></ul>',
        "tanqeeb": '<article><h2><a href="x">a</a></h2></article><article><h2><a href="y">b</a></h2><p>remote</p></article>',
        "adzuna": '{"results":[{"title":"","description":"<p>b</p>"},{"title":"<b>c</b>","location":{"display_name":"work from home"}}]}',
        "firecrawl": '{"success":true,"data":{"extract":{"jobs":[{"title":" ","company":"c"},{"title":"d","company":"c","location":" remote "}]}}}',
    }
    landed = [(r, name, n, pages[name]) for n, r in enumerate(["r", "s", None])]
    payloads = spark.createDataFrame(landed, "request_id string, source string, payload_no long, payload string")
    rows = [(1, "a", "remote", "mid", None, ["x"]), (2, "a", "remote", None, None, None), (3, "a", "", "mid", "Gaza", ["y"]), (4, None, None, "any", "", []),
            (4, "a", "remote", "mid", None, ["z"]), (5, "a", "remote", "mid", "Remote", ["x"]), (None, "a", None, None, None, None)]
    people = spark.createDataFrame(rows, PEOPLE)
    asked = spark.createDataFrame([(u, r) for u in (1, 2, 3, 4, 5, 5, None) for r in ("r", "s", "t", None)], "user_id long, request_id string")
    items = spec.items(payloads)
    new = sources.requested_postings(items, asked, people, spec, now())
    old = sources.requested_postings(items, asked, people, replace(spec, user_fields=None), now())
    count = lambda df: sorted(str(r) for r in df.collect())
    assert count(new) == count(old) and len(count(old)) == 28 and new.schema == old.schema
    text = new._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in text.lower() and text.lower().index("rlike") > text.index("Generate inline")
