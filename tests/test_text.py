from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import postings, values
from postmatch.functions import text, urls
from postmatch.functions.dates import parse_date
from postmatch.functions.fingerprint import plain_identity, with_fingerprints
from postmatch.operators.collect import recent_postings, valid_postings
from postmatch.sources.frontier import url_component
from postmatch.sources.normalize import normalize_postings
from helpers import NOW


@pytest.mark.parametrize("raw, canonical, valid", [
    ("https://WWW.Example.com/jobs/dev/?utm_campaign=winter&ref=123", "https://example.com/jobs/dev", True),
    ("https://google.com/jobs/123?utm_source=jobboard", "https://google.com/jobs/123", True),
    ("https://www.google.com/jobs/123/", "https://google.com/jobs/123", True),
    ("invalid-url", "invalid-url", False),
    ("  Not A Url// ", "not a url", False),
    ("", "", False),
    (None, "", False),
    ("http:/a.com:8080/x/../y/./z//?a&b=c d&&e=%zz&f=~*", "https://a.com/y/z?a=&b=c+d&e=%25zz&f=%7e*", True),
    ("ftp://u:p@Host/p#f", "https://host/p", False),
    ("http://", "http:", False),
    ("http://a b.com/", "http://a b.com", False),
    ("https:\\\\a.com\\b", "https://a.com/b", True),
    ("http://a.com/é à?q=é", "https://a.com/%c3%a9%20%c3%a0?q=%c3%a9", True),
    ("http://a.com:99999/", "http://a.com:99999", False),
    ("http://a.com?source=1&Source=2", "https://a.com/?source=2", True),
    ("//x.com/", "//x.com", False),
])
def test_canonical_url(spark, raw, canonical, valid):
    df = spark.createDataFrame([(raw,)], "u string")
    row = urls.with_canonical_url(df, "u").select("canonical_url", urls.is_web_url("u").alias("ok")).first()
    assert (row["canonical_url"], row["ok"]) == (canonical, valid)


def test_titles_and_companies(spark):
    titles = ["Senior Backend Developer (Remote)", "C++", "Backend Engineer (Remote) [Urgent]", "Foo_bar–baz|q #1", "[rem(urgent)ote] x", None]
    assert values(spark, titles, text.normalize_title("c")) == [
        "senior backend developer", "c", "backend engineer", "foo bar baz q 1", "x", ""]
    companies = ["Amazon Web Services Inc.", "Acme LLC", "éco", "a co.uk Ltd", "Limitedx corporation gmbh", ""]
    assert values(spark, companies, text.normalize_company("c")) == [
        "amazon web services", "acme", "é", "a uk", "limitedx", ""]


def test_whitespace_covers_unicode_blanks(spark):
    assert values(spark, ["  a ﻿b 　"], text.squeeze("c")) == ["a b"]
    assert values(spark, [" x﻿"], text.clean_trim("c")) == ["x"]


def test_strip_tags_keeps_entities_and_drops_unclosed(spark):
    raw = ["<p>Looking for <strong>AWS</strong> &amp; <em>Docker</em> expert.</p>", "a < b and more"]
    assert values(spark, raw, text.clean_html("c")) == ["Looking for AWS &amp; Docker expert.", "a"]


def test_match_form(spark):
    assert values(spark, [" Node.JS ", ".net", "Full-Stack_Dev"], text.match_form("c")) == ["node js", " net", "full stack dev"]
    pairs = spark.createDataFrame([("JavaScript", "java"), ("go", "rust"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(text.text_matches("a", "b")).collect()] == [True, False, True]


def test_utf16_length(spark):
    assert values(spark, ["a", "💻", "é"], text.utf16_length("c")) == [1, 2, 1]


def test_dates(spark):
    raw = ["2024-01-05", "2024-01-05T10:00:00+02:00", "Fri, 05 Jan 2024 10:00:00 +0000", "Fri, 05 Jan 2024 10:00:00 GMT", "Jan 5, 2024", "junk", ""]
    got = values(spark, raw, F.date_format(parse_date("c"), "dd HH"))
    assert got == ["05 00", "05 08", "05 10", "05 10", "05 00", None, None]


def test_url_component(spark):
    assert values(spark, ["a b!~'()*é"], url_component("c")) == ["a%20b!~'()*%C3%A9"]


def test_fingerprints(spark):
    rows = with_fingerprints(postings(
        spark,
        {"application_url": "https://google.com/jobs/123?utm_source=jobboard"},
        {"application_url": "https://www.google.com/jobs/123/"},
        {"title": "Backend Engineer (Remote) [Urgent]", "company": "Acme Inc."},
        {"title": "Backend Engineer", "company": "Acme LLC", "application_url": "https://other.com/2"},
        {"title": "Python Developer"},
    )).orderBy("arrival_idx").collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"]
    assert rows[2]["semantic_key"] == rows[3]["semantic_key"]
    assert rows[2]["fingerprint"] != rows[3]["fingerprint"]
    assert len({rows[i]["fingerprint"] for i in (0, 2, 4)}) == 3
    plugged = with_fingerprints(postings(spark, {}, {"application_url": ""}), plain_identity).orderBy("arrival_idx").collect()
    assert [r["fingerprint"] for r in plugged] == ["https://example.com/jobs/1", "Backend Developer:Stripe"]


def test_validator_and_recency(spark):
    from datetime import timedelta

    rows = postings(
        spark, {}, {"title": "  "}, {"company": ""}, {"application_url": ""}, {"application_url": "invalid-url"},
        {"application_url": "http://example.com"}, {"publication_date": None}, {"publication_date": NOW - timedelta(days=7)},
        {"publication_date": NOW - timedelta(days=7, seconds=1)},
    )
    kept = recent_postings(valid_postings(rows), F.lit(NOW))
    assert sorted(r["arrival_idx"] for r in kept.collect()) == [0, 5, 7]


def test_normalizer(spark):
    raw = postings(
        spark, {"title": "  A ", "company": " B ", "source": None, "application_url": " https://x.com ", "remote": None},
        {"title": "Dev (Remote)", "remote": None}, {"work_type": "remote", "remote": None}, {"remote": False, "title": "remote"},
    ).withColumns({"publication_date": F.lit("soon"), "published_at": F.lit(None).cast("string")})
    rows = normalize_postings(raw, F.lit(NOW)).orderBy("arrival_idx").collect()
    assert (rows[0]["title"], rows[0]["company"], rows[0]["source"], rows[0]["url"]) == ("A", "B", "other", "https://x.com")
    assert [r["remote"] for r in rows] == [False, True, True, False]
    assert rows[0]["publication_date"] == NOW.replace(tzinfo=None)
