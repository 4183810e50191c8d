from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import NOW, preferences
from postmatch.sources import collect
from postmatch.sources.common import query_columns
from postmatch.sources.frontier import request_frontier, user_requests
from postmatch.sources.html_pages import RULES, extract_listings
from postmatch.sources.registry import SOURCES, active_sources

PAYLOAD = "request_id string, source string, payload_no long, payload string"


def mapped(spark, name, body, cap=None, **prefs):
    """Postings of one payload for one user."""
    spec = replace(SOURCES[name], cap=cap)
    payloads = spark.createDataFrame([("r", name, 0, body if isinstance(body, str) else json.dumps(body))], PAYLOAD)
    profile = preferences(spark, {"job_title": "Node.js", "skills": ["TypeScript"], **prefs})
    items = spec.items(payloads)
    if spec.shared_feed:
        out = collect.feed_postings(items, profile, spec, F.lit(NOW))
    else:
        asked = spark.createDataFrame([(1, "r")], "user_id long, request_id string")
        out = collect.requested_postings(items, asked, profile, spec, F.lit(NOW))
    return out.orderBy("arrival_idx").collect()


def test_arbeitnow(spark):
    rows = mapped(spark, "arbeitnow", {"data": [
        {"title": "Chef", "url": "https://x.com/0", "company_name": "Kitchen", "tags": []},
        {"title": "Node.js Dev", "url": "https://x.com/1", "company_name": "Acme", "description": "<p>Looking for a  Node.js <b>backend</b></p> developer.",
         "remote": True, "tags": ["node"], "location": "Berlin", "created_at": 1767225600},
        {"title": "Backend", "url": "https://x.com/2", "tags": ["TypeScript"], "created_at": "2026-01-02T00:00:00Z"},
        {"title": "TypeScript", "url": ""},
    ]})
    assert [r["application_url"] for r in rows] == ["https://x.com/1", "https://x.com/2"]
    a, b = rows
    assert (a["description"], a["remote"], a["work_type"], a["location"], a["skills"], a["experience_level"]) == (
        "Looking for a Node.js backend developer.", True, "remote", "Berlin", ["node"], "junior")
    assert (str(a["publication_date"]), str(b["publication_date"])) == ("2026-01-01 00:00:00", "2026-01-02 00:00:00")
    assert (b["company"], b["location"], b["country"], b["remote"]) == ("Arbeitnow Employer", "Europe", "Europe", False)


def test_feed_cap(spark):
    data = [{"title": f"node.js {i}", "url": f"https://x.com/{i}"} for i in range(30)]
    for cap, n in ((None, 30), (20, 20)):
        assert [r["arrival_idx"] for r in mapped(spark, "arbeitnow", {"data": data}, cap)] == list(range(n))


def test_items_of_several_files_are_told_apart(spark, tmp_path):
    for name, title in (("a", "Data Engineer"), ("b", "Chef")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": [{"title": title, "url": f"https://x.com/{name}"}]}))
    spec = SOURCES["arbeitnow"]
    items = spec.items(collect.read_payloads(spark, str(tmp_path), "arbeitnow", "feed"))
    everyone = preferences(spark, {"user_id": 1, "job_title": "data engineer", "skills": []}, {"user_id": 2, "job_title": "e", "skills": []})
    rows = collect.feed_postings(items, everyone, spec, F.lit(NOW)).orderBy("user_id", "arrival_idx").collect()
    assert [(r["user_id"], r["title"]) for r in rows] == [(1, "Data Engineer"), (2, "Data Engineer"), (2, "Chef")]
    assert rows[1]["arrival_idx"] != rows[2]["arrival_idx"]


def test_salaries_that_are_texts_are_dropped(spark):
    from postmatch.sources.normalize import _number

    texts = spark.createDataFrame([("12k", 5.0), ("5", 6.0)], "low string, high double")
    made = texts.withColumn("v", F.parse_json(F.concat(F.lit('"'), "low", F.lit('"'))))
    got = made.select(_number(made, "low").alias("a"), _number(made, "high").alias("b"), _number(made, "v").alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, 5.0, None), (None, 6.0, None)]


def test_remotive(spark):
    (r,) = mapped(spark, "remotive", {"jobs": [{"id": 1, "url": "https://x.com/1", "title": "Dev", "company_name": "Acme", "tags": ["a"],
                                               "publication_date": "bad", "candidate_required_location": "Worldwide", "description": "<p>Join our backend team!</p>"}]})
    assert (r["location"], r["country"], r["remote"], r["experience_level"], r["description"], r["skills"]) == (
        "Worldwide", "Worldwide", True, "junior", "Join our backend team!", ["a"])
    assert r["publication_date"] == NOW.replace(tzinfo=None)


def test_adzuna(spark):
    (r,) = mapped(spark, "adzuna", {"results": [{
        "title": "<strong>Node.js</strong> Dev", "description": "work from home", "redirect_url": "https://x.com/1", "created": "2026-01-01T00:00:00Z",
        "salary_min": 50000, "salary_max": "75000", "company": {"display_name": "Acme"}, "location": {"display_name": "London", "area": ["UK", "London"]}}]})
    assert (r["title"], r["salary_min"], r["salary_max"], r["currency"], r["remote"], r["country"]) == ("Node.js Dev", 50000.0, None, "GBP", True, "UK")
    (r,) = mapped(spark, "adzuna", {"results": [{"title": "Dev", "location": {"area": []}}]}, work_type="hybrid")
    assert (r["company"], r["location"], r["country"], r["description"], r["work_type"]) == (
        "Adzuna Employer", "United Kingdom", "United Kingdom", "Dev in United Kingdom", "hybrid")


def test_jooble(spark):
    (r,) = mapped(spark, "jooble", {"jobs": [{"title": "Dev", "location": "", "snippet": "Working with <b>Node.js</b> and TypeScript", "source": "board",
                                             "link": "https://x.com/1"}]})
    assert (r["company"], r["location"], r["remote"], r["description"]) == ("board", "Remote", True, "Working with Node.js and TypeScript")


@pytest.mark.parametrize("wrap", [lambda jobs: {"data": jobs}, lambda jobs: {"data": {"jobs": jobs}}])
def test_jsearch_both_shapes(spark, wrap):
    job = {"job_title": "Dev", "employer_name": "MS", "job_apply_link": "", "job_google_link": "https://g.com", "job_city": "Redmond", "job_country": "US",
           "job_is_remote": False, "job_required_skills": ["TypeScript", "Azure"]}
    (r,) = mapped(spark, "jsearch", wrap([job]), work_type=None)
    assert (r["location"], r["country"], r["skills"], r["application_url"], r["work_type"]) == (
        "Redmond", "US", ["TypeScript", "Azure"], "https://g.com", "on-site")


def test_firecrawl(spark):
    job = {"title": " Dev ", "company": "Acme", "location": "Remote", "url": "/x"}
    (r,) = mapped(spark, "firecrawl", {"success": True, "data": {"extract": {"jobs": [job, {"title": "x"}]}}}, work_type="hybrid")
    assert (r["title"], r["remote"], r["work_type"], r["application_url"], r["description"]) == (
        "Dev", True, "remote", "https://www.linkedin.com/jobs", "Dev at Acme in Remote")
    assert mapped(spark, "firecrawl", {"success": False, "data": {"extract": {"jobs": [job]}}}) == []


def test_weworkremotely(spark):
    body = ("<rss><item><title><![CDATA[Stripe: Senior: Node.js Engineer]]></title><link>https://x.com/1</link>"
            "<pubDate>Fri, 02 Jan 2026 10:00:00 +0000</pubDate><description><![CDATA[<p>Build  it</p>]]></description></item>"
            "<ITEM><title>No colon node.js</title><link>https://x.com/2</link></ITEM><item><title>node.js</title></item></rss>")
    a, b = mapped(spark, "weworkremotely", body)
    assert (a["company"], a["title"], a["description"], str(a["publication_date"])) == (
        "Stripe", "Senior: Node.js Engineer", "Build it", "2026-01-02 10:00:00")
    assert (b["company"], b["title"], b["country"]) == ("We Work Remotely", "No colon node.js", None)


CARDS = {
    "mostaql": ('<div class="project-row"><h2><a href="/project/1"> Build API </a></h2><p class="project-brief">Short &amp; sweet</p></div>',
                ("Build API", "https://mostaql.com/project/1", "مستقل (مشروع فريلانس)", "عن بعد (Freelance)", "Short & sweet", True)),
    "tanqeeb": ('<div class="card-list-item"><h2><a href="jobs/1">Dev</a></h2><span class="company">Acme</span><span class="location">Cairo</span><p>remote ok</p></div>',
                ("Dev", "https://www.tanqeeb.com/jobs/1", "Acme", "Cairo", "remote ok", True)),
    "bayt": ('<ul><li data-js-job><h2><a href="/en/1">Dev</a></h2><b class="t-nowrap">Acme</b><span class="t-mute t-small">Riyadh</span></ul>',
             ("Dev", "https://www.bayt.com/en/1", "Acme", "Riyadh", "Dev at Acme in Riyadh", False)),
    "wuzzuf": ('<div class="css-1gatmva"><h2><a href="/jobs/1">Dev</a></h2><a class="css-ipsyv7">Acme</a><span class="css-5wys0k">Cairo</span></div>',
               ("Dev", "https://wuzzuf.net/jobs/1", "Acme", "Cairo", "Dev at Acme in Cairo", False)),
    "forasna": ('<div class="job-card"><h3><a href="https://forasna.com/1">Dev</a></h3></div>',
                ("Dev", "https://forasna.com/1", "فرصنا Employer", "Egypt", "Dev at فرصنا Employer in Egypt", False)),
}


@pytest.mark.parametrize("name", list(CARDS))
def test_result_pages(spark, name):
    html, want = CARDS[name]
    (r,) = mapped(spark, name, f"<html><body>{html}</body></html>", work_type="hybrid")
    assert (r["title"], r["application_url"], r["company"], r["location"], r["description"], r["remote"]) == want


def cards(spark, html, rules, cap=15):
    df = spark.createDataFrame([("r", 0, html)], "request_id string, payload_no long, payload string")
    return [(r["title"], r["link"]) for r in extract_listings(df, rules, cap).orderBy("pos").collect()]


def test_page_parser(spark):
    rules = {"card": 'div[class*="job"]', "title": "a"}
    nested = '<div class="jobs"><div class="job"><a href="1">A</a></div><div class="job"><a href="2">B</a><p>x<p>y</div></div>'
    assert cards(spark, nested, rules) == [("A", "1"), ("A", "1"), ("B", "2")]
    assert cards(spark, "".join(f'<div class="job"><a href="{i}">t{i}</a></div>' for i in range(20)), rules) == [(f"t{i}", str(i)) for i in range(15)]
    assert cards(spark, '<div class="job"><a>no link</a></div><div class="job"><a href="1"> </a></div><div class="job"><a href="2">ok', rules) == [("ok", "2")]
    script = '<div class="job"><script>var a="<a href=9>no</a>"</script><a href="1">yes</a></div>'
    assert cards(spark, script, rules) == [("yes", "1")]
    loose = '<ul><li data-js-job="1"><h2><a href="1">A<li data-js-job="2"><h2><a href="2">B</ul>'
    assert cards(spark, loose, {"card": RULES["bayt"]["card"], "title": RULES["bayt"]["title"]}) == [("A", "1"), ("B", "2")]


def test_broken_payloads_give_no_rows_and_count_as_failed(spark):
    payloads = spark.createDataFrame([("r", "jooble", 0, '{"jobs":['), ("r", "remotive", 0, '{"jobs":[]}'), ("r", "adzuna", 0, '{"results":{}}')], PAYLOAD)
    specs = [SOURCES[n] for n in ("remotive", "adzuna", "jooble", "bayt")]
    status = {r["source"]: r["failed"] for r in collect.source_status(payloads, specs).collect()}
    assert status == {"remotive": False, "adzuna": False, "jooble": True, "bayt": True}
    assert collect.collect_from_sources(payloads, preferences(spark), specs, F.lit(NOW)).count() == 0


def test_collect_joins_requests_and_keeps_source_order(spark):
    profile = preferences(spark, {"job_title": "Dev"}, {"user_id": 2, "job_title": "Dev"}, {"user_id": 3, "job_title": "Other"})
    specs = [SOURCES["remotive"], SOURCES["bayt"]]
    requests = user_requests(query_columns(profile), specs)
    frontier = request_frontier(requests)
    assert sorted((r["source"], r["n_users"]) for r in frontier.collect()) == [("bayt", 1), ("bayt", 2), ("remotive", 1), ("remotive", 2)]
    bodies = {"remotive": '{"jobs":[{"title":"Dev","url":"https://x.com/1","company_name":"A"}]}',
              "bayt": '<li data-js-job><h2><a href="/1">Dev</a></h2></li>'}
    landed = [(r["request_id"], r["source"], 0, bodies[r["source"]]) for r in frontier.where("n_users = 2").collect()]
    out = collect.collect_from_sources(spark.createDataFrame(landed, PAYLOAD), profile, specs, F.lit(NOW))
    assert [(r["user_id"], r["source"]) for r in out.orderBy("user_id", "arrival_idx").collect()] == [
        (1, "remotive"), (1, "bayt"), (2, "remotive"), (2, "bayt")]
    plain = collect.collect_from_sources(spark.createDataFrame(landed, PAYLOAD), profile, specs, F.lit(NOW), query_defaults=False)
    assert {r["work_type"] for r in plain.where("source = 'bayt'").collect()} == {"on-site"}


def test_read_payload_files(spark, tmp_path):
    (tmp_path / "abc.json").write_text('{"jobs":\n []}')
    row = collect.read_payloads(spark, str(tmp_path), "remotive").first()
    assert (row["request_id"], row["source"], row["payload"]) == ("abc", "remotive", '{"jobs":\n []}')


def test_active_sources():
    assert [s.name for s in active_sources()] == ["arbeitnow", "remotive", "weworkremotely", "mostaql", "tanqeeb", "bayt", "wuzzuf", "forasna"]
    assert [s.name for s in active_sources({"jsearch", "firecrawl", "adzuna"})][-2:] == ["adzuna", "firecrawl"]
    assert active_sources({"jsearch"})[-1].name == "jsearch"
