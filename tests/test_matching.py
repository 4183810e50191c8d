from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import NOW, postings, preferences
from postmatch.functions import responses
from postmatch.functions.fingerprint import with_fingerprints
from postmatch.operators import analyze, budget, collect, keywords, match, notify
from postmatch.plans import registered
from postmatch.schema import ANALYSIS, SENT_LOG


def score(spark, job, prefs, analysis=None, **options):
    df = with_fingerprints(postings(spark, job))
    analyses = None
    if analysis:
        fp = df.first()["fingerprint"]
        analyses = spark.createDataFrame([(fp, *analysis, NOW)], ANALYSIS)
    row = match.match_postings(df, preferences(spark, prefs), analyses, **options).first()
    return row["score"], row["reason"]


FULL = "role matches, 2 skill(s) match, experience level matches, work type matches"


def test_analysis_score(spark):
    got = score(spark, {}, {}, ("Backend Developer", "junior", ["Node.js", "TypeScript"], "remote"))
    assert got == (90, FULL)
    assert score(spark, {}, {"job_title": "Chef", "skills": None, "experience_level": "lead", "work_type": "hybrid"},
                 ("backend", "unknown", [], "remote")) == (0, "No strong match found")


@pytest.mark.parametrize("job, prefs, expected", [
    ({"title": "Junior Backend Developer (Node.js)", "skills": ["Node.js", "TypeScript"], "experience_level": "junior", "work_type": "remote"}, {}, (90, FULL)),
    ({"title": "Chef", "experience_level": "lead"}, {"work_type": "hybrid"}, (-15, "experience level does not match")),
    ({"title": "Chef", "experience_level": "mid"}, {"experience_level": "any", "work_type": "any"},
     (0, "experience level does not match, work type matches (any)")),
    ({"title": "Chef", "work_type": "hybrid", "remote": True}, {}, (15, "remote matches")),
    ({"title": "Chef"}, {"job_title": "", "work_type": "hybrid"}, (0, "Rule-based match")),
    ({"title": "Chef", "skills": ["javascript", "sql"]}, {"skills": ["java", "script", "SQL", "a", "x"], "work_type": "hybrid"},
     (30, "4 skill(s) match")),
    ({"title": "", "work_type": "hybrid"}, {}, (35, "role matches")),
])
def test_rule_score(spark, job, prefs, expected):
    assert score(spark, job, prefs) == expected


def test_neutral_any_level(spark):
    assert score(spark, {"title": "Chef", "experience_level": "mid"}, {"experience_level": "any", "work_type": "hybrid"},
                 any_level_neutral=True) == (0, "Rule-based match")


def test_quality_and_rank(spark):
    df = spark.createDataFrame([(1, 0, 40), (1, 1, 90), (1, 2, 39), (1, 3, 90)], "user_id long, arrival_idx long, score int")
    good = match.quality_matches(df, 0)
    assert [r["arrival_idx"] for r in match.ranked(good).orderBy("rank").collect()] == [1, 3, 0]


def test_unsent_edges(spark):
    from datetime import timedelta

    matches = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "c")], "user_id long, fingerprint string")
    day = timedelta(days=30)
    log = spark.createDataFrame([(1, "a", NOW - day + timedelta(seconds=1), "t", "c"), (1, "b", NOW - day, "t", "c")], SENT_LOG)
    left = notify.unsent(matches, log, F.lit(NOW)).collect()
    assert sorted((r["user_id"], r["fingerprint"]) for r in left) == [(1, "b"), (1, "c"), (2, "a")]


def test_message(spark):
    df = match.ranked(postings(spark, {"location": "Remote", "country": ""}).withColumns({"score": F.lit(92), "fingerprint": F.lit("f")}))
    text = df.select(notify.message_text()).first()[0]
    assert text == "💼 Backend Developer\n\n🏢 Company: Stripe\n\n🌍 Remote\n\n\n🌐 Source: arbeitnow\n\n🎯 Match: 92%"


MATCH = [
    ('{"score":90,"reason":"Strong match"}', 90.0, None), ('```json\n{"score":70,"reason":"x"}\n```', 70.0, None),
    ("invalid json", None, "json"), ('{"score":150,"reason":"x"}', None, "score"), ('{"score":1,"reason":123}', None, "reason"),
    ("", None, "empty"), (None, None, "empty"), ("[1]", None, "shape"), ("null", None, "shape"), ('{"reason":"a"}', None, "shape"),
    ('{"score":"9","reason":"a"}', None, "score"),
]


def test_match_responses(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(MATCH)], "i int, response string")
    rows = responses.parse_match_responses(df).orderBy("i").collect()
    assert [(r["score"], r["error"]) for r in rows] == [(s, e and responses.MATCH_ERRORS[e]) for _, s, e in MATCH]


def test_answers_with_anything_behind_them_are_rejected(spark):
    whole = '{"score": 50, "reason": "x"}'
    texts = [whole, f"```json\n{whole}\n```", f"{whole} trailing words", whole + '{"a": 1}', f"{whole},{whole}", f"```json\n{whole}\n``` and more", whole + ', "b": 1']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    rows = responses.parse_match_responses(df).orderBy("i").collect()
    assert [r["score"] for r in rows] == [50.0, 50.0] + [None] * 5
    assert {r["error"] for r in rows[2:]} == {responses.MATCH_ERRORS["json"]}


def test_analysis_responses(spark):
    body = '{"role":%s,"skills":%s,"experienceLevel":"mid","workType":"%s","summary":"s"}'
    texts = [body % ('"b"', '["x","y"]', " OnSite "), body % ('"b"', "[]", "odd"), body % ("1", "[]", "any"), body % ('"b"', '["x",1]', "any"),
             body % ('"b"', "null", "any"), "[]", "3", "{"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    rows = responses.parse_analysis_responses(df).orderBy("i").collect()
    assert [(r["work_type"], r["skills"]) for r in rows[:2]] == [("on-site", ["x", "y"]), ("any", [])]
    kinds = {v: k for k, v in responses.ANALYSIS_ERRORS.items()}
    assert [kinds[r["error"]] for r in rows[2:]] == ["structure", "skills", "structure", "structure", "shape", "json"]


def test_analyser_plug_in(spark):
    def answering(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({
                "fingerprint": batch["fingerprint"],
                "response": ['{"role":"backend","skills":[],"experienceLevel":"mid","workType":"any","summary":""}'
                             if "Stripe" in p else "?" for p in batch["prompt"]],
            })

    unique = with_fingerprints(postings(spark, {}, {"company": "Other"}, {"title": "Third"}))
    held = unique.where("title = 'Third'").select("fingerprint").first()[0]
    cache = spark.createDataFrame([(held, "r", "mid", [], "any", NOW)], ANALYSIS)
    misses = analyze.analysis_misses(unique, cache, F.lit(NOW))
    assert misses.count() == 2
    good, bad = analyze.analyse(misses, answering, F.lit(NOW))
    assert [r["role"] for r in good.collect()] == ["backend"]
    assert [r["error"] for r in bad.collect()] == [responses.ANALYSIS_ERRORS["json"]]
    limited, _ = analyze.analyse(misses, answering, F.lit(NOW), max_new=1)
    assert limited.count() == 1


WORDS = st.text(alphabet="ab c💻é", max_size=9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c💻é", max_size=14), min_size=1, max_size=6),
       st.lists(st.tuples(WORDS, st.lists(WORDS, max_size=2)), min_size=1, max_size=4), st.sampled_from([None, 2]), st.sampled_from([3, 1000]))
def test_keyword_search_is_containment(spark, texts, users, cap, limit):
    feed = spark.createDataFrame(list(enumerate(texts)), "ordinal long, body string")
    people = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(users)], "user_id long, job_title string, skills array<string>")
    wanted = {}
    for i, (t, s) in enumerate(users):
        keys = [w.strip(" ").lower() for w in [t, *s] if w]
        hits = [n for n, body in enumerate(texts) if not keys or any(k in body for k in keys)]
        wanted[i] = hits[:cap] if cap else hits
    got = collect.keyword_search(feed, "body", people, True, cap).collect()
    far = keywords.keyword_hits(feed, "body", "ordinal", collect.profile_keywords(people, True), automaton_chars=limit).collect()
    assert sorted((r["user_id"], r["ordinal"]) for r in got) == sorted((u, n) for u, ns in wanted.items() for n in ns)
    keys = {k for t, s in users for k in ([w.strip(" ").lower() for w in [t, *s] if w] or [""])}
    assert sorted((r["ordinal"], r["keyword"]) for r in far) == sorted((n, k) for n, b in enumerate(texts) for k in keys if k in b)


def test_keyword_hits_take_odd_rows(spark):
    feed = spark.createDataFrame([(1, None), (2, ""), (3, "abab"), (3, "abab"), (4, "x" * 200_000 + "needle")], "ordinal long, body string")
    words = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("b",), ("needle",), ("absent",)], "keyword string")
    want = [(2, ""), (3, ""), (3, ""), (3, "ab"), (3, "ab"), (3, "b"), (3, "b"), (4, ""), (4, "needle")]
    for chars in (1, 5, 1000):
        assert sorted(map(tuple, keywords.keyword_hits(feed, "body", "ordinal", words, chars).collect())) == want
    none = spark.createDataFrame([], "keyword string")
    assert keywords.keyword_hits(feed, "body", "ordinal", none).count() == 0
    assert keywords.keyword_hits(feed.where("false"), "body", "ordinal", words).count() == 0


def test_searches_reach_parts_of_every_spelling(spark):
    """The registered search finds titles of all four spellings, and postings with and without skills."""
    sf = "/root/testdata/sf0.01"
    found = registered.user_postings(spark, sf, registered.B.view(spark, sf, "profiles"))
    pairs = found.select("user_id", "arrival_idx", F.size("skills").alias("n")).distinct().collect()
    parts = {r["arrival_idx"] for r in pairs}
    by_spelling = [sum(p % 4 == k for p in parts) for k in range(4)]
    assert len(pairs) > 5_000 and min(by_spelling) > 0.6 * 500
    assert any(r["n"] == 0 for r in pairs) and any(r["n"] > 0 for r in pairs)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=30), st.one_of(st.none(), st.integers(0, 20)), st.one_of(st.none(), st.integers(0, 90)),
       st.integers(1, 5))
def test_admission_is_a_prefix_of_the_order(spark, costs, most_rows, most_cost, ranges):
    rows = spark.createDataFrame([(i // 7, i, c, "x") for i, c in enumerate(costs)], "user_id long, arrival_idx long, c int, cost_of string").repartition(3)
    good, left = budget.admit(rows, ["user_id", "arrival_idx"], F.col("c"), budget.Budget(most_rows, most_cost), ranges)
    spent, want, why = 0, [], []
    for i, c in enumerate(costs):
        spent += c or 0
        if most_rows is not None and i + 1 > most_rows:
            why.append((i, c or 0, "count"))
        elif most_cost is not None and spent > most_cost:
            why.append((i, c or 0, "cost"))
        else:
            want.append(i)
    assert sorted(r["arrival_idx"] for r in good.collect()) == want and good.columns == rows.columns
    assert sorted((r["arrival_idx"], r["cost"], r["reason"]) for r in left.collect()) == why


def test_built_in_analyser(spark):
    rows = with_fingerprints(postings(
        spark, {"title": "Senior Backend Engineer", "description": "Hybrid work", "skills": ["SQL", " ", "SQL", " Go "]}, {"title": "Cook", "work_type": "on-site"},
        {"title": "React lead", "location": "Remote, EU", "description": None, "skills": None}))
    made = {r["role"]: r for r in analyze.keyword_analyses(rows, F.lit(NOW)).collect()}
    assert (made["backend"]["level"], made["backend"]["work_type"], made["backend"]["skills"]) == ("senior", "hybrid", ["SQL", "Go"])
    assert (made["other"]["level"], made["other"]["work_type"], made["other"]["skills"]) == ("unknown", "on-site", [])
    assert (made["frontend"]["level"], made["frontend"]["work_type"], made["frontend"]["skills"]) == ("lead", "remote", [])
    done = analyze.analyse_within(rows, analyze.KEYWORDS, F.lit(NOW), budget.Budget(rows=2))
    assert done.good.count() == 2 and [r["reason"] for r in done.skipped.collect()] == ["count"] and done.rejected is None


def test_brought_to_users_equals_search_and_joins(spark):
    """Repeated items, users and keywords, null texts, several keywords that find a pair, users without keywords."""
    feed = spark.createDataFrame(
        [(1, "red ring steel"), (2, "blue bolt"), (2, "old ring"), (3, None), (None, "ring"), (4, ""), (5, "ring ring bolt")], "ordinal long, body string")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"), (4, "e"), (5, None)], "ordinal long, name string")
    searches = spark.createDataFrame(
        [(1, "Ring", ["bolt", "ring", None, ""]), (1, "steel", None), (2, None, None), (3, "nothing", []), (None, "ring", None), (4, "bolt", ["ring", "in"])],
        "user_id long, job_title string, skills array<string>")
    users = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "z"), (4, "w"), (None, "n"), (9, "none")], "user_id long, mark string")
    expected = collect.keyword_search(feed, "body", searches, True).join(items, "ordinal").join(users, "user_id")
    got = collect.brought_to_users(feed, "body", items, searches, users, True)
    assert sorted(got.columns) == sorted(expected.columns)
    rows = [sorted(map(str, df.select("user_id", "ordinal", "name", "mark").collect())) for df in (got, expected)]
    assert rows[0] == rows[1] and len(rows[0]) == 17


def test_many_users_of_a_keyword_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(collect, "SEARCHERS_PER_BLOCK", 3)
    feed = spark.range(7).selectExpr("id AS ordinal", "concat('ring ', id) AS body")
    searches = spark.range(50).selectExpr("id AS user_id", "'ring' AS job_title", "array(CAST(id % 9 AS STRING)) AS skills")
    got = collect.brought_to_users(feed, "body", feed, searches, searches.select("user_id"), True).select("user_id", "ordinal").collect()
    assert len(got) == len(set(got)) == 350


def test_unsent_by_what_users_carry(spark):
    matches = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (1, None)], "user_id long, fingerprint string")
    log = spark.createDataFrame([(1, "a", NOW, "t", "c"), (1, None, NOW, "t", "c"), (3, "x", NOW, "t", "c"), (1, "a", NOW, "t", "c")], SENT_LOG)
    users = matches.select("user_id").distinct()
    carried = matches.join(notify.with_sent(users, log, F.lit(NOW)), "user_id", "left")
    got, expected = (sorted(map(str, notify.unsent(df, log, F.lit(NOW)).select(*matches.columns).collect())) for df in (carried, matches))
    assert got == expected and len(got) == 5
