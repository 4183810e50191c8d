from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import postings
from postmatch.functions.fingerprint import with_fingerprints
from postmatch.functions.scoring import richness
from postmatch.operators import dedup
from postmatch.operators.ranking import rank_by_level


def split(df):
    keyed = with_fingerprints(df)
    return (
        sorted(r["arrival_idx"] for r in dedup.survivors(keyed).collect()),
        sorted(r["arrival_idx"] for r in dedup.duplicates(keyed).collect()),
    )


def test_distinct_rows_survive(spark):
    assert split(postings(spark, {}, {"title": "Frontend Developer", "company": "Vercel"})) == ([0, 1], [])


def test_richer_copy_replaces_the_first(spark):
    rich = {"title": "Node.js Engineer", "company": "Acme", "application_url": "https://x.com/1?ref=remotive", "location": "Berlin",
            "description": "A description of more than twenty characters", "skills": ["a", "b", "c"], "salary_min": 6e4, "salary_max": 8e4}
    poor = {"title": "Node.js Engineer", "company": "Acme", "application_url": "https://x.com/1"}
    assert split(postings(spark, poor, rich)) == ([1], [1])
    assert split(postings(spark, rich, poor)) == ([0], [1])


def test_cross_source_copy(spark):
    a = {"title": "Senior Backend Developer (Remote)", "company": "Amazon Web Services Inc.", "application_url": "https://a.com/1"}
    b = {"title": "Senior Backend Developer", "company": "Amazon Web Services", "application_url": "https://b.com/2"}
    assert split(postings(spark, a, b)) == ([0], [1])
    assert split(postings(spark, a, {**b, "user_id": 2})) == ([0, 1], [])


def test_richness_points(spark):
    df = postings(
        spark, {}, {"description": "x" * 20}, {"description": "x" * 21}, {"description": "💻" * 11},
        {"location": "a", "country": "b", "work_type": "c", "experience_level": "d", "remote": True, "salary_max": 1.0, "skills": ["s", "t"]},
        {"location": "", "salary_min": 0.0},
    )
    assert [r[0] for r in df.select(richness(), "arrival_idx").orderBy("arrival_idx").collect()] == [0, 0, 2, 2, 9, 0]


def sequential(rows):
    """Row by row, as a stream of arrivals would be handled."""
    best, repeats = {}, []
    for i, (key, points) in enumerate(rows):
        if key not in best:
            best[key] = (points, i)
        else:
            repeats.append(i)
            if points > best[key][0]:
                best[key] = (points, i)
    return sorted(i for _, i in best.values()), repeats


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=20))
def test_equals_sequential_model(spark, rows):
    df = postings(spark, *[{"title": f"t{k}", "application_url": f"https://x.com/{i}", "skills": ["s"] * p} for i, (k, p) in enumerate(rows)])
    assert split(df) == sequential(rows)


def test_global_unique_takes_first_user(spark):
    df = with_fingerprints(postings(spark, {"user_id": 2, "arrival_idx": 0}, {"user_id": 1, "arrival_idx": 5}, {"user_id": 1, "arrival_idx": 9}))
    assert [(r["user_id"], r["arrival_idx"]) for r in dedup.global_unique(df).collect()] == [(1, 5)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3)), min_size=1, max_size=30))
def test_rank_by_level_is_a_plain_rank(spark, rows):
    df = spark.createDataFrame([(g, s, i) for i, (g, s) in enumerate(rows)], "g int, s int, i long")
    got = {r["i"]: r["rank"] for r in rank_by_level(df, "g", "s", "i", chunk_rows=4).collect()}
    want = {}
    for group in (0, 1):
        order = sorted((-s, i) for i, (g, s) in enumerate(rows) if g == group)
        want.update({i: n for n, (_, i) in enumerate(order, 1)})
    assert got == want
