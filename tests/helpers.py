from __future__ import annotations

from datetime import datetime, timezone

from postmatch.schema import POSTING, PREFERENCES

NOW = datetime(2026, 9, 5, 15, 0, tzinfo=timezone.utc)


def posting(**fields):
    base = {
        "user_id": 1, "arrival_idx": 0, "title": "Backend Developer", "company": "Stripe", "source": "arbeitnow",
        "application_url": "https://example.com/jobs/1", "url": None, "location": None, "country": None, "remote": False,
        "work_type": None, "experience_level": None, "description": None, "skills": [], "publication_date": NOW,
        "published_at": NOW, "salary_min": None, "salary_max": None, "currency": None, "scraped_at": NOW,
    }
    base.update(fields)
    if base["url"] is None:
        base["url"] = base["application_url"]
    return tuple(base[f.name] for f in POSTING.fields)


def postings(spark, *rows):
    made = [posting(**{"arrival_idx": i, **r}) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, POSTING)


def preferences(spark, *rows):
    base = {
        "user_id": 1, "job_title": "Backend Developer", "work_type": "remote", "experience_level": "junior",
        "location": None, "skills": ["Node.js", "TypeScript"], "timezone": "Asia/Gaza",
        "notification_times": ["09:00", "21:00"],
    }
    made = [tuple({**base, **r}[f.name] for f in PREFERENCES.fields) for r in rows or ({},)]
    return spark.createDataFrame(made, PREFERENCES)


def values(spark, rows, expression, kind="string"):
    """Evaluate a column expression over one-column rows named ``c``."""
    df = spark.createDataFrame([(r,) for r in rows], f"c {kind}").coalesce(1)
    return [r[0] for r in df.select(expression.alias("v")).collect()]
