"""Build preference rows from user input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import preferences as P
from ..functions.text import first_truthy
from ..schema import DEFAULT_TIMES, DEFAULT_TIMEZONE, PREFERENCES_TTL_DAYS
from . import state


def create_preferences(raw: DataFrame, timezone: str = DEFAULT_TIMEZONE,
                       times: Sequence[str] = tuple(DEFAULT_TIMES)) -> DataFrame:
    """Normalise input rows; ``error`` names the first failed check, null when the row is valid.

    Input: user_id, job_title, work_type, experience_level, location, skills (comma list), timezone,
    notification_times.
    """
    return raw.select(
        "user_id",
        P.normalize_job_title("job_title").alias("job_title"),
        "work_type",
        "experience_level",
        P.normalize_location("location").alias("location"),
        P.normalize_skills(first_truthy("skills")).alias("skills"),
        F.coalesce(first_truthy("timezone"), F.lit(timezone)).alias("timezone"),
        F.coalesce("notification_times", F.array(*[F.lit(t) for t in times])).alias("notification_times"),
        F.when(~P.valid_job_title("job_title"), "Invalid job title")
        .when(~P.valid_work_type("work_type"), "Invalid work type")
        .when(~P.valid_experience_level("experience_level"), "Invalid experience level")
        .alias("error"),
    )


def preference_versions(valid: DataFrame, now) -> DataFrame:
    """Version rows that save preferences for 90 days."""
    return state.upserts(valid, now, PREFERENCES_TTL_DAYS * 86400)


def live_preferences(log: DataFrame, now) -> DataFrame:
    return state.live(log, ["user_id"], now).drop("written_at", "expires_at", "deleted")
