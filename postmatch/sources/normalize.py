"""Normalise raw posting rows whose fields arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_or
from ..functions.text import clean_html, clean_trim, first_truthy, truthy
from ..operators.state import timestamp
from .json_feeds import REMOTE_AR


def _number(raw: DataFrame, name: str) -> Column:
    """A number stays, anything else (a text that looks like one too) is null."""
    kind = raw.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.VariantType):
        is_number = F.schema_of_variant(name).rlike(r"^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
        return F.when(is_number, F.try_variant_get(name, "$", "double"))
    return F.lit(None).cast("double")


def normalize_postings(raw: DataFrame, now) -> DataFrame:
    """Trim texts, clean the description, infer remote work, parse dates, fill defaults.

    Input columns are those of the posting layout, with date columns as text. Other columns pass through.
    """
    at = timestamp(now)
    url = clean_trim(F.coalesce(first_truthy("application_url", "url"), F.lit("")))
    published = date_or(first_truthy("published_at", "publication_date"), at)
    seen = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("location", F.lit("")))
    inferred = F.coalesce(F.col("work_type") == "remote", F.lit(False)) | seen.rlike(REMOTE_AR)
    return raw.withColumns({
        "title": F.coalesce(clean_trim("title"), F.lit("")),
        "company": F.coalesce(clean_trim("company"), F.lit("")),
        "source": F.coalesce("source", F.lit("other")),
        "application_url": url,
        "url": url,
        "location": clean_trim("location"),
        "country": clean_trim("country"),
        "remote": F.coalesce("remote", inferred),
        "description": clean_html(truthy("description")),
        "skills": F.coalesce("skills", F.array().cast("array<string>")),
        "publication_date": published,
        "published_at": published,
        "salary_min": _number(raw, "salary_min"),
        "salary_max": _number(raw, "salary_max"),
        "currency": clean_trim("currency"),
        "scraped_at": at,
    })
