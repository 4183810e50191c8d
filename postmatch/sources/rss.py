"""The RSS feed source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_or
from ..functions.text import clean_html, clean_trim
from .common import ordinal


def _element(tag: str) -> Column:
    """Trimmed content of the first element, CDATA preferred; empty when absent."""
    wrapped = rf"(?is)<{tag}>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>"
    plain = rf"(?is)<{tag}>(.*?)</{tag}>"
    item = F.col("item")
    return clean_trim(
        F.when(item.rlike(wrapped), F.regexp_extract(item, wrapped, 1)).otherwise(F.regexp_extract(item, plain, 1))
    )


def weworkremotely_items(payloads: DataFrame) -> DataFrame:
    """Items with a title and a link; "Company: Title" is split at the first colon."""
    raw = payloads.select(
        "request_id",
        "payload_no",
        F.posexplode(F.regexp_extract_all("payload", F.lit("(?is)<item>(.*?)</item>"), F.lit(1))).alias("pos", "item"),
    ).select(
        "request_id",
        ordinal().alias("ordinal"),
        _element("title").alias("raw_title"),
        _element("link").alias("link"),
        _element("pubDate").alias("created"),
        clean_html(_element("description")).alias("body"),
    )
    parts = F.split("raw_title", ":", 2)
    named = F.contains(F.col("raw_title"), F.lit(":"))
    return raw.where((F.col("raw_title") != "") & (F.col("link") != "")).withColumns({
        "company_name": F.when(named, clean_trim(F.get(parts, 0))).otherwise(F.lit("We Work Remotely")),
        "title": F.when(named, clean_trim(F.get(parts, 1))).otherwise(F.col("raw_title")),
    }).drop("raw_title")


def weworkremotely_search() -> Column:
    return F.lower(F.concat_ws(" ", "title", "body"))


def weworkremotely_fields(now: Column) -> dict[str, Column]:
    c = F.col
    return {
        "title": c("title"),
        "company": c("company_name"),
        "url": c("link"),
        "location": F.lit("Remote"),
        "remote": F.lit(True),
        "work_type": F.lit("remote"),
        "description": c("body"),
        "skills": c("q_skills"),
        "published": date_or("created", now),
    }
