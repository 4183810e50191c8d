"""What every source shares: landed payloads, the user's query, and the finishing select."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_truthy, truthy

ITEMS_PER_PAYLOAD = 1_000_000
RANK_STRIDE = 1 << 44
#: What of a query the fields of an item may fall back to, but for the user's skills and level.
ASK = ("q_title", "q_work", "q_location")


@dataclass(frozen=True)
class SourceSpec:
    """How one source is read.

    ``items`` turns payload rows into item rows (request_id, ordinal, raw fields). ``fields`` maps raw and
    query fields to posting columns, given ``now``. A shared feed names the searched text in ``search``;
    every other source is joined to its users by request. ``query_fields`` names the fields that read query
    columns; the others are worked out before an item is brought to its users (None: any may read them).
    ``user_fields`` names those of them that read the user's skills or level (None: any may read them); the rest are worked out
    once for all users of a request with the same title, work type and location.
    """

    name: str
    source: str
    rank: int
    items: Callable[[DataFrame], DataFrame]
    fields: Callable[[Column], dict[str, Column]]
    search: Callable[[], Column] | None = None
    trim_keywords: bool = False
    cap: int | None = None
    query_fields: tuple[str, ...] | None = None
    user_fields: tuple[str, ...] | None = None

    @property
    def shared_feed(self) -> bool:
        return self.search is not None


def ordinal() -> Column:
    """Position of an item over all payloads of its source; needs ``payload_no`` and ``pos``."""
    fits = (F.col("pos") < ITEMS_PER_PAYLOAD) & (F.col("payload_no") < RANK_STRIDE // ITEMS_PER_PAYLOAD)
    packed = F.col("payload_no") * F.lit(ITEMS_PER_PAYLOAD) + F.col("pos")
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("too many items in a payload, or payloads of a source")))


def query_columns(profiles: DataFrame) -> DataFrame:
    """The part of the preferences a source may fall back to."""
    return profiles.select(
        "user_id",
        F.coalesce("job_title", F.lit("")).alias("q_title"),
        truthy("work_type").alias("q_work"),
        truthy("experience_level").alias("q_level"),
        truthy("location").alias("q_location"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("q_skills"),
    )


def without_query_defaults(queries: DataFrame) -> DataFrame:
    """Variant in which mapped fields never fall back to the user's own query."""
    return queries.withColumns({
        "q_work": F.lit(None).cast("string"),
        "q_level": F.lit(None).cast("string"),
        "q_location": F.lit(None).cast("string"),
        "q_skills": F.array().cast("array<string>"),
    })


def either(*values) -> Column:
    """First value that is neither null nor empty; plain strings after a column name are literals."""
    return first_truthy(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def work_type(remote: Column, default: str) -> Column:
    return F.when(remote, F.lit("remote")).otherwise(F.coalesce("q_work", F.lit(default)))


def level() -> Column:
    return F.coalesce("q_level", F.lit("mid"))


def with_own_fields(items: DataFrame, spec: SourceSpec, now: Column) -> DataFrame:
    """Add, as ``own_<name>``, the fields that do not depend on who asks, so that they are worked out once per item and not once per user."""
    if spec.query_fields is None:
        return items
    return items.withColumns({f"own_{n}": c for n, c in spec.fields(now).items() if n not in spec.query_fields})


def with_shared_fields(joined: DataFrame, spec: SourceSpec, now: Column) -> DataFrame:
    """Add, as ``own_<name>``, the other fields that do not depend on the user's skills or level; ``joined`` has :data:`ASK` of the query."""
    fields = spec.fields(now)
    return joined.withColumns({f"own_{n}": fields[n] for n in spec.query_fields if n not in spec.user_fields})


def to_postings(joined: DataFrame, spec: SourceSpec, now: Column) -> DataFrame:
    """Finishing select: posting columns in schema order. ``joined`` has the items of :func:`with_own_fields` with the query columns."""
    f = {n: F.col(f"own_{n}") if f"own_{n}" in joined.columns else c for n, c in spec.fields(now).items()}
    null = F.lit(None)
    published = f["published"]
    return joined.select(
        "user_id",
        (F.lit(spec.rank * RANK_STRIDE) + F.col("ordinal")).cast("long").alias("arrival_idx"),
        f["title"].alias("title"),
        f["company"].alias("company"),
        F.lit(spec.source).alias("source"),
        f["url"].alias("application_url"),
        f["url"].alias("url"),
        f["location"].alias("location"),
        f.get("country", null.cast("string")).alias("country"),
        f["remote"].alias("remote"),
        f["work_type"].alias("work_type"),
        level().alias("experience_level"),
        f["description"].alias("description"),
        f["skills"].alias("skills"),
        published.alias("publication_date"),
        published.alias("published_at"),
        f.get("salary_min", null.cast("double")).alias("salary_min"),
        f.get("salary_max", null.cast("double")).alias("salary_max"),
        f.get("currency", null.cast("string")).alias("currency"),
        now.alias("scraped_at"),
    )
