"""Sources whose payload is a JSON document, read as VARIANT so that no field type is assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_or, epoch_or_date
from ..functions.text import clean_html, clean_trim, strip_tags
from .common import either, ordinal, work_type

# --- fixed values: words that mark remote work, per source ---
REMOTE_EN = "(?i)remote|work from home|telecommute"
REMOTE_AR = "(?i)remote|عن بعد|telecommute"
REMOTE_SHORT = "(?i)remote|عن بعد"
# --- end of fixed values ---

_NUMBER = r"^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _explode(payloads: DataFrame, items: Column, fields: dict[str, Column]) -> DataFrame:
    opened = payloads.withColumn("doc", F.try_parse_json("payload")).select(
        "request_id", "payload_no", F.posexplode(items).alias("pos", "item")
    )
    return opened.select("request_id", ordinal().alias("ordinal"), *[c.alias(n) for n, c in fields.items()])


def _list(*paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get("doc", p, "array<variant>") for p in paths])


def _text(path: str) -> Column:
    return F.try_variant_get("item", f"$.{path}", "string")


def _flag(path: str) -> Column:
    return F.coalesce(F.try_variant_get("item", f"$.{path}", "boolean"), F.lit(False))


def _texts(path: str) -> Column:
    return F.try_variant_get("item", f"$.{path}", "array<string>")


def _is_number(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("item", f"$.{path}", "variant")).rlike(_NUMBER)


def _number(path: str) -> Column:
    """The value if it is a JSON number; a numeric text does not count."""
    return F.when(_is_number(path), F.try_variant_get("item", f"$.{path}", "double"))


def _words(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


# arbeitnow -------------------------------------------------------------------------------------------

def arbeitnow_items(payloads: DataFrame) -> DataFrame:
    return _explode(payloads, _list("$.data"), {
        "title": _text("title"), "company_name": _text("company_name"), "body": _text("description"),
        "is_remote": _flag("remote"), "link": _text("url"), "tags": _texts("tags"), "place": _text("location"),
        "created_no": _number("created_at"), "created_text": _text("created_at"),
    }).where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))


def arbeitnow_search() -> Column:
    return F.lower(F.concat_ws(
        " ", "title", F.coalesce("company_name", F.lit("")),
        F.coalesce(F.array_join("tags", " "), F.lit("")), F.coalesce("place", F.lit("")),
    ))


def arbeitnow_fields(now: Column) -> dict[str, Column]:
    c = F.col
    remote = c("is_remote")
    number = c("created_no")
    text = F.when(number.isNull(), c("created_text"))
    return {
        "title": either(c("title"), c("q_title")),
        "company": either(c("company_name"), "Arbeitnow Employer"),
        "url": either(c("link"), "https://www.arbeitnow.com"),
        "location": either(c("place"), F.when(remote, "Remote (Worldwide)").otherwise("Europe")),
        "country": either(c("place"), F.when(remote, "Remote").otherwise("Europe")),
        "remote": remote,
        "work_type": work_type(remote, "hybrid"),
        "description": either(
            clean_html("body"), F.concat("title", F.lit(" at "), F.coalesce("company_name", F.lit("undefined")))
        ),
        "skills": F.coalesce("tags", "q_skills"),
        "published": epoch_or_date(number, text, now),
    }


# remotive --------------------------------------------------------------------------------------------

def remotive_items(payloads: DataFrame) -> DataFrame:
    return _explode(payloads, _list("$.jobs"), {
        "title": _text("title"), "company_name": _text("company_name"), "body": _text("description"),
        "link": _text("url"), "tags": _texts("tags"), "place": _text("candidate_required_location"),
        "created": _text("publication_date"),
    })


def remotive_fields(now: Column) -> dict[str, Column]:
    c = F.col
    return {
        "title": c("title"),
        "company": either(c("company_name"), "Remote Company"),
        "url": either(c("link"), "https://remotive.com"),
        "location": either(c("place"), "Remote (Worldwide)"),
        "country": either(c("place")),
        "remote": F.lit(True),
        "work_type": F.lit("remote"),
        "description": F.coalesce(clean_html("body"), F.lit("")),
        "skills": F.coalesce("tags", F.array().cast("array<string>")),
        "published": date_or("created", now),
    }


# adzuna ----------------------------------------------------------------------------------------------

def adzuna_items(payloads: DataFrame) -> DataFrame:
    return _explode(payloads, _list("$.results"), {
        "title": _text("title"), "body": clean_html(_text("description")), "link": _text("redirect_url"),
        "created": _text("created"), "pay_min": _number("salary_min"), "pay_max": _number("salary_max"),
        "company_name": _text("company.display_name"), "place": _text("location.display_name"),
        "area": F.get(_texts("location.area"), 0),
    })


def adzuna_fields(now: Column) -> dict[str, Column]:
    c = F.col
    title = clean_trim(strip_tags(either(c("title"), c("q_title")), ""))
    place = either(c("place"), "United Kingdom")
    remote = _words(title, c("body"), place).rlike(REMOTE_EN)
    return {
        "title": title,
        "company": either(c("company_name"), "Adzuna Employer"),
        "url": either(c("link"), "https://www.adzuna.com"),
        "location": place,
        "country": either(c("area"), "United Kingdom"),
        "remote": remote,
        "work_type": work_type(remote, "hybrid"),
        "description": either(c("body"), F.concat(title, F.lit(" in "), place)),
        "skills": c("q_skills"),
        "published": date_or("created", now),
        "salary_min": c("pay_min"),
        "salary_max": c("pay_max"),
        "currency": F.lit("GBP"),
    }


# jooble ----------------------------------------------------------------------------------------------

def jooble_items(payloads: DataFrame) -> DataFrame:
    return _explode(payloads, _list("$.jobs"), {
        "title": _text("title"), "place": _text("location"), "body": clean_html(_text("snippet")),
        "company_name": _text("company"), "origin": _text("source"), "link": _text("link"),
        "created": _text("updated"),
    })


def jooble_fields(now: Column) -> dict[str, Column]:
    c = F.col
    title = clean_trim(strip_tags(either(c("title"), c("q_title")), ""))
    place = either(c("place"), "Remote")
    remote = _words(title, place, c("body")).rlike(REMOTE_AR)
    return {
        "title": title,
        "company": either(c("company_name"), c("origin"), "Jooble Employer"),
        "url": either(c("link"), "https://jooble.org"),
        "location": place,
        "country": place,
        "remote": remote,
        "work_type": work_type(remote, "hybrid"),
        "description": either(c("body"), F.concat(title, F.lit(" at "), either(c("company_name"), "Employer"))),
        "skills": c("q_skills"),
        "published": date_or("created", now),
    }


# linkedin through a search API: ``data`` is a list, or an object with a list of jobs -----------------

def jsearch_items(payloads: DataFrame) -> DataFrame:
    return _explode(payloads, _list("$.data", "$.data.jobs"), {
        "title": _text("job_title"), "company_name": _text("employer_name"),
        "apply_link": _text("job_apply_link"), "other_link": _text("job_google_link"),
        "city": _text("job_city"), "nation": _text("job_country"), "is_remote": _flag("job_is_remote"),
        "body": _text("job_description"), "created": _text("job_posted_at_datetime_utc"),
        "wanted": _texts("job_required_skills"),
    })


def jsearch_fields(now: Column) -> dict[str, Column]:
    c = F.col
    remote = c("is_remote")
    return {
        "title": either(c("title"), c("q_title")),
        "company": either(c("company_name"), "LinkedIn Employer"),
        "url": either(c("apply_link"), c("other_link"), "https://www.linkedin.com/jobs"),
        "location": either(c("city"), F.when(remote, "Remote").otherwise("Worldwide")),
        "country": either(c("nation")),
        "remote": remote,
        "work_type": work_type(remote, "on-site"),
        "description": F.coalesce(either(c("body"), c("title")), F.lit("")),
        "skills": F.coalesce("wanted", "q_skills"),
        "published": date_or("created", now),
    }


# linkedin through a page extraction API --------------------------------------------------------------

def firecrawl_items(payloads: DataFrame) -> DataFrame:
    jobs = F.when(F.try_variant_get("doc", "$.success", "boolean"), _list("$.data.extract.jobs"))
    return _explode(payloads, jobs, {
        "title": _text("title"), "company_name": _text("company"), "place": _text("location"),
        "link": _text("url"), "body": _text("description"),
    }).where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("company_name", F.lit("")) != ""))


def firecrawl_fields(now: Column) -> dict[str, Column]:
    c = F.col
    title = either(clean_trim("title"), c("q_title"))
    company = either(clean_trim("company_name"), "LinkedIn Employer")
    place = either(clean_trim("place"), c("q_location"), "Worldwide")
    remote = F.coalesce(c("q_work") == "remote", F.lit(False)) | _words(title, place).rlike(REMOTE_SHORT)
    return {
        "title": title,
        "company": company,
        "url": either(F.when(F.startswith("link", F.lit("http")), c("link")), "https://www.linkedin.com/jobs"),
        "location": place,
        "country": place,
        "remote": remote,
        "work_type": work_type(remote, "hybrid"),
        "description": either(
            clean_trim("body"), F.concat(title, F.lit(" at "), company, F.lit(" in "), place)
        ),
        "skills": c("q_skills"),
        "published": now,
    }
