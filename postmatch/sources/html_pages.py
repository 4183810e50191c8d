"""Sources whose payload is a result page: find the cards, then map their fields.

Only the page parser runs in Python, a page at a time on the executors; defaults, links and flags are
column expressions on its output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import first_match, load, matches, parse_selector, text_of
from ..functions.text import WHITESPACE
from ..functions.urls import absolute_link
from .common import either, ordinal, work_type
from .json_feeds import REMOTE_SHORT

# --- fixed values: where each site keeps the fields of a result card ---
RULES = {
    "mostaql": {
        "card": ".project-card, .project-row, li.media",
        "title": "h2 a, .project-title a, a.o-card__title, h2.card--title a",
        "text": ".project-brief, .project__brief, .o-card__description, .card--desc, p",
    },
    "tanqeeb": {
        "card": '.card-list-item, .job-listing, .card-item, div[class*="job"], article',
        "title": 'h2 a, .card-title a, a[href*="/jobs/"], a[href*="/job/"]',
        "company": '.card-company, .company, span[class*="company"], .t-company',
        "location": '.card-location, .location, span[class*="location"], .t-location',
        "text": ".card-desc, p, .snippet",
    },
    "bayt": {
        "card": "li[data-js-job], .has-pointer-d",
        "title": 'h2 a, a[data-js-aid="jobID"]',
        "company": '.t-nowrap.p10l a, b.t-nowrap, b[class*="company"]',
        "location": ".t-mute.t-small, span.t-mute",
    },
    "wuzzuf": {
        "card": 'div.css-1gatmva, div[class*="job"], .css-1lh32fc',
        "title": 'h2 a, a.css-o171kl, a[class*="title"]',
        "company": 'a.css-ipsyv7, a[class*="company"], .css-d7j1kk',
        "location": 'span.css-5wys0k, span[class*="location"]',
    },
    "forasna": {
        "card": '.job-card, .job-item, div[class*="job-listing"]',
        "title": 'h2 a, h3 a, a[class*="title"]',
        "company": '[class*="company"], .employer-name',
        "location": '[class*="location"]',
    },
}
# --- end of fixed values ---

FIELDS = ("title", "company", "location", "text")
LISTING = (
    "request_id string, payload_no long, pos int, title string, link string, company_name string, "
    "place string, body string"
)


def _cards(html: str, rules: dict[str, list], cap: int) -> Iterator[tuple]:
    """First ``cap`` cards of a page that have a title text and a link."""
    page = load(html)
    found = 0
    for node in page:
        if found == cap:
            return
        if not matches(node, rules["card"]):
            continue
        hits = {f: first_match(page, node, rules[f]) if f in rules else None for f in FIELDS}
        texts = {f: text_of(hit).strip(WHITESPACE) if hit else "" for f, hit in hits.items()}
        link = hits["title"].attrs.get("href") if hits["title"] else None
        if texts["title"] and link:
            yield (found, texts["title"], link, texts["company"], texts["location"], texts["text"])
            found += 1


def _listings(batches: Iterator[pd.DataFrame], rules: dict[str, str], cap: int) -> Iterator[pd.DataFrame]:
    parsed = {field: parse_selector(s) for field, s in rules.items()}
    names = [c.split()[0] for c in LISTING.split(", ")]
    for batch in batches:
        rows = [
            (request, number, *card)
            for request, number, html in zip(batch["request_id"], batch["payload_no"], batch["payload"])
            if html
            for card in _cards(html, parsed, cap)
        ]
        yield pd.DataFrame(rows, columns=names)


def extract_listings(payloads: DataFrame, rules: dict[str, str], cap: int | None = None) -> DataFrame:
    """Rows (request_id, payload_no, pos, title, link, company_name, place, body) of the cards in each page."""
    pages = payloads.select("request_id", "payload_no", "payload")
    return pages.mapInPandas(partial(_listings, rules=rules, cap=cap), LISTING)


def _items(site: str, payloads: DataFrame) -> DataFrame:
    return extract_listings(payloads, RULES[site]).withColumn("ordinal", ordinal()).drop("payload_no", "pos")


def items_of(site: str):
    return partial(_items, site)


def mostaql_fields(now: Column) -> dict[str, Column]:
    c = F.col
    return {
        "title": c("title"),
        "company": F.lit("مستقل (مشروع فريلانس)"),
        "url": absolute_link("link", "https://mostaql.com"),
        "location": F.lit("عن بعد (Freelance)"),
        "country": F.lit("الشرق الأوسط / عن بعد"),
        "remote": F.lit(True),
        "work_type": F.lit("remote"),
        "description": either(c("body"), c("title")),
        "skills": c("q_skills"),
        "published": now,
    }


def _site_fields(now: Column, base: str, employer: str, region: str, body: bool, slash: bool) -> dict[str, Column]:
    c = F.col
    company = either(c("company_name"), employer)
    place = either(c("place"), c("q_location"), region)
    composed = F.concat("title", F.lit(" at "), company, F.lit(" in "), place)
    description = either(c("body"), composed) if body else composed
    seen = [c("title"), place] + ([description] if body else [])
    remote = F.coalesce(c("q_work") == "remote", F.lit(False)) | F.concat_ws(" ", *seen).rlike(REMOTE_SHORT)
    return {
        "title": c("title"),
        "company": company,
        "url": absolute_link("link", base, slash),
        "location": place,
        "country": place,
        "remote": remote,
        "work_type": work_type(remote, "on-site"),
        "description": description,
        "skills": c("q_skills"),
        "published": now,
    }


def site_fields(base: str, employer: str, region: str, body: bool = False, slash: bool = False):
    return partial(_site_fields, base=base, employer=employer, region=region, body=body, slash=slash)
