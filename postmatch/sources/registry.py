"""The known sources, in the order their postings are concatenated."""

from __future__ import annotations

from collections.abc import Collection

from . import html_pages as H
from . import json_feeds as J
from . import rss as R
from .common import SourceSpec

_PLACED = ("location", "country", "remote", "work_type", "description", "skills")
_TITLED = ("title", "remote", "work_type", "description", "skills")
_ORDER = [
    ("arbeitnow", "arbeitnow", J.arbeitnow_items, J.arbeitnow_fields,
     {"search": J.arbeitnow_search, "trim_keywords": True, "query_fields": ("title", "work_type", "skills")}),
    ("remotive", "remotive", J.remotive_items, J.remotive_fields, {"query_fields": ()}),
    ("weworkremotely", "we_work_remotely", R.weworkremotely_items, R.weworkremotely_fields,
     {"search": R.weworkremotely_search, "query_fields": ("skills",)}),
    ("mostaql", "mostaqel", H.items_of("mostaql"), H.mostaql_fields, {"query_fields": ("skills",)}),
    ("tanqeeb", "tanqeeb", H.items_of("tanqeeb"),
     H.site_fields("https://www.tanqeeb.com", "Tanqeeb Employer", "Middle East", body=True, slash=True), {"query_fields": _PLACED}),
    ("bayt", "bayt", H.items_of("bayt"), H.site_fields("https://www.bayt.com", "Bayt Employer", "Middle East"), {"query_fields": _PLACED}),
    ("wuzzuf", "wuzzuf", H.items_of("wuzzuf"), H.site_fields("https://wuzzuf.net", "Wuzzuf Employer", "Egypt"), {"query_fields": _PLACED}),
    ("forasna", "forasna", H.items_of("forasna"),
     H.site_fields("https://forasna.com", "فرصنا Employer", "Egypt"), {"query_fields": _PLACED}),
    ("adzuna", "adzuna", J.adzuna_items, J.adzuna_fields, {"query_fields": _TITLED}),
    ("jooble", "jooble", J.jooble_items, J.jooble_fields, {"query_fields": _TITLED}),
    ("firecrawl", "linkedin", J.firecrawl_items, J.firecrawl_fields, {"query_fields": ("title", *_PLACED)}),
    ("jsearch", "linkedin", J.jsearch_items, J.jsearch_fields, {"query_fields": ("title", "work_type", "skills")}),
]

SOURCES = {
    name: SourceSpec(name, source, rank, items, fields, user_fields=("skills",), **options)
    for rank, (name, source, items, fields, options) in enumerate(_ORDER)
}
KEYED = {"adzuna", "jooble", "firecrawl", "jsearch"}


def active_sources(keys: Collection[str] = ()) -> list[SourceSpec]:
    """Sources that run given the access keys at hand; the page extraction API replaces the search API."""
    on = set(SOURCES) - KEYED | (KEYED & set(keys))
    if "firecrawl" in on:
        on.discard("jsearch")
    return [spec for name, spec in SOURCES.items() if name in on]


def register(spec: SourceSpec) -> None:
    """Plug in a source, or replace one of the same name."""
    SOURCES[spec.name] = spec
