"""Identity keys of a posting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_truthy, normalize_company, normalize_title
from .urls import with_canonical_url


def posting_url() -> Column:
    return F.coalesce(first_truthy("application_url", "url"), F.lit(""))


def _digest(*cols: str) -> Column:
    # Declared not null: otherwise joins on the key push a null check of this whole expression to the scan.
    return F.coalesce(F.sha2(F.concat_ws("|", *cols), 256), F.lit(""))


def with_fingerprints(postings: DataFrame, identity: Callable[[], Column] | None = None) -> DataFrame:
    """Add ``fingerprint`` (title, company, page) and ``semantic_key`` (title, company).

    ``fingerprint`` is the identity used by caches, the sent log and matching; ``semantic_key`` finds
    copies of one posting across sources. ``identity`` plugs in another fingerprint expression. Postings
    that already carry both keys, e.g. from before they were fanned out to users, are returned as they are.
    """
    if {"fingerprint", "semantic_key"} <= set(postings.columns) and identity is None:
        return postings
    df = with_canonical_url(postings, posting_url(), "_u").withColumns(
        {"_t": normalize_title("title"), "_c": normalize_company("company")}
    )
    own = _digest("_t", "_c", "_u")
    return df.withColumns({
        "fingerprint": identity() if identity else own,
        "semantic_key": _digest("_t", "_c"),
    }).drop("_t", "_c", "_u")


def with_url_fingerprint(df: DataFrame, url="url", canonical: str = "canonical_url",
                         out: str = "url_fingerprint") -> DataFrame:
    """Add the canonical address and its digest."""
    return with_canonical_url(df, url, canonical).withColumn(out, _digest(canonical))


def plain_identity() -> Column:
    """Readable identity: the page, else ``title:company``."""
    return F.coalesce(first_truthy("url", "application_url"), F.concat("title", F.lit(":"), "company"))
