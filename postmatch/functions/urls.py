"""URL validation and canonical form, as built-in column expressions.

The canonical form follows the WHATWG reading of a URL: web schemes always carry a host, backslashes
count as slashes, dot segments are resolved and the query is re-serialised as a form. International
host names are kept as they are (no Punycode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_trim, col

# --- fixed values: query parameters that carry tracking data only (case-sensitive) ---
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "fbclid",
    "gclid", "trk", "source", "origin", "spJobID",
]
# --- end of fixed values ---

_WEB = r"^(?i:https?|wss?|ftp):[/\\]*"
_OTHER = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST_CHARS = r"[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]"


def _authority_ok(authority: Column, host_needed: bool) -> Column:
    count = "+" if host_needed else "*"
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    return authority.rlike(rf"^(?:.*@)?(?:\[[0-9A-Fa-f:.]+\]|{_HOST_CHARS}{count})(?::\d*)?$") & (
        (port == "") | (F.ltrim(port, F.lit("0")).rlike(r"^\d{0,4}$")) | (port.try_cast("long") <= 65535)
    )


def _cleaned(c) -> Column:
    return F.regexp_replace(clean_trim(c), r"[\t\n\r]", "")


def _encode_char(ch: Column) -> Column:
    special = ch.rlike(r'[^\x21-\x7E]|["<>`{}^]')
    return F.when(special, F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)


def _resolve_dots(path: Column) -> Column:
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            F.lower(seg).isin("..", "%2e%2e", ".%2e", "%2e."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))),
        )
        .when(F.lower(seg).isin(".", "%2e"), acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    dotted = path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)")
    return F.when(dotted, F.array_join(folded, "/")).otherwise(path)


def _encode_path(path: Column) -> Column:
    unsafe = path.rlike(r'[^\x21-\x7E]|["<>`{}^]')
    encoded = F.array_join(F.transform(F.split(path, ""), _encode_char), "")
    return F.when(unsafe, encoded).otherwise(path)


def _form_decode(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _query(raw: Column) -> Column:
    """Parameters in order, tracking ones dropped, each re-encoded as a form field."""
    fields = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("name"),
            _form_decode(F.regexp_replace(p, r"(?s)^[^=]*=?", "")).alias("value"),
        ),
    )
    kept = F.filter(fields, lambda f: ~f["name"].isin(TRACKING_PARAMS))
    text = F.array_join(
        F.transform(kept, lambda f: F.concat(F.url_encode(f["name"]), F.lit("="), F.url_encode(f["value"]))),
        "&",
    )
    return F.when(raw == "", F.lit("")).otherwise(text)


def with_canonical_url(df: DataFrame, url, out: str = "canonical_url") -> DataFrame:
    """Add one spelling per page; an unparseable address is trimmed, lower-cased and slash-cut.

    The parts become columns of their own, so that each is computed once instead of being repeated
    inside one large expression.
    """
    names = ("raw", "web", "rest", "body", "auth", "path", "query", "parsed")
    raw, web, rest, body, authority, path, query, parsed = (F.col(f"_{out}_{n}") for n in names)
    text = F.regexp_replace(raw, r"[\t\n\r]", "")
    slashed = F.startswith(rest, F.lit("//"))
    host = F.when(
        authority.rlike("[@:]"), F.regexp_replace(authority, r"^.*@|:\d*$", "")
    ).otherwise(authority)
    host = F.lower(host)
    host = F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1 << 20)).otherwise(host)

    def after(c: Column, head: Column) -> Column:
        return F.substring(c, F.length(head) + 1, F.length(c))

    steps = [
        {"raw": clean_trim(url)},
        {"web": text.rlike(_WEB), "rest": F.substring_index(text, "#", 1)},
        # the part after the scheme; null when there is no scheme
        {"rest": F.when(web, F.regexp_replace(rest, _WEB, "")).when(rest.rlike(_OTHER), F.regexp_replace(rest, _OTHER, ""))},
        {"body": F.substring_index(rest, "?", 1)},
        {"query": F.substring(rest, F.length(body) + 2, F.length(rest)),
         "body": F.when(web, F.translate(body, "\\", "/")).otherwise(body)},
        {"auth": F.when(web, F.substring_index(body, "/", 1))
            .when(slashed, F.substring_index(F.substring(body, 3, 1 << 20), "/", 1)).otherwise("")},
        {"path": F.when(web | ~slashed, after(body, authority)).otherwise(after(F.substring(body, 3, 1 << 20), authority)),
         "parsed": rest.isNotNull() & F.when(web, _authority_ok(authority, True)).otherwise(
             _authority_ok(authority, False))},
        {"path": F.translate(path, "\\", "/"), "query": _query(query)},
        {"path": _resolve_dots(path)},
        {"path": F.rtrim(_encode_path(path), F.lit("/"))},
    ]
    for step in steps:
        df = df.withColumns({f"_{out}_{n}": c for n, c in step.items()})
    url_text = F.concat(
        F.lit("https://"),
        host,
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    fallback = F.rtrim(F.lower(raw), F.lit("/"))
    canonical = F.coalesce(F.when(parsed, F.lower(url_text)).otherwise(fallback), F.lit(""))
    return df.withColumn(out, canonical).drop(*[f"_{out}_{n}" for n in names])


def is_web_url(c) -> Column:
    """True for a parseable http or https address."""
    t = _cleaned(c)
    authority = F.regexp_extract(t, r"^(?i:https?):[/\\]*([^/\\?#]*)", 1)
    return F.coalesce(t.rlike(r"^(?i:https?):") & _authority_ok(authority, True), F.lit(False))


def absolute_link(href, base: str, insert_slash: bool = False) -> Column:
    """Prefix the site address to a link that does not start with ``http``."""
    h = col(href)
    glue = F.when(F.startswith(h, F.lit("/")), F.lit("")).otherwise(F.lit("/" if insert_slash else ""))
    return F.when(F.startswith(h, F.lit("http")), h).otherwise(F.concat(F.lit(base), glue, h))
