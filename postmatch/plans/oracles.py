"""SQL twins of the registered queries, in the DuckDB dialect, over the driver's tables."""

from __future__ import annotations

from ..functions import scoring as R
from ..functions.responses import ANALYSIS_ERRORS, MATCH_ERRORS
from ..functions.text import (
    COMPANY_SUFFIXES,
    COMPANY_SUFFIXES_WITH_DOT,
    TITLE_NOISE_IN_BRACKETS,
    TITLE_NOISE_IN_PARENS,
    WS_CLASS,
)
from ..functions.urls import TRACKING_PARAMS
from ..operators.notify import BUTTON_TEXT, NO_MATCH_TEXT
from .bindings import NOW, duck_sql

ORACLES: dict[str, str] = {}
TS = f"TIMESTAMP '{NOW}'"


def ctes(*views: str) -> str:
    return "WITH " + ", ".join(f"{v} AS ({duck_sql(v)})" for v in views)


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def collapse(e: str) -> str:
    return f"regexp_replace({e}, '{WS_CLASS}+', ' ', 'g')"


def squeeze(e: str) -> str:
    return f"trim({collapse(e)})"


def clean(e: str) -> str:
    return squeeze(f"regexp_replace({e}, '<[^>]*>?', ' ', 'g')")


def title(e: str) -> str:
    t = rf"regexp_replace(lower({e}), '\((?:{'|'.join(TITLE_NOISE_IN_PARENS)})\)', '', 'g')"
    t = rf"regexp_replace({t}, '\[(?:{'|'.join(TITLE_NOISE_IN_BRACKETS)})\]', '', 'g')"
    t = rf"regexp_replace({t}, '[-_–—|#]', ' ', 'g')"
    return squeeze(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')")


def company(e: str) -> str:
    words = "|".join([rf"{w}\.?" for w in COMPANY_SUFFIXES_WITH_DOT] + COMPANY_SUFFIXES)
    t = rf"regexp_replace(lower({e}), '\b(?:{words})\b', '', 'g')"
    return squeeze(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')")


def form(e: str) -> str:
    return collapse(f"regexp_replace({trim(f'lower({e})')}, '[._-]', ' ', 'g')")


def _form_encode(e: str) -> str:
    return f"replace(replace(replace(url_encode({e}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def canonical(source: str, url: str, out: str, name: str) -> str:
    """CTEs ending in ``name``: the rows of ``source`` with the canonical form of ``url`` as ``out``."""
    web = r"(?s)^(?i:https?|wss?|ftp):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    port = r"coalesce(try_cast(nullif(regexp_extract(a, ':(\d+)$', 1), '') AS BIGINT), 0) <= 65535"
    host_ok = r"regexp_matches(a, '^(?:.*@)?[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]+(?::\d*)?$')"
    tracking = ", ".join(f"'{t}'" for t in TRACKING_PARAMS)
    decode = r"url_decode(replace({}, '+', '%20'))"
    pair_name = decode.format("split_part(f, '=', 1)")
    pair_value = decode.format("CASE WHEN contains(f, '=') THEN substr(f, strpos(f, '=') + 1) ELSE '' END")
    query = (
        f"array_to_string(list_transform(list_filter(string_split(q, '&'), lambda f: f <> '' AND "
        f"{pair_name} NOT IN ({tracking})), lambda f: {_form_encode(pair_name)} || '=' || {_form_encode(pair_value)}), '&')"
    )
    return f"""
    {name}_1 AS (SELECT *, {trim(url)} AS u FROM {source}),
    {name}_2 AS (SELECT *, regexp_extract(u, '{web}', 1) AS a, replace(regexp_extract(u, '{web}', 2), ' ', '%20') AS p,
        regexp_extract(u, '{web}', 3) AS q FROM {name}_1),
    {name}_3 AS (SELECT *, {host_ok} AND {port} AS parsed,
        regexp_replace(regexp_replace(regexp_replace(lower(a), '^.*@', ''), ':\\d*$', ''), '^www\\.', '') AS h,
        regexp_replace(replace(replace(p, '/./', '/'), '/b/../', '/'), '/+$', '') AS pp, {query} AS qq FROM {name}_2),
    {name} AS (SELECT * EXCLUDE (u, a, p, q, h, pp, qq, parsed), coalesce(CASE WHEN parsed THEN
        lower('https://' || h || CASE WHEN pp = '' THEN '/' ELSE pp END || CASE WHEN qq = '' THEN '' ELSE '?' || qq END)
        ELSE regexp_replace(lower(u), '/+$', '') END, '') AS {out}, coalesce(parsed, false) AS parsed FROM {name}_3)"""


def identified(source: str = "postings_p", name: str = "idp") -> str:
    return (
        canonical(source, "coalesce(nullif(application_url, ''), url)", "cu", f"{name}_c")
        + f""", {name} AS (SELECT * EXCLUDE (cu, parsed),
        sha256(concat_ws('|', {title('title')}, {company('company')}, cu)) AS fingerprint,
        sha256(concat_ws('|', {title('title')}, {company('company')})) AS semantic_key FROM {name}_c)"""
    )


RICHNESS = """(CASE WHEN length(description) > 20 THEN 2 ELSE 0 END
  + CASE WHEN coalesce(location, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(country, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(work_type, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(experience_level, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0 THEN 2 ELSE 0 END
  + CASE WHEN remote THEN 1 ELSE 0 END + len(skills))"""


def survivors(source: str) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, semantic_key
        ORDER BY {RICHNESS} DESC, arrival_idx) AS rn FROM {source}) WHERE rn = 1)"""


def unique(source: str) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint
        ORDER BY user_id, arrival_idx) AS rn FROM {source}) WHERE rn = 1)"""


# --- text, addresses, identity -----------------------------------------------------------------------

_ADDRESSES = """addresses AS (
  SELECT 'w' || page_id AS id, url FROM pages
  UNION ALL SELECT 'p' || p_partkey, CASE p_partkey % 8
    WHEN 0 THEN ' HTTPS://WWW.Jobs.Example.com:8443/A/' || p_partkey || '//?utm_source=x&B=c d&ref=y#top '
    WHEN 1 THEN 'http://user:pw@jobs.example.com/' || p_name || '/'
    WHEN 2 THEN 'not an address/' || p_brand || '//'
    WHEN 3 THEN 'https://jobs.example.com?source=a&Source=' || p_brand || '&&flag&x=1=2'
    WHEN 4 THEN 'ftp://www.files.example.com/a/./b/../c?gclid=1'
    WHEN 5 THEN 'https://jobs.example.com:99999/'
    WHEN 6 THEN 'http://bad host.com/' || p_partkey
    ELSE 'https://jobs.example.com/j?q=%41%2F&trk=' || p_partkey || '&name=~' END FROM part)"""
ORACLES["canonical_urls"] = f"""WITH {_ADDRESSES}, {canonical('addresses', 'url', 'canonical_url', 'c')}
SELECT id, url, canonical_url, sha256(canonical_url) AS url_fingerprint,
  parsed AND regexp_matches({trim('url')}, '^(?i:https?):') AS valid FROM c"""

_BOTH = """(SELECT 'w' AS origin, arrival_idx, title, company FROM postings_w
  UNION ALL SELECT 'p', arrival_idx, title, company FROM postings_p)"""
ORACLES["normalized_titles"] = f"{ctes('postings_p', 'postings_w')} SELECT origin, arrival_idx, {title('title')} AS title_norm FROM {_BOTH}"
ORACLES["normalized_companies"] = f"{ctes('postings_p', 'postings_w')} SELECT origin, arrival_idx, {company('company')} AS company_norm FROM {_BOTH}"
ORACLES["fingerprints"] = f"{ctes('postings_p')}, {identified()} SELECT arrival_idx, fingerprint, semantic_key FROM idp"
ORACLES["clean_pages"] = f"SELECT page_id, {clean('html')} AS body, substr({clean('html')}, 1, 400) AS brief FROM pages"

ORACLES["valid_recent_postings"] = f"""{ctes('postings_p')}, d AS (SELECT arrival_idx,
  CASE WHEN arrival_idx % 13 = 0 THEN '  ' ELSE title END AS title,
  CASE WHEN arrival_idx % 19 = 0 THEN '' ELSE company END AS company, source, url, scraped_at,
  CASE WHEN arrival_idx % 17 = 0 THEN 'invalid-url' WHEN arrival_idx % 23 = 0 THEN '' ELSE application_url END AS application_url,
  CASE WHEN arrival_idx % 29 = 0 THEN NULL ELSE publication_date END AS publication_date FROM postings_p)
SELECT arrival_idx, title, publication_date FROM d WHERE trim(title) <> '' AND trim(company) <> '' AND trim(source) <> ''
  AND regexp_matches(coalesce(nullif(application_url, ''), url), '^https?://[^/]+') AND publication_date IS NOT NULL
  AND scraped_at IS NOT NULL AND publication_date >= {TS} - INTERVAL 7 DAY"""

ORACLES["normalized_postings"] = f"""{ctes('postings_p')}, r AS (SELECT *,
  '  ' || title || CASE WHEN arrival_idx % 5 = 0 THEN ' remote ' ELSE ' ' END AS t2,
  CASE WHEN arrival_idx % 7 = 0 THEN '' ELSE ' ' || application_url END AS a2,
  CASE WHEN arrival_idx % 2 = 0 THEN remote END AS r2,
  '<p>' || description || '</p>  <b>&amp;</b> end <unclosed' AS d2 FROM postings_p)
SELECT arrival_idx, trim(t2) AS title, trim(company) AS company,
  CASE WHEN arrival_idx % 6 = 0 THEN 'other' ELSE source END AS source,
  trim(coalesce(nullif(a2, ''), url)) AS application_url, trim(coalesce(nullif(a2, ''), url)) AS url,
  trim(location) AS location, trim(country) AS country,
  coalesce(r2, coalesce(work_type = 'remote', false) OR regexp_matches(t2 || ' ' || coalesce(location, ''), '(?i)remote|عن بعد|telecommute')) AS remote,
  {clean('d2')} AS description,
  CASE WHEN arrival_idx % 3 <> 0 THEN coalesce(array_to_string(skills, '|'), '') ELSE '' END AS skills,
  CASE WHEN arrival_idx % 4 <> 0 THEN published_at WHEN arrival_idx % 8 = 0 THEN {TS}
    ELSE date_trunc('day', publication_date)::TIMESTAMP END AS publication_date,
  salary_min, scraped_at FROM r"""

ORACLES["parsed_dates"] = f"""WITH d AS (SELECT p_partkey, p_partkey % 9 AS k,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (p_partkey * 3607) AS moment FROM part),
e AS (SELECT p_partkey, k, moment, CASE WHEN k IN (0, 2, 3) THEN moment WHEN k = 4 THEN moment - INTERVAL 2 HOUR
  WHEN k IN (1, 7) THEN date_trunc('day', moment)::TIMESTAMP END AS parsed FROM d)
SELECT p_partkey, parsed, CASE WHEN k = 8 THEN moment ELSE coalesce(parsed, {TS}) END AS published FROM e"""

# --- duplicates --------------------------------------------------------------------------------------

ORACLES["richness"] = f"{ctes('postings_p')} SELECT arrival_idx, CAST({RICHNESS} AS INTEGER) AS richness FROM postings_p"
ORACLES["dedup_survivors"] = f"""{ctes('postings_p')}, {identified()} SELECT user_id, arrival_idx, title, company,
  application_url, fingerprint, coalesce(array_to_string(skills, '|'), '') AS skills, salary_min FROM {survivors('idp')}"""
ORACLES["dedup_duplicates"] = f"""{ctes('postings_p')}, {identified()} SELECT user_id, arrival_idx, title, company, semantic_key
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, semantic_key ORDER BY arrival_idx) AS rn FROM idp) WHERE rn > 1"""
ORACLES["dedup_pages"] = f"""{ctes('postings_w')}, {identified('postings_w')}, d AS (SELECT * EXCLUDE (description),
  {clean('description')} AS description FROM idp)
SELECT arrival_idx, title, company, fingerprint, description FROM (SELECT *, row_number() OVER (PARTITION BY semantic_key
  ORDER BY CASE WHEN length(description) > 20 THEN 2 ELSE 0 END DESC, arrival_idx) AS rn FROM d) WHERE rn = 1"""
ORACLES["global_unique"] = f"""{ctes('postings_p')}, {identified()}, s AS {survivors('idp')}
SELECT fingerprint, user_id, arrival_idx, title FROM {unique('s')}"""
ORACLES["posting_snapshot"] = f"""{ctes('postings_p')}, {identified()}, s AS {survivors('idp')}
SELECT fingerprint, title, company, {TS} AS written_at, {TS} + INTERVAL 24 HOUR AS expires_at, false AS deleted,
  'job:' || fingerprint AS state_key FROM {unique('s')}"""

# --- collecting --------------------------------------------------------------------------------------

_KEYWORDS = f"""list_transform(list_filter(list_concat([job_title], coalesce(skills, [])), lambda w: w <> ''),
  lambda w: {trim('lower(w)')})"""


def hits(profiles: str = "profiles", name: str = "hits") -> str:
    """CTE of (user_id, arrival_idx): all parts that contain a keyword of what a user of ``profiles`` searches for."""
    return f"""feed AS (SELECT * EXCLUDE (user_id), lower(concat_ws(' ', title, company, coalesce(array_to_string(skills, ' '), ''),
  coalesce(location, ''))) AS searched FROM postings_p),
kw AS (SELECT DISTINCT user_id, unnest({_KEYWORDS}) AS keyword FROM ({duck_sql('searches')}) WHERE user_id IN (SELECT user_id FROM {profiles})),
{name} AS (SELECT DISTINCT user_id, arrival_idx FROM kw JOIN feed ON contains(searched, keyword))"""


ORACLES["keyword_search_top20"] = f"""{ctes('postings_p', 'profiles')},
feed AS (SELECT *, lower(concat_ws(' ', title, company, coalesce(array_to_string(skills, ' '), ''), coalesce(location, ''))) AS searched
  FROM postings_p),
kw AS (SELECT DISTINCT user_id, unnest({_KEYWORDS}) AS keyword FROM profiles),
kh AS (SELECT keyword, arrival_idx FROM (SELECT DISTINCT keyword FROM kw) JOIN feed ON contains(searched, keyword))
SELECT user_id, arrival_idx FROM (SELECT user_id, arrival_idx, row_number() OVER (PARTITION BY user_id ORDER BY arrival_idx) AS rn
  FROM (SELECT DISTINCT user_id, arrival_idx FROM kw JOIN kh USING (keyword))) WHERE rn <= 20"""
ORACLES["keyword_search_pages"] = f"""WITH w AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, unnest([lower(
  ['tion', 'The ', 'queau', 'sch der', 'ng', 'ción para'][n_nationkey % 6 + 1]), 'e' || (n_nationkey % 9)]) AS keyword FROM nation),
b AS (SELECT page_id, lower({clean('html')}) AS body FROM pages)
SELECT DISTINCT user_id, page_id AS ordinal FROM w JOIN b ON contains(body, keyword)"""

_PART_AT = f"({TS} - INTERVAL '6' HOUR * p_size)"
_OK_DATE = f"CASE WHEN p_size % 7 = 0 THEN {TS} ELSE {_PART_AT} END"
_RAW_PLACE = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Remote, EU' ELSE 'City ' || p_size END"
_BODY = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'Join our ' || p_type || ' &nbsp;team' END"
_LINK = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'https://apply.example.com/' || p_partkey END"
_BRAND = "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END"
_FULL = "p_name || ' ' || p_type"
_FULL_OR_QUERY = f"CASE WHEN p_partkey % 10 = 0 THEN job_title ELSE {_FULL} END"
_QSKILLS = "coalesce(array_to_string(skills, '|'), '')"


def _requested(rank: int, where: str = "true") -> str:
    return f"""{ctes('profiles')}, items AS (SELECT *, floor(p_partkey / 1000.0)::BIGINT * 1000000 + row_number() OVER (
  PARTITION BY p_name, p_brand, floor(p_partkey / 1000.0) ORDER BY p_partkey) - 1 AS ordinal FROM part WHERE {where}),
j AS (SELECT *, {rank}::BIGINT * 17592186044416 + ordinal AS arrival_idx FROM items
  JOIN profiles ON p_name = job_title AND p_brand = profiles.location)"""


def _select(source: str, frm: str, *, title: str, company: str, url: str, location: str, country: str, remote: str,
            default_work: str, description: str, skills: str, published: str, work: str | None = None,
            low: str = "CAST(NULL AS DOUBLE)", high: str = "CAST(NULL AS DOUBLE)", currency: str = "CAST(NULL AS VARCHAR)") -> str:
    work = work or f"CASE WHEN ({remote}) THEN 'remote' ELSE coalesce(work_type, '{default_work}') END"
    return f"""SELECT user_id, arrival_idx, {title} AS title, {company} AS company, '{source}' AS source, {url} AS application_url,
  {location} AS location, {country} AS country, ({remote}) AS remote, {work} AS work_type,
  coalesce(experience_level, 'mid') AS experience_level, {description} AS description, {skills} AS skills,
  {published} AS publication_date, {low} AS salary_min, {high} AS salary_max, {currency} AS currency FROM {frm}"""


def _matches(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, '(?i){pattern}')"


def _arbeitnow() -> str:
    remote = "(p_size % 3 = 0)"
    searched = (f"lower(p_name || ' ' || coalesce({_BRAND}, '') || ' ' || p_type || ' ' || coalesce({_RAW_PLACE}, ''))")
    head = f"""WITH wide AS ({duck_sql('profiles')}),
profiles AS (SELECT w.* REPLACE (s.job_title AS job_title, s.skills AS skills) FROM wide w JOIN ({duck_sql('feed_searches')}) s USING (user_id)),
items AS (SELECT *, floor(p_partkey / 50.0)::BIGINT * 1000000 + p_partkey % 50 AS ordinal,
  {searched} AS searched FROM part WHERE p_partkey % 9 <> 0),
kw AS (SELECT DISTINCT user_id, unnest({_KEYWORDS}) AS keyword FROM profiles),
kh AS (SELECT keyword, ordinal FROM (SELECT DISTINCT keyword FROM kw) JOIN items ON contains(searched, keyword)),
hits AS (SELECT DISTINCT user_id, ordinal FROM kw JOIN kh USING (keyword)),
j AS (SELECT *, ordinal AS arrival_idx FROM hits JOIN items USING (ordinal) JOIN profiles USING (user_id))"""
    return head + _select(
        "arbeitnow", "j", title="p_name", company=f"coalesce({_BRAND}, 'Arbeitnow Employer')", url=_LINK,
        location=f"coalesce({_RAW_PLACE}, CASE WHEN {remote} THEN 'Remote (Worldwide)' ELSE 'Europe' END)",
        country=f"coalesce({_RAW_PLACE}, CASE WHEN {remote} THEN 'Remote' ELSE 'Europe' END)", remote=remote,
        default_work="hybrid", description=f"coalesce({_BODY}, p_name || ' at ' || coalesce({_BRAND}, ''))", skills="p_type",
        published=f"CASE WHEN p_partkey % 2 = 0 THEN {_PART_AT} ELSE {_OK_DATE} END",
    )


ORACLES["source_arbeitnow"] = _arbeitnow()
ORACLES["source_remotive"] = _requested(1) + _select(
    "remotive", "j", title=_FULL, company=f"coalesce({_BRAND}, 'Remote Company')", url=f"coalesce({_LINK}, 'https://remotive.com')",
    location=f"coalesce({_RAW_PLACE}, 'Remote (Worldwide)')", country=_RAW_PLACE, remote="true", default_work="",
    description=f"coalesce({_BODY}, '')", skills="CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END", published=_OK_DATE)
_AD_PLACE = f"coalesce({_RAW_PLACE}, 'United Kingdom')"
_AD_TITLE = f"trim({_FULL_OR_QUERY})"
ORACLES["source_adzuna"] = _requested(8) + _select(
    "adzuna", "j", title=_AD_TITLE, company=f"coalesce({_BRAND}, 'Adzuna Employer')", url=f"coalesce({_LINK}, 'https://www.adzuna.com')",
    location=_AD_PLACE, country="p_type", default_work="hybrid",
    remote=_matches(f"{_AD_TITLE} || ' ' || coalesce({_BODY}, '') || ' ' || {_AD_PLACE}", "remote|work from home|telecommute"),
    description=f"coalesce({_BODY}, {_AD_TITLE} || ' in ' || {_AD_PLACE})", skills=_QSKILLS, published=_OK_DATE,
    low="CASE WHEN p_size % 2 = 0 THEN p_size * 1000.0::DOUBLE END", currency="'GBP'")
_JO_PLACE = f"coalesce({_RAW_PLACE}, 'Remote')"
ORACLES["source_jooble"] = _requested(9, "p_brand <> 'Brand#3'") + _select(
    "jooble", "j", title=_AD_TITLE,
    company=f"coalesce({_BRAND}, CASE WHEN p_partkey % 12 = 0 THEN 'Jooble Employer' ELSE 'board' END)",
    url=f"coalesce({_LINK}, 'https://jooble.org')", location=_JO_PLACE, country=_JO_PLACE, default_work="hybrid",
    remote=_matches(f"{_AD_TITLE} || ' ' || {_JO_PLACE} || ' ' || coalesce({_BODY}, '')", "remote|عن بعد|telecommute"),
    description=f"coalesce({_BODY}, {_AD_TITLE} || ' at ' || coalesce({_BRAND}, 'Employer'))", skills=_QSKILLS, published=_OK_DATE)
_FC_PLACE = f"coalesce({_RAW_PLACE}, location, 'Worldwide')"
_FC_REMOTE = f"coalesce(work_type = 'remote', false) OR {_matches(f'''p_name || ' ' || {_FC_PLACE}''', 'remote|عن بعد')}"
ORACLES["source_firecrawl"] = _requested(10) + _select(
    "linkedin", "j", title="p_name", company=_BRAND, url="CASE WHEN p_partkey % 9 = 0 THEN 'https://www.linkedin.com/jobs' ELSE 'https://apply.example.com/' || p_partkey END",
    location=_FC_PLACE, country=_FC_PLACE, remote=_FC_REMOTE, default_work="hybrid",
    description=f"CASE WHEN p_size % 5 = 0 THEN p_name || ' at ' || {_BRAND} || ' in ' || {_FC_PLACE} ELSE 'About ' || p_type END",
    skills=_QSKILLS, published=TS) + " WHERE p_partkey % 6 <> 0"
ORACLES["source_jsearch"] = _requested(11) + _select(
    "linkedin", "j", title=_FULL_OR_QUERY, company=f"coalesce({_BRAND}, 'LinkedIn Employer')",
    url=f"coalesce({_LINK}, 'https://g.example.com/' || p_partkey)",
    location=f"coalesce({_RAW_PLACE}, CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE 'Worldwide' END)",
    country="CASE WHEN p_size % 2 = 0 THEN 'US' END", remote="p_size % 3 = 0", default_work="on-site",
    description=f"CASE WHEN p_size % 5 <> 0 THEN p_type WHEN p_partkey % 10 = 0 THEN '' ELSE {_FULL} END",
    skills=f"CASE WHEN p_size % 2 = 0 THEN {_QSKILLS} ELSE p_type END", published=_OK_DATE)
_LOT_USERS = """SELECT * EXCLUDE (job_title, skills), 'Lot ' || (user_id % 997) || ' ' AS job_title,
  CASE WHEN user_id % 5 = 0 THEN ['Lot ' || (user_id % 997) || ' '] END AS skills FROM profiles"""
ORACLES["source_weworkremotely"] = f"""{ctes('profiles')}, u AS ({_LOT_USERS}),
j AS (SELECT *, 2::BIGINT * 17592186044416 + floor(p_partkey / 50.0)::BIGINT * 1000000 + p_partkey % 50 AS arrival_idx
  FROM part JOIN u ON p_partkey % 997 = user_id % 997)""" + _select(
    "we_work_remotely", "j", title="p_name", company="CASE WHEN p_partkey % 6 = 0 THEN 'We Work Remotely' ELSE p_brand END",
    url="'https://wwr.example.com/' || p_partkey", location="'Remote'", country="CAST(NULL AS VARCHAR)", remote="true",
    default_work="", description="'Lot ' || (p_partkey % 997) || ' in stock'", skills=_QSKILLS, published=_OK_DATE)
_AMP = "p_name || ' & ' || p_type"
ORACLES["source_mostaql"] = _requested(3) + _select(
    "mostaqel", "j", title=_AMP, company="'مستقل (مشروع فريلانس)'", url="'https://mostaql.com/project/' || p_partkey",
    location="'عن بعد (Freelance)'", country="'الشرق الأوسط / عن بعد'", remote="true", default_work="",
    description="p_type || ' work'", skills=_QSKILLS, published=TS)


def _site(rank: int, source: str, employer: str, region: str, url: str, body: str | None = None) -> str:
    place = f"coalesce({_RAW_PLACE}, location, '{region}')"
    who = f"coalesce({_BRAND}, '{employer}')"
    seen = f"{_AMP} || ' ' || {place}" + (f" || ' ' || {body}" if body else "")
    return _requested(rank) + _select(
        source, "j", title=_AMP, company=who, url=url, location=place, country=place,
        remote=f"coalesce(work_type = 'remote', false) OR {_matches(seen, 'remote|عن بعد')}", default_work="on-site",
        description=body or f"{_AMP} || ' at ' || {who} || ' in ' || {place}", skills=_QSKILLS, published=TS)


ORACLES["source_tanqeeb"] = _site(4, "tanqeeb", "Tanqeeb Employer", "Middle East", "'https://www.tanqeeb.com/jobs/' || p_partkey", "'Remote work possible'")
ORACLES["source_bayt"] = _site(5, "bayt", "Bayt Employer", "Middle East", "'https://www.bayt.com/en/jobs/' || p_partkey")
ORACLES["source_wuzzuf"] = _site(6, "wuzzuf", "Wuzzuf Employer", "Egypt", "'https://wuzzuf.net/jobs/' || p_partkey")
ORACLES["source_forasna"] = _site(7, "forasna", "فرصنا Employer", "Egypt", "'https://forasna.com/j/' || p_partkey")

ORACLES["navigation_listings"] = """WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
  '<li><a href="([^"]*)">([^<]*)</a></li>', 0) AS items FROM pages),
e AS (SELECT page_id, generate_subscripts(items, 1) - 1 AS i, unnest(items) AS item FROM n),
f AS (SELECT page_id, i, regexp_extract(item, 'href="([^"]*)"', 1) AS link, regexp_extract(item, '>([^<]*)</a>', 1) AS title FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM f WHERE trim(title) <> '' AND link <> '')
SELECT page_id, CAST(rn - 1 AS INTEGER) AS pos,
  trim(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title,
  replace(replace(replace(replace(link, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS link
FROM g"""

_UNION_SOURCES = ["arbeitnow", "remotive", "weworkremotely", "mostaql", "tanqeeb", "bayt", "wuzzuf", "forasna", "adzuna", "jooble", "jsearch"]
ORACLES["source_union_counts"] = "SELECT source, count(*) AS n, count(DISTINCT user_id) AS users, min(arrival_idx) AS first FROM (" + (
    " UNION ALL ".join(f"(SELECT user_id, source, arrival_idx FROM ({ORACLES[f'source_{n}']}))" for n in _UNION_SOURCES)
) + ") GROUP BY source"
_RANKED = [("arbeitnow", 0), ("remotive", 1), ("we_work_remotely", 2), ("mostaqel", 3), ("tanqeeb", 4), ("bayt", 5), ("wuzzuf", 6),
           ("forasna", 7), ("adzuna", 8), ("jooble", 9), ("linkedin", 11)]
_STATUS = f"""WITH s(source, source_rank) AS (VALUES {', '.join(f"('{n}', {r})" for n, r in _RANKED)}),
feeds AS (SELECT count(DISTINCT floor(p_partkey / 50.0)) AS n FROM part),
asks AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_brand = 'Brand#3') AS bad FROM (
  SELECT DISTINCT p_name, p_brand, floor(p_partkey / 1000.0) FROM part)),
status AS (SELECT source, source_rank, CASE WHEN source IN ('arbeitnow', 'we_work_remotely') THEN feeds.n ELSE asks.n END AS payloads,
  CASE WHEN source = 'jooble' THEN asks.bad ELSE 0 END AS unreadable FROM s, feeds, asks)"""
ORACLES["source_status"] = f"{_STATUS} SELECT source, source_rank, payloads, unreadable, payloads = 0 OR unreadable > 0 AS failed FROM status"
ORACLES["source_health"] = f"""{_STATUS} SELECT string_agg(source, '|' ORDER BY source_rank) AS active,
  coalesce(string_agg(source, '|' ORDER BY source_rank) FILTER (WHERE unreadable > 0), '') AS failed_last_run, count(*) AS total_count FROM status"""


def _requests() -> str:
    t = "replace(job_title, ' ', '%20')"
    place = "replace(location, '#', '%23')"
    none = "CAST(NULL AS VARCHAR)"
    rows = [
        ("arbeitnow", 0, "'https://www.arbeitnow.com/api/job-board-api'", none),
        ("remotive", 1, f"'https://remotive.com/api/remote-jobs?search=' || {t}", none),
        ("weworkremotely", 2, "'https://weworkremotely.com/categories/remote-programming-jobs.rss'", none),
        ("mostaql", 3, f"'https://mostaql.com/projects?filter[query]=' || {t}", none),
        ("tanqeeb", 4, f"'https://www.tanqeeb.com/en/jobs/search?keywords=' || {t}", none),
        ("bayt", 5, f"'https://www.bayt.com/en/jobs/?q=' || {t}", none),
        ("wuzzuf", 6, f"'https://wuzzuf.net/search/jobs/?q=' || {t}", none),
        ("forasna", 7, f"'https://forasna.com/jobs/search?q=' || {t}", none),
        ("adzuna", 8, f"'https://api.adzuna.com/v1/api/jobs/gb/search/1?what=' || {t} || '&content-type=application/json&results_per_page=20'", none),
        ("jooble", 9, "'https://jooble.org/api'", """'{"keywords":"' || job_title || '","location":"' || location || '","page":1}'"""),
        ("jsearch", 11, f"'https://jsearch.p.rapidapi.com/search-v2?query=' || {t} || '%20in%20' || {place}", none),
    ]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS source, {r} AS source_rank, {u} AS url, {b} AS body FROM profiles" for n, r, u, b in rows
    )


ORACLES["request_table"] = f"{ctes('profiles')} SELECT source, source_rank, url, body, count(*) AS n_users FROM ({_requests()}) GROUP BY ALL"

# --- matching ----------------------------------------------------------------------------------------


def fits(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def _count(offered: str) -> str:
    return f"coalesce(len(list_filter(ps, lambda w: len(list_filter({offered}, lambda o: {fits('o', 'w')})) > 0)), 0)"


def _n(e: str) -> str:
    return f"CASE WHEN {e} THEN"


SCORED = f"""
pf AS (SELECT user_id, {form("nullif(job_title, '')")} AS pt, list_transform(skills, lambda s: {form('s')}) AS ps,
  {form("nullif(experience_level, '')")} AS pl, nullif(work_type, '') AS pwr, {form("nullif(work_type, '')")} AS pw FROM profiles),
jf AS (SELECT arrival_idx AS k, {form('title')} AS mt, list_transform(skills, lambda s: {form('s')}) AS ms,
  {form("nullif(experience_level, '')")} AS ml, {form("nullif(work_type, '')")} AS mw FROM postings_p),
an AS (SELECT fingerprint, {form('role')} AS ar, list_transform(skills, lambda s: {form('s')}) AS sk, {form('level')} AS al,
  {form("nullif(work_type, '')")} AS aw FROM (SELECT a.*, i.fingerprint, row_number() OVER (PARTITION BY i.fingerprint
  ORDER BY written_at DESC) AS rn FROM analysed_parts a JOIN idp i ON i.arrival_idx = a.p_partkey
  WHERE written_at <= {TS} AND written_at > {TS} - INTERVAL 7 DAY) WHERE rn = 1),
base AS (SELECT h.user_id, i.* EXCLUDE (user_id), pf.* EXCLUDE (user_id), jf.*, an.* EXCLUDE (fingerprint), an.fingerprint IS NOT NULL AS analysed
  FROM hits h JOIN idp i USING (arrival_idx) JOIN pf ON pf.user_id = h.user_id JOIN jf ON jf.k = i.arrival_idx
  LEFT JOIN an ON an.fingerprint = i.fingerprint),
parts AS (SELECT *, coalesce({fits('mt', 'pt')}, false) AS r_role, {_count('ms')} AS r_n,
  coalesce({fits('ml', 'pl')}, false) AS r_level, pl IS NOT NULL AND ml IS NOT NULL AS both_levels,
  coalesce(pwr = 'any', false) AS any_work, coalesce({fits('mw', 'pw')}, false) AS r_work, coalesce(pwr = 'remote' AND remote, false) AS r_remote,
  coalesce({fits('ar', 'pt')}, false) AS a_role, {_count('sk')} AS a_n, coalesce({fits('al', 'pl')}, false) AS a_level,
  coalesce({fits('aw', 'pw')}, false) AS a_work FROM base),
both_scores AS (SELECT *,
  CAST(least(100, CASE WHEN r_role THEN 35 ELSE 0 END + least(30, 10 * r_n)
    + CASE WHEN r_level THEN 20 WHEN both_levels THEN -15 ELSE 0 END
    + CASE WHEN any_work OR r_work OR r_remote THEN 15 ELSE 0 END) AS INTEGER) AS rule,
  coalesce(nullif(concat_ws(', ', CASE WHEN r_role THEN '{R.ROLE_REASON}' END, CASE WHEN r_n > 0 THEN r_n || '{R.SKILL_REASON}' END,
    CASE WHEN r_level THEN '{R.LEVEL_REASON}' WHEN both_levels THEN '{R.LEVEL_MISMATCH_REASON}' END,
    CASE WHEN any_work THEN '{R.WORK_ANY_REASON}' WHEN r_work THEN '{R.WORK_REASON}' WHEN r_remote THEN '{R.REMOTE_REASON}' END), ''),
    '{R.RULE_DEFAULT_REASON}') AS rule_reason,
  CAST(least(100, CASE WHEN a_role THEN 35 ELSE 0 END + least(30, 10 * a_n) + CASE WHEN a_level THEN 20 ELSE 0 END
    + CASE WHEN any_work OR a_work THEN 15 ELSE 0 END) AS INTEGER) AS ana,
  coalesce(nullif(concat_ws(', ', CASE WHEN a_role THEN '{R.ROLE_REASON}' END, CASE WHEN a_n > 0 THEN a_n || '{R.SKILL_REASON}' END,
    CASE WHEN a_level THEN '{R.LEVEL_REASON}' END,
    CASE WHEN any_work THEN '{R.WORK_ANY_REASON}' WHEN a_work THEN '{R.WORK_REASON}' END), ''), '{R.ANALYSIS_DEFAULT_REASON}') AS ana_reason
  FROM parts),
scored AS (SELECT *, CASE WHEN analysed THEN ana ELSE rule END AS score, CASE WHEN analysed THEN ana_reason ELSE rule_reason END AS reason
  FROM both_scores)"""
_MATCH = f"{ctes('postings_p', 'profiles', 'analysed_parts', 'sent_parts')}, {identified()}, {hits()}, {SCORED}"


def sent(at: str = TS) -> str:
    return f"""sent AS (SELECT DISTINCT s.user_id, i.fingerprint FROM sent_parts s JOIN idp i ON i.arrival_idx = s.l_partkey
  WHERE sent_at > {at} - INTERVAL 30 DAY AND sent_at <= {at})"""


FRESH = f"{sent()}, fresh AS (SELECT * FROM scored WHERE score >= 40 AND (user_id, fingerprint) NOT IN (SELECT (user_id, fingerprint) FROM sent))"
MESSAGE = """'💼 ' || title || chr(10) || chr(10) || '🏢 Company: ' || company || chr(10) || chr(10)
  || coalesce('🌍 ' || nullif(location, ''), '') || chr(10) || coalesce('📍 ' || nullif(country, ''), '') || chr(10) || chr(10)
  || '🌐 Source: ' || source || chr(10) || chr(10) || '🎯 Match: ' || score || '%'"""
_OUTBOX = f"""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, arrival_idx) AS INTEGER) AS seq,
  'match' AS kind, {MESSAGE} AS text, '{BUTTON_TEXT}' AS button_text, application_url AS button_url, fingerprint"""

ORACLES["rule_scores"] = f"{_MATCH} SELECT user_id, arrival_idx, rule AS score, rule_reason AS reason FROM scored"
ORACLES["analysis_scores"] = f"{_MATCH} SELECT user_id, arrival_idx, score, reason FROM scored WHERE analysed"
ORACLES["best_matches"] = f"""{_MATCH} SELECT user_id, arrival_idx, score, reason, analysed, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY score DESC, arrival_idx) AS INTEGER) AS rank FROM scored WHERE score >= 40"""
ORACLES["unsent_matches"] = f"{_MATCH}, {FRESH} SELECT user_id, arrival_idx, score, fingerprint FROM fresh"
ORACLES["sent_log_rows"] = f"""{_MATCH}, {FRESH} SELECT user_id, fingerprint, {TS} AS sent_at, arg_min(title, arrival_idx) AS job_title,
  arg_min(company, arrival_idx) AS company, 'user:' || user_id || ':sent:' || fingerprint AS state_key FROM fresh GROUP BY user_id, fingerprint"""
ORACLES["outbox_messages"] = f"{_MATCH}, {FRESH} {_OUTBOX} FROM fresh"
ORACLES["analysis_misses"] = f"""{ctes('postings_p', 'analysed_parts')}, {identified()}, live AS (SELECT i.fingerprint FROM analysed_parts a
  JOIN idp i ON i.arrival_idx = a.p_partkey WHERE written_at <= {TS} AND written_at > {TS} - INTERVAL 7 DAY)
SELECT fingerprint, arrival_idx FROM {unique('idp')} WHERE fingerprint NOT IN (SELECT fingerprint FROM live)"""



def _words(e: str, named: dict[str, list[str]], otherwise: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains({e}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in named.items())
    return f"CASE {arms} ELSE {otherwise} END"


_COST = "len(title) + len(company) + coalesce(len(location), 0) + coalesce(len(description), 0) + coalesce(len(array_to_string(skills, ' ')), 0)"
_BUDGET = f"""{ctes('postings_p', 'analysed_parts')}, {identified()}, live AS (SELECT i.fingerprint FROM analysed_parts a
  JOIN idp i ON i.arrival_idx = a.p_partkey WHERE written_at <= {TS} AND written_at > {TS} - INTERVAL 7 DAY),
misses AS (SELECT *, {_COST} AS cost, lower(concat_ws(' ', title, coalesce(description, ''), '')) AS said FROM {unique('idp')}
  WHERE fingerprint NOT IN (SELECT fingerprint FROM live)),
spent AS (SELECT *, sum(cost) OVER (ORDER BY user_id, arrival_idx) AS spent, sum(cost) OVER () // 2 AS budget FROM misses)"""
PART_WORDS = (
    {"metalwork": ["anvil", "gear", "bolt"], "fitting": ["ring", "rod", "plate"], "gadget": ["widget", "gizmo"]},
    {"senior": ["old", "large"], "junior": ["new", "small"]}, {"hybrid": ["hot", "cold"], "remote": ["remote"]},
)
ORACLES["analysed_postings"] = f"""{_BUDGET} SELECT fingerprint, {_words('said', PART_WORDS[0], "'other'")} AS role,
  {_words('said', PART_WORDS[1], "coalesce(experience_level, 'unknown')")} AS level, coalesce(array_to_string(list_transform(skills, lambda s: trim(s)), '|'), '') AS skills,
  {_words("lower(said || ' ' || coalesce(location, ''))", PART_WORDS[2], "coalesce(work_type, 'any')")} AS work_type, {TS} AS written_at
FROM spent WHERE spent <= budget"""
ORACLES["skipped_analyses"] = f"{_BUDGET} SELECT fingerprint, user_id, arrival_idx, CAST(cost AS BIGINT) AS cost, 'cost' AS reason FROM spent WHERE spent > budget"

_FENCED = f"{trim('''regexp_replace(regexp_replace(response, '^(?i:```(?:json)?)' || '{WS}' || '*', ''), '{WS}' || '*```$', '')''')}".replace("{WS}", WS_CLASS)
_NUMERIC = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
ORACLES["parsed_match_responses"] = f"""{ctes('match_responses')}, c AS (SELECT doc_id, response, {_FENCED} AS t FROM match_responses),
d AS (SELECT doc_id, response, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM c),
e AS (SELECT doc_id, j, CASE WHEN response = '' THEN '{MATCH_ERRORS['empty']}' WHEN NOT ok THEN '{MATCH_ERRORS['json']}'
  WHEN json_type(j) <> 'OBJECT' OR NOT json_exists(j, '$.score') OR NOT json_exists(j, '$.reason') THEN '{MATCH_ERRORS['shape']}'
  WHEN json_type(j, '$.score') NOT IN {_NUMERIC} OR CAST(j->>'$.score' AS DOUBLE) NOT BETWEEN 0 AND 100 THEN '{MATCH_ERRORS['score']}'
  WHEN json_type(j, '$.reason') <> 'VARCHAR' THEN '{MATCH_ERRORS['reason']}' END AS error FROM d)
SELECT doc_id, error, CASE WHEN error IS NULL THEN CAST(j->>'$.score' AS DOUBLE) END AS score,
  CASE WHEN error IS NULL THEN j->>'$.reason' END AS reason FROM e"""
ORACLES["parsed_analysis_responses"] = f"""{ctes('analysis_responses')}, c AS (SELECT doc_id, response, {_FENCED} AS t FROM analysis_responses),
d AS (SELECT doc_id, response, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM c),
e AS (SELECT doc_id, j, CASE WHEN response = '' THEN '{ANALYSIS_ERRORS['empty']}' WHEN NOT ok THEN '{ANALYSIS_ERRORS['json']}'
  WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN '{ANALYSIS_ERRORS['shape']}'
  WHEN NOT coalesce(json_type(j, '$.role') = 'VARCHAR' AND json_type(j, '$.experienceLevel') = 'VARCHAR' AND json_type(j, '$.workType') = 'VARCHAR'
    AND json_type(j, '$.summary') = 'VARCHAR' AND json_type(j, '$.skills') = 'ARRAY', false) THEN '{ANALYSIS_ERRORS['structure']}'
  WHEN len(list_filter(json_type(j, '$.skills[*]'), lambda x: x <> 'VARCHAR')) > 0 THEN '{ANALYSIS_ERRORS['skills']}' END AS error FROM d),
f AS (SELECT *, lower(trim(j->>'$.workType')) AS w FROM e)
SELECT doc_id, error, CASE WHEN error IS NULL THEN j->>'$.role' END AS role, CASE WHEN error IS NULL THEN j->>'$.experienceLevel' END AS level,
  CASE WHEN error IS NULL THEN coalesce(array_to_string(j->>'$.skills[*]', '|'), '') END AS skills,
  CASE WHEN error IS NULL THEN CASE WHEN w IN ('remote', 'hybrid') THEN w WHEN w IN ('on-site', 'onsite') THEN 'on-site' ELSE 'any' END END AS work_type,
  CASE WHEN error IS NULL THEN j->>'$.summary' END AS summary FROM f"""

# --- preferences, schedule, state --------------------------------------------------------------------

_TITLE_OK = f"coalesce(length({squeeze('job_title')}) BETWEEN 2 AND 100, false)"
_WORK_OK = "coalesce(work_type IN ('remote', 'hybrid', 'on-site', 'any'), false)"
_LEVEL_OK = "coalesce(experience_level IN ('intern', 'junior', 'mid', 'senior', 'lead', 'any'), false)"
_CREATED = f"""created AS (SELECT user_id, {squeeze('job_title')} AS job_title, work_type, experience_level,
  CASE WHEN lower({squeeze('location')}) NOT IN ('', 'any') THEN {squeeze('location')} END AS location,
  list_filter(list_transform(string_split(nullif(skills, ''), ','), lambda s: {trim('s')}), lambda s: s <> '') AS skills,
  coalesce(nullif(timezone, ''), 'Asia/Gaza') AS timezone, coalesce(notification_times, ['09:00', '21:00']) AS notification_times,
  CASE WHEN NOT {_TITLE_OK} THEN 'Invalid job title' WHEN NOT {_WORK_OK} THEN 'Invalid work type'
    WHEN NOT {_LEVEL_OK} THEN 'Invalid experience level' END AS error FROM raw_preferences)"""
ORACLES["created_preferences"] = f"""{ctes('raw_preferences')}, {_CREATED} SELECT * EXCLUDE (skills, notification_times),
  array_to_string(skills, '|') AS skills, array_to_string(notification_times, '|') AS notification_times FROM created"""
ORACLES["preference_checks"] = f"""{ctes('raw_preferences')} SELECT user_id, {_TITLE_OK} AS title_ok, {_WORK_OK} AS work_ok,
  {_LEVEL_OK} AS level_ok FROM raw_preferences"""


def subscribers(where: str = "true") -> str:
    return f"""(SELECT user_id FROM (SELECT user_id, action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn
  FROM subscription_log WHERE {where}) WHERE rn = 1 AND action = 'add')"""


ORACLES["active_subscribers"] = f"{ctes('subscription_log')} SELECT user_id FROM {subscribers()}"
_LOG = """versions AS (SELECT user_id, event_type, value, event_id AS version, ts AS written_at,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '1' DAY * (event_id % 20) END AS expires_at, event_id % 7 = 0 AS deleted FROM events)"""
_LIVE = f"""live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY written_at DESC, version DESC) AS rn
  FROM versions WHERE written_at <= {TS}) WHERE rn = 1 AND NOT deleted AND (expires_at IS NULL OR expires_at > {TS}))"""
ORACLES["live_state"] = f"WITH {_LOG}, {_LIVE} SELECT user_id, event_type, value, version, written_at FROM live"
ORACLES["folded_state"] = ORACLES["live_state"]
ORACLES["claim_if_absent"] = f"""WITH {_LOG}, {_LIVE}, c AS (SELECT user_id % 200 AS user_id, event_type, value, event_id AS version,
  row_number() OVER (PARTITION BY user_id % 200, event_type ORDER BY event_id) AS rn FROM events)
SELECT user_id, event_type, value, version, {TS} AS written_at, {TS} + INTERVAL 36 HOUR AS expires_at, false AS deleted FROM c
WHERE rn = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM live)"""
ORACLES["deleted_state"] = f"""WITH {_LOG}, live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY written_at DESC, version DESC) AS rn FROM versions WHERE written_at <= {TS} + INTERVAL 1 SECOND) WHERE rn = 1 AND NOT deleted
  AND (expires_at IS NULL OR expires_at > {TS} + INTERVAL 1 SECOND)),
old AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY written_at DESC, version DESC) AS rn
  FROM versions WHERE written_at <= {TS}) WHERE rn = 1 AND NOT deleted AND (expires_at IS NULL OR expires_at > {TS}) AND event_type = 'click')
SELECT event_type, count(*) AS n FROM live WHERE written_at > {TS} OR (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM old)
GROUP BY event_type"""
_SAVED = f"""{ctes('raw_preferences')}, {_CREATED}, saved AS (SELECT * EXCLUDE (error) FROM created WHERE error IS NULL),
patches AS (SELECT o_custkey AS user_id, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'senior' END AS experience_level,
  CASE WHEN max(o_orderkey) % 3 = 0 THEN max(o_orderpriority) END AS location FROM orders GROUP BY o_custkey)"""
ORACLES["patched_preferences"] = f"""{_SAVED} SELECT user_id, job_title, coalesce(p.experience_level, s.experience_level) AS experience_level,
  coalesce(p.location, s.location) AS location, timezone FROM saved s JOIN patches p USING (user_id)"""
ORACLES["rejected_patches"] = f"""{_SAVED} SELECT *, 'User preferences not found' AS error FROM patches
  WHERE user_id NOT IN (SELECT user_id FROM saved)"""
ORACLES["saved_preferences"] = f"{_SAVED} SELECT user_id, job_title, work_type FROM saved"

_ZONE = "CASE WHEN timezone = 'Not/AZone' THEN 'Asia/Gaza' ELSE timezone END"


def local(at: str, zone: str) -> str:
    return f"timezone({zone}, timezone('UTC', {at}))"


def utc(clock: str, zone: str) -> str:
    return f"timezone('UTC', timezone({zone}, {clock}))"


_MOMENTS = f"""moments AS (SELECT event_id, user_id, ts AS moment, {_ZONE} AS zone, notification_times AS times,
  {local('ts', _ZONE)} AS clock FROM events JOIN profiles USING (user_id))"""
_SLOT_PARTS = """coalesce(CASE WHEN trim(split_part(t, ':', 1)) = '' THEN 0 END, try_cast(trim(split_part(t, ':', 1)) AS INTEGER), 9) * 60
  + coalesce(CASE WHEN trim(split_part(t, ':', 2)) = '' THEN 0 END, try_cast(trim(split_part(t, ':', 2)) AS INTEGER), 0)"""


def next_times(source: str) -> str:
    return f"""cand AS (SELECT *, date_trunc('day', clock)::TIMESTAMP + INTERVAL 1 MINUTE * ({_SLOT_PARTS}) AS slot
  FROM (SELECT *, unnest(times) AS t FROM {source})),
nexts AS (SELECT *, CASE WHEN {utc('slot', 'zone')} <= moment THEN {utc('slot + INTERVAL 1 DAY', 'zone')} ELSE {utc('slot', 'zone')} END AS next_time FROM cand)"""


ORACLES["next_notifications"] = f"""{ctes('profiles')}, {_MOMENTS}, {next_times('moments')}
SELECT event_id, user_id, min(next_time) AS next_time FROM nexts GROUP BY event_id, user_id"""


def slots(source: str) -> str:
    return f"""slots AS (SELECT *, {utc('''date_trunc('day', clock)::TIMESTAMP + INTERVAL 1 DAY * d + INTERVAL 1 MINUTE *
  (CAST(split_part(t, ':', 1) AS INTEGER) * 60 + CAST(split_part(t, ':', 2) AS INTEGER))''', 'zone')} AS slot
  FROM (SELECT *, unnest(times) AS t FROM {source}), (VALUES (0), (-1)) AS days(d)
  WHERE regexp_matches(t, '^([01]?\\d|2[0-3]):[0-5]\\d$')),
latest AS (SELECT event_id, user_id, moment, zone, max(slot) FILTER (WHERE slot <= moment) AS slot FROM slots GROUP BY ALL)"""


_SLOT_KEY = f"strftime({local('slot', 'zone')}, '%Y-%m-%d-%H%M')"
ORACLES["latest_slots"] = f"""{ctes('profiles')}, {_MOMENTS}, {slots('moments')}
SELECT event_id, user_id, {_SLOT_KEY} AS slot_key,
  CAST(floor((epoch_us(moment) - epoch_us(slot)) / 60000000.0) AS INTEGER) AS lag_minutes FROM moments LEFT JOIN latest USING (event_id, user_id, moment, zone)"""
ORACLES["due_users"] = f"""{ctes('profiles')}, m AS (SELECT event_id, user_id, {_ZONE} AS zone, notification_times AS times,
  TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800) AS moment FROM events JOIN profiles USING (user_id))
SELECT event_id, user_id, moment FROM m WHERE list_contains(times, strftime({local('moment', 'zone')}, '%H:%M'))"""
_SEVEN = "TIMESTAMP '2024-01-30 07:00:00'"
_DUE_NOW = f"(SELECT user_id FROM profiles WHERE list_contains(notification_times, strftime({local(_SEVEN, _ZONE)}, '%H:%M')))"
ORACLES["due_now"] = f"{ctes('profiles')} SELECT user_id FROM {_DUE_NOW}"
ORACLES["earliest_run"] = f"""{ctes('profiles', 'subscription_log')}, people AS (
  SELECT {_ZONE} AS zone, notification_times AS times FROM profiles WHERE user_id IN (SELECT user_id FROM {subscribers()})
  UNION ALL SELECT 'Asia/Gaza', ['09:00', '21:00']),
m AS (SELECT *, {TS} AS moment, {local(TS, 'zone')} AS clock FROM people), {next_times('m')}
SELECT min(next_time) AS next_run FROM nexts"""
_LATE = "TIMESTAMP '2024-01-30 19:05:00'"
ORACLES["slot_claims"] = f"""{ctes('profiles')}, m AS (SELECT user_id AS event_id, user_id, {_LATE} AS moment, timezone, {_ZONE} AS zone,
  notification_times AS times, {local(_LATE, _ZONE)} AS clock FROM profiles), {slots('m')},
s AS (SELECT DISTINCT timezone || ':' || {_SLOT_KEY} AS slot_key, floor((epoch_us(moment) - epoch_us(slot)) / 60000000.0) AS lag
  FROM latest JOIN m USING (event_id, user_id, moment, zone) WHERE slot IS NOT NULL),
held AS (SELECT timezone || ':2024-01-30-2100' AS slot_key FROM profiles WHERE user_id % 50 = 0 AND user_id % 72 < 36)
SELECT slot_key, 'scheduled' AS mode, {_LATE} AS claimed_at FROM s WHERE lag <= 300 AND slot_key NOT IN (SELECT slot_key FROM held)"""

ORACLES["claimed_slots"] = f"SELECT slot_key, 1 AS winners, 1 AS number FROM ({ORACLES['slot_claims']})"

# --- whole runs --------------------------------------------------------------------------------------


def run(at: str, users: str = "true") -> str:
    """CTEs of a whole run: subs, people, recent, matched (flags good and fresh), outcomes."""
    views = ctes("postings_p", "analysed_parts", "sent_parts", "subscription_log")
    return f"""{views}, all_profiles AS ({duck_sql('profiles')}),
due AS (SELECT user_id FROM all_profiles WHERE {users}),
subs AS (SELECT user_id FROM {subscribers()} WHERE {'true' if users == 'true' else 'user_id IN (SELECT user_id FROM due) AND user_id % 7 <> 3'}),
profiles AS (SELECT * FROM all_profiles WHERE user_id % 7 <> 3 AND user_id IN (SELECT user_id FROM subs)),
{identified()}, {hits(name='all_hits')},
hits AS (SELECT h.* FROM all_hits h JOIN postings_p p USING (arrival_idx) WHERE publication_date >= {at} - INTERVAL 7 DAY AND h.user_id % 41 <> 5),
{SCORED.replace(TS, at)}, kept AS {survivors('scored')}, {sent(at)},
matched AS (SELECT k.*, score >= 40 AS good, score >= 40 AND s.user_id IS NULL AS fresh FROM kept k
  LEFT JOIN sent s ON s.user_id = k.user_id AND s.fingerprint = k.fingerprint),
outcomes AS (SELECT s.user_id, p.user_id IS NOT NULL AS has_preferences, coalesce(c.n, 0) AS collected, coalesce(m.n, 0) AS matched,
  coalesce(m.good, 0) AS good, coalesce(m.fresh, 0) AS fresh, p.user_id IS NOT NULL AND s.user_id % 41 = 5 AS failed
  FROM subs s LEFT JOIN profiles p USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM hits GROUP BY user_id) c USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE fresh) AS fresh
    FROM matched GROUP BY user_id) m USING (user_id)),
told AS (SELECT * EXCLUDE (failed, broken), broken AS failed, CASE WHEN NOT has_preferences THEN 'skipped_no_preferences' WHEN broken THEN 'error'
  WHEN fresh > 0 THEN 'sent_jobs' ELSE 'no_match' END AS outcome, has_preferences AND (broken OR good = 0) AS tell_no_match
  FROM (SELECT *, user_id % 41 = 5 AND user_id % 7 <> 3 AND user_id IN (SELECT user_id FROM all_profiles) AS broken FROM outcomes))"""


_NO_MATCH = NO_MATCH_TEXT.replace("'", "''").replace("\n", "' || chr(10) || '")
ORACLES["pipeline_outbox"] = f"""{run(TS)} {_OUTBOX} FROM matched WHERE fresh
UNION ALL SELECT user_id, 1, 'no_match', '{_NO_MATCH}', NULL, NULL, NULL FROM told WHERE tell_no_match"""
ORACLES["streamed_matches"] = f"{run(TS)} SELECT user_id, seq, text, button_url, fingerprint FROM ({_OUTBOX} FROM matched WHERE fresh)"
ORACLES["pipeline_outcomes"] = f"{run(TS)} SELECT * FROM told"
ORACLES["run_stats"] = f"""{run(TS)} SELECT {TS} AS last_run_at, count(*) AS subscribers, count(*) AS processed,
  count(*) FILTER (WHERE outcome = 'sent_jobs') AS notified_with_jobs,
  count(*) FILTER (WHERE outcome = 'no_match' OR outcome = 'error' AND tell_no_match) AS notified_no_match,
  count(*) FILTER (WHERE outcome = 'skipped_no_preferences') AS skipped_no_preferences,
  count(*) FILTER (WHERE outcome = 'error') AS errors, CAST(coalesce(sum(collected), 0) AS BIGINT) AS total_jobs_collected,
  CAST(0 AS BIGINT) AS skipped_analyses FROM told"""


def _searched(name: str) -> str:
    """The twin of one source where users ask for what they search feeds for: title and brand in one text."""
    sql = ORACLES[f"source_{name}"]
    if name == "arbeitnow":
        return sql
    asked = f"SELECT w.* REPLACE (s.job_title AS job_title, s.skills AS skills) FROM ({duck_sql('profiles')}) w JOIN ({duck_sql('feed_searches')}) s USING (user_id)"
    return sql.replace(duck_sql("profiles"), asked).replace("p_name = job_title", "p_name || ' ' || p_brand = job_title")


def collected_run() -> str:
    """CTEs of a run over the postings of all sources: matched and told. A posting is known by its user and arrival."""
    parts = " UNION ALL ".join(f"SELECT * FROM ({_searched(n)})" for n in (
        "arbeitnow", "remotive", "mostaql", "tanqeeb", "bayt", "wuzzuf", "forasna", "adzuna", "jooble", "jsearch"))
    return f"""{ctes('analysed_parts', 'subscription_log')}, wide AS ({duck_sql('profiles')}),
subs AS {subscribers()},
profiles AS (SELECT w.* REPLACE (s.job_title AS job_title, s.skills AS skills) FROM wide w JOIN ({duck_sql('feed_searches')}) s USING (user_id)
  WHERE w.user_id % 7 <> 3 AND w.user_id IN (SELECT user_id FROM subs)),
postings_p AS (SELECT * REPLACE (user_id::HUGEINT * 1000000000000000 + arrival_idx AS arrival_idx,
    CASE WHEN skills = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(skills, '|') END AS skills), application_url AS url FROM ({parts})
  WHERE user_id IN (SELECT user_id FROM profiles) AND trim(coalesce(title, '')) <> '' AND trim(coalesce(company, '')) <> ''
    AND regexp_matches(coalesce(application_url, ''), '^https?://[^/]+') AND publication_date >= {TS} - INTERVAL 7 DAY),
{identified()}, hits AS (SELECT user_id, arrival_idx FROM idp), {SCORED}, kept AS {survivors('scored')},
matched AS (SELECT *, score >= 40 AS fresh FROM kept),
told AS (SELECT user_id FROM profiles WHERE user_id NOT IN (SELECT user_id FROM matched WHERE fresh))"""


ORACLES["collected_outbox"] = f"""{collected_run()} {_OUTBOX} FROM matched WHERE fresh
UNION ALL SELECT user_id, 1, 'no_match', '{_NO_MATCH}', NULL, NULL, NULL FROM told"""
ORACLES["due_run_outcomes"] = f"""{run(_SEVEN, f"list_contains(notification_times, strftime({local(_SEVEN, _ZONE)}, '%H:%M'))")}
SELECT user_id, outcome FROM told"""
ORACLES["simple_notifications"] = f"""{ctes('postings_p', 'analysed_parts', 'subscription_log')}, all_profiles AS ({duck_sql('profiles')}),
profiles AS (SELECT * FROM all_profiles WHERE user_id % 7 <> 3 AND user_id IN (SELECT user_id FROM {subscribers()})),
{identified()}, {hits(name='all_hits')},
hits AS (SELECT h.* FROM all_hits h JOIN postings_p p USING (arrival_idx) WHERE publication_date >= {TS} - INTERVAL 7 DAY), {SCORED}
SELECT user_id, arrival_idx, rule AS score, rule_reason AS reason, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rule DESC, arrival_idx) AS INTEGER) AS rank
FROM scored"""

# --- bot updates -------------------------------------------------------------------------------------

_KEPT = """WITH RECURSIVE first AS (SELECT event_type, ts, min(event_id) AS event_id FROM events GROUP BY event_type, ts),
kept AS (SELECT event_type, min(ts) AS ts FROM first GROUP BY event_type
  UNION ALL SELECT k.event_type, min(f.ts) FROM kept k JOIN first f ON f.event_type = k.event_type AND f.ts >= k.ts + INTERVAL 1 HOUR
  GROUP BY k.event_type)"""
ORACLES["update_dedup"] = f"{_KEPT} SELECT f.event_id, f.event_type, f.ts FROM kept JOIN first f USING (event_type, ts)"
ORACLES["streamed_update_dedup"] = f"{_KEPT} SELECT event_type, ts FROM kept"
_COMMANDS = f"""{ctes('subscription_log')} SELECT user_id FROM {subscribers()}"""
ORACLES["subscription_commands"] = _COMMANDS
ORACLES["streamed_subscriptions"] = _COMMANDS
ORACLES["subscription_status"] = f"""{ctes('subscription_log')}, s AS {subscribers("ts <= TIMESTAMP '2024-01-20'")}
SELECT user_id, ts, user_id IN (SELECT user_id FROM s) AS subscribed FROM events WHERE event_type = 'click'"""


def bot_replay() -> str:
    """CTEs of the bot's chain, update by update: said has kind, chat_id, user_id, ts and the values of each event."""
    skills = f"list_filter(list_transform(string_split(text, ','), lambda s: {trim('s')}), lambda s: s <> '')"
    place = squeeze("text")
    return f"""WITH RECURSIVE bot_updates AS ({duck_sql('bot_updates')}),
keyed AS (SELECT *, concat_ws(':', kind, chat_id, message_id, data) AS key FROM bot_updates),
kept AS (SELECT key, min(ts) AS ts FROM keyed GROUP BY key
  UNION ALL SELECT k.key, min(u.ts) FROM kept k JOIN keyed u ON u.key = k.key AND u.ts >= k.ts + INTERVAL 10 SECOND GROUP BY k.key),
s AS (SELECT u.*, row_number() OVER (PARTITION BY chat_id ORDER BY u.ts, message_id) AS n,
  coalesce(kind = 'msg' AND (text IN ('🚀 Start Job Search', 'Start Job Search', 'Start', '/start') OR regexp_matches(text, '^/start(@\\w+)?(\\s|$)')), false)
    OR coalesce(kind = 'cb' AND data IN ('start_search', 'preferences:restart'), false) AS start,
  coalesce(kind = 'cb' AND data = 'preferences:update', false) AS again, coalesce(kind = 'cb' AND data = 'preferences:confirm', false) AS confirm,
  CASE WHEN kind = 'msg' AND length({squeeze('text')}) BETWEEN 2 AND 100 THEN {squeeze('text')} END AS new_title, kind = 'msg' AND text IS NOT NULL AS spoken,
  CASE WHEN lower({place}) NOT IN ('', 'any') THEN {place} END AS new_place,
  CASE WHEN kind = 'msg' AND len({skills}) > 0 THEN array_to_string({skills}, ',') END AS new_skills,
  CASE WHEN kind = 'cb' AND data IN ('work-type:remote', 'work-type:hybrid', 'work-type:on-site', 'work-type:any') THEN substr(data, 11) END AS new_work,
  CASE WHEN kind = 'cb' AND data IN ('experience:intern', 'experience:junior', 'experience:mid', 'experience:senior', 'experience:lead', 'experience:any')
    THEN substr(data, 12) END AS new_level
  FROM keyed u JOIN kept USING (key, ts)),
walk AS (SELECT DISTINCT chat_id, 0::BIGINT AS n, 'job-title' AS step, NULL::VARCHAR AS title, NULL::VARCHAR AS work, NULL::VARCHAR AS level,
    NULL::VARCHAR AS place, NULL::VARCHAR AS skills, false AS told FROM s
  UNION ALL SELECT w.chat_id, u.n,
    CASE WHEN start OR again THEN 'job-title' WHEN step = 'job-title' AND new_title IS NOT NULL THEN 'work-type'
      WHEN step = 'work-type' AND new_work IS NOT NULL THEN 'experience-level' WHEN step = 'experience-level' AND new_level IS NOT NULL THEN 'location'
      WHEN step = 'location' AND spoken THEN 'skills' WHEN step = 'skills' AND new_skills IS NOT NULL THEN 'confirmation' ELSE step END,
    CASE WHEN start THEN NULL WHEN step = 'job-title' THEN coalesce(new_title, title) ELSE title END,
    CASE WHEN start THEN NULL WHEN step = 'work-type' THEN coalesce(new_work, work) ELSE work END,
    CASE WHEN start THEN NULL WHEN step = 'experience-level' THEN coalesce(new_level, level) ELSE level END,
    CASE WHEN start THEN NULL WHEN step = 'location' AND spoken THEN new_place ELSE place END,
    CASE WHEN start THEN NULL WHEN step = 'skills' THEN coalesce(new_skills, skills) ELSE skills END,
    confirm AND step = 'confirmation' AND title IS NOT NULL AND work IS NOT NULL AND level IS NOT NULL
  FROM walk w JOIN s u ON u.chat_id = w.chat_id AND u.n = w.n + 1),
preferred AS (SELECT s.chat_id, s.user_id, s.ts, s.n, w.title, w.work, w.level, w.place, w.skills FROM walk w JOIN s USING (chat_id, n) WHERE told),
acts AS (SELECT chat_id, user_id, ts, n, 'add' AS action FROM preferred
  UNION ALL SELECT chat_id, user_id, ts, n, CASE WHEN text LIKE '/subscribe%' THEN 'add' ELSE 'remove' END FROM s
  WHERE kind = 'msg' AND regexp_matches(text, '^/(subscribe|unsubscribe)(@\\w+)?(\\s|$)')),
asked AS (SELECT chat_id, user_id, ts, n FROM s WHERE kind = 'msg' AND regexp_matches(text, '^/subscription(@\\w+)?(\\s|$)'))"""


ORACLES["streamed_bot_updates"] = f"""{bot_replay()}
SELECT 'preferences' AS kind, chat_id, user_id, ts, title AS job_title, work AS work_type, level AS experience_level, place AS location, skills,
  NULL::VARCHAR AS action, NULL::BOOLEAN AS subscribed FROM preferred
UNION ALL SELECT 'subscription', chat_id, user_id, ts, NULL, NULL, NULL, NULL, NULL, action, NULL FROM acts
UNION ALL SELECT 'status', chat_id, user_id, ts, NULL, NULL, NULL, NULL, NULL, NULL, coalesce((SELECT arg_max(action, n) = 'add' FROM acts a
  WHERE a.chat_id = q.chat_id AND a.user_id = q.user_id AND a.n < q.n), false) FROM asked q"""
