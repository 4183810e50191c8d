"""The driver's tables seen as postings, profiles, logs and payloads.

The tables hold no postings, so each view maps one of them to the layout an operator needs. A view is one
SQL text in the part of SQL that Spark and DuckDB share; the few differing spellings are placeholders,
which lets the oracle queries start from the same rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 00:00:00"

SPARK = {"A": "array", "AT": "element_at", "CAT": "concat", "STR": "STRING", "NONE": "CAST(array() AS ARRAY<STRING>)",
         "DAYS": "datediff(l_shipdate, DATE '1995-01-01')", "TS": "CAST(ts AS TIMESTAMP)",
         "SERIES": "explode(sequence(0, 6))", "Q": '"', "Q0": '{{"', "END": "}}"}
DUCK = {"A": "list_value", "AT": "list_extract", "CAT": "list_concat", "STR": "VARCHAR",
        "NONE": "CAST([] AS VARCHAR[])", "DAYS": "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))",
        "TS": "ts", "SERIES": "unnest(range(0, 7))", "Q": '"', "Q0": '{"', "END": "}"}

_ADJ = "{A}('small', 'red', 'blue', 'hot', 'cold', 'old', 'new', 'large')"
_NOUN = "{A}('ring', 'widget', 'bolt', 'plate', 'rod', 'gear', 'gizmo', 'anvil')"
_TYPE = "{A}('STANDARD', 'SMALL', 'LARGE', 'ECONOMY', 'MEDIUM', 'PROMO')"
_LEVEL = "{A}('intern', 'junior', 'mid', 'senior', 'lead', NULL)"
_WORK = "{A}('remote', 'hybrid', 'on-site', NULL)"
_NOW = f"TIMESTAMP '{NOW}'"
_PEOPLE = f"""SELECT c_custkey AS user_id, {{AT}}({_ADJ}, CAST(1 + c_custkey % 8 AS INT)) || ' ' ||
            {{AT}}({_NOUN}, CAST(1 + floor(c_custkey / 8.0) % 8 AS INT)) AS job_title,
            'Brand#' || CAST(1 + c_custkey % 25 AS {{STR}}) AS location FROM customer"""

VIEWS = {
    # postings out of parts: few names and brands, hence many semantic duplicates
    "postings_p": f"""
        SELECT CAST(p_partkey % 3 AS BIGINT) AS user_id, p_partkey AS arrival_idx,
          p_name || {{AT}}({{A}}('', ' (Remote)', ' [Urgent]', ''), CAST(1 + p_partkey % 4 AS INT)) AS title,
          p_brand || {{AT}}({{A}}('', ' Inc.', ' LLC'), CAST(1 + p_partkey % 3 AS INT)) AS company,
          'src' || CAST(p_partkey % 11 AS {{STR}}) AS source,
          'https://jobs.example.com/' || CAST(p_partkey % 500 AS {{STR}}) || '?ref=' || CAST(p_size AS {{STR}})
            AS application_url,
          'https://jobs.example.com/' || CAST(p_partkey % 500 AS {{STR}}) || '?ref=' || CAST(p_size AS {{STR}}) AS url,
          CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN ''
            ELSE 'City ' || CAST(p_size % 7 AS {{STR}}) END AS location,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Land ' || CAST(p_size % 9 AS {{STR}}) END AS country,
          p_size % 3 = 0 AS remote,
          {{AT}}({_WORK}, CAST(1 + p_size % 4 AS INT)) AS work_type,
          {{AT}}({_LEVEL}, CAST(1 + p_size % 6 AS INT)) AS experience_level,
          CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name || ' at ' || p_brand ||
            CASE WHEN p_size % 2 = 0 THEN ' for ' || p_type ELSE '' END END AS description,
          CASE WHEN p_size % 7 = 0 THEN {{NONE}} ELSE {{CAT}}(split(p_name, ' '), {{A}}(p_type)) END AS skills,
          {_NOW} - INTERVAL '6' HOUR * p_size AS publication_date,
          {_NOW} - INTERVAL '6' HOUR * p_size AS published_at,
          CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS salary_min,
          CAST(NULL AS DOUBLE) AS salary_max,
          CAST(NULL AS {{STR}}) AS currency,
          {_NOW} AS scraped_at
        FROM part""",
    # postings out of web pages
    "postings_w": """
        SELECT page_id AS arrival_idx, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
          regexp_extract(url, '^https?://([^/?#]+)', 1) AS company, url AS application_url, url,
          regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS description
        FROM pages""",
    "profiles": f"""
        SELECT c_custkey AS user_id,
          {{AT}}({_ADJ}, CAST(1 + c_custkey % 8 AS INT)) || ' ' ||
            {{AT}}({_NOUN}, CAST(1 + floor(c_custkey / 8.0) % 8 AS INT)) AS job_title,
          {{AT}}({{A}}('remote', 'hybrid', 'on-site', 'any'), CAST(1 + c_nationkey % 4 AS INT)) AS work_type,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'intern' WHEN 'HOUSEHOLD' THEN 'junior' WHEN 'MACHINERY' THEN 'mid'
            WHEN 'BUILDING' THEN 'senior' ELSE 'any' END AS experience_level,
          'Brand#' || CAST(1 + c_custkey % 25 AS {{STR}}) AS location,
          CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {{A}}(
            {{AT}}({_NOUN}, CAST(1 + c_custkey % 7 AS INT)), {{AT}}({_TYPE}, CAST(1 + c_custkey % 6 AS INT))) END AS skills,
          {{AT}}({{A}}('Asia/Gaza', 'Asia/Riyadh', 'Europe/Berlin', 'America/New_York', 'Not/AZone'),
            CAST(1 + c_nationkey % 5 AS INT)) AS timezone,
          CASE c_custkey % 4 WHEN 0 THEN {{A}}('09:00', '21:00') WHEN 1 THEN {{A}}('07:30')
            WHEN 2 THEN {{A}}('08:00', '12:30', '18:45') ELSE {{A}}('bad', '23:59') END AS notification_times
        FROM customer""",
    # what users search for: their title at their brand, in one of the spellings of titles, and their title with a type as a skill; few enough
    # hits that a search without a cap stays small, while every part can be found
    "searches": f"""
        SELECT user_id, job_title || {{AT}}({{A}}('', ' (Remote)', ' [Urgent]', ''), CAST(1 + floor(user_id / 64.0) % 4 AS INT))
            || ' ' || location AS job_title,
          CASE WHEN user_id % 10 <> 0 THEN {{A}}(job_title || ' ' ||
            {{AT}}({_TYPE}, CAST(1 + floor(user_id / 64.0) % 6 AS INT))) END AS skills
        FROM ({_PEOPLE}) s""",
    # the same for feed items, where the brand may be missing between title and type
    "feed_searches": f"""
        SELECT user_id, job_title || ' ' || location AS job_title,
          CASE WHEN user_id % 10 <> 0 THEN {{A}}(job_title || '  ' ||
            {{AT}}({_TYPE}, CAST(1 + floor(user_id / 64.0) % 6 AS INT))) END AS skills
        FROM ({_PEOPLE}) s""",
    "subscription_log": """
        SELECT user_id, CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS action, {TS} AS ts, event_id AS seq
        FROM events WHERE event_type IN ('signup', 'error')""",
    # which part was sent to which customer, moved into the two months before NOW
    "sent_parts": f"""
        SELECT o_custkey AS user_id, l_partkey,
          {_NOW} - INTERVAL '1' DAY * ({{DAYS}} % 60) AS sent_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "analysed_parts": f"""
        SELECT p_partkey, {{AT}}(split(p_name, ' '), 2) AS role,
          {{AT}}({{A}}('intern', 'junior', 'mid', 'senior', 'unknown'), CAST(1 + p_size % 5 AS INT)) AS level,
          {{A}}(p_type, {{AT}}(split(p_name, ' '), 1)) AS skills,
          {{AT}}({{A}}('remote', 'hybrid', 'on-site', 'any'), CAST(1 + p_size % 4 AS INT)) AS work_type,
          {_NOW} - INTERVAL '1' DAY * (p_partkey % 14) - INTERVAL '1' SECOND * p_partkey AS written_at
        FROM part WHERE p_partkey % 3 <> 0""",
    # model answers in ten forms
    "match_responses": """
        SELECT doc_id, CASE doc_id % 10
          WHEN 0 THEN '{Q0}score{Q}: ' || CAST(doc_id % 101 AS {STR}) || ', {Q}reason{Q}: {Q}' || source || '{Q}{END}'
          WHEN 1 THEN '```json' || chr(10) || '{Q0}score{Q}: 70, {Q}reason{Q}: {Q}' || lang || '{Q}{END}' || chr(10) || '```'
          WHEN 2 THEN '{Q0}score{Q}: {Q}90{Q}, {Q}reason{Q}: {Q}text score{Q}{END}'
          WHEN 3 THEN '{Q0}score{Q}: ' || CAST(101 + doc_id % 50 AS {STR}) || ', {Q}reason{Q}: {Q}high{Q}{END}'
          WHEN 4 THEN 'not json ' || source
          WHEN 5 THEN ''
          WHEN 6 THEN '{Q0}score{Q}: 10, {Q}reason{Q}: 123{END}'
          WHEN 7 THEN '[1, 2]'
          WHEN 8 THEN '{Q0}score{Q}: 50{END}'
          ELSE '{Q0}score{Q}: 7.5, {Q}reason{Q}: {Q}half{Q}{END}' END AS response
        FROM documents""",
    "analysis_responses": """
        SELECT doc_id, CASE doc_id % 8
          WHEN 0 THEN '{Q0}role{Q}: {Q}backend{Q}, {Q}skills{Q}: [{Q}' || lang || '{Q}, {Q}sql{Q}], {Q}experienceLevel{Q}: {Q}mid{Q}, {Q}workType{Q}: {Q} OnSite {Q}, {Q}summary{Q}: {Q}' || source || '{Q}{END}'
          WHEN 1 THEN '```' || chr(10) || '{Q0}role{Q}: {Q}data{Q}, {Q}skills{Q}: [], {Q}experienceLevel{Q}: {Q}unknown{Q}, {Q}workType{Q}: {Q}REMOTE{Q}, {Q}summary{Q}: {Q}{Q}{END}' || chr(10) || '```'
          WHEN 2 THEN '{Q0}role{Q}: {Q}qa{Q}, {Q}skills{Q}: [{Q}a{Q}, 1], {Q}experienceLevel{Q}: {Q}mid{Q}, {Q}workType{Q}: {Q}any{Q}, {Q}summary{Q}: {Q}s{Q}{END}'
          WHEN 3 THEN '{Q0}role{Q}: 5, {Q}skills{Q}: [{Q}a{Q}], {Q}experienceLevel{Q}: {Q}mid{Q}, {Q}workType{Q}: {Q}any{Q}, {Q}summary{Q}: {Q}s{Q}{END}'
          WHEN 4 THEN source
          WHEN 5 THEN ''
          WHEN 6 THEN '3'
          ELSE '{Q0}role{Q}: {Q}qa{Q}, {Q}skills{Q}: [{Q}a b{Q}], {Q}experienceLevel{Q}: {Q}lead{Q}, {Q}workType{Q}: {Q}sometimes{Q}, {Q}summary{Q}: {Q}s{Q}{END}' END AS response
        FROM documents""",
    "raw_preferences": f"""
        SELECT c_custkey AS user_id,
          CASE c_custkey % 6 WHEN 0 THEN '   Senior   ' || c_name || '  ' WHEN 1 THEN 'A' WHEN 2 THEN c_mktsegment
            WHEN 3 THEN repeat(c_name, 6) ELSE c_name END AS job_title,
          CASE WHEN c_custkey % 7 = 0 THEN 'Remote' ELSE
            {{AT}}({{A}}('remote', 'hybrid', 'on-site', 'any'), CAST(1 + c_nationkey % 4 AS INT)) END AS work_type,
          CASE WHEN c_custkey % 11 = 0 THEN 'expert' ELSE {{AT}}({_LEVEL}, CAST(1 + c_custkey % 6 AS INT)) END AS experience_level,
          CASE c_custkey % 5 WHEN 0 THEN '  Any ' WHEN 1 THEN '' WHEN 2 THEN '  Gaza  , Palestine ' ELSE c_mktsegment END AS location,
          CASE c_custkey % 4 WHEN 0 THEN 'Node.js, TypeScript, , ' || c_mktsegment || ',   Docker  , ' WHEN 1 THEN NULL
            ELSE c_name END AS skills,
          CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Europe/Berlin' END AS timezone,
          CASE WHEN c_custkey % 2 = 0 THEN {{A}}('10:00') END AS notification_times
        FROM customer""",
    # scripted wizard updates: seven per signup event, some of them wrong or out of order
    "scripted_updates": """
        SELECT user_id AS chat_id, user_id, event_id * 10 + step AS message_id,
          CASE WHEN step IN (0, 3, 4) THEN 'msg' WHEN step = 6 AND event_id % 3 = 0 THEN 'msg' ELSE 'cb' END AS kind,
          CASE step WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'x' ELSE 'title ' || CAST(event_id AS {STR}) END
            WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN ' Any ' ELSE 'city  ' || CAST(event_id % 7 AS {STR}) END
            WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN ' , ' ELSE 'sql, spark ,' || event_type END
            WHEN 6 THEN CASE WHEN event_id % 3 = 0 THEN '/start' END END AS text,
          CASE step WHEN 1 THEN CASE WHEN event_id % 6 = 0 THEN 'work-type:none' ELSE 'work-type:remote' END
            WHEN 2 THEN 'experience:mid' WHEN 5 THEN 'preferences:confirm'
            WHEN 6 THEN CASE event_id % 3 WHEN 1 THEN 'preferences:update' WHEN 2 THEN 'preferences:restart' END END AS data,
          ts + INTERVAL '1' SECOND * step AS ts
        FROM (SELECT event_id, user_id, event_type, {TS} AS ts, {SERIES} AS step FROM events WHERE event_type = 'signup') s""",
}

# the scripted updates and commands of chats that two users share; some updates are delivered again 4 or 12 seconds later
VIEWS["bot_updates"] = f"""
        SELECT chat_id, user_id, message_id, kind, text, data, ts + INTERVAL '1' SECOND * (2 * step) AS ts
        FROM (SELECT *, {{SERIES}} AS step FROM (
          SELECT CAST(floor(user_id / 2.0) AS BIGINT) AS chat_id, user_id, message_id, kind, text, data, ts FROM ({VIEWS["scripted_updates"]}) a
          UNION ALL SELECT CAST(floor(user_id / 2.0) AS BIGINT), user_id, event_id * 10 + 9, 'msg',
            CASE event_type WHEN 'click' THEN '/subscription' WHEN 'error' THEN '/unsubscribe now' ELSE '/subscribe@bot' END,
            CAST(NULL AS {{STR}}), {{TS}} FROM events WHERE event_type <> 'signup') b) c
        WHERE step = 0 OR step = 2 AND message_id % 3 = 0 OR step = 6 AND message_id % 7 = 0"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _sql(view: str, words: dict[str, str]) -> str:
    return VIEWS[view].format(**words)


@cache
def duck_sql(view: str) -> str:
    """The view as DuckDB SQL over the driver's tables."""
    return _sql(view, DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet files of ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = _sql(name, SPARK)
    used = [t for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text]
    return spark.sql(
        _with_frames(text, used), **{f"t_{t}": table(spark, sf_dir, t) for t in used}
    )


def _with_frames(text: str, used: list[str]) -> str:
    for t in used:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{t_{t}}}")
    return text


# Response bodies written out of part rows: (item text, opening, closing). ``at`` is the posting time.
_AT = f"(TIMESTAMP '{NOW}' - INTERVAL '6' HOUR * p_size)"
_ISO = f"CASE WHEN p_size % 7 = 0 THEN 'not a date' ELSE date_format({_AT}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"
_KEY = "CAST(p_partkey AS STRING)"
_TITLE = "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat(p_name, ' ', p_type) END"
_BOLD = "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('<strong>', p_name, '</strong> ', p_type) END"
_BRAND = "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END"
_PLACE = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Remote, EU' ELSE concat('City ', CAST(p_size AS STRING)) END"
_BODY = "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('<p>Join  our <b>', p_type, '</b>&nbsp;team') END"
_LINK = f"CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('https://apply.example.com/', {_KEY}) END"
_FLAG = "CAST(p_size % 3 = 0 AS STRING)"


def _json(**fields: str) -> str:
    """SQL text of a JSON object; a value starting with ``=`` is put in without quotes."""
    parts = []
    for name, value in fields.items():
        quote = "" if value.startswith("=") else '"'
        parts.append(f"'\"{name}\":{quote}', {value.removeprefix('=')}, '{quote}'")
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def _card(opening: str, title: str, company: str, place: str, closing: str = "") -> str:
    head = f"concat('{opening}', {title}"
    if company:
        head += f", CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('{company}', p_brand, '</b>') END"
    if place:
        head += f", CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('{place}', {_PLACE}, ' </span>') END"
    return head + f", '{closing}')"


def _anchor(href: str, attrs: str = "") -> str:
    return f"'<a {attrs} href=\"{href}', {_KEY}, '\"> ', p_name, ' &amp; ', p_type, ' </a>'"


PAYLOADS = {
    "arbeitnow": (_json(
        title="p_name", company_name=_BRAND, description=_BODY, remote=f"={_FLAG}", url=_LINK,
        tags="=concat('[\"', p_type, '\"]')", location=_PLACE,
        created_at=f"=CASE WHEN p_partkey % 2 = 0 THEN CAST(unix_timestamp({_AT}) AS STRING) ELSE concat('\"', {_ISO}, '\"') END",
    ), '{"data":[', "]}"),
    "remotive": (_json(
        title="concat(p_name, ' ', p_type)", company_name=_BRAND, description=_BODY, url=_LINK,
        tags="=CASE WHEN p_size % 2 = 0 THEN 'null' ELSE concat('[\"', p_type, '\"]') END",
        candidate_required_location=_PLACE, publication_date=_ISO,
    ), '{"jobs":[', "]}"),
    "adzuna": (_json(
        title=_BOLD, description=_BODY, redirect_url=_LINK, created=_ISO,
        salary_min="=CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 1000 AS STRING) ELSE concat('\"', CAST(p_size AS STRING), '\"') END",
        company=f"=concat('{{\"display_name\":\"', {_BRAND}, '\"}}')",
        location=f"=concat('{{\"display_name\":\"', {_PLACE}, '\",\"area\":[\"', p_type, '\"]}}')",
    ), '{"results":[', "]}"),
    "jooble": (_json(
        title=_BOLD, location=_PLACE, snippet=_BODY, company=_BRAND,
        source="CASE WHEN p_partkey % 12 = 0 THEN '' ELSE 'board' END", link=_LINK, updated=_ISO,
    ), '{"jobs":[', "]}"),
    "firecrawl": (_json(
        title="concat('  ', p_name, ' ')", company=_BRAND, location=_PLACE,
        url=f"CASE WHEN p_partkey % 9 = 0 THEN concat('/jobs/', {_KEY}) ELSE concat('https://apply.example.com/', {_KEY}) END",
        description="CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(' About ', p_type, ' ') END",
    ), '{"success":true,"data":{"extract":{"jobs":[', "]}}}"),
    "jsearch": (_json(
        job_title=_TITLE, employer_name=_BRAND,
        job_apply_link=_LINK, job_google_link=f"concat('https://g.example.com/', {_KEY})",
        job_city=_PLACE, job_country="CASE WHEN p_size % 2 = 0 THEN 'US' ELSE '' END", job_is_remote=f"={_FLAG}",
        job_description="CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END", job_posted_at_datetime_utc=_ISO,
        job_required_skills="=CASE WHEN p_size % 2 = 0 THEN 'null' ELSE concat('[\"', p_type, '\"]') END",
    ), '{"data":{"jobs":[', "]}}"),
    "weworkremotely": (
        f"concat('<item><title><![CDATA[', CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(p_brand, ': ') END, p_name, "
        f"']]></title><link>https://wwr.example.com/', {_KEY}, '</link><pubDate>', "
        f"CASE WHEN p_size % 7 = 0 THEN 'soon' ELSE date_format({_AT}, 'EEE, dd MMM yyyy HH:mm:ss') || ' +0000' END, "
        f"'</pubDate><description><![CDATA[<p>Lot ', CAST(p_partkey % 997 AS STRING), ' in  stock</p>]]></description></item>')",
        "<rss><channel>", "</channel></rss>"),
    "mostaql": (_card('<div class="project-card big"><h2>', _anchor("/project/"), "", "") .removesuffix(", '')")
                + ", '</h2><p class=\"project-brief\"> ', p_type, ' work<p>more</div>')", "<body>", "</body>"),
    "tanqeeb": (_card('<article><h2 class="card-title">', _anchor("jobs/"), '</h2><b class="company">',
                      '<span class="job location">', "<p>Remote work possible</p></article>"), "<body>", "</body>"),
    "bayt": (_card('<li data-js-job="1"><h2>', _anchor("/en/jobs/"), '</h2><b class="the-company">',
                   '<span class="t-mute">'), "<ul>", "</ul>"),
    "wuzzuf": (_card('<div class="css-1gatmva">', _anchor("/jobs/", 'class="css-o171kl"'),
                     '<br><b><a class="my-company">', '</a></b><span class="css-5wys0k">', "</div>"), "<body>", "</body>"),
    "forasna": (_card('<div class="job-card"><h3>', _anchor("https://forasna.com/j/"), '</h3><b class="employer-name">',
                      '<span class="x-location">', "</div>"), "<body>", "</body>"),
}
FEED_ITEMS = 50
REQUEST_ITEMS = 1000


def payloads(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Payload rows of one source.

    Feeds hold 50 consecutive parts per payload. Requests ask for a name and a brand; their payloads cover
    1000 consecutive part keys each, so a payload stays small however many parts there are.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    item, opening, closing = PAYLOADS[name]
    feed = name in ("arbeitnow", "weworkremotely")
    separator = "," if opening.startswith("{") else ""
    rows = table(spark, sf_dir, "part").select(
        (F.lit("feed") if feed else F.concat("p_name", F.lit("|"), "p_brand")).alias("request_id"),
        F.floor(F.col("p_partkey") / (FEED_ITEMS if feed else REQUEST_ITEMS)).alias("payload_no"),
        "p_partkey",
        F.expr(item).alias("item"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda r: r["item"])
    return (
        rows.groupBy("request_id", "payload_no")
        .agg(ordered.alias("items"))
        .select("request_id", F.lit(name).alias("source"), "payload_no",
                _whole_body(name, opening, separator, closing).alias("payload"))
    )


def _whole_body(name: str, opening: str, separator: str, closing: str) -> Column:
    body = F.concat(F.lit(opening), F.array_join("items", separator), F.lit(closing))
    if name != "jooble":
        return body
    # One brand's answers arrive cut off.
    return F.when(F.endswith("request_id", F.lit("|Brand#3")), F.lit('{"jobs":[')).otherwise(body)


def asked(profiles: DataFrame) -> DataFrame:
    """Which user made which request: the title and the brand they look for."""
    return profiles.select("user_id", F.concat("job_title", F.lit("|"), "location").alias("request_id"))


def searching_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose title and skills are what their users search feeds and sources for."""
    return view(spark, sf_dir, "profiles").drop("job_title", "skills").join(view(spark, sf_dir, "feed_searches"), "user_id")


def landed(spark: SparkSession, sf_dir: str, requests: DataFrame, names: list[str]) -> DataFrame:
    """Payload rows of the sources ``names`` under the requests that were made: rows (source, request_id, wanted), wanted being name and brand."""
    out = None
    for name in names:
        part = payloads(spark, sf_dir, name)
        if name not in ("arbeitnow", "weworkremotely"):
            asked_for = requests.where(F.col("source") == name).select("request_id", "wanted").distinct()
            part = part.withColumn("wanted", F.replace("request_id", F.lit("|"), F.lit(" "))).drop("request_id").join(asked_for, "wanted")
        part = part.select("request_id", "source", "payload_no", "payload")
        out = part if out is None else out.unionByName(part)
    return out
