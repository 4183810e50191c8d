"""Every operator as a query over the driver's tables. ``oracles.py`` holds the SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, responses, schedule as clock, scoring, text, urls
from ..functions.fingerprint import with_fingerprints, with_url_fingerprint
from ..functions.preferences import valid_experience_level, valid_job_title, valid_work_type
from ..operators import analyze, collect, dedup, match, notify, report, schedule, state
from ..operators.budget import Budget, admit
from ..operators.claims import ClaimFolder
from ..operators.folded import FoldedState
from ..operators.preferences import create_preferences, live_preferences, preference_versions
from ..sources import collect as sources
from ..sources.common import query_columns
from ..sources.frontier import request_frontier, user_requests
from ..sources.html_pages import extract_listings
from ..sources.normalize import normalize_postings
from ..sources.registry import SOURCES, active_sources
from ..staging import Stager
from ..streaming import bot, continuous, subscriptions, updates, wizard
from . import bindings as B
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ALL_KEYS = ("adzuna", "jooble", "jsearch")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def now() -> Column:
    return F.lit(B.NOW).cast("timestamp")


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# --- text, addresses, identity -----------------------------------------------------------------------

def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.table(spark, sf, "pages").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), "url")
    made = B.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.expr("""CASE p_partkey % 8
            WHEN 0 THEN ' HTTPS://WWW.Jobs.Example.com:8443/A/' || p_partkey || '//?utm_source=x&B=c d&ref=y#top '
            WHEN 1 THEN 'http://user:pw@jobs.example.com/' || p_name || '/'
            WHEN 2 THEN 'not an address/' || p_brand || '//'
            WHEN 3 THEN 'https://jobs.example.com?source=a&Source=' || p_brand || '&&flag&x=1=2'
            WHEN 4 THEN 'ftp://www.files.example.com/a/./b/../c?gclid=1'
            WHEN 5 THEN 'https://jobs.example.com:99999/'
            WHEN 6 THEN 'http://bad host.com/' || p_partkey
            ELSE 'https://jobs.example.com/j?q=%41%2F&trk=' || p_partkey || '&name=~' END""").alias("url"),
    )
    return pages.unionByName(made)


@query
def canonical_urls(spark, sf):
    return with_url_fingerprint(_addresses(spark, sf)).withColumn("valid", urls.is_web_url("url"))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["arrival_idx", "title", "company"]
    web = B.view(spark, sf, "postings_w").select(F.lit("w").alias("origin"), *columns)
    return web.unionByName(B.view(spark, sf, "postings_p").select(F.lit("p").alias("origin"), *columns))


@query
def normalized_titles(spark, sf):
    return _titles(spark, sf).select("origin", "arrival_idx", text.normalize_title("title").alias("title_norm"))


@query
def normalized_companies(spark, sf):
    return _titles(spark, sf).select("origin", "arrival_idx", text.normalize_company("company").alias("company_norm"))


@query
def fingerprints(spark, sf):
    return with_fingerprints(B.view(spark, sf, "postings_p")).select("arrival_idx", "fingerprint", "semantic_key")


@query
def clean_pages(spark, sf):
    cleaned = B.table(spark, sf, "pages").select("page_id", text.clean_html("html").alias("body"))
    return cleaned.withColumn("brief", text.truncate("body", 400))


def _doubtful(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of which some are invalid."""
    k = F.col("arrival_idx")
    return B.view(spark, sf, "postings_p").withColumns({
        "title": F.when(k % 13 == 0, "  ").otherwise(F.col("title")),
        "company": F.when(k % 19 == 0, "").otherwise(F.col("company")),
        "application_url": F.when(k % 17 == 0, "invalid-url").when(k % 23 == 0, "").otherwise(F.col("application_url")),
        "publication_date": F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("publication_date")),
    })


@query
def valid_recent_postings(spark, sf):
    usable = collect.recent_postings(collect.valid_postings(_doubtful(spark, sf)), now())
    return usable.select("arrival_idx", "title", "publication_date")


def _raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("arrival_idx")
    return B.view(spark, sf, "postings_p").withColumns({
        "title": F.concat(F.lit("  "), "title", F.when(k % 5 == 0, " remote ").otherwise(" ")),
        "source": F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("source")),
        "application_url": F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" "), "application_url")),
        "remote": F.when(k % 2 == 0, F.col("remote")),
        "description": F.concat(F.lit("<p>"), "description", F.lit("</p>  <b>&amp;</b> end <unclosed")),
        "skills": F.when(k % 3 != 0, F.col("skills")),
        "published_at": F.when(k % 4 == 0, "").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")),
        "publication_date": F.when(k % 8 == 0, "soon").otherwise(F.date_format("publication_date", "yyyy-MM-dd")),
    })


@query
def normalized_postings(spark, sf):
    return normalize_postings(_raw_postings(spark, sf), now()).select(
        "arrival_idx", "title", "company", "source", "application_url", "url", "location", "country", "remote",
        "description", joined("skills"), "publication_date", "salary_min", "scraped_at",
    )


@query
def parsed_dates(spark, sf):
    at = F.expr("timestamp_seconds(1704067200 + p_partkey * 3607)")
    written = B.table(spark, sf, "part").select("p_partkey", at.alias("at")).withColumns({
        "text": F.expr("""CASE p_partkey % 9
            WHEN 0 THEN date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 1 THEN date_format(at, 'yyyy-MM-dd')
            WHEN 2 THEN date_format(at, 'EEE, dd MMM yyyy HH:mm:ss') || ' +0000'
            WHEN 3 THEN date_format(at, 'EEE, d MMM yyyy HH:mm:ss') || ' GMT'
            WHEN 4 THEN date_format(at, "yyyy-MM-dd'T'HH:mm:ss") || '+02:00' WHEN 5 THEN 'yesterday'
            WHEN 6 THEN '' WHEN 7 THEN date_format(at, 'MMM d, yyyy') END"""),
        "number": F.expr("CASE WHEN p_partkey % 9 = 8 THEN CAST(unix_timestamp(at) AS DOUBLE) END"),
    })
    return written.select(
        "p_partkey",
        dates.parse_date("text").alias("parsed"),
        dates.epoch_or_date(F.col("number"), F.col("text"), now()).alias("published"),
    )


# --- duplicates --------------------------------------------------------------------------------------

def _identified(spark: SparkSession, sf: str) -> DataFrame:
    return with_fingerprints(B.view(spark, sf, "postings_p"))


@query
def richness(spark, sf):
    return B.view(spark, sf, "postings_p").select("arrival_idx", scoring.richness().alias("richness"))


@query
def dedup_survivors(spark, sf):
    return dedup.survivors(_identified(spark, sf)).select(
        "user_id", "arrival_idx", "title", "company", "application_url", "fingerprint", joined("skills"), "salary_min"
    )


@query
def dedup_duplicates(spark, sf):
    return dedup.duplicates(_identified(spark, sf)).select("user_id", "arrival_idx", "title", "company", "semantic_key")


@query
def dedup_pages(spark, sf):
    """Web pages: one survivor per title and host."""
    pages = with_fingerprints(B.view(spark, sf, "postings_w"))
    filled = {c: F.lit(None).cast("string") for c in ("location", "country", "work_type", "experience_level")}
    pages = pages.withColumns({
        **filled,
        "user_id": F.lit(0).cast("long"),
        "remote": F.lit(False),
        "skills": F.array().cast("array<string>"),
        "salary_min": F.lit(None).cast("double"),
        "salary_max": F.lit(None).cast("double"),
        "description": text.clean_html("description"),
    })
    return dedup.survivors(pages).select("arrival_idx", "title", "company", "fingerprint", "description")


@query
def global_unique(spark, sf):
    return dedup.global_unique(dedup.survivors(_identified(spark, sf))).select(
        "fingerprint", "user_id", "arrival_idx", "title"
    )


@query
def posting_snapshot(spark, sf):
    unique = dedup.global_unique(dedup.survivors(_identified(spark, sf)))
    rows = state.upserts(unique.select("fingerprint", "title", "company"), now(), 24 * 3600)
    return rows.withColumn("state_key", state.state_key("job", "fingerprint"))


# --- collecting --------------------------------------------------------------------------------------

def _searchable(spark: SparkSession, sf: str) -> DataFrame:
    searched = F.lower(F.concat_ws(
        " ", "title", "company", F.array_join("skills", " "), F.coalesce("location", F.lit(""))
    ))
    return B.view(spark, sf, "postings_p").drop("user_id").withColumn("searched", searched)


def user_postings(spark: SparkSession, sf: str, profiles: DataFrame) -> DataFrame:
    """All parts that a search of a user of ``profiles`` finds, by title or skill, as that user's postings."""
    return _brought(spark, sf, profiles.select("user_id").distinct())


def _brought(spark: SparkSession, sf: str, users: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Parts that searches of ``users`` find, with the columns of ``users``; with ``analyses``, what these say of the part."""
    feed = _searchable(spark, sf)
    searches = B.view(spark, sf, "searches").join(users.select("user_id"), "user_id", "left_semi")
    # Identity, normal forms and analysis belong to the posting: computed before the fan-out to users.
    known = scoring.prepare_postings(with_fingerprints(feed.drop("searched")))
    if analyses is not None:
        known = known.join(scoring.prepare_analyses(analyses), "fingerprint", "left")
    return collect.brought_to_users(feed, "searched", known, searches, users, True, "arrival_idx")


@query
def keyword_search_top20(spark, sf):
    return collect.keyword_search(
        _searchable(spark, sf), "searched", B.view(spark, sf, "profiles"), True, 20, "arrival_idx"
    )


@query
def keyword_search_pages(spark, sf):
    """Words of the labelled documents' languages in whole page texts, without a cap."""
    words = B.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("user_id"),
        F.element_at(
            F.array(*[F.lit(w) for w in ("tion", "The ", "queau", "sch der", "ng", "ción para")]),
            (F.col("n_nationkey") % 6 + 1).cast("int"),
        ).alias("job_title"),
        F.array(F.concat(F.lit("e"), (F.col("n_nationkey") % 9).cast("string"))).alias("skills"),
    )
    pages = B.table(spark, sf, "pages").select(
        F.col("page_id").alias("ordinal"), F.lower(text.clean_html("html")).alias("body")
    )
    return collect.keyword_search(pages, "body", words, False)


def _lot_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles that look for one lot number, so that an uncapped feed search stays selective."""
    lot = F.concat(F.lit("Lot "), (F.col("user_id") % 997).cast("string"), F.lit(" "))
    return B.view(spark, sf, "profiles").withColumns({
        "job_title": lot, "skills": F.when(F.col("user_id") % 5 == 0, F.array(lot)),
    })


def _feed_profiles(spark: SparkSession, sf: str, feed: str) -> DataFrame:
    if feed == "weworkremotely":
        return _lot_profiles(spark, sf)
    return B.searching_profiles(spark, sf)


def _flat(postings: DataFrame) -> DataFrame:
    return postings.withColumn("skills", F.array_join("skills", "|")).drop("published_at", "scraped_at", "url")


def _mapped(name: str) -> Query:
    spec = SOURCES[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = spec.items(B.payloads(spark, sf, name))
        if spec.shared_feed:
            profiles = _feed_profiles(spark, sf, name)
            return _flat(sources.feed_postings(items, profiles, spec, now(), stage=Stager(spark)))
        profiles = B.view(spark, sf, "profiles")
        return _flat(sources.requested_postings(items, B.asked(profiles), profiles, spec, now()))

    return run


for _name in B.PAYLOADS:
    QUERIES[f"source_{_name}"] = _mapped(_name)


@query
def navigation_listings(spark, sf):
    """The page parser on every raw page: navigation items as cards."""
    pages = B.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("request_id"), F.lit(0).cast("long").alias("payload_no"),
        F.col("html").alias("payload"),
    )
    return extract_listings(pages, {"card": "nav li", "title": "a[href]"}).select(
        F.col("request_id").cast("long").alias("page_id"), "pos", "title", "link"
    )


def _all_payloads(spark: SparkSession, sf: str, names) -> DataFrame:
    out = None
    for name in names:
        part = B.payloads(spark, sf, name)
        out = part if out is None else out.unionByName(part)
    return out


@query
def source_union_counts(spark, sf):
    specs = active_sources(ALL_KEYS)
    requests = B.asked(B.view(spark, sf, "profiles"))
    parts = None
    for spec in specs:
        items = spec.items(B.payloads(spark, sf, spec.name))
        if spec.shared_feed:
            profiles = _feed_profiles(spark, sf, spec.name)
            rows = sources.feed_postings(items, profiles, spec, now(), stage=Stager(spark))
        else:
            rows = sources.requested_postings(items, requests, B.view(spark, sf, "profiles"), spec, now())
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("arrival_idx").alias("first")
    )


@query
def source_status(spark, sf):
    specs = active_sources(ALL_KEYS)
    return sources.source_status(_all_payloads(spark, sf, [s.name for s in specs]), specs)


@query
def source_health(spark, sf):
    health = report.source_health(source_status(spark, sf))
    return health.select(joined("active"), joined("failed_last_run"), "total_count")


@query
def request_table(spark, sf):
    queries = query_columns(B.view(spark, sf, "profiles"))
    return request_frontier(user_requests(queries, active_sources(ALL_KEYS))).drop("request_id")


# --- matching ----------------------------------------------------------------------------------------

def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    keys = _identified(spark, sf).select(F.col("arrival_idx").alias("p_partkey"), "fingerprint")
    return B.view(spark, sf, "analysed_parts").join(keys, "p_partkey").drop("p_partkey")


def _sent_log(spark: SparkSession, sf: str) -> DataFrame:
    keys = _identified(spark, sf).select(F.col("arrival_idx").alias("l_partkey"), "fingerprint", "semantic_key")
    return B.view(spark, sf, "sent_parts").join(keys, "l_partkey").drop("l_partkey")


def _matches(spark: SparkSession, sf: str, with_analyses: bool = True, with_sent: bool = False) -> DataFrame:
    """Scored pairs; what belongs to the user is at hand before the fan-out as well: normal forms and, with ``with_sent``, what was sent."""
    profiles = B.view(spark, sf, "profiles")
    users = scoring.prepare_profiles(profiles)
    if with_sent:
        users = notify.with_sent(users, _sent_log(spark, sf), now())
    analyses = analyze.live_analyses(_analyses(spark, sf), now()) if with_analyses else None
    return match.match_postings(_brought(spark, sf, users, analyses), profiles, analyses, keep_analysed=True)


@query
def rule_scores(spark, sf):
    return _matches(spark, sf, False).select("user_id", "arrival_idx", "score", "reason")


@query
def analysis_scores(spark, sf):
    return _matches(spark, sf).where("analysed").select("user_id", "arrival_idx", "score", "reason")


@query
def best_matches(spark, sf):
    good = match.quality_matches(_matches(spark, sf)).select("user_id", "arrival_idx", "score", "reason", "analysed")
    return match.ranked(Stager(spark)(good, "good")).select("user_id", "arrival_idx", "score", "reason", "analysed", "rank")  # ranking reads it twice


@query
def unsent_matches(spark, sf):
    good = match.quality_matches(_matches(spark, sf, with_sent=True))
    return notify.unsent(good, _sent_log(spark, sf), now()).select("user_id", "arrival_idx", "score", "fingerprint")


@query
def sent_log_rows(spark, sf):
    good = match.quality_matches(_matches(spark, sf, with_sent=True))
    rows = notify.sent_rows(notify.unsent(good, _sent_log(spark, sf), now()), now())
    return rows.withColumn("state_key", state.state_key("sent", "user_id", "fingerprint")).drop("sent_date")


@query
def outbox_messages(spark, sf):
    good = match.quality_matches(_matches(spark, sf, with_sent=True))
    fresh = notify.unsent(good, _sent_log(spark, sf), now()).select(
        "user_id", "arrival_idx", "score", "title", "company", "location", "country", "source", "application_url", "fingerprint")
    fresh = Stager(spark)(fresh, "fresh")  # ranking reads it twice
    return notify.match_messages(fresh)


@query
def analysis_misses(spark, sf):
    unique = dedup.global_unique(_identified(spark, sf))
    return analyze.analysis_misses(unique, _analyses(spark, sf), now()).select("fingerprint", "arrival_idx")


@query
def analysis_prompts(spark, sf):
    unique = dedup.global_unique(_identified(spark, sf))
    return analyze.analysis_prompts(analyze.analysis_misses(unique, _analyses(spark, sf), now()))


#: Words of parts, for the built-in analyser.
PART_ROLES = {"metalwork": ["anvil", "gear", "bolt"], "fitting": ["ring", "rod", "plate"], "gadget": ["widget", "gizmo"]}
PART_LEVELS = {"senior": ["old", "large"], "junior": ["new", "small"]}
PART_WORKS = {"hybrid": ["hot", "cold"], "remote": ["remote"]}


def _within_budget(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Postings without an analysis, in arrival order, as far as half of what they cost together goes; and the others."""
    unique = dedup.global_unique(_identified(spark, sf))
    misses = Stager(spark)(analyze.analysis_misses(unique, _analyses(spark, sf), now()), "misses")
    total = misses.agg(F.sum(analyze.posting_cost())).first()[0]
    return admit(misses, ["user_id", "arrival_idx"], analyze.posting_cost(), Budget(cost=total // 2))


@query
def analysed_postings(spark, sf):
    """The built-in analyser under a budget."""
    made = analyze.keyword_analyses(_within_budget(spark, sf)[0], now(), PART_ROLES, PART_LEVELS, PART_WORKS)
    return made.withColumn("skills", F.array_join("skills", "|"))


@query
def skipped_analyses(spark, sf):
    return _within_budget(spark, sf)[1].select("fingerprint", "user_id", "arrival_idx", "cost", "reason")


@query
def claimed_slots(spark, sf):
    """Three triggers try each claimable slot at once: how many won, and under which number."""
    claims, at = ClaimFolder(spark, f"{Stager(spark).folder}/claims"), datetime.fromisoformat("2024-01-30 19:05:00")
    keys = sorted(r["slot_key"] for r in slot_claims(spark, sf).collect())  # one per time zone and time of day
    with ThreadPoolExecutor(3) as triggers:
        won = [(k, sum(c is not None for c in triggers.map(lambda n: claims.acquire(k, f"trigger-{n}", at), range(3)))) for k in keys]
    rows = [(k, n, claims.holder(k, at).number) for k, n in won]
    return spark.createDataFrame(rows, "slot_key string, winners int, number int")


@query
def parsed_match_responses(spark, sf):
    return responses.parse_match_responses(B.view(spark, sf, "match_responses")).drop("response")


@query
def parsed_analysis_responses(spark, sf):
    parsed = responses.parse_analysis_responses(B.view(spark, sf, "analysis_responses"))
    return parsed.withColumn("skills", F.array_join("skills", "|")).drop("response")


# --- preferences, schedule, state --------------------------------------------------------------------

@query
def created_preferences(spark, sf):
    made = create_preferences(B.view(spark, sf, "raw_preferences"))
    return made.withColumns({
        "skills": F.array_join("skills", "|"), "notification_times": F.array_join("notification_times", "|"),
    })


@query
def preference_checks(spark, sf):
    return B.view(spark, sf, "raw_preferences").select(
        "user_id",
        valid_job_title("job_title").alias("title_ok"),
        valid_work_type("work_type").alias("work_ok"),
        valid_experience_level("experience_level").alias("level_ok"),
    )


@query
def active_subscribers(spark, sf):
    return state.active_subscribers(B.view(spark, sf, "subscription_log"))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """A state table out of events: one key per user and event type, some versions deleted or short-lived."""
    return B.table(spark, sf, "events").select(
        "user_id",
        "event_type",
        F.col("value").alias("value"),
        F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp").alias("written_at"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL '1' DAY * (event_id % 20) END").alias("expires_at"),
        (F.col("event_id") % 7 == 0).alias("deleted"),
    )


STATE_KEY = ["user_id", "event_type"]


@query
def live_state(spark, sf):
    return state.live(_versions(spark, sf), STATE_KEY, now()).select(*STATE_KEY, "value", "version", "written_at")


@query
def folded_state(spark, sf):
    """The same state out of a snapshot that was folded twice, and the versions since."""
    log = _versions(spark, sf)
    held = FoldedState(spark, f"{Stager(spark).folder}/state", STATE_KEY, log.schema, buckets=8)
    last = None
    for until in ("2024-01-11 00:00:00", "2024-01-21 12:00:00", None):
        late = F.lit(True) if last is None else F.col("written_at") > F.lit(last).cast("timestamp")
        early = F.lit(True) if until is None else F.col("written_at") <= F.lit(until).cast("timestamp")
        held.append(log.where(late & early), f"until-{until or 'now'}"[:16].replace(" ", "-"))
        if until is not None:
            held.fold(datetime.fromisoformat(until))
        last = until
    return held.read(now()).select(*STATE_KEY, "value", "version", "written_at")


@query
def claim_if_absent(spark, sf):
    """First purchase-sized event per key wins where the key holds no live value."""
    candidates = B.table(spark, sf, "events").select(
        (F.col("user_id") % 200).alias("user_id"), "event_type", "value", F.col("event_id").alias("version")
    )
    return state.insert_if_absent(
        _versions(spark, sf), candidates, STATE_KEY, F.col("version"), now(), 36 * 3600
    )


@query
def deleted_state(spark, sf):
    """Delete every live click key, then read the state again a second later."""
    log = _versions(spark, sf)
    later = now() + F.expr("INTERVAL '1' SECOND")
    keys = state.live(log, STATE_KEY, now()).where("event_type = 'click'").select(*STATE_KEY)
    gone = state.tombstones(keys, [("value", "double"), ("version", "long")], now())
    after = state.live(log.unionByName(gone), STATE_KEY, later)
    return after.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    """One patch per customer with an order, also for customers whose preferences are invalid."""
    return B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.when(F.max("o_orderkey") % 2 == 0, "senior").alias("experience_level"),
        F.when(F.max("o_orderkey") % 3 == 0, F.max("o_orderpriority")).alias("location"),
    )


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    return create_preferences(B.view(spark, sf, "raw_preferences")).where("error IS NULL").drop("error")


@query
def patched_preferences(spark, sf):
    merged, _ = state.patch(_saved(spark, sf), _patches(spark, sf), "user_id", ["experience_level", "location"])
    return merged.select("user_id", "job_title", "experience_level", "location", "timezone")


@query
def rejected_patches(spark, sf):
    _, rejected = state.patch(_saved(spark, sf), _patches(spark, sf), "user_id", ["experience_level", "location"])
    return rejected


@query
def saved_preferences(spark, sf):
    """Save, then read back 89 days later."""
    log = preference_versions(_saved(spark, sf), now())
    return live_preferences(log, now() + F.expr("INTERVAL '89' DAY")).select("user_id", "job_title", "work_type")


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    """One moment per event with the profile of its user."""
    events = B.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    return events.join(schedule.with_effective_schedule(B.view(spark, sf, "profiles")), "user_id")


@query
def next_notifications(spark, sf):
    return _instants(spark, sf).select(
        "event_id", "user_id", clock.next_notification(F.col("at"), F.col("zone"), F.col("times")).alias("next_time")
    )


@query
def latest_slots(spark, sf):
    slot = clock.latest_due_slot(F.col("at"), F.col("zone"), F.col("notification_times"))
    return _instants(spark, sf).select("event_id", "user_id", slot.alias("slot")).select(
        "event_id", "user_id", F.col("slot.key").alias("slot_key"), "slot.lag_minutes"
    )


@query
def due_users(spark, sf):
    """Users due at each full half hour seen in the events."""
    half = F.timestamp_seconds(F.floor(F.unix_timestamp("at") / 1800) * 1800)
    moments = _instants(spark, sf).withColumn("moment", half)
    return moments.where(clock.is_due(F.col("moment"), F.col("zone"), F.col("times"))).select(
        "event_id", "user_id", "moment"
    )


@query
def due_now(spark, sf):
    at = F.lit("2024-01-30 07:00:00").cast("timestamp")
    return schedule.due_users(B.view(spark, sf, "profiles"), at).select("user_id")


@query
def earliest_run(spark, sf):
    profiles = B.view(spark, sf, "profiles").join(active_subscribers(spark, sf), "user_id", "left_semi")
    return schedule.earliest_run(profiles, now())


@query
def slot_claims(spark, sf):
    """Slots due per user zone at NOW, against a ledger of the runs customers' orders stand for."""
    at = F.lit("2024-01-30 19:05:00").cast("timestamp")
    slots = schedule.latest_slots(schedule.distinct_schedules(B.view(spark, sf, "profiles")), at).where("slot IS NOT NULL").select(
        F.concat("timezone", F.lit(":"), "slot.key").alias("slot_key"), "slot.lag_minutes"
    )
    ledger = B.view(spark, sf, "profiles").where("user_id % 50 = 0").select(
        F.concat("timezone", F.lit(":2024-01-30-2100")).alias("slot_key"),
        F.lit("scheduled").alias("mode"),
        (at - F.make_dt_interval(hours=(F.col("user_id") % 72).cast("int"))).alias("claimed_at"),
    )
    return schedule.claimable(slots, ledger, at)


# --- whole runs --------------------------------------------------------------------------------------

def _inputs(spark: SparkSession, sf: str) -> pipeline.RunInputs:
    profiles = B.view(spark, sf, "profiles").where("user_id % 7 <> 3")
    return pipeline.RunInputs(
        subscription_log=B.view(spark, sf, "subscription_log"),
        preferences=profiles,
        collector=lambda p: user_postings(spark, sf, p),
        analyses=_analyses(spark, sf),
        sent_log=_sent_log(spark, sf),
        failed_users=profiles.where("user_id % 41 = 5").select("user_id"),
    )


@query
def pipeline_outbox(spark, sf):
    return pipeline.plan_run(_inputs(spark, sf), now(), stage=Stager(spark)).outbox


@query
def pipeline_outcomes(spark, sf):
    return pipeline.plan_run(_inputs(spark, sf), now(), stage=Stager(spark)).outcomes


@query
def run_stats(spark, sf):
    return pipeline.plan_run(_inputs(spark, sf), now(), stage=Stager(spark)).stats


#: Sources of the run from payloads to messages.
RUN_SOURCES = ("arbeitnow", "remotive", "mostaql", "tanqeeb", "bayt", "wuzzuf", "forasna", "adzuna", "jooble", "jsearch")


@query
def collected_outbox(spark, sf):
    """A whole run from landed payloads: requests of the users, sources, union, duplicates, scores, messages."""
    stage, profiles = Stager(spark), B.searching_profiles(spark, sf).where("user_id % 7 <> 3")
    specs = [s for s in active_sources(ALL_KEYS) if s.name in RUN_SOURCES]
    made = user_requests(query_columns(profiles), [s for s in specs if not s.shared_feed])
    wanted = made.join(profiles.select("user_id", F.col("job_title").alias("wanted")), "user_id")
    payloads = stage(B.landed(spark, sf, wanted, [s.name for s in specs]), "payloads")
    nothing = B.view(spark, sf, "subscription_log").where("false")
    inputs = pipeline.RunInputs(
        subscription_log=B.view(spark, sf, "subscription_log"), preferences=profiles,
        collector=lambda people: sources.collect_from_sources(payloads, people, specs, now(), stage=stage),
        analyses=_analyses(spark, sf).where("false"),
        sent_log=nothing.selectExpr("user_id", "CAST(NULL AS STRING) AS fingerprint", "ts AS sent_at"),
    )
    return pipeline.plan_run(inputs, now(), stage=stage).outbox


@query
def due_run_outcomes(spark, sf):
    at = F.lit("2024-01-30 07:00:00").cast("timestamp")
    return pipeline.plan_due_run(_inputs(spark, sf), at, stage=Stager(spark)).outcomes.select("user_id", "outcome")


@query
def simple_notifications(spark, sf):
    return pipeline.plan_simple_notification(_inputs(spark, sf), now()).select(
        "user_id", "arrival_idx", "score", "reason", "rank"
    )


# --- bot updates -------------------------------------------------------------------------------------

@query
def update_dedup(spark, sf):
    """Events repeated within an hour of the last kept one of their type; events are too sparse for 10 seconds."""
    events = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return updates.dedup_updates(
        events, F.col("event_type"), "event_id", window_seconds=3600, chunk_seconds=86400
    ).select("event_id", "event_type", "ts")


@query
def wizard_preferences(spark, sf):
    return wizard.confirmed_preferences(B.view(spark, sf, "scripted_updates"))


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """Events as subscription commands and status requests."""
    return B.table(spark, sf, "events").select(
        F.col("user_id").alias("chat_id"), "user_id", F.col("event_id").alias("message_id"),
        F.lit("msg").alias("kind"),
        F.expr("""CASE event_type WHEN 'signup' THEN '/subscribe' WHEN 'error' THEN '/unsubscribe now'
            WHEN 'click' THEN '/subscription' ELSE '/subscriber' END""").alias("text"),
        F.lit(None).cast("string").alias("data"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query
def subscription_commands(spark, sf):
    return state.active_subscribers(subscriptions.subscription_actions(_commands(spark, sf)))


@query
def subscription_status(spark, sf):
    log = B.view(spark, sf, "subscription_log").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp"))
    return subscriptions.subscription_status(_commands(spark, sf), log)


def _drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into files and read them back."""
    spark = df.sparkSession
    folder = Stager(spark).folder
    stream = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint")
        .trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    layout = B.table(spark, sf, "events").schema
    return spark.readStream.schema(layout).parquet(f"{sf}/events*.parquet")


@query
def streamed_update_dedup(spark, sf):
    """The stream form on events as messages numbered per type and hour."""
    stream = _event_stream(spark, sf).select(
        F.col("user_id").alias("chat_id"), "user_id", F.col("event_id").alias("message_id"),
        F.lit("cb").alias("kind"), F.lit(None).cast("string").alias("text"),
        F.col("event_type").alias("data"), F.col("ts").cast("timestamp").alias("ts"),
    ).withColumns({"chat_id": F.lit(0).cast("long"), "message_id": F.lit(0).cast("long")})
    kept = updates.dedup_update_stream(stream, window_seconds=3600)
    return _drained(kept, "kept").select(F.col("data").alias("event_type"), "ts")


@query
def streamed_subscriptions(spark, sf):
    commands = _event_stream(spark, sf).select(
        "user_id", F.lit("msg").alias("kind"),
        F.expr("CASE event_type WHEN 'signup' THEN '/subscribe' WHEN 'error' THEN '/unsubscribe' END").alias("text"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return state.active_subscribers(_drained(subscriptions.subscription_actions(commands), "actions"))


@query
def streamed_wizard(spark, sf):
    """The stream form of the wizard on the scripted updates, landed as files first."""
    landed = Stager(spark)(B.view(spark, sf, "scripted_updates"), "updates")
    stream = spark.readStream.schema(landed.schema).parquet(landed.inputFiles()[0].rsplit("/", 1)[0])
    return _drained(wizard.confirmed_preference_stream(stream), "confirmed")


@query
def streamed_bot_updates(spark, sf):
    """The bot's chain on repeated deliveries, answers and commands that land in two waves; the second run goes on from the state of the first."""
    folder, made = Stager(spark).folder, B.view(spark, sf, "bot_updates")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for wave in (half, ~half):
        made.where(wave).write.mode("append").parquet(f"{folder}/updates")
        stream = spark.readStream.schema(made.schema).parquet(f"{folder}/updates")
        bot.start_bot(stream, f"{folder}/bot", available_now=True).awaitTermination()
    out = None
    for kind in bot.LOGS:
        log = spark.read.parquet(f"{folder}/bot/{kind}").drop("batch", "message_id").withColumn("kind", F.lit(kind))
        out = log if out is None else out.unionByName(log, allowMissingColumns=True)
    return out


@query
def streamed_matches(spark, sf):
    """Continuous matching with the sent log as state. The second wave repeats the postings of the first, and so sends those of the other users only."""
    inputs, folder = _inputs(spark, sf), Stager(spark).folder
    subscribers = state.active_subscribers(inputs.subscription_log)
    made = Stager(spark)(user_postings(spark, sf, inputs.preferences.join(subscribers, "user_id", "left_semi")), "postings")
    store = pipeline.RunStore(spark, f"{folder}/store")
    for wave in (made.where("user_id % 2 = 0"), made):
        wave.write.mode("append").parquet(f"{folder}/postings")
        stream = spark.readStream.schema(made.schema).parquet(f"{folder}/postings")
        continuous.start_match_stream(stream, inputs, store, f"{folder}/checkpoint", now(), available_now=True).awaitTermination()
    return store.read("outbox", "user_id long, seq int, text string, button_url string, fingerprint string")
