"""Bring feed postings to the users who search for them, and drop invalid or old rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_trim, first_truthy
from ..functions.urls import is_web_url
from ..schema import RECENT_DAYS
from .keywords import keyword_hits
from .ranking import top_n
from .state import timestamp

#: Users of one search that a row of :func:`found_by_users` is brought to at a time.
USERS_PER_BLOCK = 64
#: Users of one keyword that meet its items in one group of :func:`brought_to_users`.
SEARCHERS_PER_BLOCK = 4096


def is_valid_posting() -> Column:
    """Title, company and source not blank, an http(s) address, both dates set."""
    filled = [F.coalesce(clean_trim(c), F.lit("")) != "" for c in ("title", "company", "source")]
    ok = is_web_url(F.coalesce(first_truthy("application_url", "url"), F.lit("")))
    for f in filled:
        ok = ok & f
    return ok & F.col("publication_date").isNotNull() & F.col("scraped_at").isNotNull()


def valid_postings(postings: DataFrame) -> DataFrame:
    return postings.where(is_valid_posting())


def recent_postings(postings: DataFrame, now, days: int = RECENT_DAYS) -> DataFrame:
    """At most ``days`` old; an unknown date counts as recent."""
    cutoff = timestamp(now) - F.make_dt_interval(days=F.lit(days))
    return postings.where(F.col("publication_date").isNull() | (F.col("publication_date") >= cutoff))


def profile_keywords(profiles: DataFrame, trim: bool) -> DataFrame:
    """Rows (user_id, keyword): title and skills in lower case, or the empty keyword if there are none.

    The empty keyword is part of every text, so a user without keywords receives every posting.
    """
    words = F.filter(
        F.concat(F.array("job_title"), F.coalesce("skills", F.array().cast("array<string>"))),
        lambda w: w.isNotNull() & (w != ""),
    )
    lowered = F.transform(words, lambda w: clean_trim(F.lower(w)) if trim else F.lower(w))
    keywords = F.when(F.size(lowered) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(lowered))
    return profiles.select("user_id", F.explode(keywords).alias("keyword"))


def keyword_search(feed: DataFrame, text: str, profiles: DataFrame, trim: bool, cap: int | None = None,
                   order: str = "ordinal") -> DataFrame:
    """Rows (user_id, ``order``) of the feed items that contain any keyword of the user.

    ``order`` identifies an item and gives the feed order. With ``cap`` only the first items per user are
    kept; they are among the first ``cap`` of each keyword, so both cuts together are exact. A keyword then
    carries at most ``cap`` items, as one array per user and keyword.
    """
    wanted = profile_keywords(profiles, trim)
    hits = keyword_hits(feed, text, order, wanted)
    if cap is None:
        return wanted.join(hits, "keyword").select("user_id", order).distinct()
    firsts = (
        top_n(hits, ["keyword"], [F.col(order)], cap, "_k")
        .groupBy("keyword")
        .agg(F.collect_list(order).alias("_firsts"))
    )
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_firsts"))))
    return (
        wanted.join(firsts, "keyword")
        .groupBy("user_id")
        .agg(F.slice(merged, 1, cap).alias("_items"))
        .select("user_id", F.explode("_items").alias(order))
    )


def found_by_users(feed: DataFrame, text: str, items: DataFrame, profiles: DataFrame, queries: DataFrame, trim: bool, order: str = "ordinal") -> DataFrame:
    """Rows of ``items`` with the columns of ``queries``, for every item that an uncapped :func:`keyword_search` finds for the user of a query.

    Users with the same keywords make one search: repeats are removed and items attached per search, and only then does a row go to the users of
    the search. They are dealt over blocks, so that a search that many share is not one group.
    """
    people = profile_keywords(profiles, trim).groupBy("user_id").agg(F.array_sort(F.collect_set("keyword")).alias("_search_keys"))
    searches = people.groupBy("_search_keys").agg(F.ceil(F.count(F.lit(1)) / USERS_PER_BLOCK).alias("_blocks"))
    wanted = searches.select("_search_keys", "_blocks", F.explode("_search_keys").alias("keyword"))
    found = wanted.join(keyword_hits(feed, text, order, wanted), "keyword").select("_search_keys", "_blocks", order).distinct()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    rows = found.join(items, order).select("*", every)
    placed = people.join(searches, "_search_keys").withColumn("_block", F.pmod(F.xxhash64("user_id"), F.col("_blocks"))).drop("_blocks")
    askers = placed.join(queries, "user_id")
    return rows.join(askers, ["_search_keys", "_block"]).drop("_search_keys", "_block", "_blocks")


def brought_to_users(feed: DataFrame, text: str, items: DataFrame, searches: DataFrame, users: DataFrame, trim: bool, order: str = "ordinal") -> DataFrame:
    """Rows of ``items`` with the columns of ``users`` (user_id, ...), for every pair that an uncapped :func:`keyword_search` finds.

    Items go to the keywords they contain and users to their keywords; pairs are made where both meet, and are neither shuffled nor
    compared with each other: of several keywords that find a pair only the first makes it, since the item is looked through for the
    earlier ones. What moves grows with hits and users' keywords, not with pairs. Users of a keyword are dealt over blocks.
    """
    parts = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = profile_keywords(searches, trim).groupBy("user_id").agg(F.array_sort(F.collect_set("keyword")).alias("_keys"))
    blocks = keys.select(F.explode("_keys").alias("keyword")).groupBy("keyword").agg(F.ceil(F.count(F.lit(1)) / SEARCHERS_PER_BLOCK).alias("_blocks"))
    askers = users.join(keys, "user_id").select("*", F.posexplode("_keys").alias("_at", "keyword"))
    askers = askers.withColumn("_earlier", F.slice("_keys", F.lit(1), F.col("_at"))).drop("_keys", "_at").join(blocks, "keyword")
    askers = askers.withColumn("_block", F.pmod(F.xxhash64("user_id"), F.col("_blocks"))).drop("_blocks").repartition(parts, "keyword", "_block")
    # Rows that share ``order`` are one item: it contains what any of them contains.
    texts = feed.where(F.col(text).isNotNull()).groupBy(order).agg(F.collect_set(text).alias("_texts"))
    found = keyword_hits(feed, text, order, blocks).distinct().join(blocks, "keyword").join(texts, order).join(items, order)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    found = found.select("*", every).drop("_blocks").repartition(parts, "keyword", "_block")
    made_before = F.exists("_earlier", lambda k: F.exists("_texts", lambda t: F.contains(t, k)))
    return found.join(askers, ["keyword", "_block"]).where(~made_before).drop("keyword", "_block", "_earlier", "_texts")
