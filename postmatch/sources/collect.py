"""Landed payloads to one postings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collect import found_by_users, keyword_search
from ..operators.state import timestamp
from ..staging import unstaged
from .common import ASK, SourceSpec, query_columns, to_postings, with_own_fields, with_shared_fields, without_query_defaults
from .frontier import user_requests

#: Users of one request with the same title, work type and location that an item is brought to at a time.
ASKERS_PER_BLOCK = 256


def read_payloads(spark: SparkSession, path: str, source: str, request_id: str | None = None) -> DataFrame:
    """Landed response files as payload rows, one per file, numbered in the order of their addresses.

    A file named ``<request_id>.<anything>`` serves that request unless ``request_id`` is given.
    """
    files = spark.read.text(path, wholetext=True)
    # The list of files is what the reader itself holds on the driver; it numbers them, so that no two items share an identity.
    numbers = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(files.inputFiles()))], "_file string, payload_no long")
    files = files.withColumn("_file", F.input_file_name()).join(numbers, "_file")
    name = F.regexp_extract("_file", r"([^/]+?)(?:\.[^/.]*)?$", 1)
    return files.select(
        (F.lit(request_id) if request_id is not None else name).alias("request_id"),
        F.lit(source).alias("source"),
        "payload_no",
        F.col("value").alias("payload"),
    )


def feed_postings(items: DataFrame, profiles: DataFrame, spec: SourceSpec, now, query_defaults: bool = True,
                  stage: Callable[[DataFrame, str], DataFrame] = unstaged) -> DataFrame:
    """Postings of a shared feed: each user gets the items that contain one of their keywords.

    The items are read three times; ``stage`` can keep them from being parsed three times.
    """
    items = stage(items, spec.name)
    feed = items.withColumn("_search", spec.search())
    queries = query_columns(profiles)
    if not query_defaults:
        queries = without_query_defaults(queries)
    own = with_own_fields(items, spec, timestamp(now))
    if spec.cap is None:
        joined = found_by_users(feed, "_search", own, profiles, queries, spec.trim_keywords)
    else:
        pairs = keyword_search(feed, "_search", profiles, spec.trim_keywords, spec.cap)
        joined = pairs.join(queries, "user_id").join(own, "ordinal")
    return to_postings(joined, spec, timestamp(now))


def requested_postings(items: DataFrame, asked: DataFrame, profiles: DataFrame, spec: SourceSpec, now,
                       query_defaults: bool = True) -> DataFrame:
    """Postings of a searched source: one payload serves every user with the same request.

    ``asked`` holds (user_id, request_id). Queries are attached to the requests first, so that the wide
    item side is shuffled once, on the request. Users whose queries give an item the same fields travel as one row, and
    only the finished item goes to each of them.
    """
    queries = query_columns(profiles)
    if not query_defaults:
        queries = without_query_defaults(queries)
    own, askers = with_own_fields(items, spec, timestamp(now)), asked.select("user_id", "request_id").join(queries, "user_id")
    if spec.query_fields is None or spec.user_fields is None:
        return to_postings(own.join(askers, "request_id"), spec, timestamp(now))
    joined = with_shared_fields(own.join(_in_blocks(askers), "request_id"), spec, timestamp(now))
    return to_postings(joined.select("*", F.inline("_askers")).drop("_askers"), spec, timestamp(now))


def _in_blocks(askers: DataFrame) -> DataFrame:
    """(request_id, the columns of ``ASK``, _askers): users in blocks, so that a request that many make is not one group."""
    # Only the number of blocks hangs on this hash, not who is in a group.
    askers = askers.withColumn("_ask", F.xxhash64("request_id", *ASK))
    sizes = askers.groupBy("_ask").agg(F.ceil(F.count(F.lit(1)) / ASKERS_PER_BLOCK).alias("_blocks"))
    placed = askers.join(sizes, "_ask").withColumn("_block", F.pmod(F.xxhash64("user_id"), F.col("_blocks")))
    people = F.collect_list(F.struct("user_id", "q_level", "q_skills")).alias("_askers")
    return placed.groupBy("request_id", *ASK, "_block").agg(people).drop("_block")


def collect_from_sources(payloads: DataFrame, profiles: DataFrame, specs: list[SourceSpec], now,
                         query_defaults: bool = True,
                         stage: Callable[[DataFrame, str], DataFrame] = unstaged) -> DataFrame:
    """Union of all sources, in source order through ``arrival_idx``.

    ``payloads`` has request_id, source (the spec name), payload_no and payload. A payload that cannot be
    read gives no rows; :func:`source_status` reports it.
    """
    requests = user_requests(query_columns(profiles), [s for s in specs if not s.shared_feed])
    out: DataFrame | None = None
    for spec in specs:
        items = spec.items(payloads.where(F.col("source") == spec.name))
        if spec.shared_feed:
            rows = feed_postings(items, profiles, spec, now, query_defaults, stage)
        else:
            asked = requests.where(F.col("source") == spec.name)
            rows = requested_postings(items, asked, profiles, spec, now, query_defaults)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources given")
    return out


def source_status(payloads: DataFrame, specs: list[SourceSpec]) -> DataFrame:
    """One row per active source: source, source_rank, failed, payloads, unreadable.

    A source failed when nothing was landed for it or one of its payloads is not readable.
    """
    json_sources = [s.name for s in specs if s.items.__module__.endswith("json_feeds")]
    readable = F.when(F.col("source").isin(json_sources), F.try_parse_json("payload").isNotNull()).otherwise(
        F.coalesce(F.col("payload") != "", F.lit(False))
    )
    seen = payloads.groupBy("source").agg(
        F.count(F.lit(1)).alias("payloads"), F.count_if(~readable).alias("unreadable")
    )
    expected = payloads.sparkSession.createDataFrame(
        [(s.name, s.source, s.rank) for s in specs], "name string, source string, source_rank int"
    )
    return (
        expected.join(seen.withColumnRenamed("source", "name"), "name", "left")
        .select(
            "source",
            "source_rank",
            F.coalesce("payloads", F.lit(0)).alias("payloads"),
            F.coalesce("unreadable", F.lit(0)).alias("unreadable"),
        )
        .withColumn("failed", (F.col("payloads") == 0) | (F.col("unreadable") > 0))
    )
