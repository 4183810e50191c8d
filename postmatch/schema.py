"""Column layouts, enumerations and fixed constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and durations every consumer of the tables relies on ---
WORK_TYPES = ["remote", "hybrid", "on-site", "any"]
EXPERIENCE_LEVELS = ["intern", "junior", "mid", "senior", "lead", "any"]
SOURCE_TYPES = [
    "arbeitnow", "adzuna", "jooble", "tanqeeb", "taqneeb", "mostaqel", "baeed", "souq", "bayt",
    "narigulf", "freelancer", "we_work_remotely", "remotive", "wuzzuf", "forasna", "linkedin", "other",
]
WIZARD_STEPS = ["job-title", "work-type", "experience-level", "location", "skills", "confirmation"]

POSTING_TTL_HOURS = 24
ANALYSIS_TTL_DAYS = 7
PREFERENCES_TTL_DAYS = 90
SENT_TTL_DAYS = 30
SLOT_TTL_HOURS = 36
UPDATE_DEDUP_SECONDS = 10

RECENT_DAYS = 7
MIN_MATCH_SCORE = 40
MAX_CATCHUP_LAG_MINUTES = 300
DEFAULT_TIMEZONE = "Asia/Gaza"
DEFAULT_TIMES = ["09:00", "21:00"]
# --- end of fixed values ---

POSTING = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("arrival_idx", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("application_url", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("remote", T.BooleanType()),
    T.StructField("work_type", T.StringType()),
    T.StructField("experience_level", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("publication_date", T.TimestampType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

PREFERENCES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("job_title", T.StringType()),
    T.StructField("work_type", T.StringType()),
    T.StructField("experience_level", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("timezone", T.StringType()),
    T.StructField("notification_times", T.ArrayType(T.StringType())),
])

ANALYSIS = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("work_type", T.StringType()),
    T.StructField("written_at", T.TimestampType()),
])

SENT_LOG = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("job_title", T.StringType()),
    T.StructField("company", T.StringType()),
])

#: The stored form: folders by day, which a reader of the last weeks prunes.
SENT_LOG_BY_DATE = T.StructType([*SENT_LOG.fields, T.StructField("sent_date", T.DateType())])

SLOT_LEDGER = T.StructType([
    T.StructField("slot_key", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("claimed_at", T.TimestampType()),
])

SUBSCRIPTION_LOG = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

UPDATE = T.StructType([
    T.StructField("chat_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# One landed response body; ``request_id`` ties it to the users who asked for it.
PAYLOAD = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("payload", T.StringType()),
])
