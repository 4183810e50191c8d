"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Every window starts with the conversation's system turn, then
repeats limited history, then holds its span. Only assistant texts of the span are targets; repeated turns are context.

Template: ``### <role>: <text></turn>\n``. Inside roles and texts ``\\`` becomes ``\\0``, ``###`` becomes ``\\1`` and ``</turn>`` becomes ``\\2``
(in roles also ``: `` becomes ``\\3``), so marks never occur in them and plain replacement in reverse order restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, table

ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
OPEN, CLOSE, COLON = "### ", "</turn>\n", ": "
#: The adversarial conversation of the contract: control strings inside texts.
PROBE = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.replace(text, F.lit(COLON), F.lit("\\3")) if role else text


def unescaped(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("\\3"), F.lit(COLON))
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 192, overhead: int = 4) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_turns, loss_mask) from (conv_id, turn, role, text).

    ``loss_mask`` is an array of (start, length) in code points of ``formatted``, ``n_repeated`` the number of leading context turns.
    A turn costs its words plus ``overhead``. A window keeps to ``budget`` unless the system turn or one turn alone exceeds its share: turns
    are never cut. Turns are ordered by number, role and text; nulls sort first and count as empty texts; rows that repeat are
    turns of their own. A null conv_id is a conversation. An empty table gives no windows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({
        "cost": (F.size(F.array_remove(F.split("text", BLANKS), "")) + overhead).cast("long"),
    })
    rows = rows.withColumn("pos", F.row_number().over(order))
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    # The leading system turn is paid in every window.
    leads = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumns({
        "leads": leads, "system_cost": F.max(F.when(leads, F.col("cost")).otherwise(0)).over(by_pos),
        "before": F.sum(F.when(leads, 0).otherwise(F.col("cost"))).over(by_pos) - F.when(leads, 0).otherwise(F.col("cost")),
    })
    room = F.greatest(F.lit(budget - history) - F.col("system_cost"), F.lit(2))
    half = F.floor(room / 2)
    rows = rows.withColumns({"bucket": F.floor(F.col("before") / half), "long": F.col("cost") > half})
    # Buckets of half the room, by where a turn begins: a span ends at most one half later. Longer turns stand alone.
    last = lambda c: F.lag(c).over(by_pos)
    begins = F.coalesce(
        ~last("leads") & ((F.col("bucket") != last("bucket")) | F.col("long") | last("long")), F.lit(False)
    )
    rows = rows.withColumn("begins", begins).withColumn("window", F.sum(F.col("begins").cast("long")).over(by_pos))
    # A later window repeats a turn if it begins at most ``history`` tokens after the turn began.
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("begins"), F.col("window"))).over(ahead)
    all_windows = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "later": F.when(~F.col("leads"), later), "n_windows": F.max("window").over(all_windows),
    })
    # The system turn goes to every window; the first use of a turn is its own, the others repeat it.
    every = F.when(F.col("leads"), F.sequence(F.lit(0).cast("long"), F.col("n_windows"))).otherwise(
        F.array_distinct(F.concat(F.array("window"), F.coalesce("later", F.array().cast("array<bigint>"))))
    )
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(COLON))
    used = rows.select(
        "conv_id", "pos", F.col("window").alias("own"), F.explode(every).alias("window"), (F.col("role") == "assistant").alias("target"),
        head.alias("head"), escaped(F.col("text")).alias("body"),
    ).withColumn("repeated", F.col("own") != F.col("window"))
    turn = F.struct("pos", "repeated", "target", "head", "body")
    windows = used.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda a, t: F.struct(
            (a["at"] + size(t)).alias("at"),
            F.when(t["target"] & ~t["repeated"], F.concat(a["mask"], F.array(F.struct(
                (a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
    )
    return windows.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"), F.size("turns").alias("n_turns"),
        spans["mask"].alias("loss_mask"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of every conversation from its formatted windows: turns once each, the text under the loss mask, sizes."""
    marked = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    own = windows.withColumn("own", F.filter(marked, lambda x, i: i >= F.col("n_repeated")))
    cut = lambda x: F.instr(x, COLON)
    turn = lambda x: F.concat(
        unescaped(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - len(OPEN) - 1), True), F.lit("\n"),
        unescaped(F.substring(x, cut(x) + len(COLON), F.length(x))), F.lit("\n"),
    )
    loss = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    parts = own.select(
        "conv_id", "window", F.array_join(F.transform("own", turn), "").alias("turns"), F.array_join(loss, "").alias("loss"),
        F.size("own").alias("n"), F.length("formatted").alias("chars"),
    )
    # The digest of a conversation is one hash over all of it, so its text has to meet in one row.
    whole = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    return whole.select(
        "conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"),
        "formatted_chars", "n_windows",
    ).select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(turns.unionByName(probe)))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost FROM t),
q AS (SELECT *, pos = 1 AND role = 'system' AS leads FROM p),
r AS (SELECT *, max(CASE WHEN leads THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_cost, CAST(sum(CASE WHEN leads THEN 0 ELSE cost END)
  OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) - CASE WHEN leads THEN 0 ELSE cost END AS offs FROM q),
h AS (SELECT *, greatest(1024 - 192 - lead_cost, 2) // 2 AS half FROM r),
s AS (SELECT *, offs // half AS bucket, cost > half AS big FROM h),
u AS (SELECT *, coalesce(NOT lag(leads) OVER o AND (bucket <> lag(bucket) OVER o OR big OR lag(big) OVER o), false) AS begins FROM s
  WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
v AS (SELECT *, CAST(sum(CAST(begins AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS span,
  length(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ': ', '\3'))
  + length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) + 4 + 2 + 8 AS chars FROM u),
n AS (SELECT conv_id, max(span) + 1 AS n_windows FROM v GROUP BY conv_id),
repeats AS (SELECT j.conv_id, sum(j.chars) AS chars FROM v j JOIN v i ON i.conv_id = j.conv_id AND i.begins AND NOT j.leads
  AND i.offs - j.offs BETWEEN 1 AND 192 GROUP BY j.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
  sum(CASE WHEN leads THEN chars * n_windows ELSE chars END) AS chars, any_value(n_windows) AS n_windows FROM v JOIN n USING (conv_id) GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(d.chars + coalesce(repeats.chars, 0) AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM d LEFT JOIN repeats USING (conv_id)
"""
