"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition under which a document is rejected. A bounded sample gives each rule a cost (seconds for the sample)
and a rejection rate; rules run in order of rejection per cost inside one CASE, whose later branches are evaluated only for
documents that the earlier ones let pass. The order changes cost and the named rule, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Stager, free_names, table, whole, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"


def base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (all long) of every whole text.

    A null or blank text has zeros. Repeated windows are found by sorting 64-bit hashes of the windows inside the row;
    two different windows of one text share a hash with probability below 2e-10 even at 100,000 words.
    """
    body = whole(text)
    listed, parted, ordered = free_names(df.columns, "_words", "_lines", "_sorted")
    words = df.withColumn(listed, words_of(body))
    n = F.size(listed)
    key = lambda x, i: F.xxhash64(x, *[F.get(listed, i + k) for k in range(1, WINDOW)])
    windows = F.transform(
        F.slice(listed, 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda x, i: F.struct(key(x, i).alias("h"), i.alias("i"))
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    steps = words.withColumns({parted: lines, ordered: F.sort_array(windows)})
    same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
    starts = F.filter(
        F.transform(ordered, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull()
    )
    covered = F.aggregate(
        F.sort_array(starts), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(WINDOW), s - a["last"])).alias("total")),
    )["total"]
    stats = {
        "n_words": n, "word_chars": F.length(F.array_join(listed, "")), "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size(parted), "n_dup_lines": F.size(parted) - F.size(F.array_distinct(parted)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # Generated columns stop filters from being pushed down, which would work out the sorted windows again for each window.
    row = F.struct(*[v.cast("long").alias(k) for k, v in stats.items()])
    return steps.select(*[F.col(f"`{c}`") for c in df.columns if c not in stats], F.inline(F.array(row)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules(text: str = "text") -> dict[str, Column]:
    """Rejecting conditions over the text and the columns of :func:`base_stats`, in whole numbers."""
    body = whole(text)
    left = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    return {
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "symbols": 2 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "exclamations": 4 * (F.size(F.split(body, "!!")) - 1) > F.col("n_words"),
        "capitals": 2 * left(r"\P{Lu}+") > F.col("word_chars"),
        "letters": 2 * left(r"\P{L}+") < F.col("word_chars"),
    }


def measured_order(sample: DataFrame, conditions: dict[str, Column], repeats: int = 2) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejection rate) on the sample, best rejection per cost first. ``sample`` should be a staged table."""
    n = max(1, sample.count())

    def run(condition: Column) -> tuple[float, int]:
        took, hits = [], 0
        for _ in range(repeats):
            start = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            took.append(time.perf_counter() - start)
        return min(took), hits

    floor, _ = run(F.lit(False))
    found = []
    for name, condition in conditions.items():
        seconds, hits = run(condition)
        found.append((name, max(seconds - floor, 1e-4), hits / n))
    return sorted(found, key=lambda r: (-r[2] / r[1], r[0]))


def apply_cascade(stats: DataFrame, conditions: dict[str, Column], order: list[str]) -> DataFrame:
    """Adds base_failed, rejected_by ('base', a rule, or null) and kept. ``stats`` carries :func:`base_stats`."""
    verdict = F.when(base_failed(), F.lit("base"))
    for name in order:
        verdict = verdict.when(conditions[name], F.lit(name))
    return stats.withColumns({"base_failed": base_failed(), "rejected_by": verdict}).withColumn(
        "kept", F.col("rejected_by").isNull()
    )


def quality_rules(spark: SparkSession, docs: DataFrame, text: str = "text", sample_rows: int = 1_000) -> DataFrame:
    """The input columns plus statistics, base_failed, rejected_by and kept; one row per input row.

    ``sample_rows`` bounds (in expectation) the sample for the order of the rules; every row is judged by every needed rule.
    Null and empty texts fail the base. Repeated rows are judged alike. Input columns named like an added one are replaced.
    """
    n = docs.count()
    conditions = rules(text)
    sample = base_stats(docs.select(text).sample(min(1.0, sample_rows / max(n, 1)), seed=7), text)
    order = [name for name, _, _ in measured_order(Stager(spark)(sample, "rule_sample"), conditions)]
    return apply_cascade(base_stats(docs, text), conditions, order)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM (
        SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5))),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY rid),
s AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 2 * (length(text) - length(replace(text, '!!', ''))) > n_words
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
            OR 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars) AS kept
FROM b
"""
