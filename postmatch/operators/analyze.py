"""One structured analysis per globally unique posting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.responses import parse_analysis_responses
from ..schema import ANALYSIS_TTL_DAYS
from .budget import Budget, admit
from .state import timestamp

# Batches of (fingerprint, prompt) in, batches of (fingerprint, response) out; runs on the executors.
Analyser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: Name of the built-in analyser.
KEYWORDS = "keywords"
PARALLEL_ANALYSES = 4
_NOT_IN_PROMPT = {"user_id", "arrival_idx", "fingerprint", "semantic_key"}


def live_analyses(analyses: DataFrame, now, days: int = ANALYSIS_TTL_DAYS) -> DataFrame:
    """Latest analysis per fingerprint written in the last ``days``."""
    at = timestamp(now)
    recent = analyses.where(
        (F.col("written_at") <= at) & (F.col("written_at") > at - F.make_dt_interval(days=F.lit(days)))
    )
    values = [c for c in recent.columns if c != "fingerprint"]
    return (
        recent.groupBy("fingerprint")
        .agg(F.max_by(F.struct(*values), "written_at").alias("v"))
        .select("fingerprint", "v.*")
    )


def analysis_misses(unique: DataFrame, analyses: DataFrame, now, days: int = ANALYSIS_TTL_DAYS) -> DataFrame:
    """Unique postings without a live analysis. Only the key of the cache is read."""
    at = timestamp(now)
    held = analyses.where(
        (F.col("written_at") <= at) & (F.col("written_at") > at - F.make_dt_interval(days=F.lit(days)))
    ).select("fingerprint")
    return unique.join(held, "fingerprint", "left_anti")


def _posting_json(postings: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in postings.columns if c not in _NOT_IN_PROMPT]))


def analysis_prompts(postings: DataFrame) -> DataFrame:
    """Rows (fingerprint, prompt) asking for role, skills, level, work type and a summary as JSON."""
    before = (
        "Read the job posting below and describe it as one JSON object with the keys role, skills, "
        "experienceLevel, workType and summary.\n"
        "role: backend, frontend, fullstack, mobile, devops, qa, data or other.\n"
        "experienceLevel: intern, junior, mid, senior, lead or unknown.\n"
        "workType: remote, hybrid, on-site or any.\n"
        "skills: the technical skills that matter, as a list of texts. summary: one short sentence.\n"
        "Use only what the posting says and answer with the JSON object alone.\n\nPosting:\n"
    )
    return postings.select("fingerprint", F.concat(F.lit(before), _posting_json(postings)).alias("prompt"))


def match_prompts(pairs: DataFrame, preferences: Column) -> DataFrame:
    """Add ``prompt`` asking for a score 0 to 100 and a reason for one posting and one user's preferences."""
    before = (
        "Rate from 0 to 100 how well the job posting fits the preferences: role first, then required skills, "
        "experience level, work type and place. Missing facts never count in favour.\n"
        'Answer with one JSON object {"score": number, "reason": "short text"} and nothing else.\n\nPreferences:\n'
    )
    return pairs.withColumn(
        "prompt",
        F.concat(F.lit(before), F.to_json(preferences), F.lit("\n\nPosting:\n"), _posting_json(pairs)),
    )


# Words that tell, in the order they are tried.
ROLE_WORDS = {
    "fullstack": ["full stack", "fullstack", "full-stack"], "frontend": ["frontend", "front end", "front-end", "react", "angular", "vue"],
    "mobile": ["mobile", "android", "ios", "flutter"], "devops": ["devops", "sre", "infrastructure", "platform engineer"],
    "qa": ["qa ", "quality assurance", "tester", "test engineer"], "data": ["data ", "machine learning", "analyst"],
    "backend": ["backend", "back end", "back-end", "api ", "server"],
}
LEVEL_WORDS = {
    "intern": ["intern ", "internship", "trainee"], "lead": ["lead ", "principal", "head of"], "senior": ["senior", "sr."],
    "junior": ["junior", "jr.", "entry level", "graduate"], "mid": ["mid-level", "mid level", "intermediate"],
}
WORK_WORDS = {"hybrid": ["hybrid"], "remote": ["remote", "work from home"], "on-site": ["on-site", "onsite", "on site", "office"]}


def _told(text: Column, words: dict[str, list[str]], otherwise: Column) -> Column:
    """The first name of which ``text`` contains a word."""
    out = None
    for name, spelled in words.items():
        hit = F.lit(False)
        for w in spelled:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return otherwise if out is None else out.otherwise(otherwise)


def keyword_analyses(misses: DataFrame, now, roles: dict[str, list[str]] | None = None, levels: dict[str, list[str]] | None = None,
                     works: dict[str, list[str]] | None = None) -> DataFrame:
    """Analysis rows by words alone: the built-in analyser, which asks no model and always answers.

    Role and level come from title and description, the kind of work from these and the location; what no word tells is other, the level that the
    posting states or unknown, the kind of work that it states or any. Skills are the posting's own, without blanks and repeats.
    """
    nothing = F.lit("")
    said = F.lower(F.concat_ws(" ", F.coalesce("title", nothing), F.coalesce("description", nothing), nothing))
    placed = F.lower(F.concat_ws(" ", said, F.coalesce("location", nothing), nothing))
    skills = F.array_distinct(F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != ""))
    return misses.select(
        "fingerprint",
        _told(said, ROLE_WORDS if roles is None else roles, F.lit("other")).alias("role"),
        _told(said, LEVEL_WORDS if levels is None else levels, F.coalesce(F.nullif("experience_level", nothing), F.lit("unknown"))).alias("level"),
        skills.alias("skills"),
        _told(placed, WORK_WORDS if works is None else works, F.coalesce(F.nullif("work_type", nothing), F.lit("any"))).alias("work_type"),
        timestamp(now).alias("written_at"),
    )


def posting_cost() -> Column:
    """What a posting costs to analyse: the characters of its texts."""
    texts = [F.coalesce(F.length(c), F.lit(0)) for c in ("title", "company", "location", "description")]
    total = F.coalesce(F.length(F.array_join("skills", " ")), F.lit(0))
    for t in texts:
        total = total + t
    return total


@dataclass
class Analysed:
    """Rows to append to the analyses, answers that were rejected (None for the built-in analyser), and postings that the budget left out."""

    good: DataFrame
    rejected: DataFrame | None
    skipped: DataFrame | None


def analyse_within(misses: DataFrame, analyser: Analyser | str, now, budget: Budget | None = None, parallel: int = PARALLEL_ANALYSES,
                   stage: Callable[[DataFrame, str], DataFrame] | None = None) -> Analysed:
    """Analyse ``misses`` in user and arrival order as far as ``budget`` goes; the others are matched by rules and come back as skipped.

    ``analyser`` is a plug-in or :data:`KEYWORDS`. ``parallel`` tasks ask the plug-in at a time, as many as the model behind it allows.
    """
    skipped = None
    if budget is not None and budget != Budget():
        misses, skipped = admit(misses, ["user_id", "arrival_idx"], posting_cost(), budget, stage=stage)
    if analyser == KEYWORDS:
        return Analysed(keyword_analyses(misses, now), None, skipped)
    asked = analysis_prompts(misses).repartition(parallel)
    answers = parse_analysis_responses(asked.mapInPandas(analyser, "fingerprint string, response string"))
    good = answers.where(F.col("error").isNull()).select(
        "fingerprint", "role", "level", "skills", "work_type", timestamp(now).alias("written_at")
    )
    return Analysed(good, answers.where(F.col("error").isNotNull()).select("fingerprint", "response", "error"), skipped)


def analyse(misses: DataFrame, analyser: Analyser, now, max_new: int | None = None,
            parallel: int = PARALLEL_ANALYSES) -> tuple[DataFrame, DataFrame]:
    """(analysis rows to append, rejected answers) of the first ``max_new`` misses in user and arrival order; see :func:`analyse_within`."""
    done = analyse_within(misses, analyser, now, Budget(rows=max_new), parallel)
    return done.good, done.rejected
