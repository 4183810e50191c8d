"""Match scores and their reasons.

Both scores compare normal forms that are prepared once per posting and once per profile
(:func:`prepare_postings`, :func:`prepare_profiles`, :func:`prepare_analyses`), not once per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import forms_match, match_form, utf16_length

# --- fixed values: points and wording of the scoring rules ---
ROLE_POINTS = 35
SKILL_POINTS = 10
SKILL_POINTS_MAX = 30
LEVEL_POINTS = 20
LEVEL_PENALTY = -15
WORK_TYPE_POINTS = 15
SCORE_MAX = 100
ROLE_REASON = "role matches"
SKILL_REASON = " skill(s) match"
LEVEL_REASON = "experience level matches"
LEVEL_MISMATCH_REASON = "experience level does not match"
WORK_ANY_REASON = "work type matches (any)"
WORK_REASON = "work type matches"
REMOTE_REASON = "remote matches"
RULE_DEFAULT_REASON = "Rule-based match"
ANALYSIS_DEFAULT_REASON = "No strong match found"
# --- end of fixed values ---


def richness() -> Column:
    """How much a posting tells: decides which copy of a duplicate survives."""

    def point(condition: Column, points: int = 1) -> Column:
        return F.when(condition, points).otherwise(0)

    filled = [point(F.coalesce(F.col(c), F.lit("")) != "") for c in
              ("location", "country", "work_type", "experience_level")]
    long_text = (F.length("description") > 20) | (utf16_length("description") > 20)
    paid = (F.coalesce("salary_min", F.lit(0.0)) != 0) | (F.coalesce("salary_max", F.lit(0.0)) != 0)
    total = point(long_text, 2) + point(paid, 2) + point(F.col("remote"))
    for p in filled:
        total = total + p
    return (total + F.coalesce(F.array_size("skills"), F.lit(0))).cast("int")


def prepare_postings(postings: DataFrame) -> DataFrame:
    """Add the normal forms of a posting, unless it got them before it was fanned out to users."""
    if "m_title" in postings.columns:
        return postings
    return postings.withColumns({
        "m_title": match_form("title"),
        "m_skills": F.transform("skills", match_form),
        "m_level": match_form(F.nullif("experience_level", F.lit(""))),
        "m_work": match_form(F.nullif("work_type", F.lit(""))),
    })


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Narrow, prefixed view of the preferences used by the scores."""
    wanted_title = F.nullif("job_title", F.lit(""))
    return profiles.select(
        "user_id",
        match_form(wanted_title).alias("p_title"),
        F.transform("skills", match_form).alias("p_skills"),
        match_form(F.nullif("experience_level", F.lit(""))).alias("p_level"),
        F.nullif("work_type", F.lit("")).alias("p_work_raw"),
        match_form(F.nullif("work_type", F.lit(""))).alias("p_work"),
    )


def prepare_analyses(analyses: DataFrame) -> DataFrame:
    return analyses.select(
        "fingerprint",
        match_form("role").alias("a_role"),
        F.transform("skills", match_form).alias("a_skills"),
        match_form("level").alias("a_level"),
        match_form(F.nullif("work_type", F.lit(""))).alias("a_work"),
        F.lit(True).alias("analysed"),
    )


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def matched_skills(wanted: Column, offered: Column) -> Column:
    """The wanted skills that match at least one offered skill."""
    return F.filter(wanted, lambda w: F.exists(offered, lambda o: forms_match(o, w)))


def _combine(parts: list[tuple[Column, Column]], default: str) -> tuple[Column, Column]:
    score = F.lit(0)
    for points, _ in parts:
        score = score + points
    text = F.concat_ws(", ", *[reason for _, reason in parts])
    return (
        F.least(score, F.lit(SCORE_MAX)).cast("int"),
        F.when(text == "", F.lit(default)).otherwise(text),
    )


def _flag(condition: Column, points: int, reason: str) -> tuple[Column, Column]:
    held = _holds(condition)
    return F.when(held, points).otherwise(0), F.when(held, F.lit(reason))


def _skills(n: Column) -> tuple[Column, Column]:
    n = F.coalesce(n, F.lit(0))
    return (
        F.least(F.lit(SKILL_POINTS_MAX), n * SKILL_POINTS),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(SKILL_REASON))),
    )


def add_skill_counts(pairs: DataFrame) -> DataFrame:
    """Count matched skills once per pair; scores and reasons both read the count."""
    return pairs.withColumns({
        "n_rule_skills": F.array_size(matched_skills(F.col("p_skills"), F.col("m_skills"))),
        "n_analysis_skills": F.array_size(matched_skills(F.col("p_skills"), F.col("a_skills"))),
    })


def rule_score(any_level_neutral: bool = False) -> tuple[Column, Column]:
    """Score from the posting itself, used where no analysis exists. May be negative."""
    c = F.col
    both_levels = c("p_level").isNotNull() & c("m_level").isNotNull()
    level_hit = forms_match(c("m_level"), c("p_level"))
    level_miss = both_levels & ~level_hit
    if any_level_neutral:
        level_miss = level_miss & (c("p_level") != "any")
    any_work = c("p_work_raw") == "any"
    work_hit = forms_match(c("m_work"), c("p_work"))
    work_points, work_reason = F.when(_holds(any_work | work_hit), WORK_TYPE_POINTS), None
    remote_hit = (c("p_work_raw") == "remote") & c("remote")
    work_points = work_points.when(_holds(remote_hit), WORK_TYPE_POINTS).otherwise(0)
    work_reason = (
        F.when(_holds(any_work), WORK_ANY_REASON)
        .when(_holds(work_hit), WORK_REASON)
        .when(_holds(remote_hit), REMOTE_REASON)
    )
    level = (
        F.when(_holds(level_hit), LEVEL_POINTS).when(_holds(level_miss), LEVEL_PENALTY).otherwise(0),
        F.when(_holds(level_hit), LEVEL_REASON).when(_holds(level_miss), LEVEL_MISMATCH_REASON),
    )
    return _combine(
        [
            _flag(forms_match(c("m_title"), c("p_title")), ROLE_POINTS, ROLE_REASON),
            _skills(c("n_rule_skills")),
            level,
            (work_points, work_reason),
        ],
        RULE_DEFAULT_REASON,
    )


def analysis_score() -> tuple[Column, Column]:
    """Score from the structured analysis of the posting."""
    c = F.col
    any_work = c("p_work_raw") == "any"
    work_hit = forms_match(c("a_work"), c("p_work"))
    work = (
        F.when(_holds(any_work | work_hit), WORK_TYPE_POINTS).otherwise(0),
        F.when(_holds(any_work), WORK_ANY_REASON).when(_holds(work_hit), WORK_REASON),
    )
    return _combine(
        [
            _flag(forms_match(c("a_role"), c("p_title")), ROLE_POINTS, ROLE_REASON),
            _skills(c("n_analysis_skills")),
            _flag(forms_match(c("a_level"), c("p_level")), LEVEL_POINTS, LEVEL_REASON),
            work,
        ],
        ANALYSIS_DEFAULT_REASON,
    )
