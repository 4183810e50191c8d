"""Preference normal forms and checks, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXPERIENCE_LEVELS, WORK_TYPES
from .text import clean_trim, col, squeeze, utf16_length


def normalize_job_title(c) -> Column:
    return squeeze(c)


def valid_job_title(c) -> Column:
    return F.coalesce(utf16_length(squeeze(c)).between(2, 100), F.lit(False))


def valid_work_type(c) -> Column:
    return F.coalesce(col(c).isin(WORK_TYPES), F.lit(False))


def valid_experience_level(c) -> Column:
    return F.coalesce(col(c).isin(EXPERIENCE_LEVELS), F.lit(False))


def normalize_location(c) -> Column:
    """Null when empty or the word ``any``."""
    t = squeeze(c)
    return F.when((t != "") & (F.lower(t) != "any"), t)


def normalize_skills(c) -> Column:
    """Comma list to array, in order, repeats kept, blanks dropped."""
    return F.filter(F.transform(F.split(col(c), ","), clean_trim), lambda s: s != "")
