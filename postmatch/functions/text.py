"""Text cleaning and normal forms, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the source system's whitespace class covers; Java's \s is smaller.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
              0x205F, 0x3000, 0xFEFF]
)
WS_CLASS = (
    r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# Word boundary over ASCII word characters only; Java's own \b is Unicode-aware.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# --- fixed values: noise words removed from titles and companies ---
TITLE_NOISE_IN_PARENS = ["m/f/d", "m/w/d", "w/m/d", "f/m/d", "remote", "hybrid", "onsite", "urgent"]
TITLE_NOISE_IN_BRACKETS = ["remote", "hybrid", "onsite", "urgent", "full-time", "part-time"]
COMPANY_SUFFIXES_WITH_DOT = ["inc", "llc", "ltd", "corp", "co"]
COMPANY_SUFFIXES = ["limited", "corporation", "gmbh", "sae", "fze"]
# --- end of fixed values ---


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_trim(c) -> Column:
    """Trim the full Unicode whitespace set (plain ``trim`` only removes U+0020)."""
    return F.trim(col(c), F.lit(WHITESPACE))


def collapse(c) -> Column:
    """Replace each whitespace run by one space, keeping the ends."""
    return F.regexp_replace(col(c), WS_CLASS + "+", " ")


def squeeze(c) -> Column:
    """Collapse whitespace and trim."""
    return F.trim(collapse(c))


def strip_tags(c, by: str = " ") -> Column:
    """Drop markup tags; an unclosed ``<`` removes the rest. Entities stay as they are."""
    return F.regexp_replace(col(c), "<[^>]*>?", by)


def clean_html(c) -> Column:
    return squeeze(strip_tags(c))


def truthy(c) -> Column:
    """Null for the empty string, for use in ``coalesce`` chains."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cols) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def truncate(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def utf16_length(c) -> Column:
    """Length in UTF-16 units: the unit the validation limits are expressed in."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def normalize_title(c) -> Column:
    parens = "|".join(TITLE_NOISE_IN_PARENS)
    brackets = "|".join(TITLE_NOISE_IN_BRACKETS)
    t = F.lower(col(c))
    t = F.regexp_replace(t, rf"\((?:{parens})\)", "")
    t = F.regexp_replace(t, rf"\[(?:{brackets})\]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.coalesce(F.trim(t), F.lit(""))


def normalize_company(c) -> Column:
    words = "|".join([rf"{w}\.?" for w in COMPANY_SUFFIXES_WITH_DOT] + COMPANY_SUFFIXES)
    t = F.regexp_replace(F.lower(col(c)), rf"{ASCII_BOUNDARY}(?:{words}){ASCII_BOUNDARY}", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.coalesce(F.trim(t), F.lit(""))


def match_form(c) -> Column:
    """Normal form compared by :func:`text_matches`; a leading separator leaves a leading space."""
    t = clean_trim(F.lower(col(c)))
    return collapse(F.regexp_replace(t, "[._-]", " "))


def forms_match(a: Column, b: Column) -> Column:
    """Containment either way between two values already in :func:`match_form`."""
    return F.contains(a, b) | F.contains(b, a)


def text_matches(a, b) -> Column:
    return forms_match(match_form(a), match_form(b))
