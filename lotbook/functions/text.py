"""Text cleaning, names and truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\x0b\u00a0"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: Column | str) -> Column:
    """Neither null nor empty text; never null itself."""
    c = col(c)
    return c.isNotNull() & (c != F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim all blank characters, not only spaces."""
    return F.btrim(col(c), F.lit(_BLANKS))


def clean_search(c: Column | str) -> Column:
    """Lower, punctuation to space, collapse, trim; null becomes empty text.

    Letters and digits of any script are kept, hence the Unicode classes.
    """
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    spaced = F.regexp_replace(lowered, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(spaced)


def normalize_query(c: Column | str) -> Column:
    """Lower and trim; punctuation stays, as a query is matched as typed."""
    return F.lower(strip(c))


def collapse(c: Column | str) -> Column:
    """Whitespace and no-break spaces collapse to one space; null becomes empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s\x{00A0}]+", " "))


def label_key(c: Column | str) -> Column:
    """A page label for matching: collapsed, colons dropped, lower case."""
    return F.lower(F.trim(F.replace(collapse(c), F.lit(":"), F.lit(""))))


def description_key(c: Column | str) -> Column:
    """A description label as a property name: lower case, blanks to underscores."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", "_")


def words(c: Column | str) -> Column:
    """Blank-separated words of a normalized text, without empty ones."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != F.lit(""))


def join_parts(parts: list[Column | str], sep: str) -> Column:
    """Join the truthy parts in order."""
    return F.array_join(F.filter(F.array(*[col(p) for p in parts]), truthy), sep)


def state_of_county(code: Column | str) -> Column:
    """Two-letter state from a county code ending such as ``_wy``; empty when unknown."""
    return F.upper(F.regexp_extract(F.lower(col(code)), r"_(wy|id|mt|ut|co)$", 1))


def county_display_name(code: Column | str) -> Column:
    """``teton_county_wy`` reads ``Teton County``; other codes are only title-cased."""
    code = col(code)
    parts = F.split(code, "_")
    named = F.concat(F.initcap(F.get(parts, F.lit(0))), F.lit(" County"))
    return F.when(F.get(parts, F.lit(1)) == "county", named).otherwise(
        F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))
    )


def county_code_of_uid(uid: Column | str) -> Column:
    """County code of a parcel uid: its first three underscore-separated parts."""
    return F.substring_index(col(uid), "_", 3)
