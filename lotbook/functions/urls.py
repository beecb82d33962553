"""Parameters, counties and extraction routes read from page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.text import col


def account_of_url(url: Column | str) -> Column:
    """Value of ``accountno=``; null when absent."""
    return _non_empty(F.regexp_extract(col(url), r"accountno=([^&]+)", 1))


def parcel_of_url(url: Column | str) -> Column:
    """Parcel id from ``parcel_id=`` (or ``parcelid=``, ``parcel-id=``), else the account."""
    url = col(url)
    parcel = F.regexp_extract(url, r"(?i)parcel[_-]?id=([^&]+)", 1)
    account = F.regexp_extract(url, r"(?i)account[_-]?no=([^&]+)", 1)
    return F.coalesce(_non_empty(parcel), _non_empty(account))


def county_of_url(url: Column | str) -> Column:
    found = F.lower(F.regexp_extract(col(url), r"(?i)(sublette|fremont|lincoln)", 1))
    return F.coalesce(_non_empty(found), F.lit("unknown_county"))


def extraction_route(url: Column | str, county: Column | str) -> Column:
    """Which rule set reads a page. The order is the precedence of the rules."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    c = F.lower(F.coalesce(col(county), F.lit("")))
    return (
        F.when(u.contains("greenwood") | c.isin("fremont", "sublette"), "greenwood")
        .when(
            u.contains("tetonidaho") | c.isin("teton_idaho", "teton idaho", "tetonidaho"),
            "teton_idaho",
        )
        .when(u.contains("lincoln") | (c == "lincoln"), "lincoln")
        .when(u.contains("teton") | (c == "teton"), "teton")
        .otherwise("general")
    )


def record_domain(url: Column | str, county: Column | str) -> Column:
    """County whose tax or clerk site answers; null when the request is unsupported.

    A given county decides alone; only without one is the address looked at.
    """
    u = col(url)
    low = F.lower(u)
    c = F.lower(col(county))
    given = F.when(c.isin("teton", "tetoncountywy"), "teton").when(
        c.isin("sublette", "fremont", "lincoln"), c
    )
    from_url = (
        F.when(u.contains("tetoncountywy.gov"), "teton")
        .when(low.contains("sublette"), "sublette")
        .when(low.contains("fremont"), "fremont")
        .when(low.contains("lincoln"), "lincoln")
    )
    domain = F.when(c.isNotNull() & (c != ""), given).otherwise(from_url)
    return F.when(u.isNotNull() & (u != ""), domain)


def _non_empty(c: Column) -> Column:
    return F.when(c != "", c)
