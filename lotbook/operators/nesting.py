"""Child rows nested into one ordered array per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(
    df: DataFrame,
    keys: list[str],
    tie: str,
    item: Column,
    sort_key: Column | None = None,
    into: str = "items",
) -> DataFrame:
    """``keys, into``: all items of each key in total order, ``tie`` breaking ties.

    One row per key whatever its size: tasks collect their own items of a key first, and
    the pieces meet in one shuffle. Use it where a key's own record bounds the list, a parcel's
    children; lists without such a bound are rows with a position (``positions``).
    """
    head = [] if sort_key is None else [sort_key.alias("sort")]
    packed = F.collect_list(F.struct(*head, F.col(tie).alias("tie"), item.alias("item")))
    return df.groupBy(*keys).agg(
        F.transform(F.sort_array(packed), lambda s: s["item"]).alias(into)
    )
