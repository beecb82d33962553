"""Key joins that put one feature set's properties over another's.

The right side is reduced to one row per key first (last source position wins), so
the join never multiplies rows, and hot left keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions import maps as M
from lotbook.functions.text import strip, truthy
from lotbook.operators.skew import HOT_ROWS, salted_join
from lotbook.operators.standardize import prop


def last_per_key(df: DataFrame, key: str, value: Column, order: str, into: str) -> DataFrame:
    """One row per key: the value at the greatest position."""
    return df.groupBy(key).agg(F.max_by(value, F.col(order)).alias(into))


def last_records(rows: DataFrame, key: str) -> DataFrame:
    """Records ``src_ord, props`` of many part files, one per key: the last one read.

    Records without the key are left out.
    """
    keyed = rows.withColumn("_key", _truthy_key(prop(key))).where(F.col("_key").isNotNull())
    return keyed.groupBy("_key").agg(
        F.max("src_ord").alias("src_ord"), F.max_by("props", "src_ord").alias("props")
    ).drop("_key")


def _left_merge(
    left: DataFrame,
    left_key: Column,
    right: DataFrame,
    right_key: Column,
    over: Column,
    hot_rows: int,
) -> DataFrame:
    lookup = last_per_key(
        right.select(right_key.alias("_key"), over.alias("_over"), "src_ord").where(
            F.col("_key").isNotNull()
        ),
        "_key",
        F.col("_over"),
        "src_ord",
        "_over",
    )
    joined = salted_join(
        left.withColumn("_key", left_key), lookup, "_key", "left", "src_ord", hot_rows
    )
    return (
        joined.withColumn("props", M.overwrite("props", "_over"))
        .withColumn("matched", F.col("_over").isNotNull())
        .drop("_key", "_over")
    )


def _truthy_key(key: Column) -> Column:
    return F.when(truthy(key), key)


def merge_by_id(
    primary: DataFrame,
    secondary: DataFrame,
    primary_id: str,
    secondary_id: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join on an id property; truthy values of ``secondary`` overwrite."""
    return _left_merge(
        primary,
        _truthy_key(prop(primary_id)),
        secondary,
        _truthy_key(prop(secondary_id)),
        M.truthy_only("props"),
        hot_rows,
    )


def merge_scraped(
    parcels: DataFrame, rows: DataFrame, field: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join with list-page rows on a shared field; the field itself is not copied."""
    return _left_merge(
        parcels,
        _truthy_key(prop(field)),
        rows,
        _truthy_key(prop(field)),
        M.without_key(M.truthy_only("props"), field),
        hot_rows,
    )


def join_overwrite(
    parcels: DataFrame,
    addresses: DataFrame,
    parcel_key: str,
    address_key: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join that overwrites with every value, null and empty ones included.

    A record that lacks its key property is an error. Null keys match nothing.
    """

    def required(name: str) -> Column:
        missing = F.raise_error(F.lit(f"record without key property {name}")).cast("string")
        return F.when(F.map_contains_key("props", F.lit(name)), prop(name)).otherwise(missing)

    return _left_merge(
        parcels,
        required(parcel_key),
        addresses,
        required(address_key),
        M.without_key("props", address_key),
        hot_rows,
    )


def split_keyed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records that have the property ``key``, null included, and those that lack it."""
    has = F.coalesce(F.map_contains_key("props", F.lit(key)), F.lit(False))
    return df.where(has), df.where(~has)


def merge_by_parsed_key(
    parcels: DataFrame, addresses: DataFrame, key: str = "pidn", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join on a key parsed from the HTML description of both sides.

    A parcel first takes its own parsed values, then those of its address.
    """

    def parsed(df: DataFrame) -> DataFrame:
        # Exploding a one-element array keeps the parse in one place: filters on the
        # key would otherwise be pushed below it and parse every description again.
        once = F.explode(F.array(M.parse_description(prop("description"))))
        return df.withColumn("_parsed", once)

    def parsed_key() -> Column:
        value = strip(F.try_element_at(F.col("_parsed"), F.lit(key)))
        return _truthy_key(value)

    own = parsed(parcels).withColumn("_own_key", parsed_key())
    own = own.withColumn("props", M.overwrite("props", M.truthy_only("_parsed")))
    return _left_merge(
        own.drop("_parsed"),
        F.col("_own_key"),
        parsed(addresses),
        parsed_key(),
        M.truthy_only("_parsed"),
        hot_rows,
    ).drop("_own_key")


def merge_counts(merged: DataFrame) -> DataFrame:
    """How many records a merge saw and how many it updated."""
    return merged.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("matched").alias("updated")
    )
