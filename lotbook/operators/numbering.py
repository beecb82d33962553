"""Consecutive numbers inside a group without putting the group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.session import checkpointed

BUCKET_ROWS = 1_000_000


def number_rows(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str],
    bucket: Column,
    into: str,
) -> DataFrame:
    """1-based position of each row in its group, exact for any group size.

    ``bucket`` must grow with ``order_by`` and hold a bounded share of a group (a
    range of source positions, a file block). Rows are numbered inside their bucket,
    and a running sum over the per-bucket counts gives each bucket's offset; only
    those counts meet in one task. Buckets depend on the data alone, so a recomputed
    partition gets the same numbers. Group columns must not be null.
    """
    keys = [*partition_by, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*partition_by)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(into, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def position_bucket(position: Column, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a numeric source position."""
    return F.floor(position / F.lit(rows))


def positions(df: DataFrame, keys: list[str], order_by: list[str], into: str) -> DataFrame:
    """1-based position of each row in its key, for keys and orders of any type.

    Rows are dealt by ranges of key and order, so a key with very many rows spans several
    ranges, and the ranges are its buckets. The ranges come from a sample; they are
    checkpointed, so that every pass sees the same ones.
    """
    ranged = df.repartitionByRange(*keys, *order_by).withColumn("_range", F.spark_partition_id())
    return number_rows(checkpointed(ranged), keys, order_by, F.col("_range"), into).drop("_range")
