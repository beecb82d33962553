"""Keys that hold far more rows than others.

AQE splits skewed partitions only of plain sort-merge joins: not below an
aggregate, and not for a group that is collected. These helpers split such keys in
the plan itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
_NULL_SPREAD = 64
# Tasks per core that rows are dealt to before a step that makes much of each.
_TASKS_PER_CORE = 4


def many_tasks(spark: SparkSession) -> int:
    """Tasks for a step whose work or memory grows with its rows far beyond their bytes."""
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffled, _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to many tasks by ``keys``.

    A file of few bytes is one task of a scan however many rows a later step makes of it, and
    AQE joins small partitions by their compressed bytes. The number given here it keeps.
    """
    return df.repartition(many_tasks(df.sparkSession), *keys)


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and into how many parts to split each.

    Counts combine on the map side. Whether a key is hot depends on its own rows alone.
    The result is joined without a hint, so Spark's size check decides on a broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > limit).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")
    )


def part_of(salt_on: Column, parts: Column) -> Column:
    """Stable part number in ``[0, parts)``; rows of keys that are not hot get part 0."""
    return F.pmod(F.xxhash64(salt_on), F.coalesce(parts, F.lit(1)).cast("long")).cast("int")


def with_part(
    df: DataFrame, hot: DataFrame, keys: list[str], salt_on: str, into: str = "_salt"
) -> DataFrame:
    marked = df.join(hot, keys, "left")
    return marked.withColumn(into, part_of(F.col(salt_on), F.col("_parts"))).drop("_parts")


def with_all_parts(
    df: DataFrame, hot: DataFrame, keys: list[str], into: str = "_salt"
) -> DataFrame:
    """Every row once per part of its key."""
    marked = df.join(hot, keys, "left")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return marked.withColumn(into, F.explode(every)).drop("_parts")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    salt_on: str,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose hot left keys spread over several tasks.

    ``right`` is small per key (deduplicated or aggregated). Null left keys match
    nothing, so they are spread too instead of meeting in one task.
    """
    hot = hot_keys(left.where(F.col(key).isNotNull()), [key], limit)
    spread = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), part_of(F.col(salt_on), F.lit(_NULL_SPREAD))).otherwise(
            part_of(F.col(salt_on), F.col("_parts"))
        ),
    )
    copies = with_all_parts(right, hot, [key])
    return spread.drop("_parts").join(copies, [key, "_salt"], how).drop("_salt")
