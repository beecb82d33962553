"""What the operators share: tables, the shared folder, written intermediate tables, words."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
find_words = re.compile(WORD_PATTERN).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    The warehouse is shared on a cluster as well, so nothing is ever written to a
    folder that only one machine sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/lotbook-work"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and every
    later step sees the same rows. The schema is handed over, so an empty table works.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Bits of a filter of keys: 16 MB, in rows of 4 KB, whatever the number of keys.
FILTER_BITS = 1 << 27
_ROW_BITS = 1 << 15


def _bit(key: Column) -> tuple[Column, Column]:
    """Row of a filter, and place in the row, of a key."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.floor(bit / _ROW_BITS).cast("long"), bit % _ROW_BITS


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """Which hashes the keys of a table have, as rows of bits; its size has a fixed bound."""
    row, place = _bit(F.col(key))
    bits = F.bitmap_construct_agg(place)
    return keys.where(F.col(key).isNotNull()).groupBy(row.alias("_row")).agg(bits.alias("_bits"))


def with_maybe(df: DataFrame, key: Column, filter_: DataFrame, into: str) -> DataFrame:
    """``df`` and the boolean ``into``: false only if ``key`` is null or not among the filter's keys.

    What it lets pass without need grows as the filter fills; a join decides afterwards.
    The filter is broadcast: it has at most ``FILTER_BITS`` bits.
    """
    row, place = _bit(key)
    held = filter_.select(F.struct("_row", "_bits").alias(into))
    joined = df.join(F.broadcast(held), row == F.col(into)["_row"], "left")
    byte = F.hex(F.substring(F.col(into)["_bits"], F.floor(place / 8).cast("int") + 1, F.lit(1)))
    byte = F.conv(byte, 16, 10).cast("long")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return joined.withColumn(into, F.coalesce(key.isNotNull() & is_set, F.lit(False)))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a number per row, ``_row``.

    A scan is split by the cores registered when it is planned, so numbers given to a scan
    differ between passes. These are given once and read with their rows.
    """
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), name)
