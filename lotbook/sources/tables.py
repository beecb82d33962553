"""Assessor tables, layer responses, layer catalogue and the list-page frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.config import COUNTIES, EXTRA_LAYERS
from lotbook.operators.assessor import EXPECTED_FILES, source_schema
from lotbook.sources.features import line_position


def read_assessor(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """One source table with all columns as text and its row position ``ord``.

    The position is file, block and order inside it, so it follows the source over many
    files whatever the order in which Spark packs them into tasks.
    """
    reader = spark.read.schema(source_schema(table))
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).withColumn("ord", line_position())


def missing_files(spark: SparkSession, present: DataFrame) -> DataFrame:
    """Expected source tables that a delivery (``file``) lacks."""
    expected = spark.createDataFrame([(name,) for name in EXPECTED_FILES], "file string")
    return expected.join(present.select(F.lower("file").alias("file")), "file", "left_anti")


def read_layer_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed layer responses as ``accountno, ord, attributes``; one document per line.

    An error response has no features and yields no rows.
    """
    raw = spark.read.schema(
        "features array<struct<attributes: map<string,string>>>"
    ).json(path)
    return layer_rows(raw.withColumn("response", line_position()))


def layer_rows(responses: DataFrame) -> DataFrame:
    """Features of responses (``response`` is their position), one row each, by account."""
    return responses.select("response", F.posexplode("features").alias("pos", "f")).select(
        F.try_element_at(F.col("f.attributes"), F.lit("accountno")).alias("accountno"),
        F.struct("response", "pos").alias("ord"),
        F.col("f.attributes").alias("attributes"),
    )


def layer_catalogue(spark: SparkSession) -> DataFrame:
    """``county, layer, data_type`` of every configured layer."""
    rows = [(code, "ownership", "ownership") for code in COUNTIES] + EXTRA_LAYERS
    return spark.createDataFrame(rows, "county string, layer string, data_type string")


def page_frontier(
    spark: SparkSession, base_url: str, pages: int, chunks: int, tax_year: int, page_size: int
) -> DataFrame:
    """``chunk, page, url``: pages 1..n in contiguous chunks, the last takes the rest."""
    return chunked_pages(
        spark.range(1, pages + 1, 1, chunks).withColumnRenamed("id", "page"),
        F.lit(pages),
        chunks,
        base_url,
        tax_year,
        page_size,
    )


def chunked_pages(
    frontier: DataFrame, pages: Column, chunks: int, base_url: str, tax_year: int, page_size: int
) -> DataFrame:
    per_chunk = F.greatest(F.floor(pages / chunks), F.lit(1))
    chunk = F.least(F.floor((F.col("page") - 1) / per_chunk), F.lit(chunks - 1)).cast("int")
    url = F.concat(
        F.lit(f"{base_url}?pageNumber="),
        F.col("page").cast("string"),
        F.lit(f"&taxYear={tax_year}&pageSize={page_size}"),
    )
    return frontier.withColumns({"chunk": chunk, "url": url})


def result_count(html: Column | str) -> Column:
    """Total from ``1,234 results found``; null when absent."""
    html = F.col(html) if isinstance(html, str) else html
    digits = F.regexp_extract(html, r"(\d{1,3}(?:,\d{3})*) results found", 1)
    return F.when(digits != "", F.replace(digits, F.lit(","), F.lit("")).cast("int"))


def page_count(total: Column, page_size: int) -> Column:
    return F.ceil(total / F.lit(page_size)).cast("int")
