"""Feature and list sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.operators.search_index import (
    BUCKETS,
    StoredIndex,
    gram_counts,
    gram_postings,
    key_bucket,
    postings,
    prepare_entries,
)
from lotbook.operators.skew import dealt, many_tasks
from lotbook.schemas import JSON_FIELD_NAMES, STANDARD_FIELDS


def geometry_json(geom: Column) -> Column:
    """GeoJSON geometry text; ``null`` for a missing geometry."""

    def position(p: Column) -> Column:
        return F.array(p["x"], p["y"])

    polys = F.transform(
        geom["polys"], lambda poly: F.transform(poly, lambda ring: F.transform(ring, position))
    )
    coordinates = F.when(geom["type"] == "Polygon", F.to_json(F.get(polys, F.lit(0)))).otherwise(
        F.to_json(polys)
    )
    text = F.concat(
        F.lit('{"type":"'), geom["type"], F.lit('","coordinates":'), coordinates, F.lit("}")
    )
    return F.coalesce(text, F.lit("null"))


def feature_line(properties: Column, geom: Column) -> Column:
    """A feature as one line, properties before geometry."""
    return F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(properties, {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        geometry_json(geom),
        F.lit("}"),
    )


def standard_properties() -> Column:
    return F.struct(
        *[F.col(name).alias(JSON_FIELD_NAMES.get(name, name)) for name in STANDARD_FIELDS]
    )


def write_standardized(standardized: DataFrame, path: str) -> None:
    """Parquet by county; a rerun replaces only the counties it holds."""
    (
        standardized.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("county")
        .parquet(path)
    )


def write_feature_lines(standardized: DataFrame, path: str) -> None:
    """One feature per line and one directory per county, the splittable text form."""
    lines = standardized.select(
        "county", feature_line(standard_properties(), F.col("geom")).alias("value")
    )
    lines.write.mode("overwrite").partitionBy("county").text(path)


def write_merged(merged: DataFrame, path: str, as_features: bool) -> None:
    """Merged records in the shape of their input: features, or plain JSON records."""
    if as_features:
        merged.select(feature_line(F.col("props"), F.col("geom")).alias("value")).write.mode(
            "overwrite"
        ).text(path)
    else:
        merged.select(F.to_json("props").alias("value")).write.mode("overwrite").text(path)


INDEX_TABLES = ("entries", "postings", "grams", "gram_counts")


def write_search_index(entries: DataFrame, path: str, version: str = "") -> None:
    """Prepared entries, postings, substring keys and their counts, in the folders ``version``.

    The last three have a folder per bucket of their key, so a search reads only those that
    its requests name. Rows are dealt by bucket and part of the entries: a frequent word spreads
    over the parts, and the files of a folder are sorted. Nothing is sampled, as ranges would
    have to be, so each key is made once.
    """
    spark = entries.sparkSession
    parts = -(-many_tasks(spark) // BUCKETS)
    prepare_entries(entries).write.mode("overwrite").parquet(f"{path}/entries/{version}")
    # Of few bytes, entries would be few tasks; each becomes hundreds of rows.
    written = dealt(spark.read.parquet(f"{path}/entries/{version}"), "uid")

    def write(table: DataFrame, name: str, *key: str) -> None:
        keyed = table.withColumn("bucket", key_bucket(*key))
        of_entry = {"uid"} & set(table.columns)
        part = F.pmod(F.xxhash64(*of_entry), F.lit(parts)) if of_entry else F.lit(0)
        rows = keyed.repartition(BUCKETS * parts, "bucket", part)
        order = ["bucket", *key, *of_entry]
        target = f"{path}/{name}/{version}"
        rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(target)

    write(postings(written), "postings", "kind", "token")
    write(gram_postings(written), "grams", "county_code", "gram")
    grams = spark.read.parquet(f"{path}/grams/{version}")
    write(gram_counts(grams.drop("bucket")), "gram_counts", "county_code", "gram")


def read_search_index(spark: SparkSession, path: str, version: str = "") -> StoredIndex:
    """The tables that ``write_search_index`` wrote."""
    return StoredIndex(*(_index_table(spark, f"{path}/{t}/{version}") for t in INDEX_TABLES))


def _index_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def write_split(df: DataFrame, valid: Column, good_path: str, bad_path: str) -> None:
    """Valid rows to Parquet, the others as JSON to a quarantine."""
    ok = F.coalesce(valid, F.lit(False))
    df.where(ok).write.mode("overwrite").parquet(good_path)
    df.where(~ok).write.mode("overwrite").json(bad_path)
