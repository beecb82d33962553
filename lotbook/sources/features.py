"""Feature scans: line-delimited collections, whole documents, plain JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions.maps import no_properties
from lotbook.schemas import FEATURE_JSON


_FEATURE_NAMES = ["type", "id", "properties", "geometry"]


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system Spark can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def file_bucket() -> Column:
    """Numbering bucket of features read from lines: their file block."""
    return F.struct("src_ord.file", "src_ord.block")


def line_position() -> Column:
    """Reading order of a line: file, start of its block, order inside the scan task.

    Blocks are read front to back, so the order inside a block is the file's own.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_feature_lines(spark: SparkSession, path: str, county: str | None = None) -> DataFrame:
    """Collections as ``county, src_ord, feature_id, props, geom``, a feature per row.

    The default scan: files split at any line, whatever their size. A line may hold one
    feature or a whole collection. Without ``county`` the code comes from ``county=``
    directories. Lines that do not parse have their text in ``corrupt``.
    """
    lines = spark.read.text(path)
    code = F.col("county") if county is None else F.lit(county)
    placed = lines.select(
        code.alias("county"), line_position().alias("src_ord"), F.trim("value").alias("line")
    )
    record = F.rtrim("line", F.lit(","))
    whole = f"{FEATURE_JSON}, features array<struct<{FEATURE_JSON}>>, _bad string"
    parsed = F.from_json(record, whole, {"columnNameOfCorruptRecord": "_bad"})
    # A line that opens the list of features is the collection's head, not a feature.
    head = F.col("line").endswith("[")
    rows = placed.where(F.col("line").startswith("{") & (F.length("line") > 2) & ~head)
    rows = rows.withColumn("_all", parsed)
    # A collection on one line is exploded; any other line is its own only feature.
    one = F.array(F.struct(*[F.col(f"_all.{n}") for n in _FEATURE_NAMES]))
    features = rows.select(
        "county",
        "src_ord",
        F.col("_all._bad").alias("corrupt"),
        F.posexplode(F.coalesce("_all.features", one)).alias("pos", "f"),
    )
    order = F.struct("src_ord.file", "src_ord.block", "src_ord.line", F.col("pos").alias("pos"))
    return features.select(
        "county", order.alias("src_ord"), *_feature_columns("f"), "corrupt"
    )


def _feature_columns(f: str) -> list[Column]:
    return [
        F.col(f"{f}.id").alias("feature_id"),
        F.coalesce(F.col(f"{f}.properties"), no_properties()).alias("props"),
        G.parse_geometry(
            F.col(f"{f}.geometry.type"), F.col(f"{f}.geometry.coordinates")
        ).alias("geom"),
    ]


def read_declared_crs(spark: SparkSession, path: str, county: str | None = None) -> DataFrame:
    """``county, crs_name`` from the header line of line-delimited collections."""
    code = F.col("county") if county is None else F.lit(county)
    name = F.get_json_object(
        F.concat(F.lit("{"), F.rtrim(F.trim("value"), F.lit(",")), F.lit("}")),
        "$.crs.properties.name",
    )
    return (
        spark.read.text(path)
        .where(F.trim("value").startswith('"crs"'))
        .select(code.alias("county"), name.alias("crs_name"))
        .groupBy("county")
        .agg(F.max("crs_name").alias("crs_name"))
    )


def read_feature_document(spark: SparkSession, path: str, county: str) -> DataFrame:
    """A collection written as one JSON document.

    Such a file cannot be split; use it for small layers and rewrite large ones as
    lines (``sinks.features.write_feature_lines``).
    """
    raw = spark.read.schema(f"features array<struct<{FEATURE_JSON}>>").json(
        path, multiLine=True, mode="FAILFAST"
    )
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("block")
        ).alias("at"),
        F.posexplode("features").alias("pos", "f"),
    ).select(
        F.lit(county).alias("county"),
        F.struct("at.file", "at.block", F.col("pos").cast("bigint").alias("line")).alias("src_ord"),
        *_feature_columns("f"),
    )


def read_json_records(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """JSON lines, or a plain JSON array, as ``src_ord, props``; anything else is an error."""
    raw = (
        spark.read.text(path, wholetext=array)
        .select(line_position().alias("src_ord"), F.trim("value").alias("value"))
        .where(F.col("value") != "")
    )
    if not array:
        props = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
        return raw.select("src_ord", props.alias("props"))
    items = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    return raw.select("src_ord", F.posexplode(items).alias("pos", "props")).select(
        F.struct("src_ord.file", "src_ord.block", F.col("pos").cast("bigint").alias("line")).alias(
            "src_ord"
        ),
        "props",
    )


def read_address_points(spark: SparkSession, path: str) -> DataFrame:
    """Address points from feature lines: ``src_ord, props, px, py``."""
    line = F.rtrim(F.trim("value"), F.lit(","))
    raw = (
        spark.read.text(path)
        .select(line_position().alias("src_ord"), line.alias("line"))
        .where(F.col("line").startswith("{") & (F.length("line") > 2))
        .withColumn("f", F.from_json("line", FEATURE_JSON))
    )
    point = G.parse_point(F.col("f.geometry.coordinates"))
    return raw.withColumn("p", point).select(
        "src_ord",
        F.coalesce("f.properties", no_properties()).alias("props"),
        F.col("p.x").alias("px"),
        F.col("p.y").alias("py"),
    )


def read_decoded_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files: UTF-8 where valid, else Latin-1, which never fails."""
    content = F.col("content")
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return spark.read.format("binaryFile").load(path).select("path", text.alias("text"))


def read_present(spark: SparkSession, paths: dict[str, str], read) -> tuple[DataFrame | None, list[str]]:
    """Union of the counties whose path exists, and the counties that are absent."""
    out, absent = None, []
    for county, path in paths.items():
        if not file_exists(spark, path):
            absent.append(county)
            continue
        df = read(spark, path, county)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, absent
