"""The layers of all counties in one scan, by the folders they were landed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.functions.shapes import has_place, parse_shape
from lotbook.session import checkpointed
from lotbook.sources.collections import cut_features, parsed_features, read_chunks
from lotbook.sources.tables import layer_catalogue

_FOLDERS = r"/county=([^/]+)/layer=([^/]+)/"


def read_layers(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Features of every layer under ``base/county=.../layer=.../``, and what was rejected.

    Features are ``county, layer, data_type, src_ord, feature_id, props, shape``; files may
    have any layout and are split anywhere (``sources.collections``). Rejects are
    ``county, layer, reason, content``: text that is no feature, features of a layer that the
    catalogue does not have, geometries that cannot be read. A feature without a geometry is
    kept, with a null shape.
    """
    parsed = parsed_features(
        *cut_features(read_chunks(spark, base)), F.lit(None).cast("string"), parse_shape
    )
    landed = parsed.withColumns(
        {
            "county": F.regexp_extract("src_ord.file", _FOLDERS, 1),
            "layer": F.regexp_extract("src_ord.file", _FOLDERS, 2),
        }
    )
    # One row per configured layer: a fixed, small side.
    rows = landed.join(F.broadcast(layer_catalogue(spark)), ["county", "layer"], "left")
    lost = F.col("geom").isNotNull() & ~has_place("geom")
    reason = (
        F.when(F.col("corrupt").isNotNull(), "no feature")
        .when(F.col("data_type").isNull(), "unknown layer")
        .when(lost, "geometry not read")
    )
    # Numbers, systems, rejects and counts all read this: the text is parsed once.
    judged = checkpointed(rows.withColumn("reason", reason))
    features = judged.where(F.col("reason").isNull()).select(
        "county", "layer", "data_type", "src_ord", "feature_id", "props", F.col("geom").alias("shape")
    )
    content = F.coalesce("corrupt", F.to_json(F.struct("feature_id", "props", "geom.type")))
    rejects = judged.where(F.col("reason").isNotNull()).select(
        "county", "layer", "reason", content.alias("content")
    )
    return features, rejects
