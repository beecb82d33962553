"""Layers besides parcels: easements, control points, survey lines, precincts, roads, zoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions import shapes as S
from lotbook.operators.numbering import number_rows
from lotbook.operators.tiles import ZOOM_BANDS, tile_cover
from lotbook.sources.features import file_bucket

LAYER = ["county", "layer"]
COVER = ["band", "z", "x", "y", "uid"]


def layer_features(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Read layers (``sources.layers``) as ``uid, data_type, props, shape, bbox`` in degrees.

    ``uid`` is county, layer and the feature's number in its layer, in source order. A layer's
    system is the declared one (``declared`` has ``county, layer, crs_name``), else guessed
    from its first vertex. Features without a geometry stay, without a box.
    """
    numbered = number_rows(rows, LAYER, ["src_ord"], file_bucket(), "number")
    first = F.get(F.get(F.col("shape.paths"), F.lit(0)), F.lit(0))
    placed = F.when(S.has_place("shape"), F.col("src_ord"))
    systems = rows.groupBy(*LAYER).agg(F.min_by(first, placed).alias("p"))
    crs = G.crs_of_point(F.col("p.x"), F.col("p.y"))
    if declared is not None:
        systems = systems.join(declared, LAYER, "left")
        crs = F.coalesce(G.declared_crs("crs_name"), crs)
    # One row per configured layer: a fixed, small side.
    systems = F.broadcast(systems.select(*LAYER, crs.alias("crs")))
    uid = F.concat_ws("_", "county", "layer", F.col("number").cast("string"))
    return (
        numbered.join(systems, LAYER)
        .withColumn("shape", S.shape_in_degrees("shape", "crs"))
        .select(
            uid.alias("uid"),
            *LAYER,
            "data_type",
            "feature_id",
            "props",
            "shape",
            S.shape_box("shape").alias("bbox"),
        )
    )


def layer_cover(
    features: DataFrame, bands: list[tuple[str, int, int]] = ZOOM_BANDS
) -> DataFrame:
    """``band, z, x, y, uid, steps``: the tiles that features touch.

    Areas take the tiles of their box, as parcels do, with no steps. Points and lines take
    the tiles along their steps only, and ``steps`` counts those that touch the tile: a road
    across a county is in the tiles it runs through, not in all of its box.
    """
    areas = features.where(F.col("shape.type").isin(S.AREA_KINDS))
    boxed = tile_cover(areas, bands).select(*COVER, F.lit(0).cast("long").alias("steps"))
    others = features.where(F.col("shape.type").isin(S.POINT_KINDS + S.LINE_KINDS))
    return step_cover(others, bands).unionByName(boxed)


def step_cover(features: DataFrame, bands: list[tuple[str, int, int]]) -> DataFrame:
    """Tiles along the steps of ``shape``, drawn straight in the web-mercator plane.

    A step is cut at the borders of the tile columns it passes; in each column it takes the
    rows between where it enters and leaves. Steps are rows, so a line of any length is spread
    over no array; the steps of a line lie in one task, so most meet before the shuffle.
    """
    zooms = F.array(
        *[
            F.struct(F.lit(name).alias("band"), F.lit(z).alias("z"))
            for name, low, high in bands
            for z in range(low, high + 1)
        ]
    )
    step = features.select("uid", F.explode(S.steps("shape")).alias("s"))
    ends = step.select(
        "uid",
        S.world_x(F.col("s.x1")).alias("ax"),
        S.world_y(F.col("s.y1")).alias("ay"),
        S.world_x(F.col("s.x2")).alias("bx"),
        S.world_y(F.col("s.y2")).alias("by"),
    )
    # From west to east, so that the cuts do not depend on the way the line was drawn.
    back = F.col("ax") > F.col("bx")

    def either(a: str, b: str) -> Column:
        return F.when(back, F.col(b)).otherwise(F.col(a))

    east = ends.select(
        "uid",
        either("ax", "bx").alias("wx"),
        either("ay", "by").alias("wy"),
        either("bx", "ax").alias("ex"),
        either("by", "ay").alias("ey"),
        F.explode(zooms).alias("_zoom"),
    )
    n = F.pow(F.lit(2.0), F.col("_zoom.z"))
    scaled = east.select(
        "uid", "_zoom.band", "_zoom.z", n.alias("n"), *[(F.col(c) * n).alias(c) for c in ("wx", "wy", "ex", "ey")]
    )

    def tile(place: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.floor(place), (F.col("n") - 1).cast("long")))

    columns = scaled.withColumn("x", F.explode(F.sequence(tile(F.col("wx")), tile(F.col("ex")))))

    def height(border: Column) -> Column:
        slope = (F.col("ey") - F.col("wy")) / (F.col("ex") - F.col("wx"))
        return F.col("wy") + (border - F.col("wx")) * slope

    enter = F.when(F.col("wx") >= F.col("x"), F.col("wy")).otherwise(height(F.col("x")))
    leave = F.when(F.col("ex") <= F.col("x") + 1, F.col("ey")).otherwise(height(F.col("x") + 1))
    cut = columns.withColumns({"_in": enter, "_out": leave})
    rows = F.sequence(tile(F.least("_in", "_out")), tile(F.greatest("_in", "_out")))
    touched = cut.select("band", "z", "x", F.explode(rows).alias("y"), "uid")
    return touched.groupBy(*COVER).agg(F.count(F.lit(1)).alias("steps"))


def layer_counts(features: DataFrame, rejects: DataFrame) -> DataFrame:
    """``county, layer, features, placed, rejects`` of each layer with a feature or a reject."""
    good = features.groupBy(*LAYER).agg(
        F.count(F.lit(1)).alias("features"), F.count("bbox").alias("placed")
    )
    bad = rejects.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("rejects"))
    joined = good.withColumn("rejects", F.lit(0).cast("long")).unionByName(
        bad, allowMissingColumns=True
    )
    return joined.groupBy(*LAYER).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("features", "placed", "rejects")]
    )
