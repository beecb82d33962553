"""Point-in-polygon join over a grid of several levels.

Spark has no spatial join. A polygon is put on the level whose cells are about its
own size and listed under the few cells its box touches; a point is listed once per
level. Equal cells meet in an equi-join, and the box and the exact test decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions import maps as M
from lotbook.operators.numbering import number_rows, position_bucket
from lotbook.operators.skew import HOT_ROWS, hot_keys, with_all_parts, with_part

# Side of the finest cell in degrees (about 200 m), growth per level, levels.
CELL = 0.002
STEP = 4
LEVELS = 5

_CELL_KEYS = ["_level", "_cx", "_cy"]


def _size(level: Column, cell: float, step: int) -> Column:
    return F.lit(cell) * F.pow(F.lit(float(step)), level)


def _polygon_cells(shapes: DataFrame, cell: float, step: int, levels: int) -> DataFrame:
    """One row per shape and touched cell.

    Shapes larger than the top level's cells list more of them; nothing is capped.
    """
    box = F.col("_box")
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    wanted = F.ceil(F.log(F.greatest(extent / cell, F.lit(1e-12))) / math.log(step))
    level = F.least(F.greatest(wanted, F.lit(0)), F.lit(levels - 1)).cast("int")
    leveled = shapes.withColumn("_level", level)
    size = _size(F.col("_level"), cell, step)

    def span(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))

    return leveled.withColumn("_cx", span(box["xmin"], box["xmax"])).withColumn(
        "_cy", span(box["ymin"], box["ymax"])
    )


def _point_cells(points: DataFrame, cell: float, step: int, levels: int) -> DataFrame:
    leveled = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
    size = _size(F.col("_level"), cell, step)
    return leveled.withColumn("_cx", F.floor(F.col("px") / size)).withColumn(
        "_cy", F.floor(F.col("py") / size)
    )


def spatial_matches(
    parcels: DataFrame,
    addresses: DataFrame,
    cell: float = CELL,
    step: int = STEP,
    levels: int = LEVELS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``addr_ord, parcel_ord``: the first parcel that covers each address point.

    ``parcels`` has ``src_ord, geom``; ``addresses`` has ``src_ord, px, py``. Parcels
    of the same geometry are joined once, as only the first can win; cells crowded
    with points are salted. A point keeps the least parcel, found with map-side
    combine. Boundaries count as covered.
    """
    shapes = (
        parcels.where(G.valid_polygon("geom"))
        .groupBy("geom")
        .agg(F.min("src_ord").alias("parcel_ord"))
        .select(
            "parcel_ord", G.bbox("geom").alias("_box"), G.segments("geom").alias("_segments")
        )
        .where(F.col("_box").isNotNull())
    )
    points = addresses.where(F.col("px").isNotNull() & F.col("py").isNotNull()).select(
        F.col("src_ord").alias("addr_ord"), "px", "py"
    )
    point_cells = _point_cells(points, cell, step, levels)
    hot = hot_keys(point_cells, _CELL_KEYS, hot_rows)
    left = with_part(point_cells, hot, _CELL_KEYS, "addr_ord")
    right = with_all_parts(_polygon_cells(shapes, cell, step, levels), hot, _CELL_KEYS)
    px, py, box = F.col("px"), F.col("py"), F.col("_box")
    inside_box = px.between(box["xmin"], box["xmax"]) & py.between(box["ymin"], box["ymax"])
    return (
        left.join(right, [*_CELL_KEYS, "_salt"])
        .where(inside_box & G.covers_point(F.col("_segments"), px, py))
        .groupBy("addr_ord")
        .agg(F.min("parcel_ord").alias("parcel_ord"))
    )


def spatial_join(parcels: DataFrame, addresses: DataFrame, **grid) -> DataFrame:
    """Parcels with the truthy properties of their first address put over their own."""
    first = (
        spatial_matches(parcels, addresses, **grid)
        .groupBy("parcel_ord")
        .agg(F.min("addr_ord").alias("addr_ord"))
    )
    values = addresses.select(
        F.col("src_ord").alias("addr_ord"), M.truthy_only("props").alias("_over")
    )
    found = first.join(values, "addr_ord").select(
        F.col("parcel_ord").alias("src_ord"), "addr_ord", "_over"
    )
    return (
        parcels.join(found, "src_ord", "left")
        .withColumn("props", M.overwrite("props", "_over"))
        .drop("_over")
    )


def spatial_unmatched(parcels: DataFrame, addresses: DataFrame, **grid) -> DataFrame:
    """Addresses that no parcel covers."""
    matched = spatial_matches(parcels, addresses, **grid).select(
        F.col("addr_ord").alias("src_ord")
    )
    return addresses.join(matched, "src_ord", "left_anti")


def spatial_counts(matches: DataFrame, addresses: DataFrame) -> DataFrame:
    """Parcels with an address, addresses matched, addresses unmatched."""
    per_parcel = matches.groupBy("parcel_ord").agg(F.count(F.lit(1)).alias("n"))
    rows = per_parcel.select(
        F.lit(1).alias("p"), F.col("n").alias("m"), F.lit(0).alias("a")
    ).unionByName(
        addresses.select(
            F.lit(0).alias("p"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("a")
        )
    )
    sums = rows.agg(F.sum("p").alias("p"), F.sum("m").alias("m"), F.sum("a").alias("a"))
    return sums.select(
        F.coalesce("p", F.lit(0)).alias("parcels_matched"),
        F.coalesce("m", F.lit(0)).alias("addresses_matched"),
        (F.coalesce("a", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("addresses_unmatched"),
    )


def multiple_matches(matches: DataFrame) -> DataFrame:
    """Parcels with more than one address: ``parcel_ord, addresses, position, addr_ord``.

    One row per address, in order of its number; a parcel with very many addresses is
    numbered in blocks of source positions.
    """
    crowded = (
        matches.groupBy("parcel_ord")
        .agg(F.count(F.lit(1)).alias("addresses"))
        .where(F.col("addresses") > 1)
    )
    listed = matches.join(crowded, "parcel_ord")
    bucket = position_bucket(F.col("addr_ord"))
    numbered = number_rows(listed, ["parcel_ord"], ["addr_ord"], bucket, "position")
    return numbered.select("parcel_ord", "addresses", "position", "addr_ord")
