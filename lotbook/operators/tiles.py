"""Which map tiles a parcel falls into, and what a crowded tile keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.operators.numbering import positions
from lotbook.operators.skew import dealt

# Zoom bands as (name, lowest, highest).
ZOOM_BANDS = [("low", 6, 12), ("mid", 13, 16), ("high", 17, 17)]
LEGACY_BANDS = [("legacy", 7, 15)]

_TILE = ["z", "x", "y"]


def tile_cover(parcels: DataFrame, bands: list[tuple[str, int, int]] = ZOOM_BANDS) -> DataFrame:
    """``band, z, x, y, uid, area``: every tile a parcel's box touches, all bands merged.

    ``parcels`` has ``uid`` and ``bbox`` (a box struct). A box becomes a row per zoom and tile,
    dozens of them, so the boxes are dealt to many tasks first: what a task sorts or counts
    does not depend on how few files the boxes came from.
    """
    zooms = F.array(
        *[
            F.struct(F.lit(name).alias("band"), F.lit(z).alias("z"))
            for name, low, high in bands
            for z in range(low, high + 1)
        ]
    )
    box, z = F.col("bbox"), F.col("z")
    area = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"])
    boxes = parcels.where(box.isNotNull()).select("uid", "bbox")
    return (
        dealt(boxes, "uid")
        .select("uid", "bbox", F.explode(zooms).alias("_zoom"))
        .select("uid", "bbox", F.col("_zoom.band").alias("band"), F.col("_zoom.z").alias("z"))
        .withColumn(
            "x", F.explode(F.sequence(G.tile_x(box["xmin"], z), G.tile_x(box["xmax"], z)))
        )
        .withColumn(
            "y", F.explode(F.sequence(G.tile_y(box["ymax"], z), G.tile_y(box["ymin"], z)))
        )
        .select("band", *_TILE, "uid", area.cast("decimal(24,12)").alias("area"))
    )


def tile_counts(cover: DataFrame) -> DataFrame:
    return cover.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("features"))


def tile_lists(cover: DataFrame) -> DataFrame:
    """``z, x, y, position, uid``: the features of each tile in order of uid.

    A tile has no bound on its features, so its list is rows, the same for every size.
    """
    return positions(cover.select(*_TILE, "uid"), _TILE, ["uid"], "position")


def tile_largest(cover: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` largest features of each tile, ties by uid.

    A constant bound lets Spark prune per partition before the shuffle, so a tile
    that holds everything still sends only ``keep`` rows per task.
    """
    order = Window.partitionBy(*_TILE).orderBy(F.col("area").desc(), F.col("uid"))
    return (
        cover.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= keep)
        .select("band", *_TILE, "rank", "uid", "area")
    )


def tile_coalesced(cover: DataFrame, keep: int) -> DataFrame:
    """Per tile: features kept and, as one coalesced rest, their number and area.

    The rest is the tile's total less what is kept. Areas are decimals, so the
    difference is exact and no tile is sorted whole.
    """
    kept = (
        tile_largest(cover, keep)
        .groupBy(*_TILE)
        .agg(F.count(F.lit(1)).alias("kept"), F.sum("area").alias("kept_area"))
    )
    total = cover.groupBy(*_TILE).agg(
        F.count(F.lit(1)).alias("features"), F.sum("area").alias("total_area")
    )
    return total.join(kept, _TILE).select(
        *_TILE,
        "kept",
        (F.col("features") - F.col("kept")).alias("rest"),
        (F.col("total_area") - F.col("kept_area")).alias("rest_area"),
    )
