"""Map tile assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feeds
from checks.parcel_checks import STANDARD_SQL
from lotbook.functions import geometry as G
from lotbook.operators import tiles


def _boxes(spark, sf):
    return feeds.features(spark, sf).select(
        F.col("src_ord").alias("uid"), G.bbox("geom").alias("bbox")
    )


def _cover(spark, sf):
    return tiles.tile_cover(_boxes(spark, sf))


def tile_cover(spark, sf):
    return _cover(spark, sf).select("band", "z", "x", "y", "uid")


def tile_counts(spark, sf):
    return tiles.tile_counts(_cover(spark, sf))


def tile_lists(spark, sf):
    return tiles.tile_lists(_cover(spark, sf))


def tile_topk(spark, sf):
    return tiles.tile_largest(_cover(spark, sf), 10).select("z", "x", "y", "rank", "uid")


def tile_coalesced(spark, sf):
    return tiles.tile_coalesced(_cover(spark, sf), 10).select(
        "z", "x", "y", "kept", "rest", F.round(F.col("rest_area") * 1000000, 3).cast("double").alias("rest_area")
    )


_Y = "cast(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, z)) as bigint)"
_X = "cast(floor(({lon} + 180) / 360 * pow(2, z)) as bigint)"

_COVER_SQL = f"""{STANDARD_SQL},
  zs as (select unnest(range(6, 18)) as z),
  zoomed as (select *, case when z <= 12 then 'low' when z <= 16 then 'mid' else 'high' end as band,
      cast((xmax - xmin) * (ymax - ymin) as decimal(24, 12)) as area from std, zs where xmin is not null),
  xs as (select *, unnest(range({_X.format(lon='xmin')}, {_X.format(lon='xmax')} + 1)) as x from zoomed),
  tc as (select band, cast(z as int) as z, x, unnest(range({_Y.format(lat='ymax')}, {_Y.format(lat='ymin')} + 1)) as y, ck as uid, area from xs),
  ranked as (select *, row_number() over (partition by z, x, y order by area desc, uid) as rank from tc)"""

QUERIES = {
    "tile_cover": (tile_cover, f"with {_COVER_SQL} select band, z, x, y, uid from tc"),
    "tile_counts": (tile_counts, f"with {_COVER_SQL} select z, x, y, count(*) as features from tc group by z, x, y"),
    "tile_lists": (
        tile_lists,
        f"with {_COVER_SQL} select z, x, y, row_number() over (partition by z, x, y order by uid) as position, uid from tc",
    ),
    "tile_topk": (tile_topk, f"with {_COVER_SQL} select z, x, y, rank, uid from ranked where rank <= 10"),
    "tile_coalesced": (
        tile_coalesced,
        f"""with {_COVER_SQL} select z, x, y, count(*) filter (rank <= 10) as kept, count(*) filter (rank > 10) as rest,
          cast(round(coalesce(sum(area) filter (rank > 10), 0) * 1000000, 3) as double) as rest_area from ranked group by z, x, y""",
    ),
}
