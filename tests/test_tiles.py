"""Tile cover against a direct computation, crowded tiles."""

import math

from pyspark.sql import functions as F

from lotbook.operators import tiles

SCHEMA = "uid string, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>"
BOXES = [("a", (-110.8, 43.4, -110.79, 43.41)), ("b", (-110.8, 43.4, -110.5, 43.6)), ("c", None), ("d", (-110.8, 43.4, -110.8, 43.4))]


def expected(box, z):
    def tx(lon):
        return int((lon + 180) / 360 * 2**z)

    def ty(lat):
        r = math.radians(lat)
        return int((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * 2**z)

    return {(x, y) for x in range(tx(box[0]), tx(box[2]) + 1) for y in range(ty(box[3]), ty(box[1]) + 1)}


def cover(spark, bands=((("all"), 6, 13),)):
    return tiles.tile_cover(spark.createDataFrame(BOXES, SCHEMA), list(bands))


def test_cover(spark):
    rows = cover(spark).collect()
    for uid, box in BOXES:
        for z in range(6, 14):
            got = {(r.x, r.y) for r in rows if r.uid == uid and r.z == z}
            assert got == (expected(box, z) if box else set())


def test_bands_cover_each_zoom_once():
    zooms = [z for _, low, high in tiles.ZOOM_BANDS for z in range(low, high + 1)]
    assert zooms == list(range(6, 18))


def test_crowded_tiles_keep_the_largest_and_sum_the_rest(spark):
    c = cover(spark)
    largest = {(r.z, r.x, r.y): r.uid for r in tiles.tile_largest(c, 1).collect()}
    counts = {(r.z, r.x, r.y): r.features for r in tiles.tile_counts(c).collect()}
    rest = {(r.z, r.x, r.y): r for r in tiles.tile_coalesced(c, 1).collect()}
    for tile, n in counts.items():
        assert rest[tile].kept == 1 and rest[tile].rest == n - 1
    assert largest[(6, *next(iter(expected(BOXES[0][1], 6))))] == "b"


def test_lists_are_rows_in_order_and_lose_nothing(spark):
    many = spark.range(100).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("uid"),
        F.struct(*[F.lit(v).alias(n) for v, n in zip((-110.8, 43.4, -110.8, 43.4), ("xmin", "ymin", "xmax", "ymax"))]).alias("bbox"),
    )
    listed = tiles.tile_lists(tiles.tile_cover(many, [("x", 6, 6)])).collect()
    ordered = [r.uid for r in sorted(listed, key=lambda r: r.position)]
    assert ordered == sorted(f"u{i}" for i in range(100))
    assert sorted(r.position for r in listed) == list(range(1, 101))


def test_boxes_of_one_file_expand_in_many_tasks(spark):
    """A task's sort grows with the rows it makes; one scan task made them all before."""
    boxes = spark.range(0, 400, 1, 1).select(
        "id", F.struct(*[F.lit(v).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), BOXES[0][1])]).alias("bbox")
    )
    rows = tiles.tile_cover(boxes.withColumnRenamed("id", "uid")).groupBy(F.spark_partition_id().alias("task"))
    counts = [r["count"] for r in rows.count().collect()]
    assert len(counts) >= 8 and max(counts) < sum(counts) / 4
