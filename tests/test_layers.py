"""Layers of points, lines and areas: shapes, tiles along lines, scans by folder."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lotbook.functions import shapes as S
from lotbook.operators import layers, tiles
from lotbook.plans.jobs import layers_job
from lotbook.sources.layers import read_layers

SHAPES = [
    ("Point", [1, 2, 3], [[(1, 2)]]),
    ("MultiPoint", [[1, 2], [3, 4]], [[(1, 2)], [(3, 4)]]),
    ("LineString", [[1, 2], [3, 4], [5, 6, 7]], [[(1, 2), (3, 4), (5, 6)]]),
    ("MultiLineString", [[[1, 2], [3, 4]], [], [[5, 6], [7, 8]]], [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]),
    ("Polygon", [[[0, 0], [1, 0], [0, 1], [0, 0]]], [[(0, 0), (1, 0), (0, 1), (0, 0)]]),
    ("MultiPolygon", [[[[0, 0], [1, 0], [0, 0]]], None, [[[5, 5], [6, 6], [5, 5]]]], [[(0, 0), (1, 0), (0, 0)], [(5, 5), (6, 6), (5, 5)]]),
    ("LineString", [[1, 2], [None, 4], [5]], [[(1, 2)]]),
    ("Point", [], []),
    ("LineString", "odd", []),
    ("GeometryCollection", None, []),
]


def shaped(spark, rows):
    df = spark.createDataFrame([(i, k, json.dumps(c)) for i, (k, c) in enumerate(rows)], "i int, k string, c string")
    return df.select(F.col("i").cast("string").alias("uid"), S.parse_shape(F.col("k"), F.col("c")).alias("shape"))


def test_shapes_boxes_and_steps(spark):
    df = shaped(spark, [s[:2] for s in SHAPES])
    rows = df.select("uid", "shape", S.shape_box("shape").alias("b"), S.has_place("shape").alias("placed"), S.steps("shape").alias("s"))
    for row in rows.collect():
        kind, _, want = SHAPES[int(row.uid)]
        got = [[(v.x, v.y) for v in path] for path in row.shape.paths]
        assert (row.shape.type, got) == (kind, want)
        assert row.placed is bool(want)
        flat = [v for path in want for v in path]
        assert (row.b is None) is (not flat)
        if flat:
            xs, ys = zip(*flat)
            assert tuple(row.b) == (min(xs), min(ys), max(xs), max(ys))
        steps = [(*a, *b) for p in want for a, b in (zip(p, p[1:]) if len(p) > 1 else [(p[0], p[0])])]
        assert [tuple(s) for s in row.s] == steps


def world(lon, lat, z):
    r = math.radians(max(-85.0511287798066, min(85.0511287798066, lat)))
    return (lon + 180) / 360 * 2**z, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * 2**z


def crossed(path, z):
    """Tiles of a path by clipping each step against each tile of its box."""
    found = set()
    places = [world(*p, z) for p in path]
    for (ax, ay), (bx, by) in zip(places, places[1:] or places):
        for x in range(int(min(ax, bx)), int(max(ax, bx)) + 1):
            for y in range(int(min(ay, by)), int(max(ay, by)) + 1):
                low, high = 0.0, 1.0
                for start, end, tile in ((ax, bx, x), (ay, by, y)):
                    if start == end:
                        continue
                    t = sorted(((tile - start) / (end - start), (tile + 1 - start) / (end - start)))
                    low, high = max(low, t[0]), min(high, t[1])
                if low <= high:
                    found.add((x, y))
    return found


def test_lines_take_the_tiles_they_cross(spark):
    rng = random.Random(3)
    lines = [[[rng.uniform(-111, -110), rng.uniform(43, 44)] for _ in range(rng.randint(1, 6))] for _ in range(25)]
    lines += [[[-110.5, 43.1], [-110.5, 43.9]], [[-110.9, 43.5], [-110.1, 43.5]], [[170, 89], [-170, -89.9]]]
    df = shaped(spark, [("LineString", line) for line in lines])
    rows = layers.layer_cover(df.withColumn("bbox", S.shape_box("shape")), [("all", 5, 11)]).collect()
    for i, line in enumerate(lines):
        for z in (5, 8, 11):
            if abs(line[0][1]) > 85 and z > 8:
                continue
            got = {(r.x, r.y) for r in rows if r.uid == str(i) and r.z == z}
            want = {(min(max(x, 0), 2**z - 1), min(max(y, 0), 2**z - 1)) for x, y in crossed(line, z)}
            assert got == want, (i, z)
    # A slanted road is in far fewer tiles than its box.
    slanted = shaped(spark, [("LineString", [[-111, 43], [-110, 44]])]).withColumn("bbox", S.shape_box("shape"))
    along, boxed = layers.layer_cover(slanted, [("z", 13, 13)]).count(), tiles.tile_cover(slanted, [("z", 13, 13)]).count()
    assert along * 10 < boxed


def test_direction_does_not_matter_and_areas_take_their_box(spark):
    line = [[-110.7, 43.2], [-110.3, 43.8], [-110.9, 43.4]]
    ring = [[[-110.7, 43.2], [-110.3, 43.2], [-110.3, 43.8], [-110.7, 43.2]]]
    df = shaped(spark, [("LineString", line), ("LineString", line[::-1]), ("Polygon", ring)])
    df = df.withColumn("bbox", S.shape_box("shape"))
    rows = layers.layer_cover(df, [("a", 6, 12)]).collect()
    by = {u: {(r.z, r.x, r.y, r.steps) for r in rows if r.uid == u} for u in "012"}
    assert by["0"] == by["1"]
    boxed = {(r.z, r.x, r.y, 0) for r in tiles.tile_cover(df.where("uid = 2"), [("a", 6, 12)]).collect()}
    assert by["2"] == boxed


def land(base, county, layer, text):
    folder = base / f"county={county}" / f"layer={layer}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.json").write_text(text)


def feature(i, kind, coordinates):
    geometry = kind and {"type": kind, "coordinates": coordinates}
    return {"type": "Feature", "id": str(i), "properties": {"n": i}, "geometry": geometry}


@pytest.fixture
def landed(tmp_path):
    base = tmp_path / "in"
    roads = [feature(i, "LineString", [[-110.5, 43.5], [-110.4 + i / 100, 43.6]]) for i in range(20)]
    land(base, "teton_county_wy", "roads", json.dumps({"type": "FeatureCollection", "features": roads}))
    feet = [feature(0, "Point", [2500000.0, 1300000.0]), feature(1, None, None), feature(2, "Point", [])]
    land(base, "teton_county_wy", "control_points", json.dumps({"type": "FeatureCollection", "features": feet}, indent=1))
    land(base, "teton_county_wy", "parks", json.dumps(feature(9, "Point", [1, 2])))
    land(base, "teton_county_wy", "zoning", '{"type": "Feature", "id": "z", "properties": {')
    return base


def test_scan_by_folder(spark, landed):
    features, rejects = read_layers(spark, str(landed))
    got = layers.layer_features(features).collect()
    assert sorted(r.uid for r in got if r.layer == "roads") == sorted(f"teton_county_wy_roads_{i + 1}" for i in range(20))
    assert all(r.uid.endswith(f"_{int(r.feature_id) + 1}") for r in got)
    points = {r.feature_id: r for r in got if r.data_type == "control_points"}
    assert set(points) == {"0", "1"} and points["1"].bbox is None
    # Feet are brought to degrees.
    assert -112 < points["0"].bbox.xmin < -108 and 42 < points["0"].bbox.ymin < 46
    assert sorted((r.layer, r.reason) for r in rejects.collect()) == [
        ("control_points", "geometry not read"), ("parks", "unknown layer"), ("zoning", "no feature")
    ]


def test_job_writes_features_tiles_rejects_and_counts(spark, landed, tmp_path):
    target = str(tmp_path / "out")
    layers_job(spark, str(landed), target)
    roads = spark.read.parquet(f"{target}/features").where("data_type = 'roads'")
    assert roads.count() == 20
    counts = {r.layer: (r.features, r.placed, r.rejects) for r in spark.read.parquet(f"{target}/counts").collect()}
    assert counts == {"roads": (20, 20, 0), "control_points": (2, 1, 1), "parks": (0, 0, 1), "zoning": (0, 0, 1)}
    bands = spark.read.parquet(f"{target}/tiles").where("band = 'high'")
    assert bands.select("z").distinct().collect()[0].z == 17


def test_an_empty_layer(spark, tmp_path):
    land(tmp_path, "teton_county_wy", "plss", '{"type": "FeatureCollection", "features": []}')
    features, rejects = read_layers(spark, str(tmp_path))
    assert layers.layer_cover(layers.layer_features(features)).count() == 0 and rejects.count() == 0
