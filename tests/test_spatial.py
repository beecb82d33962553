"""The grid join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lotbook.operators import spatial
from lotbook.schemas import GEOMETRY

PARCELS = f"src_ord bigint, props map<string,string>, geom {GEOMETRY}"
POINTS = "src_ord bigint, props map<string,string>, px double, py double"


def box(x, y, w, h):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return ("Polygon", [[ring]])


def scene(seed, n_boxes=40, n_points=200):
    rng = random.Random(seed)
    grid = 1 / 64
    boxes = []
    for i in range(n_boxes):
        size = rng.choice([1, 2, 40, 200])
        boxes.append((i, rng.randrange(-200, 200) * grid, rng.randrange(-200, 200) * grid, size * grid, rng.choice([1, 3, size]) * grid))
    boxes += [(n_boxes + j, *boxes[0][1:]) for j in range(5)]  # copies of one shape
    points = [(i, rng.randrange(-450, 450) * grid / 2, rng.randrange(-450, 450) * grid / 2) for i in range(n_points)]
    return boxes, points


def brute(boxes, points):
    out = {}
    for i, px, py in points:
        hits = [b for b, x, y, w, h in boxes if x <= px <= x + w and y <= py <= y + h]
        if hits:
            out[i] = min(hits)
    return out


def frames(spark, boxes, points):
    parcels = spark.createDataFrame([(b[0], {"PIN": str(b[0])}, box(*b[1:])) for b in boxes], PARCELS)
    addresses = spark.createDataFrame([(p[0], {"FID": str(p[0]), "note": ""}, p[1], p[2]) for p in points], POINTS)
    return parcels, addresses


@pytest.mark.parametrize("seed, cell, hot", [(1, 0.02, 10**6), (2, 0.5, 10**6), (3, 0.1, 3)])
def test_matches_brute_force(spark, seed, cell, hot):
    boxes, points = scene(seed)
    matches = spatial.spatial_matches(*frames(spark, boxes, points), cell=cell, hot_rows=hot)
    assert {r.addr_ord: r.parcel_ord for r in matches.collect()} == brute(boxes, points)


def test_join_report_and_rest(spark):
    boxes, points = scene(4)
    want = brute(boxes, points)
    parcels, addresses = frames(spark, boxes, points)
    matches = spatial.spatial_matches(parcels, addresses).cache()
    first = {}
    for a, p in sorted(want.items()):
        first.setdefault(p, a)
    joined = {r.src_ord: dict(r.props) for r in spatial.spatial_join(parcels, addresses).collect()}
    for p, props in joined.items():
        assert props.get("FID") == (str(first[p]) if p in first else None)
        assert "note" not in props
    rest = {r.src_ord for r in spatial.spatial_unmatched(parcels, addresses).collect()}
    assert rest == {p[0] for p in points} - set(want)
    counts = spatial.spatial_counts(matches, addresses).collect()[0]
    assert tuple(counts) == (len(set(want.values())), len(want), len(points) - len(want))
    groups = {}
    for a, p in want.items():
        groups.setdefault(p, set()).add(a)
    groups = {p: g for p, g in groups.items() if len(g) > 1}
    listed = spatial.multiple_matches(matches).collect()
    for p, g in groups.items():
        rows = sorted((r.position, r.addr_ord) for r in listed if r.parcel_ord == p)
        assert rows == list(enumerate(sorted(g), 1))
        assert all(r.addresses == len(g) for r in listed if r.parcel_ord == p)
    assert {r.parcel_ord for r in listed} == set(groups)


def test_null_and_other_geometries_match_nothing(spark):
    parcels = spark.createDataFrame([(1, {}, None), (2, {}, ("Point", None)), (3, {}, ("Polygon", []))], PARCELS)
    addresses = spark.createDataFrame([(1, {}, 0.0, 0.0), (2, {}, None, 0.0)], POINTS)
    assert spatial.spatial_matches(parcels, addresses).count() == 0


def test_plan_has_no_nested_loop(spark):
    boxes, points = scene(5)
    matches = spatial.spatial_matches(*frames(spark, boxes, points))
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_numbers_of_partitions_do_not_matter(spark):
    boxes, points = scene(6)
    parcels, addresses = frames(spark, boxes, points)
    a = spatial.spatial_matches(parcels.repartition(1), addresses.repartition(7))
    b = spatial.spatial_matches(parcels.repartition(5), addresses.coalesce(1))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    assert a.select(F.count_distinct("addr_ord")).collect()[0][0] == a.count()
