"""Geometry as arrays of points: parsing, boxes, containment, reprojection, tiles.

A polygon is lifted to a one-part multi-polygon, so one shape covers both kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.bind import bind
from lotbook.functions.text import col

POLYGON_KINDS = ["Polygon", "MultiPolygon"]
_EMPTY_POINTS = "cast(array() as array<struct<x: double, y: double>>)"


def parse_geometry(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text to the shared shape; a third ordinate is dropped."""

    def point(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def rings(polygon: Column) -> Column:
        return F.transform(polygon, lambda ring: F.transform(ring, point))

    single = F.array(rings(F.from_json(coordinates, "array<array<array<double>>>")))
    multi = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), rings)
    polys = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi)
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), polys.alias("polys")))


def parse_point(coordinates: Column) -> Column:
    p = F.from_json(coordinates, "array<double>")
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def points(geom: Column | str) -> Column:
    """All vertices as one array; null and empty parts are skipped."""
    polys = F.filter(col(geom)["polys"], lambda p: p.isNotNull())
    rings = F.filter(F.flatten(polys), lambda r: r.isNotNull())
    return F.filter(F.flatten(rings), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def valid_polygon(geom: Column | str) -> Column:
    geom = col(geom)
    return (
        geom.isNotNull()
        & geom["type"].isin(*POLYGON_KINDS)
        & (F.coalesce(F.size(geom["polys"]), F.lit(0)) > 0)
    )


def bbox(geom: Column | str) -> Column:
    """Box struct of all vertices; null for other kinds and for empty coordinates."""
    geom = col(geom)

    def box(pts: Column) -> Column:
        xs = F.transform(pts, lambda p: p["x"])
        ys = F.transform(pts, lambda p: p["y"])
        found = F.struct(
            F.array_min(xs).alias("xmin"),
            F.array_min(ys).alias("ymin"),
            F.array_max(xs).alias("xmax"),
            F.array_max(ys).alias("ymax"),
        )
        return F.when(F.size(pts) > 0, found)

    return bind(geom, lambda g: bind(F.when(valid_polygon(g), points(g)), box))


def bbox_array(box: Column | str) -> Column:
    """Box as ``[min_lon, min_lat, max_lon, max_lat]``, or null."""

    def corners(b: Column) -> Column:
        return F.when(b.isNotNull(), F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))

    return bind(col(box), corners)


def segments(geom: Column | str) -> Column:
    """Edges of all rings, holes included, as ``(x1, y1, x2, y2)`` structs."""

    def edges(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.zip_with(
            F.slice(ring, F.lit(1), n),
            F.slice(ring, F.lit(2), n),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    rings = F.filter(F.flatten(col(geom)["polys"]), lambda r: F.size(r) > 1)
    return F.flatten(F.transform(rings, edges))


def covers_point(segs: Column, px: Column, py: Column) -> Column:
    """True when the point lies inside or on the boundary (even-odd over all rings).

    ``side`` is the cross product of an edge with the point: its sign tells on which
    side of the edge the point lies, and zero within the edge's extent means on it.
    Comparing signs needs no division, so horizontal edges need no special case.
    """

    def side(s: Column) -> Column:
        return (s["x2"] - s["x1"]) * (py - s["y1"]) - (px - s["x1"]) * (s["y2"] - s["y1"])

    def on_edge(s: Column) -> Column:
        return (
            (side(s) == 0)
            & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
            & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
        )

    def crosses(s: Column) -> Column:
        return ((s["y1"] > py) != (s["y2"] > py)) & ((side(s) > 0) == (s["y2"] > s["y1"]))

    crossings = F.size(F.filter(segs, crosses))
    return F.exists(segs, on_edge) | (crossings % 2 == 1)


def box_center(box: Column) -> tuple[Column, Column]:
    return (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2


def degree_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Plain Euclidean distance in degrees."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


# ---------------------------------------------------------------- reference systems

WGS84 = "EPSG:4326"

# Zone parameters (degrees, scale, metres) of the two State Plane zones
# in use, from the public EPSG registry; GRS 80 ellipsoid, US survey feet.
STATE_PLANE_ZONES = {
    "EPSG:3738": {"lat0": 40.5, "lon0": -108.75, "k0": 0.9999375, "fe": 600000.0, "fn": 0.0},
    "EPSG:3739": {
        "lat0": 40.5,
        "lon0": -(110.0 + 5.0 / 60.0),
        "k0": 0.9999375,
        "fe": 800000.0,
        "fn": 100000.0,
    },
}
_FOOT = 1200.0 / 3937.0
_A = 6378137.0
_F = 1.0 / 298.257222101
_E2 = _F * (2.0 - _F)
_EP2 = _E2 / (1.0 - _E2)


def declared_crs(name: Column | str) -> Column:
    """System named in the collection header; null when absent or not known."""
    name = col(name)
    return (
        F.when(name.contains("3738"), "EPSG:3738")
        .when(name.contains("EPSG:3739") | name.contains("EPSG:2677"), "EPSG:3739")
        .when(name.contains("EPSG:4326"), WGS84)
    )


def crs_of_point(x: Column, y: Column) -> Column:
    """System guessed from the size of a first coordinate; degrees unless clearly feet."""
    degrees = x.between(-180, 180) & y.between(-90, 90)
    feet = (x > 1000000) | (y > 1000000)
    return F.when(degrees, WGS84).when(feet, "EPSG:3739").otherwise(WGS84)


def meridian_arc(lat: float) -> float:
    """Distance along the meridian from the equator (Snyder 1987, eq. 3-21)."""
    e4, e6 = _E2**2, _E2**3
    return _A * (
        (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat
        - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * math.sin(2 * lat)
        + (15 * e4 / 256 + 45 * e6 / 1024) * math.sin(4 * lat)
        - (35 * e6 / 3072) * math.sin(6 * lat)
    )


def _bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` evaluated once, see ``functions.bind``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _inverse_sql(x: str, y: str, zone: dict[str, float]) -> str:
    """Point struct in degrees: inverse Transverse Mercator (Snyder 1987, 8-17 to 8-25).

    Written as SQL text, as the series would take hundreds of calls to build.
    """

    def number(v: float) -> str:
        return f"{v:.17e}D"

    mu = (
        f"(({number(meridian_arc(math.radians(zone['lat0'])))}"
        f" + ({y} * {number(_FOOT)} - {number(zone['fn'])}) / {number(zone['k0'])})"
        f" / {number(_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))})"
    )
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    series = [
        3 * e1 / 2 - 27 * e1**3 / 32,
        21 * e1**2 / 16 - 55 * e1**4 / 32,
        151 * e1**3 / 96,
        1097 * e1**4 / 512,
    ]
    foot = " + ".join(["m", *[f"{number(c)} * sin({2 * i + 2} * m)" for i, c in enumerate(series)]])
    e2, ep2, a = number(_E2), number(_EP2), number(_A)
    lat = (
        "degrees(f - (n * t / r) * (d * d / 2"
        f" - (5 + 3 * t * t + 10 * c - 4 * c * c - 9 * {ep2}) * d * d * d * d / 24"
        f" + (61 + 90 * t * t + 298 * c + 45 * t * t * t * t - 252 * {ep2} - 3 * c * c)"
        " * d * d * d * d * d * d / 720))"
    )
    lon = (
        f"{number(zone['lon0'])} + degrees((d - (1 + 2 * t * t + c) * d * d * d / 6"
        f" + (5 - 2 * c + 28 * t * t - 3 * c * c + 8 * {ep2} + 24 * t * t * t * t)"
        " * d * d * d * d * d / 120) / cos(f))"
    )
    east = f"({x} * {number(_FOOT)} - {number(zone['fe'])}) / {number(zone['k0'])}"
    body = f"named_struct('x', {lon}, 'y', {lat})"
    body = _bound("d", f"({east}) / n", body)
    body = _bound("r", f"{a} * (1 - {e2}) / (w * sqrt(w))", body)
    body = _bound("n", f"{a} / sqrt(w)", body)
    body = _bound("w", f"1 - {e2} * sin(f) * sin(f)", body)
    body = _bound("c", f"{ep2} * cos(f) * cos(f)", body)
    body = _bound("t", "tan(f)", body)
    return _bound("f", _bound("m", mu, foot), body)


def to_degrees_sql(x: str, y: str, crs: str) -> str:
    """SQL of the point struct in WGS84 degrees from the system named in ``crs``."""
    branches = " ".join(
        f"when '{name}' then {_inverse_sql(x, y, zone)}" for name, zone in STATE_PLANE_ZONES.items()
    )
    return f"case {crs} {branches} else named_struct('x', {x}, 'y', {y}) end"


def reproject(geom: str, crs: str) -> Column:
    """Geometry column with every vertex in WGS84 degrees; degrees pass unchanged."""
    point = to_degrees_sql("p.x", "p.y", crs)
    return F.expr(
        f"if({geom} is null or {crs} = '{WGS84}', {geom}, named_struct('type', {geom}.type, 'polys',"
        f" transform({geom}.polys, poly -> transform(poly, ring -> transform(ring, p -> {point})))))"
    )


# ---------------------------------------------------------------- web-mercator tiles

# Fixed value: latitude at which the square web-mercator world ends.
MAX_LATITUDE = 85.0511287798066


def tile_x(lon: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    raw = F.floor((lon + 180.0) / 360.0 * n)
    return F.greatest(F.lit(0).cast("long"), F.least(raw, (n - 1).cast("long")))


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(lat, F.lit(MAX_LATITUDE))))
    raw = F.floor((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)
    return F.greatest(F.lit(0).cast("long"), F.least(raw, (n - 1).cast("long")))
