"""Shapes of any layer: points, lines and areas as paths of vertices.

A point is a path of one vertex, a line is a path, and so is each ring of an area. Parcels
have a shape of their own (``functions.geometry``), which keeps the rings of each polygon
together; layers need only where their features are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.bind import bind
from lotbook.functions.geometry import MAX_LATITUDE, WGS84, to_degrees_sql
from lotbook.functions.text import col

POINT_KINDS = ["Point", "MultiPoint"]
LINE_KINDS = ["LineString", "MultiLineString"]
AREA_KINDS = ["Polygon", "MultiPolygon"]

SHAPE = "struct<type: string, paths: array<array<struct<x: double, y: double>>>>"


def parse_shape(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text to a shape; null without a geometry.

    A third ordinate is dropped, as are vertices that lack one of two and paths without any
    vertex. Kinds other than the six, and coordinates that do not fit their kind, have no
    paths.
    """

    def nested(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    def vertex(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def path(line: Column) -> Column:
        return F.transform(line, vertex)

    def present(parts: Column) -> Column:
        return F.filter(parts, lambda part: part.isNotNull())

    lines = F.transform(nested(3), path)
    found = (
        F.when(kind == "Point", F.array(F.array(vertex(nested(1)))))
        .when(kind == "MultiPoint", F.transform(nested(2), lambda p: F.array(vertex(p))))
        .when(kind == "LineString", F.array(path(nested(2))))
        .when(kind.isin("MultiLineString", "Polygon"), lines)
        .when(kind == "MultiPolygon", F.transform(F.flatten(present(nested(4))), path))
    )
    whole = F.transform(
        present(found),
        lambda p: F.filter(p, lambda v: v["x"].isNotNull() & v["y"].isNotNull()),
    )
    paths = F.coalesce(F.filter(whole, lambda p: F.size(p) > 0), F.lit([]).cast(_PATHS))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), paths.alias("paths")))


_PATHS = "array<array<struct<x: double, y: double>>>"


def has_place(shape: Column | str) -> Column:
    """Whether a shape has a vertex; false for null."""
    return F.coalesce(F.size(col(shape)["paths"]) > 0, F.lit(False))


def shape_box(shape: Column | str) -> Column:
    """Box struct of all vertices of any kind; null where there is none."""

    def box(vertices: Column) -> Column:
        xs = F.transform(vertices, lambda v: v["x"])
        ys = F.transform(vertices, lambda v: v["y"])
        found = F.struct(
            F.array_min(xs).alias("xmin"),
            F.array_min(ys).alias("ymin"),
            F.array_max(xs).alias("xmax"),
            F.array_max(ys).alias("ymax"),
        )
        return F.when(F.size(vertices) > 0, found)

    return bind(F.flatten(col(shape)["paths"]), box)


def steps(shape: Column | str) -> Column:
    """From each vertex of a path to the next, as ``(x1, y1, x2, y2)``; a path of one vertex
    is a step to itself."""

    def of_path(path: Column) -> Column:
        last = F.greatest(F.size(path) - 1, F.lit(1))
        heads = F.slice(path, F.lit(1), last)
        tails = F.when(F.size(path) > 1, F.slice(path, F.lit(2), last)).otherwise(path)
        return F.zip_with(
            heads,
            tails,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(col(shape)["paths"], of_path))


def shape_in_degrees(shape: str, crs: str) -> Column:
    """Shape column with every vertex in WGS84 degrees from the system in column ``crs``."""
    point = to_degrees_sql("p.x", "p.y", crs)
    return F.expr(
        f"if({shape} is null or {crs} = '{WGS84}', {shape}, named_struct('type', {shape}.type,"
        f" 'paths', transform({shape}.paths, path -> transform(path, p -> {point}))))"
    )


# ---------------------------------------------------------------- the square world


def world_x(lon: Column) -> Column:
    """Web-mercator place of a longitude, from 0 (west end) to 1."""
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    """Web-mercator place of a latitude, from 0 (north end) to 1."""
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(lat, F.lit(MAX_LATITUDE))))
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0
