"""County layers to the standard parcel schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.config import COUNTIES, County, Link
from lotbook.functions import geometry as G
from lotbook.functions import maps as M
from lotbook.functions.text import strip, truthy
from lotbook.operators.numbering import BUCKET_ROWS, number_rows, position_bucket
from lotbook.schemas import STANDARD_FIELDS


def prop(name: str) -> Column:
    """A property of the open bag; null when absent."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"try_element_at(props, '{quoted}')")


def mapped_value(names: list[str], fallback: bool = False) -> Column:
    """The first mapped property; with ``fallback`` the first truthy alternate."""
    if not fallback:
        return prop(names[0])
    return F.coalesce(*[F.when(truthy(prop(n)), prop(n)) for n in names])


def mailing_address(names: list[str]) -> Column:
    """``address, city, state zip`` from up to four properties, stray separators trimmed.

    A single mapped property is taken as it is when truthy, else null.
    """
    if len(names) == 1:
        return F.when(truthy(prop(names[0])), prop(names[0]))
    parts = [F.coalesce(prop(n), F.lit("")) for n in names[:4]]
    address, city, state, zip_code = parts + [F.lit("")] * (4 - len(parts))
    place = strip(F.concat(F.lit(", "), city, F.lit(", "), state, F.lit(" "), zip_code))
    any_place = truthy(city) | truthy(state) | truthy(zip_code)
    line = F.concat(address, F.when(any_place, place).otherwise(F.lit("")))
    return F.btrim(line, F.lit(", "))


def link_url(link: Link) -> Column:
    """A link from its template; null when its property is not truthy."""
    if link.field is None:
        return F.lit(link.base)
    value = prop(link.field)
    return F.when(truthy(value), F.concat(F.lit(link.base + link.value_prefix), value))


def parcel_uid(county: Column, number: Column) -> Column:
    """``county_000001``; numbers beyond six digits are not cut."""
    return F.concat(F.lower(county), F.lit("_"), F.format_string("%06d", number))


def per_county(registry: dict[str, County], setting, build) -> Column:
    """One expression for all counties: those with an equal setting share a CASE branch."""
    groups: dict = {}
    for code, county in registry.items():
        groups.setdefault(setting(county), []).append(code)
    out = F.lit(None).cast("string")
    for value, codes in groups.items():
        if value:
            out = F.when(F.col("county").isin(*codes), build(value)).otherwise(out)
    return out


def detect_crs(features: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``county, crs``: the declared system, else the guess from the first geometry.

    ``min_by`` keeps the first geometry's point with map-side combine; the result has
    one row per county.
    """
    polys = F.col("geom.polys")
    has_coordinates = F.col("geom").isNotNull() & (polys.isNull() | (F.size(polys) > 0))
    first_ring = F.get(F.get(polys, F.lit(0)), F.lit(0))
    first = F.when(has_coordinates, F.get(first_ring, F.lit(0)))
    guessed = (
        features.groupBy("county")
        .agg(F.min_by(first, F.when(has_coordinates, F.col("src_ord"))).alias("p"))
        .select("county", G.crs_of_point(F.col("p.x"), F.col("p.y")).alias("guess"))
    )
    if declared is None:
        return guessed.select("county", F.col("guess").alias("crs"))
    return guessed.join(declared, "county", "left").select(
        "county", F.coalesce(G.declared_crs("crs_name"), F.col("guess")).alias("crs")
    )


def reproject_features(features: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Geometry in WGS84 degrees; counties already in degrees pass unchanged."""
    # One row per county of the registry: a fixed, small side.
    systems = F.broadcast(detect_crs(features, declared))
    return (
        features.join(systems, "county", "left")
        .withColumn("crs", F.coalesce("crs", F.lit(G.WGS84)))
        .withColumn("geom", G.reproject("geom", "crs"))
        .drop("crs")
    )


def standardize(
    features: DataFrame,
    registry: dict[str, County] = COUNTIES,
    declared: DataFrame | None = None,
    bucket: Column | None = None,
    fallback: bool = False,
) -> DataFrame:
    """Features ``county, src_ord, props, geom`` of any counties to the standard schema.

    All counties go through one projection, so a union of counties is scanned once.
    ``bucket`` bounds the numbering's share of a county (see ``number_rows``); a
    numeric ``src_ord`` needs none given.
    """
    if bucket is None:
        bucket = position_bucket(F.col("src_ord"), BUCKET_ROWS)
    numbered = number_rows(
        reproject_features(features, declared), ["county"], ["src_ord"], bucket, "number"
    )

    def mapped(name: str) -> Column:
        return per_county(
            registry,
            lambda c: tuple(c.mappings.get(name, [])),
            lambda names: mapped_value(list(names), fallback),
        )

    def link(kind: str) -> Column:
        return per_county(registry, lambda c: c.links.get(kind), link_url)

    values = {
        "global_parcel_uid": parcel_uid(F.col("county"), F.col("number")),
        "county": F.col("county"),
        "county_parcel_id_num": mapped("parcel_id"),
        "mailing_address": per_county(
            registry,
            lambda c: tuple(c.mappings.get("mailing_address", [])),
            lambda names: mailing_address(list(names)),
        ),
        "property_details_link": link("property_details"),
        "tax_details_link": link("tax_details"),
        "clerk_records_link": link("clerk_records"),
        "bbox": G.bbox_array(G.bbox("geom")),
        "raw_data": F.col("props"),
    }
    columns = [values.get(name, None) for name in STANDARD_FIELDS]
    return numbered.select(
        *[
            (mapped(name) if c is None else c).alias(name)
            for name, c in zip(STANDARD_FIELDS, columns)
        ],
        "geom",
    )


def parse_descriptions(features: DataFrame) -> DataFrame:
    """Properties parsed from the HTML description put over the feature's own."""
    return features.withColumn(
        "props", M.overwrite("props", M.parse_description(prop("description")))
    )


def reshape_features(features: DataFrame) -> DataFrame:
    """Feature with its defaults: type ``Feature``, empty properties."""
    return features.select(
        F.coalesce("type", F.lit("Feature")).alias("type"),
        "id",
        F.coalesce("properties", M.no_properties()).alias("properties"),
        "geometry",
    )


