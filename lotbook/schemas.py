"""Fixed schemas of the parcel model."""

from __future__ import annotations

GEOMETRY = "struct<type: string, polys: array<array<array<struct<x: double, y: double>>>>>"

BBOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"

# One landed feature as it appears on a line of a feature collection. Coordinates
# stay JSON text here because Polygon and MultiPolygon nest to different depths.
FEATURE_JSON = (
    "type string, id string, properties map<string,string>, "
    "geometry struct<type: string, coordinates: string>"
)

# Column names and order of the standardized parcel.
STANDARD_FIELDS = [
    "global_parcel_uid",
    "county",
    "county_parcel_id_num",
    "owner_name",
    "physical_address",
    "mailing_address",
    "acreage",
    "property_value",
    "land_type_description",
    "deed_reference",
    "tax_year",
    "owner_city",
    "owner_state",
    "owner_zip",
    "property_details_link",
    "tax_details_link",
    "clerk_records_link",
    "bbox",
    "raw_data",
]

# The standard schema spells this one column with a slash; the core uses an
# identifier and the JSON sink renames it.
JSON_FIELD_NAMES = {"land_type_description": "land_type/description"}

# Column names and order of a search entry.
ENTRY_FIELDS = [
    "global_parcel_uid",
    "pidn",
    "owner",
    "mailing_address",
    "physical_address",
    "county",
    "state",
    "bbox",
    "clerk_rec",
    "property_det",
    "tax_info",
]

SEARCH_REQUEST = (
    "qid bigint, q string, counties array<string>, fields array<string>, "
    "lon double, lat double, max_rows int"
)

# The canonical property document.
LEGAL = (
    "struct<subdivision: string, lot: string, block: string, section: string, "
    "township: string, range: string, location: string>"
)
ACREAGE = (
    "struct<residential: double, agricultural: double, commercial: double, "
    "industrial: double, other: double>"
)
VALUES = "struct<total_value: string, land: string, developments: string>"
