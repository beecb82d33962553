"""County registry: which source field feeds which standard field, and link templates.

A registry entry is data, compiled by ``operators.standardize`` into one column
expression per standard field; adding a county adds an entry, no code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Link:
    """A link template: ``base`` alone, or ``base`` + prefix + the value of ``field``."""

    base: str
    field: str | None = None
    value_prefix: str = ""


@dataclass(frozen=True)
class County:
    code: str
    mappings: dict[str, list[str]] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)
    # Properties arrive inside an HTML description and are parsed before standardizing.
    parse_description: bool = False
    # (parcel key, address key) of a list-page join done before standardizing.
    address_join: tuple[str, str] | None = None


_OWNER_PLACE = {
    "owner_city": ["owner_city", "city"],
    "owner_state": ["owner_state", "state"],
    "owner_zip": ["owner_zip", "zip", "zip_code"],
}

# Source field names and link addresses of the five counties.
COUNTIES: dict[str, County] = {
    c.code: c
    for c in [
        County(
            "teton_county_wy",
            {
                "parcel_id": ["pidn"],
                "owner_name": ["owner"],
                "physical_address": ["st_address"],
                "mailing_address": ["address"],
                "acreage": ["area_calc"],
                "property_value": ["acctval"],
                "land_type_description": ["accttype"],
                "deed_reference": ["deed", "deed_reference", "deed_ref"],
                "tax_year": ["tax_year", "year"],
                **_OWNER_PLACE,
            },
            {
                "property_details": Link(
                    "https://gis.tetoncountywy.gov/portal/apps/dashboards/"
                    "ca93f7b7ae3e4d51ad371121a64ee739#accountno=",
                    "accountno",
                ),
                "clerk_records": Link(
                    "https://gis.tetoncountywy.gov/portal/apps/dashboards/"
                    "03ef10d8b8634909b6263e9016bcc986#statepin=",
                    "pidn",
                ),
                "tax_details": Link(
                    "https://gis.tetoncountywy.gov/portal/apps/dashboards/"
                    "5574848e46464109a14dead33e5ddace#ParcelInfo=",
                    "tax_id",
                ),
            },
            parse_description=True,
        ),
        County(
            "teton_county_id",
            {
                "parcel_id": ["pin"],
                "owner_name": ["owner"],
                "physical_address": ["physical_address"],
                "mailing_address": [
                    "mailing_address",
                    "mailing_city",
                    "mailing_state",
                    "mailing_zip",
                ],
                "acreage": ["acres"],
                "property_value": ["total_value"],
                "land_type_description": ["legal_1"],
                "deed_reference": ["deed_ref1"],
                "tax_year": ["taxyear"],
                "owner_city": ["mailing_city"],
                "owner_state": ["mailing_state"],
                "owner_zip": ["mailing_zip"],
            },
            parse_description=True,
        ),
        County(
            "lincoln_county_wy",
            {
                "parcel_id": ["PIN"],
                "owner_name": ["OWNERSHIP"],
                "physical_address": ["Address"],
                "mailing_address": ["MAIL_ADD"],
                "acreage": ["GR_ACRE"],
                "property_value": ["value", "property_value", "assessed_value"],
                "land_type_description": ["Description"],
                "deed_reference": ["deed", "deed_reference", "deed_ref"],
                "tax_year": ["tax_year", "year"],
                **_OWNER_PLACE,
            },
            {
                "property_details": Link("https://propertydetails.lcwy.org/Home/Detail/", "RWACCT"),
                # This county's tax site wants the account with two leading zeros.
                "tax_details": Link(
                    "https://itax.tylertech.com/LincolnWY/detail.aspx?taxid=", "RWACCT", "00"
                ),
                "clerk_records": Link("https://idocmarket.com/Subscription/Subscribe?county=LINWY1"),
            },
            address_join=("RWACCT", "Account #"),
        ),
        County(
            "sublette_county_wy",
            {
                "parcel_id": ["pidn"],
                "owner_name": ["name"],
                "physical_address": ["st_address"],
                "mailing_address": ["address"],
                "acreage": ["acres_calc"],
                "property_value": ["total_val"],
                "land_type_description": ["accttype"],
                "deed_reference": ["bookpage"],
                "tax_year": ["taxyear"],
                **_OWNER_PLACE,
            },
            {
                "property_details": Link(
                    "https://maps.terragis.net/sublette/mapserver/tabDetail.php?v=2&accountno=",
                    "accountno",
                ),
                "tax_details": Link(
                    "https://maps.terragis.net/sublette/treas/query/search.php?Tax_ID=", "tax_id"
                ),
                "clerk_records": Link(
                    "https://maps.terragis.net/sublette/clerk/query/list.php?pidn=", "pidn"
                ),
            },
        ),
        County(
            "fremont_county_wy",
            {
                "parcel_id": ["pidn"],
                "owner_name": ["ownername"],
                "physical_address": ["st_address"],
                "mailing_address": ["address"],
                "acreage": ["grossacres"],
                "property_value": ["acct_val"],
                "land_type_description": ["accttype"],
                "deed_reference": ["receptno"],
                "tax_year": ["tax_year", "year"],
                **_OWNER_PLACE,
            },
            {
                "property_details": Link(
                    "https://maps.terragis.net/fremontwy/tabDetail.php?v=2&accountno=", "accountno"
                ),
                "tax_details": Link(
                    "https://itax.tylertech.com/FremontWY/detail.aspx?taxid=", "tax_id"
                ),
                "clerk_records": Link(
                    "https://fremontcountywy-recorder.tylerhost.net/recorder/eagleweb/docSearch.jsp"
                ),
            },
        ),
    ]
}

# Layers configured for a county besides ownership.
EXTRA_LAYERS: list[tuple[str, str, str]] = [
    ("teton_county_wy", "conservation_easements", "conservation_easement"),
    ("teton_county_wy", "control_points", "control_points"),
    ("teton_county_wy", "plss", "plss"),
    ("teton_county_wy", "precincts", "precincts"),
    ("teton_county_wy", "roads", "roads"),
    ("teton_county_wy", "zoning", "zoning"),
]


def load_registry(spark: SparkSession, path: str) -> dict[str, County]:
    """Read a registry from a JSON config of the same shape, on any file system of Spark's.

    ``{county: {"ownership": {"standardization_mappings": {...}, "standardized_links": {...}}}}``;
    a county without mappings or links gets empty ones.
    """
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    registry = {}
    for code, layers in raw.items():
        ownership = layers.get("ownership", {})
        known = COUNTIES.get(code)
        links = {}
        for kind, spec in ownership.get("standardized_links", {}).items():
            base = spec.get("static_url") or spec.get("base_url")
            if base is None or ("static_url" not in spec and "field" not in spec):
                continue
            prefix = known.links[kind].value_prefix if known and kind in known.links else ""
            links[kind] = Link(base, spec.get("field"), prefix)
        registry[code] = County(
            code,
            ownership.get("standardization_mappings", {}),
            links,
            parse_description=bool(known and known.parse_description),
            address_join=known.address_join if known else None,
        )
    return registry
