"""Canonical property documents: nested, one row per parcel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions.bind import bind
from lotbook.functions.legal import legal_part
from lotbook.functions.maps import truthy_only
from lotbook.functions.numbers import number_text
from lotbook.functions.text import join_parts
from lotbook.operators.assessor import KEY, acreage_sums
from lotbook.operators.nesting import nest
from lotbook.operators.search_index import dealt_by_folder
from lotbook.operators.skew import dealt

LEGAL_FIELDS = ["subdivision", "lot", "block", "section", "township", "range", "location"]
ACREAGE_FIELDS = ["residential", "agricultural", "commercial", "industrial", "other"]
VALUE_FIELDS = ["total_value", "land", "developments"]
TOP_FIELDS = [
    "county_parcel_id",
    "tax_id",
    "physical_address",
    "mailing_address",
    "owner_name",
    "deed",
    "tax_district",
    "total_acres",
]

# Development label and improvement attribute it shows.
IMPROVEMENT_LABELS = {
    "Building ID": "improvement_number",
    "Property Type": "dwelling_type",
    "Property Address": "property_address",
    "Year Built": "year_built",
    "Effective Year": "effective_year",
    "Stories": "stories",
    "Units": "units",
    "Market Grade": "market_grade",
    "Class": "class",
    "Use Code": "use_code",
    "Bedrooms": "bedrooms",
    "Bathrooms": "bathrooms",
    "Rooms": "rooms",
    "Fireplaces": "fireplaces",
    "Total Sq Ft": "total_sqft",
    "First Floor Sq Ft": "first_floor_sqft",
    "Second Floor Sq Ft": "second_floor_sqft",
    "Basement Sq Ft": "basement_sqft",
    "Attic Sq Ft": "attic_sqft",
    "Garage 1 Sq Ft": "garage1_sqft",
    "Garage 2 Sq Ft": "garage2_sqft",
    "Siding": "siding",
    "Roofing": "roofing",
    "Exterior": "exterior",
    "Interior": "interior",
    "Foundation": "foundation",
    "Floor Cover": "floor_cover",
    "Heating System 1": "heating_system1",
    "Heating System 2": "heating_system2",
    "Heating System 3": "heating_system3",
    "Fuel Gas": "fuel_gas",
    "Fuel Oil": "fuel_oil",
    "Fuel Electric": "fuel_electric",
    "Fuel Solid": "fuel_solid",
    "Improvement Value": "improvement_value",
    "Estimated Value": "estimated_value",
    "Base Cost": "base_cost",
    "Percent Complete": "percent_complete",
    "Conforming": "conforming",
    "Other Improvements Only": "other_improvements_only",
    "Review Year": "review_year",
    "Inspection Date": "inspection_date",
    "Appraiser Initials": "appraiser_initials",
    "Line Number": "line_number",
    "House Number 1": "house_number1",
    "House Number 2": "house_number2",
    "Direction 1": "direction1",
    "Street Name": "street_name",
    "Direction 2": "direction2",
    "Zip Code": "zip_code",
}

# Development label and building-layer attribute it shows.
BUILDING_LABELS = {
    "Building ID": "impno",
    "Account Number": "accountno",
    "Neighborhood": "nbhd",
    "Improvement Value": "impsval",
    "Build Date ID": "builddateid",
    "Parcel Number": "parcelno",
    "Improvement ID": "bltasdetailid",
    "Jurisdiction": "jurisdiction",
    "Property Type": "propertytype",
    "Owner Occupied Flag": "owneroccupiedflag",
    "Occupancy Code": "occcode",
    "Occupancy Description": "occdescription",
    "BLTAS Code": "bltascode",
    "BLTAS Description": "bltasdescription",
    "Square Feet": "sf",
    "Condo Improvement SF": "condoimpsf",
    "Basement SF": "basementsf",
    "Improvement Perimeter": "impperimeter",
    "Improvement Completed %": "impcompletedpct",
    "Improvement Condition Type": "impconditiontype",
    "Improvement Quality": "impquality",
    "HVAC Type": "hvactype",
    "Improvement Exterior": "impexterior",
    "Improvement Interior": "impinterior",
    "Improvement Unit Type": "impunittype",
    "BLTAS Stories": "bltasstories",
    "Sprinkler SF": "sprinklersf",
    "Roof Type": "rooftype",
    "Roof Cover": "roofcover",
    "Floor Cover": "floorcover",
    "BLTAS Foundation": "bltasfoundation",
    "Room Count": "roomcount",
    "Bedroom Count": "bedroomcount",
    "Bath Count": "bathcount",
    "BLTAS Total Unit Count": "bltastotalunitcount",
    "Class Code": "classcode",
    "Class Description": "classdescription",
    "BLTAS Year Built": "bltasyearbuilt",
    "Year Remodeled": "yearremodeled",
    "Remodeled Percent": "remodeledpercent",
    "Adjusted Year Built": "adjustedyearbuilt",
    "Age": "age",
    "Mobile Home Title No": "mhtitleno",
    "Mobile Home Serial No": "mhserialno",
    "Mobile Home Length": "mhlength",
    "Mobile Home Width": "mhwidth",
    "Mobile Home Code": "mhcode",
    "Appraiser": "appraiser",
    "Appraisal Date": "appraisaldate",
    "New Construction Value": "newconstructionvalue",
    "Permit Value Change": "permitvaluechange",
    "Occupancy Percent": "occpercent",
    "Occupancy Abstract": "occabstract",
    "Net SF": "netsf",
    "Last Update Timestamp": "lastupdatetimestamp",
    "Mobile Home Model Name": "mhmodelname",
    "Mobile Home Total Length": "mhtotallength",
    "Mobile Home Decal No": "mhdecalno",
    "Mobile Home Tag No": "mhtagno",
    "Neighborhood Extension": "nbhdextension",
    "Total Unfinished SF": "totalunfinishedsf",
    "Total Finished SF": "totalfinishedsf",
    "Cost RCN": "costrcn",
    "Cost RCNLD": "costrcnld",
    "Detail Unit Count": "detailunitcount",
    "Improvement Detail Description": "impdetaildescription",
    "Improvement Detail Type": "impdetailtype",
}


def labelled(labels: dict[str, str], value_of) -> Column:
    """Label map of a record's attributes; null and empty ones are left out."""
    pairs = []
    for label, attribute in labels.items():
        pairs += [F.lit(label), value_of(attribute)]
    return truthy_only(F.create_map(*pairs))


def canonical(columns: dict[str, Column]) -> list[Column]:
    """The document's columns in order: given values over the empty skeleton.

    Keys are top fields, ``legal.x``, ``acreage.x``, ``value.x`` and ``developments``.
    """

    def text(name: str) -> Column:
        given = columns.get(name)
        value = F.lit("") if given is None else F.coalesce(given.cast("string"), F.lit(""))
        return value

    def acres(name: str) -> Column:
        given = columns.get(f"acreage.{name}")
        return F.lit(0.0) if given is None else F.coalesce(given.cast("double"), F.lit(0.0))

    top = {name: text(name).alias(name) for name in TOP_FIELDS}
    legal = F.struct(*[text(f"legal.{n}").alias(n) for n in LEGAL_FIELDS]).alias("legal")
    acreage = F.struct(*[acres(n).alias(n) for n in ACREAGE_FIELDS]).alias("acreage_breakdown")
    values = F.struct(*[text(f"value.{n}").alias(n) for n in VALUE_FIELDS]).alias("value_summary")
    none = F.expr("cast(array() as array<map<string,string>>)")
    given = columns.get("developments")
    developments = none if given is None else F.coalesce(given, none)
    first = TOP_FIELDS[: TOP_FIELDS.index("tax_district")]
    rest = TOP_FIELDS[TOP_FIELDS.index("tax_district") :]
    return [
        *[top[n] for n in first],
        legal,
        *[top[n] for n in rest],
        acreage,
        values,
        developments.alias("developments"),
    ]


def _items(name: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(name)), lambda s: s["item"])


def _newest_first(name: str) -> Column:
    """Items by ``sort`` descending, missing ones last, ties by ``tie`` ascending."""

    def order(a: Column, b: Column) -> Column:
        later = a["sort"].isNotNull() & (b["sort"].isNull() | (a["sort"] > b["sort"]))
        sooner = b["sort"].isNotNull() & (a["sort"].isNull() | (b["sort"] > a["sort"]))
        return (
            F.when(later, -1)
            .when(sooner, 1)
            .when(a["tie"] < b["tie"], -1)
            .when(a["tie"] > b["tie"], 1)
            .otherwise(0)
        )

    return F.transform(F.array_sort(F.collect_list(name), order), lambda s: s["item"])


def assessor_documents(
    tables: dict[str, DataFrame], by_folder: bool = False
) -> DataFrame:
    """Documents from the six assessor tables, each with a row position ``ord``.

    The first legal row is found per parcel first. Then parcels and all four kinds of
    children meet in one union and one shuffle, instead of a chain of joins whose child
    rows would multiply; acreage is summed where the land records are listed. A parcel
    is one document with all its children in total order, however many it has.
    ``by_folder`` deals the rows so that ``lookup.write_documents`` finds the documents of a
    folder in few tasks and need not shuffle them.
    """
    legal = tables["legal_descriptions"]
    lines = F.array_join(
        F.filter(F.array(*[f"legal_line{i}" for i in range(1, 7)]), lambda s: s != ""), " "
    )
    first_legal = legal.groupBy(KEY).agg(F.min_by(lines, F.col("ord")).alias("_location"))
    header = tables["parcels"].join(first_legal, KEY, "left")

    improvements = tables["improvements"]
    shown = [c for c in improvements.columns if c in IMPROVEMENT_LABELS.values()]
    kinds = {
        "improvement": (
            improvements,
            F.struct(
                F.col("improvement_number").alias("sort"),
                F.col("ord").alias("tie"),
                F.struct(*[F.col(c).cast("string").alias(c) for c in shown]).alias("item"),
            ),
        ),
        "land": (
            tables["land_records"],
            F.struct(
                F.col("land_category").alias("sort"),
                F.col("ord").alias("tie"),
                F.struct(
                    "land_category",
                    "land_quantity",
                    "land_unit",
                    "land_value",
                    "land_location",
                    "land_class",
                    "land_type",
                ).alias("item"),
            ),
        ),
        "sale": (
            tables["sales"],
            F.struct(
                F.col("sale_date").alias("sort"),
                F.col("ord").alias("tie"),
                F.struct(
                    "sale_date", "valid_sale", "sale_price", "personal_property_included"
                ).alias("item"),
            ),
        ),
        "permit": (
            tables["permits"],
            F.struct(
                F.col("permit_filing_date").alias("sort"),
                F.col("ord").alias("tie"),
                F.struct(
                    "permit_ref_number", "permit_filing_date", "permit_description", "permit_type"
                ).alias("item"),
            ),
        ),
    }
    children = None
    for name, (table, item) in kinds.items():
        rows = table.select(KEY, item.alias(name))
        children = rows if children is None else children.unionByName(rows, allowMissingColumns=True)

    head = header.select(
        KEY, F.struct(*[c for c in header.columns if c != KEY]).alias("header")
    )
    # Lists gain nothing from a first pass where the rows lie: it would sort a scan task's whole
    # share of wide rows. Dealt by key first, a task sorts its own parcels alone.
    rows = children.unionByName(head, allowMissingColumns=True)
    placed, keys = (dealt_by_folder(rows, KEY), ["_part", KEY]) if by_folder else (dealt(rows, KEY), [KEY])
    land = F.col("land.item")
    nested = (
        placed.groupBy(*keys)
        .agg(
            F.first("header", ignorenulls=True).alias("h"),
            *acreage_sums(land["land_category"], land["land_quantity"]),
            _items("improvement").alias("improvements"),
            _items("land").alias("detailed_land_records"),
            _newest_first("sale").alias("sales_history"),
            _newest_first("permit").alias("building_permits"),
        )
        # Children of unknown parcels have no document.
        .where(F.col("h").isNotNull())
    )
    developments = F.transform(
        "improvements",
        lambda s: labelled(
            {k: v for k, v in IMPROVEMENT_LABELS.items() if v in shown}, lambda a: s[a]
        ),
    )
    h = F.col("h")
    columns = {
        "county_parcel_id": F.col(KEY),
        "tax_id": h["deed_reference1"],
        "physical_address": h["physical_address"],
        "mailing_address": join_parts(
            [
                h["mailing_address_line1"],
                h["mailing_address_line2"],
                h["mailing_city"],
                h["mailing_state"],
                h["mailing_zip"],
            ],
            ", ",
        ),
        "owner_name": h["owner_name"],
        "deed": join_parts([h[f"deed_reference{i}"] for i in range(1, 6)], "; "),
        "tax_district": h["tax_district"],
        "total_acres": number_text(h["total_acres"]),
        "legal.location": h["_location"],
        "value.total_value": number_text(h["total_value"]),
        "value.land": number_text(h["land_value"]),
        "value.developments": number_text(h["improvement_value"]),
        "developments": developments,
        **{f"acreage.{n}": F.col(n) for n in ACREAGE_FIELDS},
    }
    return nested.select(
        *canonical(columns),
        "detailed_land_records",
        "sales_history",
        "building_permits",
    )


# The first land-type word found decides the acreage field.
LAND_TYPE_WORDS = ["residential", "agricultural", "commercial", "industrial"]


def land_type_field(land_type: Column) -> Column:
    out = None
    low = F.lower(F.coalesce(land_type, F.lit("")))
    for word in LAND_TYPE_WORDS:
        hit = low.contains(word)
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise("other")


def layer_documents(parcels: DataFrame, buildings: DataFrame, land: DataFrame) -> DataFrame:
    """Documents from layer responses ``accountno, ord, attributes`` of three layers.

    The first parcel and land rows represent the account; every building is kept.
    """

    def first_of(df: DataFrame, into: str) -> DataFrame:
        return df.groupBy("accountno").agg(F.min_by("attributes", "ord").alias(into))

    nested = nest(
        buildings,
        ["accountno"],
        "ord",
        F.map_entries("attributes"),
        into="buildings",
    )
    spine = (
        first_of(parcels, "p")
        .join(first_of(land, "l"), "accountno", "left")
        .join(nested, "accountno", "left")
    )

    def p(name: str) -> Column:
        return F.try_element_at(F.col("p"), F.lit(name))

    land_type = F.try_element_at(F.col("l"), F.lit("landtype"))
    acres = F.try_element_at(F.col("l"), F.lit("landacres")).try_cast("double")
    field = land_type_field(land_type)

    def building(entries: Column) -> Column:
        return bind(
            F.map_from_entries(entries),
            lambda m: labelled(BUILDING_LABELS, lambda a: F.try_element_at(m, F.lit(a))),
        )

    columns = {
        "county_parcel_id": p("pidn"),
        "tax_id": p("tax_id"),
        "physical_address": p("st_address"),
        "mailing_address": join_parts(
            [p("address"), p("address2"), p("owner_city"), p("owner_state"), p("owner_zip")], ", "
        ),
        "owner_name": p("owner"),
        "deed": p("deed"),
        "tax_district": p("tax_dist"),
        "total_acres": p("area_tax"),
        "legal.lot": p("lot"),
        "legal.location": p("descript"),
        **{
            f"legal.{n}": legal_part(p("descript"), n)
            for n in ["subdivision", "block", "section", "township", "range"]
        },
        "value.total_value": p("acctval"),
        "value.land": p("landval"),
        "value.developments": p("impsval"),
        "developments": F.transform("buildings", building),
        **{f"acreage.{n}": F.when(field == n, acres) for n in ACREAGE_FIELDS},
    }
    return spine.select("accountno", *canonical(columns))
