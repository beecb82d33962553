"""Ordered label rules compiled to CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.bind import bind

# Rules of the general pages, label pattern to document field. Order
# decides: the first field with a matching pattern takes the value.
GENERAL_RULES: list[tuple[str, list[str]]] = [
    ("county_parcel_id", ["pidn", "parcel number"]),
    ("tax_id", ["tax id"]),
    ("physical_address", ["street address", "property address", "address"]),
    ("mailing_address", ["mailing address"]),
    ("owner_name", ["owner"]),
    ("tax_district", ["tax district"]),
    ("total_acres", ["total acres", "acres"]),
    ("legal.subdivision", ["subdivision"]),
    ("legal.lot", ["lot"]),
    ("legal.block", ["block"]),
    ("legal.section", ["section"]),
    ("legal.township", ["township"]),
    ("legal.range", ["range"]),
    ("legal.extended", ["extended legal", "extended"]),
    ("value.land", ["land"]),
    ("value.developments", ["improvement", "developments"]),
]

# Rules of the building-table pages.
TABLE_RULES: list[tuple[str, list[str]]] = [
    ("county_parcel_id", ["pidn"]),
    ("tax_id", ["tax id"]),
    ("physical_address", ["street address"]),
    ("mailing_address", ["mailing address"]),
    ("owner_name", ["owner"]),
    ("tax_district", ["tax district"]),
    ("total_acres", ["acres"]),
    ("legal.location", ["location"]),
    ("deed", ["deed"]),
    ("actual_value", ["actual value"]),
    ("total_acres", ["total"]),
    ("acreage.residential", ["residential"]),
    ("acreage.agricultural", ["agricultural"]),
    ("acreage.commercial", ["commercial"]),
    ("acreage.industrial", ["industrial"]),
    ("acreage.other", ["other", "misc", "mixed"]),
]

# Rules of the sectioned pages.
SECTION_RULES: list[tuple[str, list[str]]] = [
    ("county_parcel_id", ["pidn"]),
    ("tax_id", ["tax id"]),
    ("county_parcel_id", ["parcel number"]),
    ("tax_id", ["account number"]),
    ("physical_address", ["property address", "street address"]),
    ("mailing_address", ["mailing address"]),
    ("owner_name", ["owner name", "primary owner"]),
    ("tax_district", ["tax district"]),
    ("total_acres", ["total acres", "acres"]),
    ("legal.location", ["legal description", "extended legal"]),
    ("legal.subdivision", ["subdivision"]),
    ("deed", ["deed"]),
    ("value.land", ["land"]),
    ("value.developments", ["improvement"]),
    ("value.total_value", ["total"]),
    ("acreage.residential", ["residential"]),
    ("acreage.agricultural", ["agricultural"]),
    ("acreage.commercial", ["commercial"]),
    ("acreage.industrial", ["industrial"]),
    ("acreage.other", ["other", "misc", "mixed"]),
]

# Rules of a page's definition lists on the sectioned pages; "=" asks
# for the whole label.
LIST_RULES: list[tuple[str, list[str]]] = [
    ("legal.subdivision", ["=subdivision"]),
    ("legal.lot", ["=lot"]),
    ("legal.block", ["=block"]),
    ("legal.section", ["=section"]),
    ("legal.township", ["=township"]),
    ("legal.range", ["=range"]),
    ("county_parcel_id", ["parcel number"]),
    ("tax_id", ["account number"]),
    ("tax_district", ["tax district"]),
    ("total_acres", ["total acres"]),
]

# Rules of a building's labels: pattern, pattern that must be absent,
# attributes it fills. A "?" attribute is filled only while still empty.
BUILDING_RULES: list[tuple[str, str, list[str]]] = [
    ("heat", "", ["Heat"]),
    ("total sq ft", "", ["Total Sq Ft", "Sq Ft"]),
    ("condo sq ft", "", ["Condo Sq Ft"]),
    ("bsmt sq ft", "fin", ["Bsmt Sq Ft"]),
    ("bsmt fin sq ft", "", ["Bsmt Fin Sq Ft"]),
    ("property type", "", ["Property Type", "Type"]),
    ("built as", "", ["Built As", "?Type"]),
    ("occupancy", "", ["Occupancy", "?Type"]),
    ("roof type", "", ["Roof Type", "Roof Cover"]),
    ("roof cover", "", ["Roof Cover"]),
    ("foundation", "", ["Foundation"]),
    ("year built", "remodel", ["Year Built", "Year Built*"]),
    ("year remodel", "", ["Year Remodel"]),
    ("=rooms", "", ["Rooms"]),
    ("bed rooms", "", ["Bed Rooms", "Bedrooms"]),
    ("=bedrooms", "", ["Bedrooms"]),
    ("bath", "", ["Baths"]),
    ("=units", "", ["Units"]),
    ("unit type", "", ["Unit Type"]),
    ("quality", "", ["Quality"]),
    ("condition", "", ["Condition"]),
    ("class descr", "", ["Class Descr", "Exterior"]),
    ("=exterior", "", ["Exterior"]),
    ("interior", "", ["Interior"]),
    ("stories", "", ["Stories"]),
]

# Attributes of a building on the sectioned pages.
BUILDING_ATTRIBUTES = [
    "Building Name",
    "Building ID",
    "Type",
    "Built As",
    "Property Type",
    "Occupancy",
    "Stories",
    "Total Sq Ft",
    "Sq Ft",
    "Condo Sq Ft",
    "Bsmt Sq Ft",
    "Bsmt Fin Sq Ft",
    "Exterior",
    "Class Descr",
    "Interior",
    "Roof Type",
    "Roof Cover",
    "Foundation",
    "Year Built",
    "Year Built*",
    "Year Remodel",
    "Heat",
    "Rooms",
    "Bed Rooms",
    "Bedrooms",
    "Baths",
    "Units",
    "Unit Type",
    "Quality",
    "Condition",
    "Sketch(s)",
    "Component Type",
]

# Words that class a text span.
ADDRESS_WORDS = ["ST", "DR", "AVE", "ROAD", "STREET", "NORTH", "SOUTH", "EAST", "WEST"]
OWNER_WORDS = ["TRUSTEE", "TRUST", "LLC", "INC", "CORP", "COMPANY"]
STATE_WORDS = ["WY", "WYOMING"]

# Free-text patterns of an address and an owner.
ADDRESS_TEXT = r"(?i)(\d+\s+[A-Z\s]+(?:ST|DR|AVE|ROAD|STREET))"
OWNER_TEXT = r"(?i)([A-Z\s&]+(?:TRUSTEE|TRUST|LLC|INC))"


def hits(label: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches: contained text, or the whole label after ``=``."""
    tests = [
        label == F.lit(p[1:]) if p.startswith("=") else label.contains(p) for p in patterns
    ]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def first_field(label: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Field of the first matching rule, or null."""

    def chain(text: Column) -> Column:
        out = None
        for name, patterns in rules:
            hit = hits(text, patterns)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return bind(label, chain)


def matching_fields(label: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """All fields with a matching rule, in order."""

    def marks(text: Column) -> Column:
        found = [F.when(hits(text, patterns), F.lit(name)) for name, patterns in rules]
        return F.filter(F.array(*found), lambda f: f.isNotNull())

    return bind(label, marks)


def building_targets(label: Column) -> Column:
    """Attributes the first matching building rule fills; null when none matches."""

    def chain(text: Column) -> Column:
        out = None
        for pattern, absent, targets in BUILDING_RULES:
            hit = hits(text, [pattern])
            if absent:
                hit = hit & ~text.contains(absent)
            value = F.array(*[F.lit(t) for t in targets])
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return bind(label, chain)


def _any_word(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def span_class(text: Column) -> Column:
    """Class of a span's text by the first rule that fits; null for the rest.

    ``ST`` is contained in ``TRUST``, so most owners read as addresses. Results must
    keep that.
    """

    def chain(upper: Column) -> Column:
        return (
            F.when(_any_word(upper, ADDRESS_WORDS), "property_address")
            .when(_any_word(upper, OWNER_WORDS), "owner_name")
            .when(upper.endswith("%"), "percent_ownership")
            .when(upper.rlike(r"^[0-9]{5}$"), "zip_code")
            .when(upper.isin(*STATE_WORDS), "state")
        )

    return F.when(F.length(text) > 2, bind(F.upper(text), chain))
