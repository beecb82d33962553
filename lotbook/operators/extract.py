"""Pages to canonical documents, one rule set per route.

Every rule set ends in assignments ``page_id, pos, field, value``. The last
assignment of a field wins, found by ``max_by`` with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.functions.bind import bind
from lotbook.functions.numbers import money_before, money_total, number_text, numeric_or_text
from lotbook.functions.text import collapse, label_key, truthy
from lotbook.functions.urls import (
    account_of_url,
    extraction_route,
    parcel_of_url,
    record_domain,
)
from lotbook.operators import page_blocks as B
from lotbook.operators.documents import (
    ACREAGE_FIELDS,
    LEGAL_FIELDS,
    TOP_FIELDS,
    VALUE_FIELDS,
    canonical,
)
from lotbook.operators.labels import (
    ADDRESS_TEXT,
    BUILDING_ATTRIBUTES,
    GENERAL_RULES,
    LIST_RULES,
    OWNER_TEXT,
    SECTION_RULES,
    TABLE_RULES,
    building_targets,
    first_field,
    hits,
    matching_fields,
)
from lotbook.operators.skew import salted_join

# Order in which the sources of a page are read; later ones overwrite.
TABLES, LISTS, SPANS, DIVS, STRONGS, PARAGRAPHS = range(6)

ALL_FIELDS = [
    *TOP_FIELDS,
    *[f"legal.{n}" for n in [*LEGAL_FIELDS, "extended"]],
    *[f"acreage.{n}" for n in ACREAGE_FIELDS],
    *[f"value.{n}" for n in VALUE_FIELDS],
]


def _position(*parts) -> Column:
    """Comparable position of an assignment inside its page."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.struct(*[c.cast("int").alias(f"p{i}") for i, c in enumerate(columns)])


def _assignments(df: DataFrame, field: Column, value: Column, *pos) -> DataFrame:
    padded = [*pos, *[0] * (4 - len(pos))]
    return df.select(
        "page_id", _position(*padded).alias("pos"), field.alias("field"), value.alias("value")
    ).where(F.col("field").isNotNull())


def last_values(assignments: DataFrame) -> DataFrame:
    """``page_id, values``: last value of each field, one map per page."""
    return _value_maps(
        B.by_page(assignments)
        .groupBy("page_id", "field")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def settled_values(assignments: DataFrame) -> DataFrame:
    """Like ``last_values``, but values of the ``DIVS`` source are guesses.

    A guess counts only where the sources before it left nothing; later sources
    overwrite as usual.
    """
    source = F.col("pos.p0")

    def last_of(condition: Column) -> Column:
        return F.max_by("value", F.when(condition, F.col("pos")))

    found = (
        B.by_page(assignments)
        .groupBy("page_id", "field")
        .agg(
            last_of(source < DIVS).alias("early"),
            last_of(source == DIVS).alias("guess"),
            last_of(source > DIVS).alias("late"),
        )
    )
    value = F.coalesce("late", F.when(truthy("early"), F.col("early")), "guess", "early")
    return _value_maps(found.select("page_id", "field", value.alias("value")))


def _value_maps(last: DataFrame) -> DataFrame:
    return last.groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("values")
    )


def documents_of(
    values: DataFrame, developments: DataFrame | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Canonical documents from value maps; acreage that is no number stays as text."""
    out = values
    if developments is not None:
        out = out.join(developments, "page_id", "full_outer")
    if pages is not None:
        out = pages.select("page_id").join(out, "page_id", "left")

    def value(name: str) -> Column:
        return F.try_element_at(F.col("values"), F.lit(name))

    columns = {name: value(name) for name in ALL_FIELDS}
    for name in ACREAGE_FIELDS:
        columns[f"acreage.{name}"] = numeric_or_text(value(f"acreage.{name}"))
    if developments is not None:
        columns["developments"] = F.col("developments")
    texts = []
    for name in ACREAGE_FIELDS:
        text = value(f"acreage.{name}")
        texts += [F.lit(name), F.when(numeric_or_text(text).isNull(), text)]
    return out.select(
        "page_id",
        *canonical(columns),
        F.coalesce(value("legal.extended"), F.lit("")).alias("legal_extended"),
        F.map_filter(F.create_map(*texts), lambda k, v: v.isNotNull()).alias("acreage_text"),
    )


def _developments(rows: DataFrame, order: list[str], item: Column) -> DataFrame:
    """One development list per page; maps travel as entry arrays, which can be sorted."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.map_entries(item).alias("entries"))))
    return rows.groupBy("page_id").agg(
        F.transform(packed, lambda s: F.map_from_entries(s["entries"])).alias("developments")
    )


def _span_assignments(elements: DataFrame) -> DataFrame:
    spans = B.span_fields(elements)
    field = F.when(F.col("class") == "property_address", "physical_address").when(
        F.col("class") == "owner_name", "owner_name"
    )
    return _assignments(spans, field, F.col("value"), SPANS)


# ---------------------------------------------------------------- general pages

# Labels that start a development section.
SECTION_STARTS = ["building id", "residential", "out building", "development", "building_id"]

# Label patterns of a development's fields.
DEVELOPMENT_FIELDS = [
    ("building_id", ["building id", "building_id"]),
    ("type", ["residential", "type", "out building", "development"]),
    ("year_built", ["year built"]),
    ("sq_ft", ["sq ft"]),
    ("bedrooms", ["bedroom"]),
    ("baths", ["bath"]),
]
DEVELOPMENT_ATTRIBUTES = ["year_built", "sq_ft", "bedrooms", "baths"]


def general_rows(elements: DataFrame) -> DataFrame:
    """Rows of all tables and lists in reading order with their development segment.

    Segment 0 is before the first section start; a started section takes all later
    rows of the page.
    """
    tables = B.keyed_rows(B.table_rows(elements)).select(
        "page_id", F.lit(TABLES).alias("source"), "block", "row", "pairs"
    )
    items = F.sort_array(F.collect_list(F.struct("cell", B.pair(F.col("key"), F.col("value")).alias("p"))))
    lists = (
        B.list_pairs(elements)
        .groupBy("page_id", "block")
        .agg(F.transform(items, lambda s: s["p"]).alias("pairs"))
        .select("page_id", F.lit(LISTS).alias("source"), "block", F.lit(0).alias("row"), "pairs")
    )
    rows = tables.unionByName(lists)
    starts = F.exists("pairs", lambda p: label_key(p["key"]).isin(*SECTION_STARTS))
    order = Window.partitionBy("page_id").orderBy("source", "block", "row")
    return rows.withColumn("segment", F.sum(starts.cast("int")).over(order))


def _general_top(rows: DataFrame) -> DataFrame:
    """Assignments of value rows and of all rows before any development section.

    Once a pair of a row has matched, later pairs of that row are only tested
    against the first rule. A value row (``Value Type``) counts as matched.
    """

    def value_of(key: str) -> Column:
        found = F.filter("pairs", lambda p: p["key"] == F.lit(key))
        return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])

    kind, amount = F.lower(value_of("Value Type")), value_of("Appraised Value")
    value_field = F.when(
        truthy(kind) & truthy(amount),
        F.when(kind.contains("land"), "value.land").when(
            kind.contains("improvement"), "value.developments"
        ),
    )
    fields = F.transform("pairs", lambda p: first_field(label_key(p["key"]), GENERAL_RULES))
    prepared = rows.withColumns({"value_field": value_field, "amount": amount, "fields": fields})
    first_hit = F.when(F.col("value_field").isNotNull(), -1).otherwise(
        F.array_position(F.transform("fields", lambda f: f.isNotNull()), True) - 1
    )
    prepared = prepared.withColumn("first_hit", first_hit)
    values = _assignments(
        prepared, F.col("value_field"), F.col("amount"), F.col("source"), F.col("block"), F.col("row"), -1
    )
    each = prepared.where(F.col("segment") == 0).select(
        "page_id", "source", "block", "row", "fields", "first_hit", F.posexplode("pairs").alias("i", "p")
    )
    label = label_key(F.col("p.key"))
    none_hit = (F.col("first_hit") == -1) & F.forall("fields", lambda f: f.isNull())
    # array_position gives 0 for no hit, hence -1 above; -1 with a value row means all
    # pairs come after the match.
    after = (F.col("i") > F.col("first_hit")) & ~none_hit
    field = F.when(
        after, F.when(hits(label, GENERAL_RULES[0][1]), GENERAL_RULES[0][0])
    ).otherwise(F.get("fields", F.col("i")))
    pairs = _assignments(
        each, field, F.col("p.value"), F.col("source"), F.col("block"), F.col("row"), F.col("i")
    )
    return values.unionByName(pairs)


def _general_developments(rows: DataFrame) -> DataFrame:
    each = rows.where(F.col("segment") > 0).select(
        "page_id", "segment", "source", "block", "row", F.posexplode("pairs").alias("i", "p")
    )
    label, value = label_key(F.col("p.key")), F.col("p.value")
    pos = _position(F.col("source"), F.col("block"), F.col("row"), F.col("i"))
    last = [
        F.max_by(value, F.when(hits(label, patterns), pos)).alias(name)
        for name, patterns in DEVELOPMENT_FIELDS
    ]
    built = each.groupBy("page_id", "segment").agg(*last)
    any_attribute = F.lit(False)
    for name in DEVELOPMENT_ATTRIBUTES:
        any_attribute = any_attribute | truthy(name)
    names = [name for name, _ in DEVELOPMENT_FIELDS]
    flat = []
    for name in names:
        flat += [F.lit(name), F.col(name)]
    item = F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())
    return _developments(built.where(any_attribute), ["segment"], item)


def general_documents(elements: DataFrame) -> DataFrame:
    """Documents of pages without a rule set of their own."""
    rows = general_rows(elements)
    strongs = (
        elements.where(
            (F.col("kind") == "strong") & (F.length("text") > 2) & truthy("extra")
        )
        .groupBy("page_id", "text")
        .agg(F.max_by("extra", "seq").alias("value"), F.min("seq").alias("seq"))
        .select(
            "page_id",
            "seq",
            "value",
            F.explode(matching_fields(label_key("text"), GENERAL_RULES)).alias("field"),
        )
    )
    paragraphs = elements.where(
        (F.col("kind") == "p")
        & (F.length("text") > 10)
        & F.upper("text").rlike("EXTENDED LEGAL|LEGAL DESCRIPTION")
    )
    early = _general_top(rows).unionByName(_span_assignments(elements))
    late = _assignments(strongs, F.col("field"), F.col("value"), STRONGS, F.col("seq")).unionByName(
        _assignments(
            paragraphs, F.lit("legal.extended"), F.col("text"), PARAGRAPHS, F.col("seq")
        )
    )
    guesses = _guess_assignments(elements)
    values = settled_values(early.unionByName(guesses).unionByName(late))
    return documents_of(values, _general_developments(rows))


def free_text_sections(elements: DataFrame) -> DataFrame:
    """``page_id, address_section, owner_section``: last box text that mentions either."""
    text = F.col("text")
    classes = F.split("classes", " ")
    wanted = F.arrays_overlap(classes, F.array(*[F.lit(c) for c in ["ibox-content", "col-6", "col"]]))
    boxes = elements.where((F.col("kind") == "div") & wanted & (F.length(text) > 10))
    address = F.upper(text).rlike("STREET|ADDRESS|ROAD")
    owner = ~address & F.upper(text).rlike("OWNER|TRUSTEE|TRUST")
    return boxes.groupBy("page_id").agg(
        F.max_by(text, F.when(address, F.col("seq"))).alias("address_section"),
        F.max_by(text, F.when(owner, F.col("seq"))).alias("owner_section"),
    )


def _guess_assignments(elements: DataFrame) -> DataFrame:
    """Address and owner read from free text."""
    address = F.trim(F.regexp_extract("address_section", ADDRESS_TEXT, 1))
    owner = F.trim(F.regexp_extract("owner_section", OWNER_TEXT, 1))
    guesses = F.array(
        F.struct(F.lit("physical_address").alias("field"), address.alias("value")),
        F.struct(F.lit("owner_name").alias("field"), owner.alias("value")),
    )
    guessed = free_text_sections(elements).select("page_id", F.explode(guesses).alias("g"))
    return _assignments(
        guessed.where(truthy("g.value")), F.col("g.field"), F.col("g.value"), DIVS
    )


# ---------------------------------------------------------------- building-table pages


def two_pass(pairs: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Pairs with ``field`` and its ``shown`` value: key as label, else value as label."""
    by_key = first_field(label_key("key"), rules)
    by_value = first_field(label_key("value"), rules)
    return pairs.withColumns(
        {
            "field": F.coalesce(by_key, by_value),
            "shown": F.when(by_key.isNotNull(), F.col("value")).otherwise(F.col("key")),
        }
    )


def table_documents(elements: DataFrame) -> DataFrame:
    """Documents of pages built from regular and building tables."""
    rows = B.building_tables(B.table_rows(elements))
    regular = B.plain_rows(rows.where(~F.col("is_building")))
    matched = two_pass(
        regular.where((F.col("kind") != "note") & (F.col("key") != "note")), TABLE_RULES
    )
    shown = F.col("shown")
    is_value = F.col("field") == "actual_value"
    split_values = F.array(
        F.struct(F.lit("value.total_value").alias("field"), money_total(shown).alias("value")),
        F.struct(F.lit("value.land").alias("field"), money_before(shown, "Land").alias("value")),
        F.struct(
            F.lit("value.developments").alias("field"),
            money_before(shown, "Improvements").alias("value"),
        ),
    )
    plain = F.array(F.struct(F.col("field").alias("field"), shown.alias("value")))
    items = F.when(is_value, F.filter(split_values, lambda v: v["value"] != "")).otherwise(plain)
    exploded = matched.where(F.col("field").isNotNull()).select(
        "page_id", "block", "row", F.explode(items).alias("a")
    )
    fields = _assignments(
        exploded, F.col("a.field"), F.col("a.value"), TABLES, F.col("block"), F.col("row")
    )
    values = last_values(fields.unionByName(_span_assignments(elements)))
    built = B.building_developments(rows.where(F.col("is_building")))
    return documents_of(
        values, _developments(built, ["block", "segment", "position"], F.col("development"))
    )


# ---------------------------------------------------------------- sectioned pages


def building_blocks(elements: DataFrame) -> DataFrame:
    """``page_id, building, attributes``: buildings headed "Building ID n" with their lists.

    The content box that follows a building's heading holds its definition lists.
    """
    text = F.lower(collapse("text"))
    heads = elements.where((F.col("kind") == "h4") & text.contains("building id")).select(
        "page_id",
        "seq",
        F.lit(True).alias("is_head"),
        F.regexp_extract(text, r"building id\s*(\d+)", 1).alias("number"),
    )
    boxes = elements.where(
        (F.col("kind") == "div") & F.array_contains(F.split("classes", " "), "ibox-content")
    ).select("page_id", "seq", F.lit(False).alias("is_head"), F.lit("").alias("number"))
    order = Window.partitionBy("page_id").orderBy("seq")
    placed = (
        heads.unionByName(boxes)
        .withColumn("building", F.sum(F.col("is_head").cast("int")).over(order))
        .where(F.col("building") > 0)
    )
    buildings = placed.groupBy("page_id", "building").agg(
        F.max(F.when(F.col("is_head"), F.col("number"))).alias("number"),
        F.min(F.when(~F.col("is_head"), F.col("seq"))).alias("content"),
    )
    pairs = B.list_pairs(elements).where((F.col("key") != "") & (F.col("value") != ""))
    filled = (
        buildings.join(pairs, ["page_id", "content"])
        .withColumn("target", F.explode(building_targets(F.lower("key"))))
        .withColumns(
            {
                "attribute": F.ltrim(F.col("target"), F.lit("?")),
                "weak": F.col("target").startswith("?"),
            }
        )
    )
    # A weak value only fills an empty attribute: the first weak one counts, and any
    # plain assignment beats it.
    rank = F.struct(
        (~F.col("weak")).alias("plain"), F.when(F.col("weak"), -F.col("seq")).otherwise(F.col("seq"))
    )
    best = filled.groupBy("page_id", "building", "attribute").agg(
        F.max_by("value", rank).alias("value")
    )
    listed = best.groupBy("page_id", "building").agg(
        F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("found")
    )
    number = F.when(F.col("number") != "", F.col("number")).otherwise("Unknown")
    fixed = {
        "Building Name": F.concat(F.lit("Building "), number),
        "Building ID": number,
        "Component Type": F.lit("Main Building"),
    }
    # One loop over the names, the map bound once: an expression per name took three times as long.
    given = F.create_map(*[part for name, value in fixed.items() for part in (F.lit(name), value)])
    others = F.map_filter("found", lambda k, v: ~k.isin(*fixed))
    names = F.array(*[F.lit(name) for name in BUILDING_ATTRIBUTES])
    attributes = bind(
        F.coalesce(F.map_concat(others, given), given),
        lambda known: F.map_from_arrays(
            names, F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n), F.lit("")))
        ),
    )
    return buildings.join(listed, ["page_id", "building"], "left").select(
        "page_id", "building", attributes.alias("attributes")
    )


def section_documents(elements: DataFrame) -> DataFrame:
    """Documents of pages built from headed sections, lists and a value table."""
    rollup = B.value_rollup(B.table_rows(elements, via=None))
    money = rollup.select(
        "page_id",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("key"), number_text(column).alias("value"), F.lit(i).alias("i")
                    )
                    for i, (label, column) in enumerate(
                        [("Land", "land"), ("Improvement", "improvements"), ("Total", "total")]
                    )
                ]
            )
        ).alias("m"),
    ).select("page_id", "m.key", "m.value", "m.i")
    matched = two_pass(money, SECTION_RULES)
    tables = _assignments(matched, F.col("field"), F.col("shown"), 0, F.col("i"))
    spans = _span_assignments(elements)
    divs = _assignments(B.section_fields(elements), F.col("field"), F.col("value"), DIVS)
    by_label = (
        B.list_pairs(elements)
        .where((F.col("key") != "") & (F.col("value") != ""))
        .groupBy("page_id", "key")
        .agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    )
    field = first_field(label_key("key"), LIST_RULES)
    account = F.regexp_extract("value", r"([A-Z0-9]+)", 1)
    value = F.when(field == "tax_id", F.when(account != "", account)).otherwise(F.col("value"))
    lists = _assignments(by_label, field, value, STRONGS, F.col("seq")).where(
        F.col("value").isNotNull()
    )
    values = last_values(
        tables.unionByName(spans).unionByName(divs).unionByName(lists)
    )
    built = _developments(building_blocks(elements), ["building"], F.col("attributes"))
    return documents_of(values, built)


# ---------------------------------------------------------------- routes


def routed(requests: DataFrame) -> DataFrame:
    """Page requests ``page_id, url, county`` with their ``route``."""
    return requests.withColumn("route", extraction_route("url", "county"))


PAGE_ROUTES = {
    "general": general_documents,
    "greenwood": table_documents,
    "lincoln": section_documents,
}


def routed_elements(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Element rows with their page's ``route``; store these to extract several routes."""
    return elements.join(routed(requests).select("page_id", "route"), "page_id")


def extract_documents(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents of all page routes in one plan: each page goes through its route's rules.

    ``elements`` comes from ``routed_elements``. Requests of the two account routes are
    answered from tables (``documents``). A page that yields nothing still gets an
    empty document.
    """
    routes = routed(requests).select("page_id", "route")
    docs = None
    for route, build in PAGE_ROUTES.items():
        part = build(elements.where(F.col("route") == route))
        docs = part if docs is None else docs.unionByName(part)
    return routes.where(F.col("route").isin(*PAGE_ROUTES)).join(docs, "page_id", "left")


def scrape_requests(requests: DataFrame) -> DataFrame:
    """``county, links`` requests split into what each part needs.

    ``tax_domain`` and ``clerk_domain`` are the sites that answer, null when the
    request names none or an unsupported one; ``details_route`` is the rule set.
    """
    def link(name: str) -> Column:
        return F.try_element_at(F.col("links"), F.lit(name))

    details = link("property_details")
    return requests.select(
        "*",
        record_domain(link("tax"), "county").alias("tax_domain"),
        record_domain(link("clerk"), "county").alias("clerk_domain"),
        F.when(truthy(details), extraction_route(details, "county")).alias("details_route"),
    )


DOCUMENT_COLUMNS = [
    "county_parcel_id",
    "tax_id",
    "physical_address",
    "mailing_address",
    "owner_name",
    "deed",
    "legal",
    "tax_district",
    "total_acres",
    "acreage_breakdown",
    "value_summary",
    "developments",
]


def answer_requests(
    requests: DataFrame,
    page_documents: DataFrame,
    parcel_documents: DataFrame,
    account_documents: DataFrame,
) -> DataFrame:
    """``county, links`` requests (with ``request_id``) and their document, if any.

    The route decides where the document comes from: the saved page of the link
    (``page_documents`` with ``url``), the assessor tables by parcel id, or the layer
    responses by account. All documents meet in one keyed union and one join; links
    asked for very often are salted. A request without an answer keeps a null
    document.
    """
    split = scrape_requests(requests)
    url = F.try_element_at(F.col("links"), F.lit("property_details"))
    route = F.col("details_route")
    key = (
        F.when(route == "teton_idaho", F.concat(F.lit("parcel:"), parcel_of_url(url)))
        .when(route == "teton", F.concat(F.lit("account:"), account_of_url(url)))
        .when(route.isNotNull(), F.concat(F.lit("page:"), url))
    )

    def keyed(documents: DataFrame, kind: str, by: str) -> DataFrame:
        return documents.select(
            F.concat(F.lit(f"{kind}:"), F.col(by)).alias("_key"),
            F.struct(*DOCUMENT_COLUMNS).alias("document"),
        )

    # Of several saved pages of one address the last answers: one answer per request.
    last = page_documents.groupBy("url").agg(
        F.max_by(F.struct(*DOCUMENT_COLUMNS), "page_id").alias("_last")
    )
    found = (
        keyed(last.select("url", "_last.*"), "page", "url")
        .unionByName(keyed(parcel_documents, "parcel", "county_parcel_id"))
        .unionByName(keyed(account_documents, "account", "accountno"))
    )
    return salted_join(split.withColumn("_key", key), found, "_key", "left", "request_id").drop("_key")
