"""Tables, lists, spans and sections of a page as relations.

Input is the element rows of ``sources.pages``. Windows and groups are keyed by
page, whose rows are bounded by the page's own size. A relation first keeps its own
kinds and columns and is then placed by page: its later windows and groups all start
with the page and reuse that one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.functions.maps import map_of_pairs
from lotbook.functions.numbers import money_value
from lotbook.functions.text import collapse
from lotbook.operators.labels import span_class

_PAIR = "struct<key: string, value: string>"


def by_page(df: DataFrame) -> DataFrame:
    return df.repartition("page_id")


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def table_rows(elements: DataFrame, via: str | None = "table") -> DataFrame:
    """``page_id, block, row, via, cells, divider, header``: one row per table row.

    Only cells directly under a row directly under its table count by default, so
    nested tables do not mix; ``via=None`` keeps rows of table sections as well.
    """
    rows = elements.where(F.col("kind").isin("tr", "td", "th"))
    if via is not None:
        rows = rows.where(F.col("via") == via)
    rows = by_page(rows.select("page_id", "kind", "block", "via", "row", "cell", "classes", "text"))
    is_cell = F.col("kind") != "tr"
    grouped = rows.groupBy("page_id", "block", "via", "row").agg(
        F.sort_array(
            F.collect_list(F.when(is_cell, F.struct("cell", collapse("text").alias("text"))))
        ).alias("cells"),
        F.max(F.when(~is_cell, F.col("classes"))).alias("classes"),
        F.bool_or(F.col("kind") == "th").alias("has_th"),
    )
    classes = F.split(F.coalesce("classes", F.lit("")), " ")
    many_first = (F.col("row") == 0) & (F.size("cells") > 2)
    return grouped.select(
        "page_id",
        "block",
        "via",
        "row",
        F.transform("cells", lambda c: c["text"]).alias("cells"),
        F.array_contains(classes, "divider").alias("divider"),
        (many_first | F.array_contains(classes, "toprow") | F.col("has_th")).alias("header"),
    )


def keyed_rows(rows: DataFrame) -> DataFrame:
    """General table rows as key-value pairs: ``page_id, block, row, kind, pairs``.

    The last header row names the cells of later rows of its width; other rows are a
    key with its value, a note, or plain values. Header rows are not returned.
    """
    order = Window.partitionBy("page_id", "block").orderBy("row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    header = F.last(F.when(F.col("header"), F.col("cells")), ignorenulls=True).over(before)
    cells, n = F.col("cells"), F.size("cells")
    named = F.zip_with("names", cells, pair)
    kind = (
        F.when((F.size("names") > 0) & (F.size("names") == n), "data")
        .when(n == 2, "pair")
        .when(n == 1, "note")
        .when(n > 2, "values")
    )
    pairs = (
        F.when(F.col("kind") == "data", named)
        .when(F.col("kind") == "pair", F.array(pair(F.get(cells, F.lit(0)), F.get(cells, F.lit(1)))))
        .when(F.col("kind") == "note", F.array(pair(F.lit("note"), F.get(cells, F.lit(0)))))
        .when(
            F.col("kind") == "values", F.array(pair(F.lit("values"), F.array_join(cells, " ")))
        )
    )
    return (
        rows.withColumn("names", header)
        .where(~F.col("header"))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("page_id", "block", "row", "kind", pairs.alias("pairs"))
    )


def plain_rows(rows: DataFrame) -> DataFrame:
    """Rows of a regular table: pair, note, or the last cell naming the first."""
    cells, n = F.col("cells"), F.size("cells")
    first = F.get(cells, F.lit(0))
    key = (
        F.when(n == 1, F.lit("note")).when(n == 2, first).when(n > 2, F.element_at(cells, -1))
    )
    value = F.when(n == 2, F.get(cells, F.lit(1))).otherwise(first)
    kind = F.when(n == 1, "note").when(n == 2, "pair").otherwise("values")
    return rows.where(~F.col("header") & (n > 0)).select(
        "page_id", "block", "row", kind.alias("kind"), key.alias("key"), value.alias("value")
    )


# Section names that make a table a building table, and its columns.
BUILDING_SECTIONS = ["residential", "out building"]
MAIN_COLUMNS = ["Type", "Stories", "Sq Ft", "Exterior", "Roof Cover", "Year Built*", "Sketch(s)"]
COMPONENT_COLUMNS = ["Sq Ft", "Exterior", "Roof Cover", "Year Built*", "Sketch(s)"]


def building_tables(rows: DataFrame) -> DataFrame:
    """Table rows with ``is_building``: some divider row names a building section."""
    text = F.lower(F.array_join("cells", " "))
    named = F.lit(False)
    for section in BUILDING_SECTIONS:
        named = named | text.contains(section)
    whole = Window.partitionBy("page_id", "block")
    return rows.withColumn("is_building", F.max(F.col("divider") & named).over(whole))


def building_rows(rows: DataFrame) -> DataFrame:
    """Rows of building tables with their segment and role.

    A divider starts a segment. Inside it, position 0 names the building, 1 is its
    main row and later ones are components.
    """
    order = Window.partitionBy("page_id", "block").orderBy("row")
    kept = rows.where(F.col("divider") | F.col("header") | (F.size("cells") > 2))
    segmented = kept.withColumn("segment", F.sum(F.col("divider").cast("int")).over(order))
    inside = Window.partitionBy("page_id", "block", "segment").orderBy("row")
    position = F.row_number().over(inside) - 1
    name = F.coalesce(
        F.get(F.first("cells").over(inside), F.lit(0)), F.lit("Unknown Development")
    )
    return segmented.withColumns({"position": position, "building": name})


def building_developments(rows: DataFrame) -> DataFrame:
    """``page_id, block, segment, position, development``: main and component rows as maps."""

    def cell(i: int) -> Column:
        return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))

    def made(*pairs: tuple[str, Column]) -> Column:
        flat = []
        for label, value in pairs:
            flat += [F.lit(label), value]
        return F.create_map(*flat)

    main = made(
        ("Building Name", F.col("building")),
        *[(label, cell(i)) for i, label in enumerate(MAIN_COLUMNS)],
        ("Component Type", F.lit("Main Building")),
    )
    component = made(
        ("Building Name", F.col("building")),
        ("Building Component", cell(0)),
        ("Stories", F.lit("")),
        *[(label, cell(i + 1)) for i, label in enumerate(COMPONENT_COLUMNS)],
        ("Component Type", F.lit("Component")),
    )
    n = F.size("cells")
    role = F.when((F.col("position") == 1) & (n >= 7), main).when(
        (F.col("position") > 1) & (n >= 1), component
    )
    return building_rows(rows).select(
        "page_id", "block", "segment", "position", role.alias("development")
    ).where(F.col("development").isNotNull())


def list_pairs(elements: DataFrame) -> DataFrame:
    """``page_id, block, cell, seq, content, key, value``: dt and dd of equal ordinal.

    Surplus labels or values of a list pair with nothing and drop out.
    """
    terms = elements.where(F.col("kind").isin("dt", "dd") & (F.col("block") >= 0))
    terms = by_page(terms.select("page_id", "seq", "kind", "block", "cell", "content", "text"))
    is_term = F.col("kind") == "dt"
    text = collapse("text")
    return (
        terms.groupBy("page_id", "block", "cell")
        .agg(
            F.max(F.when(is_term, text)).alias("key"),
            F.max(F.when(~is_term, text)).alias("value"),
            F.min("seq").alias("seq"),
            F.max("content").alias("content"),
        )
        .where(F.col("key").isNotNull() & F.col("value").isNotNull())
    )


def span_fields(elements: DataFrame) -> DataFrame:
    """``page_id, class, value``: first span for address and owner, last for the others."""
    text = collapse("text")
    spans = elements.where(F.col("kind") == "span").select(
        "page_id", "seq", text.alias("text"), span_class(text).alias("class")
    )
    first = F.col("class").isin("property_address", "owner_name")
    return (
        spans.where(F.col("class").isNotNull())
        .groupBy("page_id", "class")
        .agg(F.min_by("text", F.when(first, F.col("seq")).otherwise(-F.col("seq"))).alias("value"))
    )


def section_fields(elements: DataFrame) -> DataFrame:
    """``page_id, field, value`` anchored at headings of the page's first content box.

    The address is the next span after its heading; owner and mailing lines are the
    sibling spans between the rule under their heading and the next heading.
    """
    page = Window.partitionBy("page_id")
    first_box = F.min(
        F.when((F.col("kind") == "div") & F.col("classes").contains("ibox-content"), F.col("seq"))
    ).over(page)
    parts = elements.where(F.col("kind").isin("h5", "span", "hr", "strong", "div")).select(
        "page_id", "seq", "parent", "kind", "classes", "content", "text", "tail"
    )
    inside = by_page(parts).withColumn("_box", first_box)
    inside = inside.where(F.col("content") == F.col("_box"))
    siblings = Window.partitionBy("page_id", "parent").orderBy("seq")
    heading = F.when(F.col("kind") == "h5", F.trim("text"))
    marked = inside.withColumns(
        {
            "section": F.last(heading, ignorenulls=True).over(siblings),
            "nth": F.sum((F.col("kind") == "h5").cast("int")).over(siblings),
            "address_at": F.min(F.when(heading == "Property Address", F.col("seq"))).over(page),
        }
    )
    under = Window.partitionBy("page_id", "parent", "nth").orderBy("seq")
    marked = marked.withColumn("rules", F.sum((F.col("kind") == "hr").cast("int")).over(under))
    is_span = F.col("kind") == "span"
    text = collapse("text")
    owner_line = (
        is_span
        & (F.col("section") == "Owner Name & Address")
        & (F.col("rules") > 0)
        & (text != "")
        & (text != "Primary Owner")
    )
    lines = F.transform(
        F.sort_array(F.collect_list(F.when(owner_line, F.struct("seq", text.alias("text"))))),
        lambda s: s["text"],
    )
    legal = (F.col("kind") == "strong") & (F.trim("text") == "Extended Legal:")
    found = marked.groupBy("page_id").agg(
        F.min_by(text, F.when(is_span & (F.col("seq") > F.col("address_at")), F.col("seq"))).alias(
            "address"
        ),
        lines.alias("lines"),
        F.min_by(collapse("tail"), F.when(legal, F.col("seq"))).alias("legal"),
    )
    more = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    fields = F.array(
        F.struct(F.lit("physical_address").alias("field"), F.col("address").alias("value")),
        F.struct(F.lit("owner_name").alias("field"), F.get("lines", F.lit(0)).alias("value")),
        F.struct(
            F.lit("mailing_address").alias("field"),
            F.when(F.size("lines") > 1, F.array_join(more, " ")).alias("value"),
        ),
        F.struct(F.lit("legal.location").alias("field"), F.col("legal").alias("value")),
    )
    return (
        found.select("page_id", F.explode(fields).alias("f"))
        .select("page_id", "f.field", "f.value")
        .where(F.col("value").isNotNull())
    )


def value_rollup(rows: DataFrame) -> DataFrame:
    """``page_id, land, improvements, total`` of each page's first table.

    The value is the third column from the right: row 0 is land, rows 1 and 2 are
    improvements. ``rows`` comes from ``table_rows(via=None)``; rows directly under
    the table win over those of its body. Pages with fewer rows have none.
    """
    rank = F.when(F.col("via") == "table", 0).when(F.col("via") == "tbody", 1).otherwise(2)
    page = Window.partitionBy("page_id")
    first = (
        rows.where(F.col("block") == 1)
        .withColumn("_rank", rank)
        .withColumn("_best", F.min("_rank").over(page))
        .where(F.col("_rank") == F.col("_best"))
    )
    value = money_value(F.get("cells", F.size("cells") - 3))
    return (
        first.where(F.col("row") <= 2)
        .withColumn("v", value)
        .groupBy("page_id")
        .agg(
            F.count("v").alias("n"),
            F.sum(F.when(F.col("row") == 0, F.col("v"))).alias("land"),
            F.sum(F.when(F.col("row") > 0, F.col("v"))).alias("improvements"),
        )
        .where(F.col("n") == 3)
        .select("page_id", "land", "improvements", (F.col("land") + F.col("improvements")).alias("total"))
    )


def list_page_records(elements: DataFrame) -> DataFrame:
    """``page_id, box, account, record, valid``: one record per box of a list page.

    An anchor's text, even an empty one, goes before the whole value. A box whose labels and values do
    not pair up, or without an account, is kept as not valid.
    """
    is_term = F.col("kind") == "dt"
    terms = elements.where(F.col("kind").isin("dt", "dd") & (F.col("box") >= 0))
    terms = by_page(terms.select("page_id", "seq", "kind", "box", "text", "extra"))
    nth = F.row_number().over(Window.partitionBy("page_id", "box", "kind").orderBy("seq"))
    paired = (
        terms.withColumn("nth", nth)
        .groupBy("page_id", "box", "nth")
        .agg(
            F.max(F.when(is_term, F.col("text"))).alias("key"),
            F.max(F.when(~is_term, F.col("text"))).alias("value"),
            F.max(F.when(~is_term, F.col("extra"))).alias("anchor"),
        )
    )
    boxes = elements.where(
        (F.col("kind") == "div") & F.array_contains(F.split("classes", " "), "ibox")
    ).select("page_id", F.col("seq").alias("box"))
    paired = paired.unionByName(boxes, allowMissingColumns=True)
    is_account = F.col("key") == "Account #"
    account = F.coalesce("anchor", "value")
    shown = F.when(is_account, account).otherwise(F.col("value"))
    items = F.sort_array(
        F.collect_list(
            F.when(F.col("nth").isNotNull(), F.struct("nth", F.col("key"), shown.alias("value")))
        )
    )
    both = F.col("key").isNotNull() & F.col("value").isNotNull()
    matched = F.bool_and(F.when(F.col("nth").isNotNull(), both))
    boxed = paired.groupBy("page_id", "box").agg(
        items.alias("items"),
        F.max_by(account, F.when(is_account, F.col("nth"))).alias("account"),
        matched.alias("matched"),
    )
    pairs = F.transform(
        F.filter("items", lambda i: i["key"].isNotNull()), lambda i: pair(i["key"], i["value"])
    )
    has_account = F.col("account").isNotNull() & (F.col("account") != "")
    return boxed.select(
        "page_id",
        "box",
        "account",
        map_of_pairs(pairs).alias("record"),
        (F.coalesce("matched", F.lit(True)) & has_account).alias("valid"),
    )


def next_page_flags(elements: DataFrame) -> DataFrame:
    """``page_id, has_next``: an anchor reads ``Next``."""
    return elements.groupBy("page_id").agg(
        F.bool_or((F.col("kind") == "a") & (F.col("text") == "Next")).alias("has_next")
    )
