"""Page extraction, over the page table and over pages written from parcel rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks import feeds
from checks.assessor_checks import layer_responses
from checks.assessor_checks import tables as assessor_tables
from lotbook.operators import extract as E
from lotbook.operators import page_blocks as B
from lotbook.operators.documents import assessor_documents, layer_documents
from lotbook.operators.labels import TABLE_RULES, span_class
from lotbook.operators.skew import dealt
from lotbook.session import checkpointed
from lotbook.sources.pages import page_elements, read_pages

P = feeds.PARCELS_SQL


def _elements(spark, sf):
    return page_elements(read_pages(spark, f"{sf}/pages.parquet"))


def html_counts(spark, sf):
    """Elements per kind of every page of the page table."""
    return _elements(spark, sf).groupBy("page_id", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


def html_anchors(spark, sf):
    rows = _elements(spark, sf).where(F.col("kind") == "a")
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]
    )
    return rows.groupBy("page_id").agg(F.array_join(texts, "|").alias("anchors"))


def has_next(spark, sf):
    return B.next_page_flags(_elements(spark, sf))


# ---------------------------------------------------------------- written pages


def _page(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def general_pages(spark, sf):
    """Pages with a headed table, plain rows, lists, spans, labels and paragraphs."""
    ck = F.col("ck")
    html = _page(
        "<html><body><div class='ibox-content'><p>Extended Legal: tract ", ck.cast("string"), " of the plat</p></div>",
        "<span>", F.when(ck % 2 == 0, F.concat(F.col("phys"), F.lit(" NORTH"))), "</span><span>", F.concat(ck.cast("string"), F.lit("%")), "</span>",
        "<table><tr><th>Value Type</th><th>Appraised Value</th><th>Note</th></tr>",
        "<tr><td>Land</td><td>", _money(ck * 10), "</td><td>x</td></tr>",
        "<tr><td>Improvements</td><td>", _money(ck * 20), "</td><td>y</td></tr></table>",
        "<table><tr><td>Parcel&nbsp;Number:</td><td>", F.col("pid"), "</td></tr><tr><td>Tax ID</td><td>", F.col("taxid"), "</td></tr>",
        "<tr><td>only a note</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>",
        "<dl><dt>Owner Name</dt><dd>", F.col("owner"), "</dd><dt>Total Acres</dt><dd>", F.col("acres"), "</dd></dl>",
        "<dl><dt>Subdivision</dt><dd>", F.col("ltype"), "</dd></dl>",
        "<strong>Tax District</strong> <b>D", F.col("k").cast("string"), "</b>",
        F.when(ck % 3 == 0, _page(
            "<table><tr><td>Building ID</td><td>", ck.cast("string"), "</td></tr><tr><td>Year Built</td><td>", (1950 + ck % 70).cast("string"),
            "</td></tr><tr><td>Property Type</td><td>Cabin</td></tr></table><table><tr><td>Building ID</td><td>empty</td></tr></table>")),
        "</body></html>",
    )
    return feeds.parcels(spark, sf).select(ck.alias("page_id"), html.alias("html"))


def table_pages(spark, sf):
    """Pages with a regular table and a building table."""
    ck = F.col("ck")
    html = _page(
        "<span>Owned by ", F.col("ltype"), " LLC</span>",
        "<table><tr><td>PIDN:</td><td>", F.col("pid"), "</td></tr><tr><td>", F.col("taxid"), "</td><td>Tax ID</td></tr>",
        "<tr><td>A note</td></tr><tr><td>", F.col("acres"), "</td><td>-</td><td>Residential</td></tr>",
        "<tr><td>n/a</td><td>-</td><td>Industrial</td></tr>",
        "<tr><td>Actual Value</td><td>", _money(ck * 30), " (", _money(ck * 10), " Land + ", _money(ck * 20), " Improvements)</td></tr></table>",
        "<table><tr class='divider'><td colspan='7'>Residential ", ck.cast("string"), "</td></tr>",
        "<tr class='toprow'><td>House</td><td>2</td><td>", (ck % 3000).cast("string"), "</td><td>Log</td><td>Metal</td><td>1990</td><td>S1</td></tr>",
        "<tr><td>Garage</td><td>400</td><td>Log</td><td>Metal</td><td>1991</td><td>S2</td></tr>",
        "<tr><td>too</td><td>short</td></tr>",
        F.when(ck % 2 == 0, _page("<tr class='divider x'><td>Out Building</td></tr><tr class='toprow'><td>Barn</td><td>1</td><td>900</td><td>Wood</td><td>Tin</td><td>1950</td><td></td></tr>")),
        "</table>",
    )
    return feeds.parcels(spark, sf).select(ck.alias("page_id"), html.alias("html"))


def section_pages(spark, sf):
    """Pages with headed sections, a value table, lists and buildings."""
    ck = F.col("ck")
    html = _page(
        "<div class='ibox'><div class='ibox-content'><h5>Property Address</h5><div><span>", F.concat(ck.cast("string"), F.lit(" Main&nbsp; Road")), "</span></div>",
        "<h5>Owner Name & Address</h5><hr><span>Primary Owner</span><span>", F.col("owner"), "</span><br><span>PO Box ", ck.cast("string"), "</span><span>", F.col("city"), "</span>",
        "<h5>Other</h5><span>never</span><strong>Extended Legal:</strong> Tract ", ck.cast("string"), "<br></div></div>",
        "<table><tbody><tr><td>Land</td><td>1</td><td>", _money(ck * 10), ".00</td><td>-</td><td>-</td></tr>",
        "<tr><td>Residential</td><td>", _money(ck * 20), "</td><td>a</td><td>b</td></tr><tr><td>Other</td><td>$5</td><td>a</td><td>b</td></tr></tbody></table>",
        "<dl><dt>Parcel Number</dt><dd>", F.col("pid"), "</dd><dt>Account Number</dt><dd> ", F.col("account"), " (view)</dd><dt>Lot</dt><dd>", (ck % 50).cast("string"), "</dd></dl>",
        "<div class='ibox'><div class='ibox-heading'><h4>Building ID ", (ck % 4).cast("string"), "</h4></div><div class='ibox-content'>",
        "<dl><dt>Built As</dt><dd>Ranch</dd><dt>Property Type</dt><dd>Single</dd><dt>Occupancy</dt><dd>Home</dd></dl>",
        "<dl><dt>Total Sq Ft</dt><dd>", (ck % 3000).cast("string"), "</dd><dt>Bsmt Fin Sq Ft</dt><dd>7</dd><dt>Roof Cover</dt><dd>Tin</dd><dt>Roof Type</dt><dd>Gable</dd></dl></div></div>",
    )
    return feeds.parcels(spark, sf).select(ck.alias("page_id"), html.alias("html"))


def list_pages(spark, sf):
    """List pages: one box per order, ten orders to a page; some boxes do not pair up."""
    k = F.col("o_orderkey")
    box = _page(
        "<div class='ibox'><dl><dt>Account #</dt><dd><a href='#'>", F.when(k % 6 != 0, F.concat(F.lit("R"), k.cast("string"))),
        "</a> open</dd><dt>Address</dt><dd>", F.col("o_orderpriority"), "</dd>", F.when(k % 7 == 0, F.lit("<dt>Extra</dt>")), "</dl></div>",
    )
    last = F.when(F.floor(k / 10) % 3 == 0, "<a href='?p'>Next</a>").otherwise("<a>Back</a>")
    # Orders are dealt by page before boxes are written: pages are then made without a further shuffle.
    orders = feeds.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.floor(k / 10).alias("page_id"))
    boxes = dealt(orders, "page_id").select("page_id", k.alias("k"), box.alias("box"), last.alias("tail"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "box"))), lambda s: s["box"]), "")
    return boxes.groupBy("page_id").agg(F.concat(body, F.first("tail")).alias("html"))


# ---------------------------------------------------------------- queries over them


def _stored(pages):
    """Element rows cut off from the parser, for rules that read them many times.

    Pages are written where the rows they are made of were dealt to many tasks, so markup is
    parsed where it is written and not shuffled.
    """
    return checkpointed(page_elements(pages))



def html_headers(spark, sf):
    """Rows of general tables as pairs, named by the header above them."""
    rows = B.keyed_rows(B.table_rows(_stored(general_pages(spark, sf))))
    shown = F.array_join(F.transform("pairs", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return rows.select("page_id", "block", "row", "kind", shown.alias("pairs"))


def html_pairs(spark, sf):
    return B.list_pairs(_stored(general_pages(spark, sf))).select("page_id", "block", "cell", "key", "value")


def html_buildings(spark, sf):
    rows = B.building_tables(B.table_rows(_stored(table_pages(spark, sf))))
    built = B.building_developments(rows.where(F.col("is_building")))
    d = F.col("development")
    return built.select(
        "page_id", "segment", "position", d["Building Name"].alias("building"),
        F.try_element_at(d, F.lit("Type")).alias("type"), F.try_element_at(d, F.lit("Building Component")).alias("component"),
        d["Sq Ft"].alias("sq_ft"), d["Component Type"].alias("role"),
    )


def value_table(spark, sf):
    return B.value_rollup(B.table_rows(_stored(section_pages(spark, sf)), via=None))


def list_records(spark, sf):
    rows = B.list_page_records(_stored(list_pages(spark, sf)))
    return rows.where("valid").select(
        "page_id", "account", F.col("record")["Address"].alias("address"), F.size("record").cast("bigint").alias("fields")
    )


def list_quarantine(spark, sf):
    rows = B.list_page_records(_stored(list_pages(spark, sf)))
    return rows.groupBy("page_id").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("skipped"))


def list_next(spark, sf):
    return B.next_page_flags(_stored(list_pages(spark, sf)))


def span_classes(spark, sf):
    """Classes of part names and brands read as span texts."""
    k = F.col("p_partkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.col("p_name"), F.lit(" street")))
        .when(k % 6 == 1, F.concat(F.col("p_brand"), F.lit(" LLC")))
        .when(k % 6 == 2, F.concat((k % 100).cast("string"), F.lit("%")))
        .when(k % 6 == 3, F.lpad((k % 100000).cast("string"), 5, "8"))
        .when(k % 6 == 4, F.lit("Wyoming"))
        .otherwise(F.col("p_type"))
    )
    return feeds.table(spark, sf, "part").select("p_partkey", span_class(text).alias("class"))


def two_pass_labels(spark, sf):
    k = F.col("p_partkey")
    key = F.element_at(F.array(*[F.lit(v) for v in ["PIDN:", "1.5", "Mixed Use", "  Total Acres ", "hello", "7", "Deed Ref"]]), (k % 7 + 1).cast("int"))
    value = F.element_at(F.array(*[F.lit(v) for v in ["Commercial", "x", "Owner", "9", "Tax ID"]]), (k % 5 + 1).cast("int"))
    pairs = feeds.table(spark, sf, "part").select("p_partkey", key.alias("key"), value.alias("value"))
    return E.two_pass(pairs, TABLE_RULES).select("p_partkey", "field", "shown")


def _shown(docs, *extra):
    return docs.select(
        "page_id", "county_parcel_id", "tax_id", "physical_address", "mailing_address", "owner_name", "tax_district",
        "total_acres", F.col("value_summary.total_value").alias("total_value"), F.col("value_summary.land").alias("land"),
        F.col("value_summary.developments").alias("improvements"), F.size("developments").cast("bigint").alias("n_developments"), *extra,
    )


def general_documents(spark, sf):
    docs = E.general_documents(_stored(general_pages(spark, sf)))
    first = F.get("developments", F.lit(0))
    return _shown(
        docs, F.col("legal.subdivision").alias("subdivision"), F.col("legal_extended"),
        F.try_element_at(first, F.lit("year_built")).alias("year_built"), F.try_element_at(first, F.lit("type")).alias("type"),
    )


def table_documents(spark, sf):
    docs = E.table_documents(_stored(table_pages(spark, sf)))
    return _shown(
        docs, F.col("acreage_breakdown.residential").alias("residential"), F.col("acreage_text")["industrial"].alias("industrial_text"),
        F.array_join(F.transform("developments", lambda d: d["Sq Ft"]), "|").alias("sizes"),
    )


def section_documents(spark, sf):
    docs = E.section_documents(_stored(section_pages(spark, sf)))
    first = F.get("developments", F.lit(0))
    return _shown(
        docs, F.col("legal.location").alias("location"), F.col("legal.lot").alias("lot"),
        *[first[n].alias(a) for n, a in [("Building Name", "building"), ("Type", "type"), ("Sq Ft", "sq_ft"), ("Roof Cover", "roof"), ("Built As", "built_as"), ("Heat", "heat")]],
    )


def canonical_pages(spark, sf):
    """All routes in one job: a third of the parcels on each kind of page."""
    general, table, section = general_pages(spark, sf), table_pages(spark, sf), section_pages(spark, sf)
    k = F.floor(F.col("page_id") / 3) % 3
    pages = general.where(k == 0).unionByName(table.where(k == 1)).unionByName(section.where(k == 2))
    requests = pages.select(
        "page_id", F.when(k == 1, "https://maps.greenwoodmap.com/x").otherwise("https://example.org/").alias("url"),
        F.when(k == 2, "Lincoln").otherwise("").alias("county"),
    )
    rows = E.routed_elements(requests, page_elements(pages))
    docs = E.extract_documents(requests, checkpointed(rows))
    return docs.select("page_id", "route", "county_parcel_id", "owner_name", F.size("developments").cast("bigint").alias("n_developments"))


def request_answers(spark, sf):
    """Detail requests of all parcels, answered from pages, assessor tables or layers."""
    ck, k = F.col("ck"), F.col("k")
    flat = feeds.parcels(spark, sf)
    account = F.concat(F.lit("R"), F.lpad((ck * 2).cast("string"), 7, "0"))
    url = (
        F.when(k == 0, F.concat(F.lit("https://gis.tetoncountywy.gov/#accountno="), account))
        .when(k == 1, F.concat(F.lit("https://tetonidaho.example/?parcel_id=R-"), F.lpad((ck * 3).cast("string"), 7, "0")))
        .when(k == 2, F.concat(F.lit("https://lincoln.example/"), ck.cast("string")))
    )
    county = F.when(k == 2, "lincoln").when(k == 3, "fremont").otherwise("")
    requests = flat.select(
        ck.alias("request_id"), county.alias("county"),
        F.create_map(F.lit("property_details"), url, F.lit("tax"), F.lit("u")).alias("links"),
    )
    sections = section_pages(spark, sf)
    pages = E.section_documents(_stored(sections)).withColumn(
        "url", F.concat(F.lit("https://lincoln.example/"), F.col("page_id").cast("string"))
    )
    answered = E.answer_requests(
        requests, pages, assessor_documents(assessor_tables(spark, sf)), layer_documents(*layer_responses(spark, sf))
    )
    return answered.select(
        "request_id", "tax_domain", "details_route", F.col("document.owner_name").alias("owner_name"),
        F.size("document.developments").cast("bigint").alias("n_developments"),
    )


_MONEY = "'$' || format('{{:,}}', ck * {})"

# A development section takes all later rows of its page, lists included, and in a list
# whose first label matched, later labels only count as parcel ids.
_GENERAL_SQL = f"""with {P} select ck as page_id, pid as county_parcel_id, coalesce(taxid, '') as tax_id,
    case when ck % 2 = 0 and phys is not null then trim(concat(phys, ' NORTH')) else '' end as physical_address,
    '' as mailing_address, case when ck % 3 = 0 then '' else owner end as owner_name, concat('D', k) as tax_district, '' as total_acres, '' as total_value,
    {_MONEY.format(10)} as land, {_MONEY.format(20)} as improvements, case when ck % 3 = 0 then 1 else 0 end as n_developments,
    case when ck % 3 = 0 then '' else ltype end as subdivision, concat('Extended Legal: tract ', ck, ' of the plat') as legal_extended,
    case when ck % 3 = 0 then cast(1950 + ck % 70 as varchar) end as year_built, case when ck % 3 = 0 then 'Cabin' end as type from p"""

_TABLE_SQL = f"""with {P} select ck as page_id, pid as county_parcel_id, coalesce(taxid, '') as tax_id, '' as physical_address,
    '' as mailing_address, concat('Owned by ', ltype, ' LLC') as owner_name, '' as tax_district, '' as total_acres,
    {_MONEY.format(30)} as total_value, {_MONEY.format(10)} as land, {_MONEY.format(20)} as improvements,
    case when ck % 2 = 0 then 3 else 2 end as n_developments, cast(acres as double) as residential, 'n/a' as industrial_text,
    concat(ck % 3000, '|400', case when ck % 2 = 0 then '|900' else '' end) as sizes from p"""

_SECTION_SQL = f"""with {P} select ck as page_id, pid as county_parcel_id, coalesce(account, '') as tax_id, concat(ck, ' Main Road') as physical_address,
    trim(concat('PO Box ', ck, ' ', coalesce(city, ''))) as mailing_address, owner as owner_name, '' as tax_district, '' as total_acres,
    concat(ck * 30 + 5, '.0') as total_value, concat(ck * 10, '.0') as land, concat(ck * 20 + 5, '.0') as improvements, 1 as n_developments,
    concat('Tract ', ck) as location, cast(ck % 50 as varchar) as lot, concat('Building ', ck % 4) as building, 'Single' as type,
    cast(ck % 3000 as varchar) as sq_ft, 'Gable' as roof, 'Ranch' as built_as, '' as heat from p"""

_CLEAN = "trim(regexp_replace({}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"

QUERIES = {
    "html_counts": (
        html_counts,
        """select * from (select page_id, kind, len(regexp_extract_all(html, concat('<', kind, '[\\s>]'))) as n
             from pages, (select unnest(['a', 'li', 'p', 'h1']) as kind)) where n > 0""",
    ),
    "html_anchors": (
        html_anchors,
        """with t as (select page_id, list_transform(regexp_extract_all(html, '<a\\s[^>]*>([^<]*)</a>', 1), lambda x: trim(x)) as a from pages)
           select page_id, array_to_string(a, '|') as anchors from t where len(a) > 0""",
    ),
    "has_next": (has_next, "select page_id, regexp_matches(html, '<a\\s[^>]*>\\s*Next\\s*</a>') as has_next from pages"),
    "html_headers": (
        html_headers,
        f"""with {P}, r as (
          select ck as page_id, 1 as block, 1 as row, 'data' as kind, concat('Value Type=Land;Appraised Value=', {_MONEY.format(10)}, ';Note=x') as pairs from p
          union all select ck, 1, 2, 'data', concat('Value Type=Improvements;Appraised Value=', {_MONEY.format(20)}, ';Note=y') from p
          union all select ck, 2, 0, 'pair', concat('Parcel Number:=', pid) from p
          union all select ck, 2, 1, 'pair', concat('Tax ID=', coalesce(taxid, '')) from p
          union all select ck, 2, 2, 'note', 'note=only a note' from p
          union all select ck, 2, 3, 'values', 'values=1 2 3 4' from p
          union all select ck, 3, 0, 'pair', concat('Building ID=', ck) from p where ck % 3 = 0
          union all select ck, 3, 1, 'pair', concat('Year Built=', 1950 + ck % 70) from p where ck % 3 = 0
          union all select ck, 3, 2, 'pair', 'Property Type=Cabin' from p where ck % 3 = 0
          union all select ck, 4, 0, 'pair', 'Building ID=empty' from p where ck % 3 = 0) select * from r""",
    ),
    "html_pairs": (
        html_pairs,
        f"""with {P} select ck as page_id, 1 as block, 0 as cell, 'Owner Name' as key, owner as value from p
          union all select ck, 1, 1, 'Total Acres', acres from p union all select ck, 2, 0, 'Subdivision', ltype from p""",
    ),
    "html_buildings": (
        html_buildings,
        f"""with {P} select ck as page_id, 1 as segment, 1 as position, concat('Residential ', ck) as building, 'House' as type, null as component, cast(ck % 3000 as varchar) as sq_ft, 'Main Building' as role from p
          union all select ck, 1, 2, concat('Residential ', ck), null, 'Garage', '400', 'Component' from p
          union all select ck, 2, 1, 'Out Building', 'Barn', null, '900', 'Main Building' from p where ck % 2 = 0""",
    ),
    "value_table": (
        value_table,
        f"with {P} select ck as page_id, ck * 10e0 as land, ck * 20e0 + 5 as improvements, ck * 30e0 + 5 as total from p",
    ),
    "list_records": (
        list_records,
        """select o_orderkey // 10 as page_id, concat('R', o_orderkey) as account, o_orderpriority as address, 2 as fields
           from orders where o_orderkey % 6 <> 0 and o_orderkey % 7 <> 0""",
    ),
    "list_quarantine": (
        list_quarantine,
        """select o_orderkey // 10 as page_id, count(*) filter (o_orderkey % 6 <> 0 and o_orderkey % 7 <> 0) as good,
             count(*) filter (o_orderkey % 6 = 0 or o_orderkey % 7 = 0) as skipped from orders group by 1""",
    ),
    "list_next": (list_next, "select o_orderkey // 10 as page_id, (o_orderkey // 10) % 3 = 0 as has_next from orders group by all"),
    "span_classes": (
        span_classes,
        """with t as (select p_partkey, case p_partkey % 6 when 0 then concat(p_name, ' street') when 1 then concat(p_brand, ' LLC')
             when 2 then concat(p_partkey % 100, '%') when 3 then lpad(cast(p_partkey % 100000 as varchar), 5, '8') when 4 then 'Wyoming' else p_type end as s from part)
           select p_partkey, case when length(s) <= 2 then null when regexp_matches(upper(s), 'ST|DR|AVE|ROAD|STREET|NORTH|SOUTH|EAST|WEST') then 'property_address'
             when regexp_matches(upper(s), 'TRUSTEE|TRUST|LLC|INC|CORP|COMPANY') then 'owner_name' when s like '%\\%' escape '\\' then 'percent_ownership'
             when regexp_matches(s, '^[0-9]{5}$') then 'zip_code' when upper(s) in ('WY', 'WYOMING') then 'state' end as class from t""",
    ),
    "two_pass_labels": (
        two_pass_labels,
        """with t as (select p_partkey, (['PIDN:', '1.5', 'Mixed Use', '  Total Acres ', 'hello', '7', 'Deed Ref'])[p_partkey % 7 + 1] as key,
             (['Commercial', 'x', 'Owner', '9', 'Tax ID'])[p_partkey % 5 + 1] as value from part),
           f as (select *, case p_partkey % 7 when 0 then 'county_parcel_id' when 2 then 'acreage.other' when 3 then 'total_acres' when 6 then 'deed' end as by_key,
             case p_partkey % 5 when 0 then 'acreage.commercial' when 2 then 'owner_name' when 4 then 'tax_id' end as by_value from t)
           select p_partkey, coalesce(by_key, by_value) as field, case when by_key is not null then value else key end as shown from f""",
    ),
    "general_documents": (general_documents, _GENERAL_SQL),
    "table_documents": (table_documents, _TABLE_SQL),
    "section_documents": (section_documents, _SECTION_SQL),
    "request_answers": (
        request_answers,
        f"""with {P}, o as (select o_custkey as c, count(*) as n, count(*) as im from orders group by 1)
          select p.ck as request_id, case p.k when 2 then 'lincoln' when 3 then 'fremont' end as tax_domain,
            case p.k when 0 then 'teton' when 1 then 'teton_idaho' when 2 then 'lincoln' end as details_route,
            case p.k when 0 then acct.owner when 1 then par.owner when 2 then p.owner end as owner_name,
            case p.k when 0 then case when acct.ck is not null then coalesce(oa.n, 0) end when 1 then case when par.ck is not null then coalesce(op.im, 0) end
              when 2 then 1 end as n_developments
          from p left join p acct on acct.ck = p.ck * 2 left join p par on par.ck = p.ck * 3
            left join o oa on oa.c = p.ck * 2 left join o op on op.c = p.ck * 3""",
    ),
    "canonical_pages": (
        canonical_pages,
        f"""with {P} select ck as page_id, case ck // 3 % 3 when 0 then 'general' when 1 then 'greenwood' else 'lincoln' end as route, pid as county_parcel_id,
          case when ck // 3 % 3 = 1 then concat('Owned by ', ltype, ' LLC') when ck // 3 % 3 = 0 and ck % 3 = 0 then '' else owner end as owner_name,
          case ck // 3 % 3 when 0 then case when ck % 3 = 0 then 1 else 0 end when 1 then case when ck % 2 = 0 then 3 else 2 end else 1 end as n_developments from p""",
    ),
}
