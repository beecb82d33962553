"""Assessor tables, nested documents and layer responses."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import feeds
from lotbook.operators import assessor as A
from lotbook.operators import documents as D
from lotbook.operators import lookup as K
from lotbook.session import shared_folder
from lotbook.sources.tables import chunked_pages, page_count, result_count

P = feeds.PARCELS_SQL


def _text(sql: str) -> Column:
    return F.expr(sql.format(text="string"))


# Source columns of the six tables, all text, from the supplied tables. `{text}` is
# the engine's text type; the same spelling is used in the SQL.
_PARCELS = {
    "PM_PAR_14": "concat(' ', pid, ' ')", "PM_PAR_15": "'A'", "PM_MAIL_NM": "owner",
    "PM_MAIL_A1": "addr", "PM_MAIL_A2": "case when ck % 3 = 0 then 'Unit 2' end",
    "PM_MAIL_CT": "city", "PM_MAIL_ST": "state", "PM_MAIL_ZP": "zip", "PM_PROP_AD": "phys",
    "PM_PROP_ZP": "zip", "PM_DEEDRF1": "deed", "PM_DEEDRF2": "taxid",
    "PM_DEEDRF3": "cast(null as {text})", "PM_DEEDRF4": "''", "PM_DEEDRF5": "account",
    "PM_TOT_VAL": "worth", "PM_IMP_VAL": "case when ck % 2 = 0 then ' 1,250 ' else '' end",
    "PM_LND_VAL": "case when ck % 4 = 0 then 'n/a' else concat(cast(ck * 10 as {text}), '.25') end",
    "PM_PV_ACRE": "acres", "PM_ZONING": "ltype", "PM_TAXAREA": "concat('D', cast(k as {text}))",
}

_LINE_PARCEL = "concat('R-', lpad(cast(o_custkey as {text}), 7, '0'))"

# Land records: line items of the customer's orders; categories 0..13 reach every band.
_LAND = {
    "LD_PAR_14": _LINE_PARCEL,
    "LD_CAT_NUM": "case when l_partkey % 29 = 0 then '' else cast(l_partkey % 14 as {text}) end",
    "LD_LOC_NUM": "l_returnflag", "LD_CLS_NUM": "cast(l_linenumber as {text})",
    "LD_TYP_NUM": "'x'",
    "LD_QNTY": "case when l_suppkey % 7 = 0 then '' else cast(cast(l_quantity as bigint) as {text}) end",
    "LD_UNIT": "'AC'", "LD_VALUE": "cast(cast(floor(l_extendedprice) as bigint) as {text})",
}
_SALES = {
    "SL_PAR_14": _LINE_PARCEL, "SL_SALE_DT": "{day}",
    "SL_PRICE": "concat(cast(cast(floor(o_totalprice) as bigint) as {text}), '.0')",
    "SL_VALID": "o_orderstatus", "SL_PERS_PR": "'N'",
}
_PERMITS = {
    "PE_PAR_14": _LINE_PARCEL, "PE_REF_NUM": "cast(o_orderkey as {text})", "PE_FIL_DAT": "{day}",
    "PE_DESCRIP": "o_orderpriority", "PE_TYPE": "concat(' ', o_orderstatus)",
}
_IMPROVEMENTS = {
    "IM_PAR_14": _LINE_PARCEL, "IM_NUMBER": "cast(o_orderkey % 10 as {text})",
    "IM_DWELL_N": "o_orderpriority", "IM_PROP_AD": "''",
    "IM_YR_BLT": "cast(1950 + o_orderkey % 70 as {text})", "IM_STORIES": "cast(o_orderkey % 3 as {text})",
    "IM_BEDROOM": "''", "IM_BATHRM": "'2.5'", "IM_FIREPLC": "'0'",
    "IM_1ST_SQF": "concat(cast(o_orderkey % 3000 as {text}), '.0')", "IM_2ND_SQF": "''",
    "IM_BAS_SQF": "''", "IM_ATT_SQF": "''", "IM_TOT_SQF": "concat(cast(o_orderkey % 5000 as {text}), '.5')",
    "IM_SIDING": "'Log'", "IM_ROOFING": "''", "IM_HEAT_1": "'Gas'", "IM_HEAT_2": "''",
    "IM_HEAT_3": "''", "IM_EXT_VAL": "'1,000'", "IM_GAR1_SF": "''", "IM_GAR2_SF": "''",
}
_LEGAL = {"LG_PAR_14": _LINE_PARCEL, "LG_LINE_1": "o_orderpriority", "LG_LINE_2": "''",
          "LG_LINE_3": "o_orderstatus", "LG_LINE_4": "''", "LG_LINE_5": "''", "LG_LINE_6": "''"}


def _select(df: DataFrame, columns: dict[str, str], table: str, ord_sql: str) -> DataFrame:
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    raw = df.select(
        *[F.expr(sql.format(text="string", day=day)).alias(c) for c, sql in columns.items()],
        F.expr(ord_sql).alias("ord"),
    )
    return A.typed_table(raw, table, keep=("ord",))


def tables(spark, sf) -> dict[str, DataFrame]:
    orders = feeds.table(spark, sf, "orders")
    lines = feeds.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "parcels": A.typed_table(
            feeds.parcels(spark, sf).select(*[_text(sql).alias(c) for c, sql in _PARCELS.items()]), "parcels"
        ).drop("last_updated"),
        "land_records": _select(lines, _LAND, "land_records", "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate)"),
        "sales": _select(orders, _SALES, "sales", "o_orderkey"),
        "permits": _select(orders, _PERMITS, "permits", "o_orderkey"),
        "improvements": _select(orders, _IMPROVEMENTS, "improvements", "o_orderkey"),
        "legal_descriptions": _select(orders, _LEGAL, "legal_descriptions", "o_orderkey"),
    }


def assessor_parcels(spark, sf):
    return tables(spark, sf)["parcels"]


def _trimmed(sql: str) -> str:
    return f"coalesce(trim({sql.format(text='varchar')}), '')"


def _number(sql: str) -> str:
    return f"try_cast(replace(trim({sql.format(text='varchar')}), ',', '') as double)"


_TYPED_SQL = "select {} from p".format(
    ", ".join(
        (_number(_PARCELS[s]) if kind == "double" else _trimmed(_PARCELS[s])) + f" as {n}"
        for s, n, kind in A.TABLES["parcels"]
    )
)
_PARCELS_SQL = f"with {P} {_TYPED_SQL}"

_LAND_SQL = f"""land as (select concat('R-', lpad(cast(o_custkey as varchar), 7, '0')) as county_parcel_id,
    case when l_partkey % 29 = 0 then null else l_partkey % 14 end as cat,
    case when l_suppkey % 7 = 0 then 0 else cast(cast(l_quantity as bigint) as double) end as q
  from lineitem join orders on l_orderkey = o_orderkey),
  ac as (select county_parcel_id, sum(case when cat between 1 and 3 then q else 0 end) as residential,
    sum(case when cat between 4 and 6 then q else 0 end) as agricultural,
    sum(case when cat between 7 and 9 then q else 0 end) as commercial,
    sum(case when cat between 10 and 12 then q else 0 end) as industrial,
    sum(case when cat between 1 and 12 then 0 else q end) as other from land group by 1)"""


def acreage_breakdown(spark, sf):
    return A.acreage_by_category(tables(spark, sf)["land_records"])


def acreage_by_text(spark, sf):
    """First land row of each supplier decides the acreage field by its text."""
    text = F.concat(F.col("p_type"), F.lit(" "), F.element_at(
        F.array(*[F.lit(w) for w in ["Residential lot", "AGRICULTURAL", "commercial/industrial", "Industrial", "vacant"]]),
        (F.col("p_partkey") % 5 + 1).cast("int")))
    rows = (
        feeds.table(spark, sf, "lineitem")
        .join(feeds.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_suppkey", F.struct("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").alias("o"), text.alias("t"))
    )
    first = rows.groupBy("l_suppkey").agg(F.min_by(F.struct("t", "o.l_quantity"), "o").alias("f"))
    field = D.land_type_field(F.col("f.t"))
    return first.select(
        "l_suppkey", *[F.when(field == n, F.col("f.l_quantity")).otherwise(0.0).alias(n) for n in D.ACREAGE_FIELDS]
    )


_TEXT_SQL = """with f as (select l_suppkey, l_quantity, lower(concat(p_type, ' ', (['Residential lot', 'AGRICULTURAL', 'commercial/industrial', 'Industrial', 'vacant'])[p_partkey % 5 + 1])) as t
    from lineitem join part on l_partkey = p_partkey
    qualify row_number() over (partition by l_suppkey order by l_partkey, l_orderkey, l_linenumber, l_quantity) = 1),
  g as (select *, case when contains(t, 'residential') then 'residential' when contains(t, 'agricultural') then 'agricultural'
    when contains(t, 'commercial') then 'commercial' when contains(t, 'industrial') then 'industrial' else 'other' end as fld from f)
  select l_suppkey, case when fld = 'residential' then l_quantity else 0 end as residential,
    case when fld = 'agricultural' then l_quantity else 0 end as agricultural, case when fld = 'commercial' then l_quantity else 0 end as commercial,
    case when fld = 'industrial' then l_quantity else 0 end as industrial, case when fld = 'other' then l_quantity else 0 end as other from g"""


def _document_columns(docs: DataFrame) -> DataFrame:
    def joined(array: str, item) -> Column:
        return F.array_join(F.transform(array, item), ";")

    return docs.select(
        "county_parcel_id", "tax_id", "physical_address", "mailing_address", "owner_name", "deed",
        "tax_district", "total_acres", F.col("legal.location").alias("location"),
        *[F.col(f"acreage_breakdown.{n}").alias(n) for n in D.ACREAGE_FIELDS],
        F.col("value_summary.total_value").alias("total_value"), F.col("value_summary.land").alias("land_value"),
        F.col("value_summary.developments").alias("improvement_value"),
        F.size("detailed_land_records").cast("bigint").alias("land_rows"),
        joined("developments", lambda d: F.concat_ws("|", d["Building ID"], d["Year Built"], d["Stories"], d["Total Sq Ft"], d["Siding"], F.size(d).cast("string"))).alias("developments"),
        joined("sales_history", lambda s: F.concat_ws("|", s["sale_date"], s["valid_sale"])).alias("sales"),
        joined("building_permits", lambda s: F.concat_ws("|", s["permit_filing_date"], s["permit_ref_number"], s["permit_type"])).alias("permits"),
    )


def parcel_documents(spark, sf):
    return _document_columns(D.assessor_documents(tables(spark, sf)))


def _plain(c: str) -> str:
    """A double as the document shows it."""
    return f"case when {c} is null then '' when {c} = floor({c}) then concat(cast(cast({c} as bigint) as varchar), '.0') else cast({c} as varchar) end"


_DOCUMENTS_SQL = f"""with {P}, t as ({_TYPED_SQL}),
  {_LAND_SQL}, ln as (select county_parcel_id, count(*) as land_rows from land group by 1),
  o as (select concat('R-', lpad(cast(o_custkey as varchar), 7, '0')) as county_parcel_id, strftime(o_orderdate, '%Y-%m-%d') as day, * from orders),
  sa as (select county_parcel_id, string_agg(concat(day, '|', o_orderstatus), ';' order by day desc, o_orderkey) as sales from o group by 1),
  pe as (select county_parcel_id, string_agg(concat(day, '|', o_orderkey, '|', o_orderstatus), ';' order by day desc, o_orderkey) as permits from o group by 1),
  im as (select county_parcel_id, string_agg(concat(o_orderkey % 10, '|', 1950 + o_orderkey % 70, '|', o_orderkey % 3, '|', o_orderkey % 5000, '.5|Log|', 11), ';' order by cast(o_orderkey % 10 as varchar), o_orderkey) as developments
    from o group by 1),
  lg as (select county_parcel_id, concat(o_orderpriority, ' ', o_orderstatus) as location from o
    qualify row_number() over (partition by county_parcel_id order by o_orderkey) = 1)
  select t.county_parcel_id, deed_reference1 as tax_id, physical_address,
    array_to_string(list_filter([mailing_address_line1, mailing_address_line2, mailing_city, mailing_state, mailing_zip], lambda x: x <> ''), ', ') as mailing_address,
    owner_name, array_to_string(list_filter([deed_reference1, deed_reference2, deed_reference3, deed_reference4, deed_reference5], lambda x: x <> ''), '; ') as deed,
    tax_district, {_plain('total_acres')} as total_acres, coalesce(location, '') as location,
    coalesce(residential, 0) as residential, coalesce(agricultural, 0) as agricultural, coalesce(commercial, 0) as commercial,
    coalesce(industrial, 0) as industrial, coalesce(other, 0) as other,
    {_plain('total_value')} as total_value, {_plain('land_value')} as land_value, {_plain('improvement_value')} as improvement_value,
    coalesce(land_rows, 0) as land_rows, coalesce(developments, '') as developments, coalesce(sales, '') as sales, coalesce(permits, '') as permits
  from t left join ac using (county_parcel_id) left join ln using (county_parcel_id) left join sa using (county_parcel_id)
    left join pe using (county_parcel_id) left join im using (county_parcel_id) left join lg using (county_parcel_id)"""


def parcel_improvements(spark, sf):
    t = tables(spark, sf)
    joined = A.parcel_improvements(t["parcels"], t["improvements"])
    return joined.select("county_parcel_id", "owner_name", "total_value", "improvement_number", "year_built", "building_value")


def parcel_index(spark, sf):
    dated = tables(spark, sf)["parcels"].withColumn("last_updated", F.current_timestamp())
    return A.parcel_index(dated).drop("last_updated")


def parcel_index_meta(spark, sf):
    dated = tables(spark, sf)["parcels"].withColumn("last_updated", F.lit("2024-01-01").cast("timestamp"))
    return A.index_metadata(dated, "Teton County Idaho", "assessor tables").drop("last_updated")


def duplicate_keys(spark, sf):
    """The key check over sales, whose parcel id is far from unique."""
    return A.duplicate_keys(tables(spark, sf)["sales"])


def point_lookup(spark, sf):
    """Documents of the parcels that orders name, found or not."""
    wanted = _wanted(spark, sf)
    docs = K.documents_of(tables(spark, sf), wanted)
    found = A.lookup_all(docs, wanted, "Teton Idaho", "assessor tables")
    return found.select("parcel_id", "county", "source", "owner_name", "error")


def _wanted(spark, sf):
    return feeds.table(spark, sf, "orders").select(
        F.concat(F.lit("R-"), F.lpad((F.col("o_custkey") * 2).cast("string"), 7, "0")).alias("parcel_id")
    )


def asked_documents(spark, sf):
    """Whole documents of the parcels that orders name, built for them alone."""
    return _document_columns(K.documents_of(tables(spark, sf), _wanted(spark, sf)))


def stored_lookup(spark, sf):
    """The same from all documents, written by key and read back by folder."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    K.write_documents(D.assessor_documents(tables(spark, sf), by_folder=True), path, by_folder=True)
    return _document_columns(K.asked_documents(spark.read.parquet(path), _wanted(spark, sf)))


# ---------------------------------------------------------------- layer responses


def layer_responses(spark, sf):
    """Layer responses built as JSON from the tables, then read back."""
    orders = feeds.table(spark, sf, "orders")
    account = F.concat(F.lit("R"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    building = F.to_json(F.struct(F.struct(
        account.alias("accountno"), F.col("o_orderkey").cast("string").alias("impno"),
        F.lit("").alias("nbhd"), F.col("o_orderpriority").alias("propertytype"),
    ).alias("attributes")))
    schema = "struct<features: array<struct<attributes: map<string,string>>>>"

    def read(df, body):
        text = F.concat(F.lit('{"features":['), body, F.lit("]}"))
        return df.select("ord", F.from_json(text, schema)["features"].alias("features")).select(
            "ord", F.explode("features").alias("f")
        ).select(F.col("f.attributes")["accountno"].alias("accountno"), "ord", F.col("f.attributes").alias("attributes"))

    flat = feeds.parcels(spark, sf)
    base = F.concat(F.lit("R"), F.lpad(F.col("ck").cast("string"), 7, "0")).alias("accountno")
    parcel = F.to_json(F.struct(F.struct(
        base, F.col("pid").alias("pidn"), F.col("taxid").alias("tax_id"), F.col("phys").alias("st_address"),
        F.col("addr").alias("address"), F.col("city").alias("owner_city"), F.col("owner"), F.col("deed"),
        F.concat(F.lit("LOT "), F.col("ck").cast("string"), F.lit(", "), F.col("ltype"), F.lit(", BLOCK "), F.col("k").cast("string")).alias("descript"),
        F.col("worth").alias("acctval"),
    ).alias("attributes")))
    land = F.to_json(F.struct(F.struct(
        base, F.when(F.col("ck") % 2 == 0, "Residential Land").otherwise(F.col("ltype")).alias("landtype"),
        F.col("acres").alias("landacres"),
    ).alias("attributes")))
    return (
        read(flat.withColumn("ord", F.col("ck")), parcel),
        read(orders.withColumn("ord", F.col("o_orderkey")), building),
        read(flat.withColumn("ord", F.col("ck")), land),
    )


def canonical_details(spark, sf):
    docs = D.layer_documents(*layer_responses(spark, sf))
    return docs.select(
        "accountno", "county_parcel_id", "tax_id", "mailing_address", "owner_name", "deed",
        F.col("legal.subdivision").alias("subdivision"), F.col("legal.block").alias("block"),
        F.col("legal.township").alias("township"), F.col("value_summary.total_value").alias("total_value"),
        F.col("acreage_breakdown.residential").alias("residential"), F.col("acreage_breakdown.other").alias("other"),
        F.array_join(F.transform("developments", lambda d: F.concat_ws("|", d["Building ID"], d["Property Type"], F.size(d).cast("string"))), ";").alias("developments"),
    )


_DETAILS_SQL = f"""with {P}, b as (select o_custkey as ck, string_agg(concat(o_orderkey, '|', o_orderpriority, '|', 3), ';' order by o_orderkey) as developments from orders group by 1)
  select concat('R', lpad(cast(p.ck as varchar), 7, '0')) as accountno, pid as county_parcel_id, coalesce(taxid, '') as tax_id,
    array_to_string(list_filter([addr, city], lambda x: x is not null and x <> ''), ', ') as mailing_address, owner as owner_name, coalesce(deed, '') as deed,
    ltype as subdivision, cast(k as varchar) as block,
    regexp_extract(concat('LOT ', p.ck, ', ', ltype, ', BLOCK ', k), '(?i)T(\\d+)', 1) as township, worth as total_value,
    case when p.ck % 2 = 0 then cast(acres as double) else 0 end as residential,
    case when p.ck % 2 <> 0 then cast(acres as double) else 0 end as other,
    coalesce(developments, '') as developments
  from p left join b on p.ck = b.ck"""


def page_frontier(spark, sf):
    """Pages of the list site sized by a count read from text: one page per order id."""
    orders = feeds.table(spark, sf, "orders")
    text = F.concat(F.format_number(F.col("o_orderkey") + 24000, 0), F.lit(" results found"))
    counted = orders.select(F.col("o_orderkey"), result_count(text).alias("total"))
    counted = counted.withColumn("pages", page_count(F.col("total"), 100))
    paged = counted.withColumn("page", F.col("o_orderkey") % F.col("pages") + 1)
    return chunked_pages(paged, F.col("pages"), 10, "https://example.org/list", 2026, 100).select(
        "o_orderkey", "total", "pages", "page", "chunk", "url"
    )


_ASKED_SQL = f"""select d.* from ({_DOCUMENTS_SQL}) d semi join
  (select concat('R-', lpad(cast(o_custkey * 2 as varchar), 7, '0')) as county_parcel_id from orders) w using (county_parcel_id)"""

QUERIES = {
    "assessor_parcels": (assessor_parcels, _PARCELS_SQL),
    "acreage_breakdown": (acreage_breakdown, f"with {_LAND_SQL} select * from ac"),
    "acreage_by_text": (acreage_by_text, _TEXT_SQL),
    "parcel_documents": (parcel_documents, _DOCUMENTS_SQL),
    "parcel_improvements": (
        parcel_improvements,
        f"""with {P}, i as (select concat('R-', lpad(cast(o_custkey as varchar), 7, '0')) as pid, * from orders)
          select p.pid as county_parcel_id, owner as owner_name, try_cast(worth as double) as total_value,
            cast(o_orderkey % 10 as varchar) as improvement_number, 1950 + o_orderkey % 70 as year_built,
            case when o_orderkey is not null then 1000e0 end as building_value from p left join i on p.pid = i.pid""",
    ),
    "parcel_index": (
        parcel_index,
        f"""with {P} select pid as county_parcel_id, owner as owner_name, coalesce(phys, '') as physical_address,
          try_cast(worth as double) as total_value, cast(acres as double) as total_acres from p""",
    ),
    "parcel_index_meta": (
        parcel_index_meta,
        "select 'Teton County Idaho' as county, count(*) as total_parcels, 'assessor tables' as source from customer",
    ),
    "duplicate_keys": (
        duplicate_keys,
        """select concat('R-', lpad(cast(o_custkey as varchar), 7, '0')) as county_parcel_id, count(*) as "rows"
           from orders group by 1 having count(*) > 1""",
    ),
    "point_lookup": (
        point_lookup,
        f"""with {P}, w as (select distinct concat('R-', lpad(cast(o_custkey * 2 as varchar), 7, '0')) as parcel_id from orders)
          select parcel_id, 'Teton Idaho' as county, case when pid is not null then 'assessor tables' end as source,
            owner as owner_name, case when pid is null then 'Parcel not found' end as error from w left join p on parcel_id = pid""",
    ),
    "asked_documents": (asked_documents, _ASKED_SQL),
    "stored_lookup": (stored_lookup, _ASKED_SQL),
    "canonical_details": (canonical_details, _DETAILS_SQL),
    "page_frontier": (
        page_frontier,
        """with t as (select o_orderkey, o_orderkey + 24000 as total, cast(ceil((o_orderkey + 24000) / 100.0) as bigint) as pages from orders),
           g as (select *, o_orderkey % pages + 1 as page from t)
           select o_orderkey, total, pages, page, least((page - 1) // (pages // 10), 9) as chunk,
             concat('https://example.org/list?pageNumber=', page, '&taxYear=2026&pageSize=100') as url from g""",
    ),
}
