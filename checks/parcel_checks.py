"""Standardizing, merging, joining in space, reprojecting, snapshots."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import feeds
from lotbook.config import COUNTIES
from lotbook.functions import geometry as G
from lotbook.functions import maps as M
from lotbook.functions import text as T
from lotbook.functions.legal import LEGAL_PATTERNS, legal_part
from lotbook.functions.numbers import money_before, money_total, parse_number
from lotbook.functions.urls import (
    account_of_url,
    county_of_url,
    extraction_route,
    parcel_of_url,
    record_domain,
)
from lotbook.operators import merge, snapshots, spatial
from lotbook.operators.search_index import search_entries
from lotbook.operators.standardize import detect_crs, reproject_features, standardize
from lotbook.plans.jobs import county_counts
from lotbook.session import checkpointed, shared_folder
from lotbook.sources import collections

P = feeds.PARCELS_SQL


def _case(values: dict[int, str]) -> str:
    return "case k " + " ".join(f"when {k} then {v}" for k, v in values.items()) + " end"


def _truthy(c: str, value: str) -> str:
    return f"case when {c} is not null and {c} <> '' then {value} end"


def _link_sql(kind: str) -> str:
    sources = {"accountno": "account", "RWACCT": "account", "pidn": "pid", "tax_id": "taxid"}
    out = {}
    for k, code in enumerate(feeds.COUNTY_CODES):
        link = COUNTIES[code].links.get(kind)
        if link is None:
            out[k] = "null"
        elif link.field is None:
            out[k] = f"'{link.base}'"
        else:
            c = sources[link.field]
            out[k] = _truthy(c, f"concat('{link.base}{link.value_prefix}', {c})")
    return _case(out)


_COUNTY = _case({k: f"'{c}'" for k, c in enumerate(feeds.COUNTY_CODES)})
_COMPOSITE = """trim(concat(coalesce(addr, ''),
  case when coalesce(city, '') <> '' or coalesce(state, '') <> '' or coalesce(zip, '') <> ''
    then rtrim(concat(', ', coalesce(city, ''), ', ', coalesce(state, ''), ' ', coalesce(zip, '')))
    else '' end), ', ')"""

# `std`: standardized parcels with the box as four columns.
STANDARD_SQL = f"""{P}, std as (
  select concat({_COUNTY}, '_', printf('%06d', row_number() over (partition by k order by ck))) as global_parcel_uid,
    {_COUNTY} as county, ck, pid as county_parcel_id_num, owner as owner_name, phys as physical_address,
    {_case({0: _truthy('addr', 'addr'), 1: _COMPOSITE, 2: _truthy('addr', 'addr'), 3: _truthy('addr', 'addr'), 4: _truthy('addr', 'addr')})} as mailing_address,
    acres as acreage, worth as property_value, ltype as land_type_description, deed as deed_reference,
    {_case({0: "'2024'", 1: "'2024'", 2: "'2024'", 3: "'2024'", 4: 'null'})} as tax_year,
    case when k = 2 then null else city end as owner_city,
    case when k = 2 then null else state end as owner_state,
    case when k = 2 then null else zip end as owner_zip,
    {_link_sql('property_details')} as property_details_link,
    {_link_sql('tax_details')} as tax_details_link,
    {_link_sql('clerk_records')} as clerk_records_link,
    case when ck % 17 <> 0 then x0 end as xmin, case when ck % 17 <> 0 then y0 end as ymin,
    case when ck % 17 <> 0 then greatest(x0 + w, case when ck % 6 = 0 then x0 + 0.0029296875e0 else x0 end) end as xmax,
    case when ck % 17 <> 0 then greatest(y0 + h, case when ck % 6 = 0 then y0 + 0.00390625e0 else y0 end) end as ymax
  from p)"""

_STANDARD_COLUMNS = [
    "global_parcel_uid", "county", "county_parcel_id_num", "owner_name", "physical_address",
    "mailing_address", "acreage", "property_value", "land_type_description", "deed_reference",
    "tax_year", "owner_city", "owner_state", "owner_zip", "property_details_link",
    "tax_details_link", "clerk_records_link",
]


def standardized(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(feeds.features(spark, sf))


def _box_columns() -> list:
    return [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(["xmin", "ymin", "xmax", "ymax"])]


def standardize_parcels(spark, sf):
    return standardized(spark, sf).select(*_STANDARD_COLUMNS, *_box_columns())


def mailing_addresses(spark, sf):
    return standardized(spark, sf).select("global_parcel_uid", "mailing_address")


def links(spark, sf):
    return standardized(spark, sf).select(
        "global_parcel_uid", "property_details_link", "tax_details_link", "clerk_records_link"
    )


def entries(spark, sf):
    return search_entries(standardized(spark, sf)).select(
        *[c for c in search_entries(standardized(spark, sf)).columns if c != "bbox"], *_box_columns()
    )


_DISPLAY = _case({k: "'%s County'" % c.split("_")[0].title() for k, c in enumerate(feeds.COUNTY_CODES)})

ENTRIES_SQL = f"""{STANDARD_SQL}, e as (
  select global_parcel_uid, ck, coalesce(county_parcel_id_num, '') as pidn, coalesce(owner_name, '') as owner,
    coalesce(mailing_address, '') as mailing_address, coalesce(physical_address, '') as physical_address,
    concat(upper(substr(county, 1, 1)), substr(county, 2, strpos(county, '_') - 2), ' County') as county,
    county as county_code, upper(right(county, 2)) as state,
    coalesce(clerk_records_link, '') as clerk_rec, coalesce(property_details_link, '') as property_det,
    coalesce(tax_details_link, '') as tax_info, xmin, ymin, xmax, ymax
  from std)"""


def county_state_names(spark, sf):
    """Codes built from nations and regions, states beyond the five counties included."""
    code = F.concat(
        F.lower(F.replace("n_name", F.lit("_"), F.lit(""))),
        F.when(F.col("n_nationkey") % 7 == 6, F.lit("_parish_")).otherwise(F.lit("_county_")),
        F.element_at(F.array(*[F.lit(s) for s in ["wy", "id", "mt", "ut", "co"]]), F.col("n_regionkey") + 1),
    )
    return feeds.table(spark, sf, "nation").select(
        code.alias("code"),
        T.county_display_name(code).alias("display"),
        T.state_of_county(code).alias("state"),
    )


def clean_text(spark, sf):
    doc = feeds.table(spark, sf, "documents")
    return doc.select(
        "doc_id",
        T.clean_search("text").alias("cleaned"),
        T.collapse("text").alias("collapsed"),
        T.label_key("text").alias("label"),
        T.description_key("source").alias("source_key"),
    )


# ---------------------------------------------------------------- merges

_PID = {"teton_county_wy": "pidn", "sublette_county_wy": "pidn", "fremont_county_wy": "pidn"}


def _keyed_parcels(spark, sf):
    """Parcels with their id under one property name; each seventh has none."""
    ck = F.col("ck")
    return feeds.parcels(spark, sf).select(
        ck.alias("src_ord"),
        F.create_map(
            F.lit("pidn"), F.when(ck % 7 == 0, "").otherwise(F.col("pid")),
            F.lit("site"), F.col("phys"),
            F.lit("note"), F.lit("own"),
        ).alias("props"),
    )


def _merged_columns(df):
    return df.select(
        "src_ord",
        *[F.try_element_at(F.col("props"), F.lit(n)).alias(n.lower()) for n in ["pidn", "site", "note", "FID"]],
        "matched",
    )


def _address_rows(spark, sf):
    """Addresses of all orders; parcels without an id (each seventh) stay unmatched."""
    return feeds.addresses(spark, sf).select("src_ord", "props")


def merge_by_id(spark, sf):
    return _merged_columns(
        merge.merge_by_id(_keyed_parcels(spark, sf), _address_rows(spark, sf), "pidn", "pidn")
    )


def merge_scraped(spark, sf):
    return _merged_columns(
        merge.merge_scraped(_keyed_parcels(spark, sf), _address_rows(spark, sf), "pidn")
    )


def join_overwrite(spark, sf):
    return _merged_columns(
        merge.join_overwrite(_keyed_parcels(spark, sf), _address_rows(spark, sf), "pidn", "pidn")
    )


def _merge_sql(truthy_only: bool, hot_null: bool) -> str:
    def over(c, own):
        new = f"case when coalesce({c}, '') <> '' then {c} else {own} end" if truthy_only else c
        return f"case when f.ok is not null then {new} else {own} end"

    return f"""with {P}, {feeds.ADDRESSES_SQL},
      f as (select * from a qualify row_number() over (partition by apid order by ok desc) = 1)
      select ck as src_ord, case when ck % 7 = 0 then '' else pid end as pidn,
        {over('site', 'phys')} as site, {over('note', "'own'")} as note,
        cast(f.ok as varchar) as fid, f.ok is not null as matched
      from p left join f on ck % 7 <> 0 and pid = apid"""


def _description(key, site, note):
    row = "<tr><td>{}</td><td>{}</td></tr>"
    parts = [
        F.lit("<table><tr><th colspan=2>Parcel</th></tr><tr><td>Pid N</td><td> "), key,
        F.lit(" </td></tr><tr><th>Site Address</th><td>"), F.coalesce(site, F.lit("")),
        F.lit("</td></tr>" + row.format("Owner &amp; Co", "first")
              + row.format("owner &amp; co", "<b>A &lt; B</b>")),
        F.lit("<tr><td>Note</td><td>"), note, F.lit("</td></tr></table>"),
    ]
    return F.concat(*parts)


def merge_by_parsed_key(spark, sf):
    ck = F.col("ck")
    left = feeds.parcels(spark, sf).select(
        ck.alias("src_ord"),
        F.create_map(
            F.lit("description"),
            _description(F.when(ck % 7 == 0, "").otherwise(F.col("pid")), F.col("phys"), F.lit("own")),
        ).alias("props"),
    )
    right = _address_rows(spark, sf).select(
        "src_ord",
        F.create_map(
            F.lit("description"),
            _description(F.col("props")["pidn"], F.col("props")["site"], F.col("props")["note"]),
        ).alias("props"),
    )
    merged = merge.merge_by_parsed_key(left, right, key="pid_n")
    return merged.select(
        "src_ord",
        *[
            F.try_element_at(F.col("props"), F.lit(k)).alias(n)
            for k, n in [("pid_n", "pid"), ("site_address", "site"), ("note", "note"), ("owner_&_co", "owner")]
        ],
        "matched",
    )


_PARSED_SQL = f"""with {P}, {feeds.ADDRESSES_SQL},
  f as (select * from a qualify row_number() over (partition by apid order by ok desc) = 1)
  select ck as src_ord, case when ck % 7 <> 0 then pid end as pid,
    coalesce(site, nullif(phys, '')) as site,
    coalesce(nullif(note, ''), 'own') as note, 'A < B' as owner, f.ok is not null as matched
  from p left join f on ck % 7 <> 0 and pid = apid"""


def merge_counts(spark, sf):
    merged = merge.merge_by_id(_keyed_parcels(spark, sf), _address_rows(spark, sf), "pidn", "pidn")
    return merge.merge_counts(merged)


# ---------------------------------------------------------------- space


def _pair(spark, sf):
    parcels_df = feeds.features(spark, sf)
    return parcels_df, feeds.addresses(spark, sf)


def spatial_matches(spark, sf):
    return spatial.spatial_matches(*_pair(spark, sf))


def spatial_join(spark, sf):
    joined = spatial.spatial_join(*_pair(spark, sf))
    return joined.select(
        "src_ord", "addr_ord",
        *[F.try_element_at(F.col("props"), F.lit(n)).alias(n) for n in ["site", "note"]],
    )


def spatial_unmatched(spark, sf):
    return spatial.spatial_unmatched(*_pair(spark, sf)).select("src_ord", "px", "py")


def spatial_counts(spark, sf):
    parcels_df, address_df = _pair(spark, sf)
    return spatial.spatial_counts(spatial.spatial_matches(parcels_df, address_df), address_df)


def spatial_multi(spark, sf):
    return spatial.multiple_matches(checkpointed(spatial.spatial_matches(*_pair(spark, sf))))


_SPACE = f"with {P}, {feeds.ADDRESSES_SQL}, {feeds.MATCHES_SQL}"

# ---------------------------------------------------------------- geometry


def bbox(spark, sf):
    b = G.bbox("geom")
    return feeds.features(spark, sf).select(
        "src_ord", *[b[n].alias(n) for n in ["xmin", "ymin", "xmax", "ymax"]]
    )


def coords_2d(spark, sf):
    """Three-dimensional GeoJSON text parsed, the third ordinate dropped."""
    def number(c):
        return F.col(c).cast("string")

    ring = F.concat(
        F.lit("[["), number("x0"), F.lit(","), number("y0"), F.lit(",7.5],["),
        (F.col("x0") + F.col("w")).cast("string"), F.lit(","), number("y0"), F.lit("],["),
        number("x0"), F.lit(","), (F.col("y0") + F.col("h")).cast("string"), F.lit(",1]]"),
    )
    multi = F.col("ck") % 2 == 0
    text = F.when(multi, F.concat(F.lit("[[["), F.substring(ring, F.lit(2), F.length(ring)), F.lit("]]"))).otherwise(
        F.concat(F.lit("[["), F.substring(ring, F.lit(2), F.length(ring)), F.lit("]"))
    )
    geom = G.parse_geometry(F.when(multi, "MultiPolygon").otherwise("Polygon"), text)
    parsed = feeds.parcels(spark, sf).select("ck", geom.alias("geom"))
    pts = G.points("geom")
    return parsed.select(
        "ck", F.col("geom.type").alias("kind"), F.size(pts).alias("points"),
        *[F.element_at(pts, i)[a].alias(f"{a}{i}") for i in (1, 2, 3) for a in ("x", "y")],
    )


def crs_detect(spark, sf):
    df = feeds.feet_features(spark, sf)
    return detect_crs(df, feeds.declared(df))


def reproject(spark, sf):
    df = feeds.feet_features(spark, sf)
    corner = F.get(G.points("geom"), F.lit(0))
    moved = reproject_features(df, feeds.declared(df))
    return moved.select("src_ord", "county", F.round(corner["x"], 6).alias("lon"), F.round(corner["y"], 6).alias("lat"))


def _double(v: float) -> str:
    return f"cast('{v!r}' as double)"


def _reproject_sql() -> str:
    z = G.STATE_PLANE_ZONES
    e2 = (1 / 298.257222101) * (2 - 1 / 298.257222101)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep2 = e2 / (1 - e2)
    zone = "case when k = 4 then {} else {} end"

    def by_zone(name, f=lambda v: v):
        return zone.format(_double(f(z["EPSG:3738"][name])), _double(f(z["EPSG:3739"][name])))

    arc0 = by_zone("lat0", lambda d: G.meridian_arc(math.radians(d)))
    mu_div = 6378137.0 * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    return f"""with {P},
      g as (select ck, k, {_COUNTY} as county,
        case when k >= 3 then 2300000e0 + (ck % 1000) * 100e0 else x0 end as x,
        case when k >= 3 then 1300000e0 + (ck % 700) * 150e0 else y0 end as y from p),
      s1 as (select *, (({arc0}) + (y * (1200e0 / 3937e0) - ({by_zone('fn')})) / 0.9999375e0) / {_double(mu_div)} as mu,
        (x * (1200e0 / 3937e0) - ({by_zone('fe')})) / 0.9999375e0 as e from g),
      s2 as (select *, mu + {_double(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu)
        + {_double(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu)
        + {_double(151 * e1**3 / 96)} * sin(6 * mu) + {_double(1097 * e1**4 / 512)} * sin(8 * mu) as f from s1),
      s3 as (select *, tan(f) * tan(f) as t, {_double(ep2)} * cos(f) * cos(f) as c,
        6378137e0 / sqrt(1 - {_double(e2)} * sin(f) * sin(f)) as n,
        6378137e0 * (1 - {_double(e2)}) / pow(1 - {_double(e2)} * sin(f) * sin(f), 1.5) as r from s2),
      s4 as (select *, e / n as d from s3),
      ll as (select ck, k, county, x, y,
        degrees(f - (n * tan(f) / r) * (d * d / 2
          - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_double(ep2)}) * pow(d, 4) / 24
          + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_double(ep2)} - 3 * c * c) * pow(d, 6) / 720)) as lat_left,
        ({by_zone('lon0')}) + degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6
          + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_double(ep2)} + 24 * t * t) * pow(d, 5) / 120) / cos(f)) as lon_low
        from s4)
      select ck as src_ord, county,
        round(case when k >= 3 then lon_low else x end, 6) as lon,
        round(case when k >= 3 then lat_left else y end, 6) as lat from ll"""


def valid_geometries(spark, sf):
    return feeds.features(spark, sf).where(G.valid_polygon("geom")).groupBy("county").agg(
        F.count(F.lit(1)).alias("valid")
    )


# ---------------------------------------------------------------- scalar functions


def _legal_text():
    """Legal descriptions made of part values."""
    k = F.col("p_partkey")
    return (
        F.when(k % 4 == 0, F.concat(F.lit("LOT "), k.cast("string"), F.lit(", "), F.upper("p_name"), F.lit(", BLOCK "), (k % 30).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("block "), (k % 30).cast("string"), F.lit(" S"), (k % 36).cast("string"), F.lit(" T41 R"), (k % 120).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("LOT"), k.cast("string")))
    )


def legal_parts(spark, sf):
    parts = feeds.table(spark, sf, "part").select("p_partkey", _legal_text().alias("legal"))
    return parts.select("p_partkey", *[legal_part("legal", n).alias(n) for n in LEGAL_PATTERNS])


_LEGAL_SQL = """with l as (select p_partkey, coalesce(case
    when p_partkey % 4 = 0 then concat('LOT ', p_partkey, ', ', upper(p_name), ', BLOCK ', p_partkey % 30)
    when p_partkey % 4 = 1 then concat('block ', p_partkey % 30, ' S', p_partkey % 36, ' T41 R', p_partkey % 120)
    when p_partkey % 4 = 2 then concat('LOT', p_partkey) end, '') as legal from part)
  select p_partkey, trim(regexp_extract(legal, '(?i)LOT\\s+\\d+,\\s+([^,]+)', 1)) as subdivision,
    regexp_extract(legal, '(?i)BLOCK\\s+(\\d+)', 1) as block, regexp_extract(legal, '(?i)S(\\d+)', 1) as section,
    regexp_extract(legal, '(?i)T(\\d+)', 1) as township, regexp_extract(legal, '(?i)R(\\d+)', 1) as "range" from l"""


def currency_values(spark, sf):
    text = F.concat(
        F.lit("$"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" ($ "),
        F.format_number(F.floor(F.col("o_totalprice") / 4), 0), F.lit(" Land"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit(" + $"), F.format_number(F.floor(F.col("o_totalprice") / 2), 0), F.lit("  Improvements"))),
        F.lit(")"),
    )
    return feeds.table(spark, sf, "orders").select("o_orderkey", text.alias("v")).select(
        "o_orderkey", money_total("v").alias("total"), money_before("v", "Land").alias("land"),
        money_before("v", "Improvements").alias("improvements"),
        parse_number(F.replace(money_total("v"), F.lit("$"), F.lit(""))).alias("amount"),
    )


_CURRENCY_SQL = """select o_orderkey, '$' || format('{:,}', cast(floor(o_totalprice) as bigint)) as total,
    '$' || format('{:,}', cast(floor(o_totalprice / 4) as bigint)) as land,
    case when o_orderkey % 3 = 0 then '' else '$' || format('{:,}', cast(floor(o_totalprice / 2) as bigint)) end as improvements,
    floor(o_totalprice) as amount from orders"""


def assessor_numeric(spark, sf):
    """Number texts of every shape, valid and not, from order values."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(v)
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("  "), F.format_number(whole, 0), F.lit(".50 ")))
        .when(k % 8 == 1, whole.cast("string"))
        .when(k % 8 == 2, F.lit(""))
        .when(k % 8 == 3, F.concat(F.lit("-"), whole.cast("string"), F.lit(".25")))
        .when(k % 8 == 4, F.concat(whole.cast("string"), F.lit("d")))
        .when(k % 8 == 5, F.lit("0"))
        .when(k % 8 == 6, F.concat(F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("e2")))
    )
    return feeds.table(spark, sf, "orders").select("o_orderkey", parse_number(text).alias("value"))


_NUMERIC_SQL = """select o_orderkey, case o_orderkey % 8 when 0 then floor(o_totalprice) + 0.5
    when 1 then floor(o_totalprice) when 3 then -(floor(o_totalprice) + 0.25) when 5 then 0e0
    when 6 then cast(o_orderkey % 100 as double) end as value from orders"""


def _request_urls(spark, sf):
    pages = feeds.table(spark, sf, "pages").select("page_id", "url")
    k = F.col("page_id")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in [
            "?accountno=R", "&parcel_id=", "?ParcelID=", "?account-no=", "/lincoln/?x=", "/Fremont/", "#", "/maps.greenwoodmap.com/", "/tetonidaho/?parcel-id=",
        ]]), (k % 9 + 1).cast("int"))
    county = F.element_at(
        F.array(*[F.lit(s) for s in ["Fremont", "teton", "", "Lincoln", "Teton Idaho", "sublette", "park"]]),
        (k % 7 + 1).cast("int"),
    )
    return pages.select("page_id", F.concat("url", suffix, k.cast("string"), F.lit("&z=1")).alias("url"), county.alias("county"))


_URLS_SQL = """u as (select page_id, concat(url, (['?accountno=R', '&parcel_id=', '?ParcelID=', '?account-no=', '/lincoln/?x=', '/Fremont/', '#', '/maps.greenwoodmap.com/', '/tetonidaho/?parcel-id='])[page_id % 9 + 1], page_id, '&z=1') as url,
    (['Fremont', 'teton', '', 'Lincoln', 'Teton Idaho', 'sublette', 'park'])[page_id % 7 + 1] as county from pages)"""


def url_params(spark, sf):
    return _request_urls(spark, sf).select(
        "page_id", account_of_url("url").alias("account"), parcel_of_url("url").alias("parcel"),
        county_of_url("url").alias("county_name"),
    )


def route(spark, sf):
    return _request_urls(spark, sf).select(
        "page_id", extraction_route("url", "county").alias("route"), record_domain("url", "county").alias("domain")
    )


# ---------------------------------------------------------------- counties and runs


def combine_counties(spark, sf):
    """One frame per county, put together again."""
    out = None
    for code in feeds.COUNTY_CODES:
        one = standardize(feeds.features(spark, sf).where(F.col("county") == code))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("global_parcel_uid", "county", "owner_name")


def county_totals(spark, sf):
    return county_counts(standardized(spark, sf))


def missing_counties(spark, sf):
    """Expected county codes (one per nation) whose least balance is not below -900."""
    expected = feeds.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    present = feeds.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.min("c_acctbal").alias("least")
    ).where(F.col("least") < -900)
    return expected.join(present, "k", "left_anti")


def _runs(spark, sf):
    return feeds.table(spark, sf, "events").withColumn("run_ts", F.date_format("ts", "yyyyMMdd"))


def latest_snapshot(spark, sf):
    return snapshots.current_snapshot(_runs(spark, sf)).select("run_ts", "event_id", "value")


def retained_runs(spark, sf):
    return snapshots.retained_runs(snapshots.run_list(_runs(spark, sf)))


def rollback_snapshot(spark, sf):
    runs = _runs(spark, sf)
    pinned = runs.agg(F.min("run_ts").alias("run_ts"))
    return snapshots.current_snapshot(runs, pinned).select("run_ts", "event_id", "value")


_RUNS = "with r as (select strftime(ts, '%Y%m%d') as run_ts, event_id, value from events)"

QUERIES = {
    "standardize_parcels": (
        standardize_parcels,
        f"with {STANDARD_SQL} select {', '.join(_STANDARD_COLUMNS)}, xmin, ymin, xmax, ymax from std",
    ),
    "mailing_address": (mailing_addresses, f"with {STANDARD_SQL} select global_parcel_uid, mailing_address from std"),
    "links": (
        links,
        f"with {STANDARD_SQL} select global_parcel_uid, property_details_link, tax_details_link, clerk_records_link from std",
    ),
    "search_entries": (entries, f"with {ENTRIES_SQL} select * exclude (ck, county_code) from e"),
    "county_state_names": (
        county_state_names,
        """select concat(lower(replace(n_name, '_', '')), case when n_nationkey % 7 = 6 then '_parish_' else '_county_' end,
             (['wy', 'id', 'mt', 'ut', 'co'])[n_regionkey + 1]) as code,
           case when n_nationkey % 7 = 6 then concat('Nation', n_nationkey, ' Parish ', (['Wy', 'Id', 'Mt', 'Ut', 'Co'])[n_regionkey + 1])
             else concat('Nation', n_nationkey, ' County') end as display,
           (['WY', 'ID', 'MT', 'UT', 'CO'])[n_regionkey + 1] as state from nation""",
    ),
    "clean_text": (
        clean_text,
        """select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as cleaned,
             trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) as collapsed,
             lower(trim(replace(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')), ':', ''))) as label,
             regexp_replace(lower(trim(source)), '\\s+', '_', 'g') as source_key from documents""",
    ),
    "merge_by_id": (merge_by_id, _merge_sql(True, False)),
    "merge_scraped": (merge_scraped, _merge_sql(True, False)),
    "join_overwrite": (join_overwrite, _merge_sql(False, False)),
    "merge_by_parsed_key": (merge_by_parsed_key, _PARSED_SQL),
    "merge_counts": (
        merge_counts,
        f"with m as ({_merge_sql(True, False)}) select count(*) as records, count(*) filter (matched) as updated from m",
    ),
    "spatial_matches": (spatial_matches, f"{_SPACE} select ok as addr_ord, ck as parcel_ord from m"),
    "spatial_join": (
        spatial_join,
        f"""{_SPACE}, f as (select ck, min(ok) as ok from m group by ck)
          select p.ck as src_ord, f.ok as addr_ord, site, nullif(note, '') as note
          from p left join f on p.ck = f.ck left join a on a.ok = f.ok""",
    ),
    "spatial_unmatched": (
        spatial_unmatched,
        f"{_SPACE} select ok as src_ord, px, py from a where ok not in (select ok from m)",
    ),
    "spatial_counts": (
        spatial_counts,
        f"""{_SPACE} select count(distinct ck) as parcels_matched, count(*) as addresses_matched,
          (select count(*) from a) - count(*) as addresses_unmatched from m""",
    ),
    "spatial_multi": (
        spatial_multi,
        f"""{_SPACE} select ck as parcel_ord, count(*) over (partition by ck) as addresses,
          row_number() over (partition by ck order by ok) as position, ok as addr_ord
          from m qualify count(*) over (partition by ck) > 1""",
    ),
    "bbox": (bbox, f"with {STANDARD_SQL} select ck as src_ord, xmin, ymin, xmax, ymax from std"),
    "coords_2d": (
        coords_2d,
        f"""with {P} select ck, case when ck % 2 = 0 then 'MultiPolygon' else 'Polygon' end as kind, 3 as points,
          x0 as x1, y0 as y1, x0 + w as x2, y0 as y2, x0 as x3, y0 + h as y3 from p""",
    ),
    "crs_detect": (
        crs_detect,
        f"""with {P} select distinct {_COUNTY} as county,
          case when k = 4 then 'EPSG:3738' when k = 3 then 'EPSG:3739' else 'EPSG:4326' end as crs from p""",
    ),
    "reproject": (reproject, _reproject_sql()),
    "valid_geometries": (
        valid_geometries,
        f"with {P} select {_COUNTY} as county, count(*) as valid from p where ck % 17 <> 0 group by 1",
    ),
    "legal_parts": (legal_parts, _LEGAL_SQL),
    "currency_values": (currency_values, _CURRENCY_SQL),
    "assessor_numeric": (assessor_numeric, _NUMERIC_SQL),
    "url_params": (
        url_params,
        f"""with {_URLS_SQL} select page_id, nullif(regexp_extract(url, 'accountno=([^&]+)', 1), '') as account,
          coalesce(nullif(regexp_extract(url, '(?i)parcel[_-]?id=([^&]+)', 1), ''), nullif(regexp_extract(url, '(?i)account[_-]?no=([^&]+)', 1), '')) as parcel,
          coalesce(nullif(lower(regexp_extract(url, '(?i)(sublette|fremont|lincoln)', 1)), ''), 'unknown_county') as county_name from u""",
    ),
    "route": (
        route,
        f"""with {_URLS_SQL}, l as (select *, lower(url) as u, lower(county) as c from u)
          select page_id, case when contains(u, 'greenwood') or c in ('fremont', 'sublette') then 'greenwood'
              when contains(u, 'tetonidaho') or c in ('teton_idaho', 'teton idaho', 'tetonidaho') then 'teton_idaho'
              when contains(u, 'lincoln') or c = 'lincoln' then 'lincoln'
              when contains(u, 'teton') or c = 'teton' then 'teton' else 'general' end as route,
            case when c <> '' then case when c in ('teton', 'tetoncountywy') then 'teton' when c in ('sublette', 'fremont', 'lincoln') then c end
              when contains(url, 'tetoncountywy.gov') then 'teton' when contains(u, 'sublette') then 'sublette'
              when contains(u, 'fremont') then 'fremont' when contains(u, 'lincoln') then 'lincoln' end as domain from l""",
    ),
    "combine_counties": (combine_counties, f"with {STANDARD_SQL} select global_parcel_uid, county, owner_name from std"),
    "county_counts": (
        county_totals,
        f"with {STANDARD_SQL} select county, count(*) as features from std group by rollup (county)",
    ),
    "missing_inputs": (
        missing_counties,
        """select n_nationkey as k, n_name from nation
           where n_nationkey not in (select c_nationkey from customer where c_acctbal < -900)""",
    ),
    "latest_snapshot": (latest_snapshot, f"{_RUNS} select * from r where run_ts = (select max(run_ts) from r)"),
    "retained_runs": (
        retained_runs,
        f"""{_RUNS} select run_ts, dense_rank() over (order by run_ts desc) as age,
          dense_rank() over (order by run_ts desc) <= 5 as kept from (select distinct run_ts from r)""",
    ),
    "rollback_snapshot": (rollback_snapshot, f"{_RUNS} select * from r where run_ts = (select min(run_ts) from r)"),
}


def _layouts(spark, sf):
    """Parcels as text in three layouts, one document per 20 customers: a collection on one
    line, one spread over lines, bare features. Every 23rd feature is broken."""
    rows = feeds.parcels(spark, sf).select("ck", "pid", "owner", "phys")

    def quoted(name):
        escaped = F.regexp_replace(name, r'(["\\\\])', r"\\$1")
        return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))

    rows = rows.withColumns({"o": quoted("owner"), "p": quoted("phys")})
    whole = F.concat(
        F.lit('{"type": "Feature", "id": "'), "pid", F.lit('", "properties": {"owner": '), "o",
        F.lit(', "phys": '), "p", F.lit(', "odd": "} ] { \\" [ x", "list": [{"a": 1}]}, "geometry": '),
        F.when(F.col("ck") % 23 == 0, F.lit("nothing")).otherwise(F.lit("null")), F.lit("}"),
    )
    grouped = rows.withColumn("doc", F.floor(F.col("ck") / 20)).groupBy("doc")
    grouped = grouped.agg(F.array_sort(F.collect_list(F.struct("ck", whole.alias("t")))).alias("f"))
    one = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("f.t", ", "), F.lit('], "tail": [{"b": {}}]}'))
    spread = F.regexp_replace(one, r'([,{\[]) ?(["{])', "$1\n  $2")
    layout = F.when(F.col("doc") % 3 == 0, one).when(F.col("doc") % 3 == 1, spread)
    return grouped.select(layout.otherwise(F.array_join("f.t", "\n")).alias("value"))


def any_layout(spark, sf):
    """Features and rejects of text in any layout, read back from files without line ends."""
    path = f"{shared_folder(spark)}/layouts-{uuid.uuid4().hex}"
    _layouts(spark, sf).write.option("lineSep", " ").text(path)
    rows = collections.read_collections(spark, path, "teton_county_wy")
    pid = F.coalesce("feature_id", F.regexp_extract("corrupt", r'"id":\s*"([^"]+)"', 1))
    return rows.select(
        pid.alias("pid"),
        F.try_element_at("props", F.lit("owner")).alias("owner"),
        F.try_element_at("props", F.lit("phys")).alias("phys"),
        F.col("corrupt").isNotNull().alias("rejected"),
    )


def split_counts(spark, sf):
    """Good features and rejects per district of the scanned text."""
    rows = any_layout(spark, sf)
    return rows.groupBy(F.substring("pid", -1, 1).alias("district")).agg(
        F.count_if(~F.col("rejected")).alias("good"), F.count_if("rejected").alias("bad")
    )


QUERIES |= {
    "any_layout": (
        any_layout,
        f"""with {P} select pid, case when ck % 23 <> 0 then owner end as owner,
          case when ck % 23 <> 0 then phys end as phys, ck % 23 = 0 as rejected from p""",
    ),
    "split_counts": (
        split_counts,
        f"""with {P} select right(pid, 1) as district, count(*) filter (ck % 23 <> 0) as good,
          count(*) filter (ck % 23 = 0) as bad from p group by 1""",
    ),
}
