"""The supplied tables as county feeds, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.operators.skew import dealt

COUNTY_CODES = [
    "teton_county_wy",
    "teton_county_id",
    "lincoln_county_wy",
    "sublette_county_wy",
    "fremont_county_wy",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def county_of(k: Column) -> Column:
    out = None
    for i, code in enumerate(COUNTY_CODES):
        out = F.when(k == i, code) if out is None else out.when(k == i, code)
    return out


# Flat parcel values. One spelling serves both engines: only functions that exist in
# both with equal meaning are used.
PARCEL_VALUES = {
    "ck": "c_custkey",
    "k": "c_nationkey % 5",
    "pid": "concat('R-', lpad(cast(c_custkey as {text}), 7, '0'))",
    "owner": "concat(c_mktsegment, ' ', n_name, ', ', c_name)",
    "phys": (
        "case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '' "
        "else concat(cast(100 + c_custkey % 900 as {text}), ' ', n_name, ' St.') end"
    ),
    "addr": (
        "case when c_custkey % 19 = 0 then '' "
        "else concat('PO Box ', cast(c_custkey % 500 as {text})) end"
    ),
    "city": "case when c_custkey % 7 = 0 then null else r_name end",
    "state": "case when c_nationkey % 5 = 1 then 'ID' else 'WY' end",
    "zip": "case when c_custkey % 5 = 0 then '' else lpad(cast(c_custkey % 100000 as {text}), 5, '0') end",
    "acres": "concat(cast(c_custkey % 40 as {text}), '.5')",
    "worth": "cast(c_acctbal as {text})",
    "ltype": "c_mktsegment",
    "deed": (
        "case when c_custkey % 9 = 0 then null "
        "else concat('B', cast(c_custkey % 97 as {text}), 'P', cast(c_custkey % 31 as {text})) end"
    ),
    "account": "case when c_custkey % 10 = 0 then null else concat('A', lpad(cast(c_custkey as {text}), 8, '0')) end",
    "taxid": "case when c_custkey % 8 = 0 then null else concat('T', cast(c_custkey as {text})) end",
    # Coordinates are multiples of 1/1024, exact in doubles in both engines.
    "x0": "-111 + (c_custkey % 200) * 0.00390625e0",
    "y0": "42.5e0 + floor(c_custkey / 200e0) * 0.00390625e0",
    "w": "(1 + c_custkey % 5) * 0.0009765625e0",
    "h": "(1 + c_custkey % 3) * 0.0009765625e0",
}

_JOINED = (
    "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
)


def _values(text: str) -> str:
    return ", ".join(f"{sql.format(text=text)} as {name}" for name, sql in PARCEL_VALUES.items())


# `p`: flat parcels.
PARCELS_SQL = f"p as (select {_values('varchar')} from {_JOINED})"


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Flat parcel values; nation and region are joined by Spark's own choice.

    The customers are one small file, hence one task: they are dealt before texts, pages and
    shapes many times their size are made of them.
    """
    joined = (
        dealt(table(spark, sf, "customer"), "c_custkey")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        *[F.expr(sql.format(text="string")).alias(name) for name, sql in PARCEL_VALUES.items()]
    )


# Source property names per county, in the order of COUNTY_CODES; county 4 has only
# the alternate name of the tax year and county 2 of the owner place.
_PROPERTY_NAMES = [
    {"pidn": "pid", "owner": "owner", "st_address": "phys", "address": "addr", "area_calc": "acres",
     "acctval": "worth", "accttype": "ltype", "deed": "deed", "tax_year": "year",
     "owner_city": "city", "owner_state": "state", "owner_zip": "zip", "accountno": "account",
     "tax_id": "taxid"},
    {"pin": "pid", "owner": "owner", "physical_address": "phys", "mailing_address": "addr",
     "mailing_city": "city", "mailing_state": "state", "mailing_zip": "zip", "acres": "acres",
     "total_value": "worth", "legal_1": "ltype", "deed_ref1": "deed", "taxyear": "year"},
    {"PIN": "pid", "OWNERSHIP": "owner", "Address": "phys", "MAIL_ADD": "addr", "GR_ACRE": "acres",
     "value": "worth", "Description": "ltype", "deed": "deed", "tax_year": "year", "city": "city",
     "state": "state", "zip": "zip", "RWACCT": "account"},
    {"pidn": "pid", "name": "owner", "st_address": "phys", "address": "addr", "acres_calc": "acres",
     "total_val": "worth", "accttype": "ltype", "bookpage": "deed", "taxyear": "year",
     "owner_city": "city", "owner_state": "state", "owner_zip": "zip", "accountno": "account",
     "tax_id": "taxid"},
    {"pidn": "pid", "ownername": "owner", "st_address": "phys", "address": "addr",
     "grossacres": "acres", "acct_val": "worth", "accttype": "ltype", "receptno": "deed",
     "year": "year", "owner_city": "city", "owner_state": "state", "owner_zip": "zip",
     "accountno": "account", "tax_id": "taxid"},
]


def _props() -> Column:
    out = None
    for k, names in enumerate(_PROPERTY_NAMES):
        flat = []
        for name, source in names.items():
            flat += [F.lit(name), F.lit("2024") if source == "year" else F.col(source)]
        here = F.create_map(*flat)
        out = F.when(F.col("k") == k, here) if out is None else out.when(F.col("k") == k, here)
    return out


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(
        point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)
    )


def geometry() -> Column:
    """Rectangles; some with a hole, some of two parts, some missing."""
    x, y, w, h, ck = (F.col(c) for c in ["x0", "y0", "w", "h", "ck"])
    outer = box_ring(x, y, w, h)
    hole = box_ring(x + w / 4, y + h / 4, w / 2, h / 2)
    unit = F.lit(0.0009765625)
    second = box_ring(x + 2 * unit, y + 3 * unit, unit, unit)
    rings = F.when(ck % 4 == 1, F.array(outer, hole)).otherwise(F.array(outer))
    polys = F.when(ck % 6 == 0, F.array(rings, F.array(second))).otherwise(F.array(rings))
    kind = F.when(ck % 6 == 0, "MultiPolygon").otherwise("Polygon")
    return F.when(ck % 17 != 0, F.struct(kind.alias("type"), polys.alias("polys")))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """``county, src_ord, feature_id, props, geom`` of the five counties."""
    return parcels(spark, sf).select(
        county_of(F.col("k")).alias("county"),
        F.col("ck").alias("src_ord"),
        F.col("ck").cast("string").alias("feature_id"),
        _props().alias("props"),
        geometry().alias("geom"),
    )


def feet_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same parcels with two counties in State Plane feet."""
    ck, k = F.col("ck"), F.col("k")
    x = F.when(k >= 3, 2300000.0 + (ck % 1000) * 100.0).otherwise(F.col("x0"))
    y = F.when(k >= 3, 1300000.0 + (ck % 700) * 150.0).otherwise(F.col("y0"))
    size = F.when(k >= 3, 500.0).otherwise(F.lit(0.0009765625))
    flat = parcels(spark, sf).withColumns({"x": x, "y": y})
    geom = F.struct(
        F.lit("Polygon").alias("type"),
        F.array(F.array(box_ring(F.col("x"), F.col("y"), size, size))).alias("polys"),
    )
    return flat.select(
        county_of(k).alias("county"), ck.alias("src_ord"), _props().alias("props"), geom.alias("geom")
    )


DECLARED_SQL = "case when k = 4 then 'urn:ogc:def:crs:EPSG::3738' end"


def declared(features_df: DataFrame) -> DataFrame:
    """Declared system of one county."""
    named = F.when(F.col("county") == COUNTY_CODES[4], "urn:ogc:def:crs:EPSG::3738")
    return features_df.select("county").distinct().select("county", named.alias("crs_name"))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Address points from orders, near the parcel of their customer."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    half = 0.00048828125
    return table(spark, sf, "orders").select(
        ok.alias("src_ord"),
        F.create_map(
            F.lit("pidn"), F.expr("concat('R-', lpad(cast(o_custkey as string), 7, '0'))"),
            F.lit("FID"), ok.cast("string"),
            F.lit("site"), F.concat(F.col("o_orderpriority"), F.lit(" Road")),
            F.lit("note"), F.when(ok % 3 == 0, "").otherwise(F.col("o_orderstatus")),
        ).alias("props"),
        (-111 + (ck % 200) * 0.00390625 + (ok % 13 - 3) * half).alias("px"),
        (42.5 + F.floor(ck / 200.0) * 0.00390625 + (ok % 9 - 2) * half).alias("py"),
    )


# `a`: the same addresses.
ADDRESSES_SQL = """a as (
  select o_orderkey as ok, concat('R-', lpad(cast(o_custkey as varchar), 7, '0')) as apid,
    concat(o_orderpriority, ' Road') as site,
    case when o_orderkey % 3 = 0 then '' else o_orderstatus end as note,
    -111 + (o_custkey % 200) * 0.00390625e0 + (o_orderkey % 13 - 3) * 0.00048828125e0 as px,
    42.5e0 + floor(o_custkey / 200e0) * 0.00390625e0 + (o_orderkey % 9 - 2) * 0.00048828125e0 as py
  from orders)"""

# `m`: brute force over rectangles: covered by the outer box unless strictly inside the
# hole, or covered by the second part; the least parcel wins.
MATCHES_SQL = """m as (
  select ok, min(ck) as ck from a join p on
    ck % 17 <> 0 and (
      (px between x0 and x0 + w and py between y0 and y0 + h
       and not (ck % 4 = 1 and px > x0 + w / 4 and px < x0 + w / 4 + w / 2
                and py > y0 + h / 4 and py < y0 + h / 4 + h / 2))
      or (ck % 6 = 0
          and px between x0 + 0.001953125e0 and x0 + 0.0029296875e0
          and py between y0 + 0.0029296875e0 and y0 + 0.00390625e0))
  group by ok)"""
