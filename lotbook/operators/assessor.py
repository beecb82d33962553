"""Assessor tables: all-text source columns to typed tables, indexes and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions.numbers import parse_integer, parse_number
from lotbook.functions.text import strip
from lotbook.operators.skew import HOT_ROWS, salted_join

KEY = "county_parcel_id"

# Source column, target column and type of the six tables.
TABLES: dict[str, list[tuple[str, str, str]]] = {
    "parcels": [
        ("PM_PAR_14", "county_parcel_id", "text"),
        ("PM_PAR_15", "parcel_status", "text"),
        ("PM_MAIL_NM", "owner_name", "text"),
        ("PM_MAIL_A1", "mailing_address_line1", "text"),
        ("PM_MAIL_A2", "mailing_address_line2", "text"),
        ("PM_MAIL_CT", "mailing_city", "text"),
        ("PM_MAIL_ST", "mailing_state", "text"),
        ("PM_MAIL_ZP", "mailing_zip", "text"),
        ("PM_PROP_AD", "physical_address", "text"),
        ("PM_PROP_ZP", "property_zip", "text"),
        ("PM_DEEDRF1", "deed_reference1", "text"),
        ("PM_DEEDRF2", "deed_reference2", "text"),
        ("PM_DEEDRF3", "deed_reference3", "text"),
        ("PM_DEEDRF4", "deed_reference4", "text"),
        ("PM_DEEDRF5", "deed_reference5", "text"),
        ("PM_TOT_VAL", "total_value", "double"),
        ("PM_IMP_VAL", "improvement_value", "double"),
        ("PM_LND_VAL", "land_value", "double"),
        ("PM_PV_ACRE", "total_acres", "double"),
        ("PM_ZONING", "zoning", "text"),
        ("PM_TAXAREA", "tax_district", "text"),
    ],
    "improvements": [
        ("IM_PAR_14", "county_parcel_id", "text"),
        ("IM_NUMBER", "improvement_number", "text"),
        ("IM_DWELL_N", "dwelling_type", "text"),
        ("IM_PROP_AD", "property_address", "text"),
        ("IM_YR_BLT", "year_built", "int"),
        ("IM_STORIES", "stories", "int"),
        ("IM_BEDROOM", "bedrooms", "int"),
        ("IM_BATHRM", "bathrooms", "double"),
        ("IM_FIREPLC", "fireplaces", "int"),
        ("IM_1ST_SQF", "first_floor_sqft", "double"),
        ("IM_2ND_SQF", "second_floor_sqft", "double"),
        ("IM_BAS_SQF", "basement_sqft", "double"),
        ("IM_ATT_SQF", "attic_sqft", "double"),
        ("IM_TOT_SQF", "total_sqft", "double"),
        ("IM_SIDING", "siding", "text"),
        ("IM_ROOFING", "roofing", "text"),
        ("IM_HEAT_1", "heating_system1", "text"),
        ("IM_HEAT_2", "heating_system2", "text"),
        ("IM_HEAT_3", "heating_system3", "text"),
        ("IM_EXT_VAL", "improvement_value", "double"),
        ("IM_GAR1_SF", "garage1_sqft", "double"),
        ("IM_GAR2_SF", "garage2_sqft", "double"),
    ],
    "legal_descriptions": [
        ("LG_PAR_14", "county_parcel_id", "text"),
        ("LG_LINE_1", "legal_line1", "text"),
        ("LG_LINE_2", "legal_line2", "text"),
        ("LG_LINE_3", "legal_line3", "text"),
        ("LG_LINE_4", "legal_line4", "text"),
        ("LG_LINE_5", "legal_line5", "text"),
        ("LG_LINE_6", "legal_line6", "text"),
    ],
    "land_records": [
        ("LD_PAR_14", "county_parcel_id", "text"),
        ("LD_CAT_NUM", "land_category", "int"),
        ("LD_LOC_NUM", "land_location", "text"),
        ("LD_CLS_NUM", "land_class", "int"),
        ("LD_TYP_NUM", "land_type", "int"),
        ("LD_QNTY", "land_quantity", "double"),
        ("LD_UNIT", "land_unit", "text"),
        ("LD_VALUE", "land_value", "double"),
    ],
    "sales": [
        ("SL_PAR_14", "county_parcel_id", "text"),
        ("SL_SALE_DT", "sale_date", "text"),
        ("SL_PRICE", "sale_price", "double"),
        ("SL_VALID", "valid_sale", "text"),
        ("SL_PERS_PR", "personal_property_included", "text"),
    ],
    "permits": [
        ("PE_PAR_14", "county_parcel_id", "text"),
        ("PE_REF_NUM", "permit_ref_number", "text"),
        ("PE_FIL_DAT", "permit_filing_date", "text"),
        ("PE_DESCRIP", "permit_description", "text"),
        ("PE_TYPE", "permit_type", "text"),
    ],
}

# Source tables a delivery should hold.
EXPECTED_FILES = [
    "pcxpar00.dbf",
    "pcparc00.dbf",
    "pcparsum.dbf",
    "pcappl00.dbf",
    "pclegl00.dbf",
    "pcname00.dbf",
    "pccatg00.dbf",
    "pcperm00.dbf",
    "pcsale00.dbf",
    "pcspec00.dbf",
    "pcimpc00.dbf",
    "pcicat00.dbf",
    "pcimag00.dbf",
    "pcland00.dbf",
    "pclndc00.dbf",
    "pcothi00.dbf",
]

# Category bands of the acreage breakdown; the rest is "other".
ACREAGE_BANDS = {
    "residential": (1, 3),
    "agricultural": (4, 6),
    "commercial": (7, 9),
    "industrial": (10, 12),
}


def source_schema(table: str) -> str:
    """All-text schema of a source table."""
    return ", ".join(f"`{source}` string" for source, _, _ in TABLES[table])


def typed_table(raw: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename, trim and parse one source table in a single projection.

    Null text is empty; numbers that do not parse are null. ``keep`` passes columns
    through, such as the row position.
    """

    def target(source: str, kind: str) -> Column:
        if kind == "double":
            return parse_number(source)
        if kind == "int":
            return parse_integer(source)
        return F.coalesce(strip(source), F.lit(""))

    out = raw.select(
        *[target(source, kind).alias(name) for source, name, kind in TABLES[table]],
        *keep,
    )
    return out.withColumn("last_updated", F.current_timestamp()) if table == "parcels" else out


def duplicate_keys(parcels: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that break the primary key; empty for a loadable table."""
    return (
        parcels.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def parcel_index(parcels: DataFrame) -> DataFrame:
    """The lookup list, in key order (a range-partitioned sort)."""
    return parcels.select(
        "county_parcel_id",
        "owner_name",
        "physical_address",
        "total_value",
        "total_acres",
        "last_updated",
    ).orderBy("county_parcel_id")


def index_metadata(parcels: DataFrame, county: str, source: str) -> DataFrame:
    """One row about the index: county, number of parcels, refresh time, source."""
    return parcels.agg(
        F.count(F.lit(1)).alias("total_parcels"), F.max("last_updated").alias("last_updated")
    ).select(F.lit(county).alias("county"), "total_parcels", "last_updated", F.lit(source).alias("source"))


def acreage_sums(category: Column, quantity: Column) -> list[Column]:
    """Sums of each band's quantities; null quantities count as zero, null categories as other."""
    given = F.coalesce(quantity, F.lit(0.0))
    sums = [
        F.sum(F.when(category.between(low, high), given).otherwise(0.0)).alias(name)
        for name, (low, high) in ACREAGE_BANDS.items()
    ]
    in_band = F.coalesce(category.between(1, 12), F.lit(False))
    return [*sums, F.sum(F.when(in_band, 0.0).otherwise(given)).alias("other")]


def acreage_by_category(land: DataFrame) -> DataFrame:
    """Acres per parcel and band."""
    return land.groupBy(KEY).agg(*acreage_sums(F.col("land_category"), F.col("land_quantity")))


def parcel_improvements(
    parcels: DataFrame, improvements: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Parcels with their improvements (with row position ``ord``), parcels without any too.

    A left join cannot split a hot right key. The improvements therefore lead a
    salted inner join, and parcels without any are added.
    """
    with_any = salted_join(
        improvements.withColumnRenamed("improvement_value", "building_value"),
        parcels,
        KEY,
        "inner",
        "ord",
        hot_rows,
    ).drop("ord")
    without = parcels.join(improvements.select(KEY).distinct(), KEY, "left_anti")
    return with_any.unionByName(without, allowMissingColumns=True)


def lookup(table: DataFrame, parcel_id: str) -> DataFrame:
    """One parcel's rows; the equality reaches the file scan."""
    return table.where(F.col(KEY) == parcel_id)


def lookup_all(documents: DataFrame, keys: DataFrame, county: str, source: str) -> DataFrame:
    """Documents of a list of parcel ids with result metadata, or an error record.

    ``keys`` has ``parcel_id``; it may hold any number of distinct ids.
    """
    found = documents.withColumn("database_source", F.lit(True)).withColumn("source", F.lit(source))
    joined = keys.select("parcel_id").distinct().join(
        found, F.col("parcel_id") == F.col(KEY), "left"
    )
    return joined.withColumn("county", F.lit(county)).withColumn(
        "error", F.when(F.col(KEY).isNull(), F.lit("Parcel not found"))
    )
