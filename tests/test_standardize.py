"""Standard schema, links, numbering."""

import json

from pyspark.sql import functions as F

from lotbook.config import COUNTIES, County, Link, load_registry
from lotbook.operators.numbering import number_rows, position_bucket
from lotbook.operators.standardize import mailing_address, parcel_uid, standardize
from lotbook.schemas import GEOMETRY, STANDARD_FIELDS

FEATURES = f"county string, src_ord bigint, props map<string,string>, geom {GEOMETRY}"


def rows(spark, *features):
    data = [(c, i, p, g) for i, (c, p, g) in enumerate(features)]
    return spark.createDataFrame(data, FEATURES)


def test_uid_padding(one):
    assert one(parcel_uid(F.lit("Teton_County_WY"), F.lit(1))) == "teton_county_wy_000001"
    assert one(parcel_uid(F.lit("Teton_County_WY"), F.lit(1234567))) == "teton_county_wy_1234567"


def test_mailing_address(spark):
    names = ["a", "c", "s", "z"]
    cases = {
        ("12 A", "Driggs", "ID", "83422"): "12 A, Driggs, ID 83422",
        ("12 A", "", "", ""): "12 A",
        ("", "Driggs", "", ""): "Driggs",
        (None, None, None, None): "",
    }
    for values, want in cases.items():
        df = spark.createDataFrame([(dict(zip(names, values)),)], "props map<string,string>")
        assert df.select(mailing_address(names)).collect()[0][0] == want
    df = spark.createDataFrame([({"a": ""},)], "props map<string,string>")
    assert df.select(mailing_address(["a"])).collect()[0][0] is None


def test_columns_links_and_quirk(spark):
    df = standardize(
        rows(
            spark,
            ("lincoln_county_wy", {"RWACCT": "7", "PIN": "p", "city": "Afton"}, None),
            ("lincoln_county_wy", {"RWACCT": ""}, None),
            ("sublette_county_wy", {"pidn": "5", "owner_city": "Big Piney"}, None),
        )
    )
    assert df.columns == [*STANDARD_FIELDS, "geom"]
    out = {r.global_parcel_uid: r for r in df.collect()}
    first = out["lincoln_county_wy_000001"]
    assert first.tax_details_link.endswith("taxid=007")
    assert first.property_details_link.endswith("Detail/7")
    assert first.clerk_records_link == COUNTIES["lincoln_county_wy"].links["clerk_records"].base
    assert first.owner_city is None
    assert out["lincoln_county_wy_000002"].tax_details_link is None
    assert out["sublette_county_wy_000001"].clerk_records_link.endswith("pidn=5")
    assert out["sublette_county_wy_000001"].owner_city == "Big Piney"


def test_fallback_uses_alternates(spark):
    df = standardize(rows(spark, ("lincoln_county_wy", {"city": "Afton"}, None)), fallback=True)
    assert df.collect()[0].owner_city == "Afton"


def test_numbers_follow_source_order_across_buckets(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("county"), (F.col("id") * 37 % 1009).alias("src_ord")
    )
    out = number_rows(df, ["county"], ["src_ord"], position_bucket(F.col("src_ord"), 50), "n").collect()
    for county in "ab":
        mine = sorted((r.src_ord, r.n) for r in out if r.county == county)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_state_plane_county_is_moved_to_degrees(spark):
    ring = [(2400000.0, 1300000.0), (2400100.0, 1300000.0), (2400100.0, 1300100.0), (2400000.0, 1300000.0)]
    flat = [(-110.0, 43.0), (-109.9, 43.0), (-109.9, 43.1), (-110.0, 43.0)]
    df = standardize(
        rows(
            spark,
            ("fremont_county_wy", {}, ("Polygon", [[ring]])),
            ("teton_county_wy", {}, ("Polygon", [[flat]])),
        )
    )
    boxes = {r.county: r.bbox for r in df.collect()}
    assert boxes["teton_county_wy"] == [-110.0, 43.0, -109.9, 43.1]
    west, south = boxes["fremont_county_wy"][:2]
    assert -112 < west < -108 and 42 < south < 45


def test_registry_from_json(spark, tmp_path):
    config = {
        "x_county_wy": {
            "ownership": {
                "standardization_mappings": {"parcel_id": ["p"]},
                "standardized_links": {"tax_details": {"base_url": "u=", "field": "t"}, "clerk_records": {"static_url": "s"}},
            }
        },
        "empty_county_wy": {},
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    registry = load_registry(spark, str(path))
    assert registry["x_county_wy"].links == {"tax_details": Link("u=", "t"), "clerk_records": Link("s")}
    assert registry["empty_county_wy"] == County("empty_county_wy")
