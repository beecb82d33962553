"""Assessor tables, documents, lookups and layer responses."""

import pytest
from pyspark.sql import functions as F

from lotbook.operators import assessor as A
from lotbook.operators import documents as D
from lotbook.operators import lookup as K
from lotbook.sinks.tables import DuplicateKeyError, load_table


def raw(spark, table, *rows):
    names = [s for s, _, _ in A.TABLES[table]]
    data = [tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{n}` string" for n in names) + ", ord bigint"
    return A.typed_table(spark.createDataFrame(data, schema), table, keep=("ord",))


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "parcels": raw(
            spark, "parcels",
            {"PM_PAR_14": " RP1 ", "PM_MAIL_NM": "Ann", "PM_MAIL_A1": "Box 1", "PM_MAIL_ZP": "83", "PM_DEEDRF1": "d1",
             "PM_DEEDRF3": "d3", "PM_TOT_VAL": "1,200", "PM_PV_ACRE": "x"},
            {"PM_PAR_14": "RP2"},
        ).drop("ord", "last_updated"),
        "improvements": raw(spark, "improvements", {"IM_PAR_14": "RP1", "IM_NUMBER": "2", "IM_YR_BLT": "1,990"},
                            {"IM_PAR_14": "RP1", "IM_NUMBER": "10", "IM_TOT_SQF": "900"}),
        "legal_descriptions": raw(spark, "legal_descriptions", {"LG_PAR_14": "RP1", "LG_LINE_1": "first", "LG_LINE_3": "line"},
                                  {"LG_PAR_14": "RP1", "LG_LINE_1": "second"}),
        "land_records": raw(spark, "land_records", *[
            {"LD_PAR_14": "RP1", "LD_CAT_NUM": c, "LD_QNTY": q}
            for c, q in [("2", "1.5"), ("5", None), ("8", "2"), ("11", "3"), ("13", "4"), (None, "1")]]),
        "sales": raw(spark, "sales", *[{"SL_PAR_14": "RP1", "SL_SALE_DT": d, "SL_VALID": v} for d, v in
                                       [("2001-05-01", "a"), ("2010-01-01", "b"), ("2001-05-01", "c")]],
                     {"SL_PAR_14": "ORPHAN", "SL_SALE_DT": "2020"}),
        "permits": raw(spark, "permits", {"PE_PAR_14": "RP2", "PE_REF_NUM": "9"}),
    }


def test_typed_columns(tables):
    row = tables["parcels"].where("county_parcel_id = 'RP1'").collect()[0]
    assert (row.total_value, row.total_acres, row.zoning) == (1200.0, None, "")
    assert dict(tables["improvements"].dtypes)["year_built"] == "int"


def test_acreage_bands(tables):
    row = A.acreage_by_category(tables["land_records"]).collect()[0]
    assert row.asDict() == {"county_parcel_id": "RP1", "residential": 1.5, "agricultural": 0.0,
                            "commercial": 2.0, "industrial": 3.0, "other": 5.0}


def test_documents(tables):
    docs = {r.county_parcel_id: r for r in D.assessor_documents(tables).collect()}
    assert set(docs) == {"RP1", "RP2"}
    d = docs["RP1"]
    assert (d.tax_id, d.deed, d.mailing_address) == ("d1", "d1; d3", "Box 1, 83")
    assert d.legal.location == "first line" and d.value_summary.total_value == "1200.0" and d.total_acres == ""
    assert [x["Building ID"] for x in d.developments] == ["10", "2"]  # text order
    assert d.developments[1] == {"Building ID": "2", "Year Built": "1990"}
    assert [s.valid_sale for s in d.sales_history] == ["b", "a", "c"]
    assert [r.land_category for r in d.detailed_land_records] == [None, 2, 5, 8, 11, 13]
    assert d.acreage_breakdown.other == 5.0
    assert docs["RP2"].developments == [] and len(docs["RP2"].building_permits) == 1


def test_a_large_parcel_is_one_ordered_document(spark, tables):
    n = 100_000
    sales = tables["sales"]
    days = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 9000).cast("int")), "yyyy-MM-dd")
    many = spark.range(n).select(
        *[
            {"county_parcel_id": F.lit("RP1"), "sale_date": days, "ord": F.col("id")}
            .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in sales.schema
        ]
    )
    docs = D.assessor_documents({**tables, "sales": many}).where("county_parcel_id = 'RP1'")
    (one,) = docs.collect()
    dates = [s.sale_date for s in one.sales_history]
    assert len(dates) == n and dates == sorted(dates, reverse=True)
    keys = spark.createDataFrame([("RP1",)], "parcel_id string")
    assert A.lookup_all(docs, keys, "c", "s").count() == 1


def test_parcel_improvements_keeps_parcels_without(tables):
    for limit in (1, 10**6):
        out = A.parcel_improvements(tables["parcels"], tables["improvements"], limit).collect()
        assert sorted((r.county_parcel_id, r.improvement_number or "") for r in out) == [("RP1", "10"), ("RP1", "2"), ("RP2", "")]


def test_lookup_is_pushed_down_and_reports_misses(spark, tables, tmp_path):
    path = str(tmp_path / "docs")
    D.assessor_documents(tables).write.parquet(path)
    docs = spark.read.parquet(path)
    plan = A.lookup(docs, "RP1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(county_parcel_id,RP1)" in plan
    keys = spark.createDataFrame([("RP1",), ("NOPE",), ("RP1",)], "parcel_id string")
    out = {r.parcel_id: r for r in A.lookup_all(docs, keys, "Teton Idaho", "s").collect()}
    assert out["RP1"].error is None and out["RP1"].database_source
    assert out["NOPE"].error == "Parcel not found" and out["NOPE"].county == "Teton Idaho"


def test_documents_of_asked_parcels(spark, tables):
    whole = {r.county_parcel_id: r for r in D.assessor_documents(tables).collect()}
    for ids in (["RP1"], ["RP2", "RP1", "RP1", "NOPE", None], [None], []):
        keys = spark.createDataFrame([(i,) for i in ids], "parcel_id string")
        got = {r.county_parcel_id: r for r in K.documents_of(tables, keys).collect()}
        assert got == {i: whole[i] for i in set(ids) & set(whole)}


def test_stored_documents_are_read_by_folder_and_row_group(spark, tables, tmp_path):
    one = D.assessor_documents(tables).where("county_parcel_id = 'RP1'")
    ids = spark.range(3000).select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("i"))
    many = one.crossJoin(ids).withColumn("county_parcel_id", F.col("i")).drop("i")
    path = str(tmp_path / "docs")
    K.write_documents(many, path)
    stored = spark.read.parquet(path)

    def asked(ids):
        return K.asked_documents(stored, spark.createDataFrame([(i,) for i in ids], "parcel_id string"))

    few, more = ["P00007", "P02999", "X", None, "P00007"], [f"P{i:05}" for i in range(0, 3000, 7)] + ["X", None]
    for keys in (few, more, [None], []):
        got = sorted(r.county_parcel_id for r in asked(keys).collect())
        assert got == sorted({k for k in keys if k and k != "X"})
    plan = asked(few)._jdf.queryExecution().executedPlan().toString()
    assert "In(county_parcel_id, [" in plan
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in folders
    # Only the files of the folders asked for are opened.
    read = asked(few)
    assert read.count() == 2 and read.collect()
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 1 <= scan.metrics().apply("numFiles").value() <= 3 < len(stored.inputFiles())
    out = K.lookup_stored(stored, spark.createDataFrame([("P00001",), ("X",)], "parcel_id string"), "C", "S")
    assert {r.parcel_id: r.error for r in out.collect()} == {"P00001": None, "X": "Parcel not found"}


def test_documents_by_folder_are_written_and_asked_for_without_a_shuffle(spark, tables, tmp_path, monkeypatch):
    """Documents were shuffled to be written, and again when many keys were asked for."""
    ids = [f"P{i:05}" for i in range(3000)]
    header = tables["parcels"].where("county_parcel_id = 'RP1'").drop("county_parcel_id")
    parcels = spark.createDataFrame([(i,) for i in ids], "county_parcel_id string").crossJoin(header)
    many = {**tables, "parcels": parcels, "sales": tables["sales"].withColumn("county_parcel_id", F.lit("P00007"))}
    documents = D.assessor_documents(many, by_folder=True)
    path = str(tmp_path / "docs")
    K.write_documents(documents, path, by_folder=True)
    stored = spark.read.parquet(path)
    folders = [name.rsplit("/", 2)[1] for name in stored.inputFiles()]
    assert len(folders) == len(set(folders)) == 64
    assert sorted(r.county_parcel_id for r in stored.select("county_parcel_id").collect()) == ids
    row = stored.where("county_parcel_id = 'P00007'").collect()[0]
    assert [s.sale_date for s in row.sales_history] == ["2020", "2010-01-01", "2001-05-01", "2001-05-01"]
    assert row.acreage_breakdown.other == 0.0

    keys = spark.createDataFrame([(i,) for i in [*ids[::2], "X", None]], "parcel_id string")
    monkeypatch.setattr(K, "PART_KEYS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        asked = K.asked_documents(stored, keys)
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert "hashpartitioning(county_parcel_id" not in plan
        assert sorted(r.county_parcel_id for r in asked.collect()) == ids[::2]
        # Folders with too many keys for that are joined, with the same documents.
        monkeypatch.setattr(K, "PART_KEYS", 22)
        asked = K.asked_documents(stored, keys)
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert sorted(r.county_parcel_id for r in asked.collect()) == ids[::2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_land_records_are_read_once_for_documents(spark):
    from checks import assessor_checks

    tables = assessor_checks.tables(spark, "/root/testdata/sf0.001")
    plan = D.assessor_documents(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_quantity") > 0 and plan.count("/lineitem.parquet") == 1


def test_duplicate_key_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    load_table(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k")
    with pytest.raises(DuplicateKeyError):
        load_table(spark.createDataFrame([("b", 1), ("b", 2)], "k string, v int"), path, "k")
    assert [r.k for r in spark.read.parquet(path).collect()] == ["a"]


def test_layer_documents(spark):
    schema = "accountno string, ord bigint, attributes map<string,string>"
    parcels = spark.createDataFrame([("R1", 2, {"pidn": "late"}), ("R1", 1, {"pidn": "p", "descript": "LOT 1, ELK, BLOCK 3", "address": "A", "owner_zip": "8"})], schema)
    buildings = spark.createDataFrame([("R1", i, {"impno": str(i), "sf": None, "age": ""}) for i in range(5)], schema)
    land = spark.createDataFrame([("R1", 1, {"landtype": "Agricultural / Residential", "landacres": "2.5"})], schema)
    doc = D.layer_documents(parcels, buildings, land).collect()[0]
    assert (doc.county_parcel_id, doc.mailing_address, doc.legal.subdivision, doc.legal.block) == ("p", "A, 8", "ELK", "3")
    assert doc.developments == [{"Building ID": str(i)} for i in range(5)]
    assert doc.acreage_breakdown.residential == 2.5 and doc.acreage_breakdown.agricultural == 0.0


def test_label_tables_have_all_labels():
    assert (len(D.IMPROVEMENT_LABELS), len(D.BUILDING_LABELS)) == (50, 67)


def test_duplicate_keys_and_metadata(tables):
    assert A.duplicate_keys(tables["parcels"]).count() == 0
    assert A.duplicate_keys(tables["sales"]).collect()[0].asDict() == {"county_parcel_id": "RP1", "rows": 3}
    dated = tables["parcels"].withColumn("last_updated", F.current_timestamp())
    meta = A.index_metadata(dated, "C", "S").collect()[0]
    assert (meta.county, meta.total_parcels, meta.source) == ("C", 2, "S")
    assert [r.county_parcel_id for r in A.parcel_index(dated).collect()] == ["RP1", "RP2"]


def test_documents_deal_wide_rows_by_key_before_lists_are_collected(spark):
    """Collected where they lay, a scan task sorted all of its wide rows at once."""
    from checks import assessor_checks
    from lotbook.operators.documents import assessor_documents

    tables = assessor_checks.tables(spark, "/root/testdata/sf0.001")
    plan = assessor_documents(tables)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    dealt_at = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line and "county_parcel_id" in line)
    assert not any("collect_list" in line for line in lines[dealt_at:])
