"""Sources, sinks and jobs on files."""

import json

import pytest
from pyspark.sql import functions as F

from lotbook.config import EXTRA_LAYERS
from lotbook.operators.assessor import TABLES
from lotbook.operators.standardize import standardize
from lotbook.plans import jobs
from lotbook.sinks import features as SF
from lotbook.sinks import tables as ST
from lotbook.sources import features as F_
from lotbook.sources import tables as T

SQUARE = [[[0, 0, 5], [4, 0, 5], [4, 4, 5], [0, 0, 5]]]


def feature(i, props, geometry="polygon"):
    geom = {"type": "Polygon", "coordinates": SQUARE} if geometry == "polygon" else geometry
    return {"type": "Feature", "id": i, "properties": props, "geometry": geom}


def write_lines(path, features, crs=None):
    lines = ["{", '  "type": "FeatureCollection",']
    if crs:
        lines.append(f'  "crs": {json.dumps({"type": "name", "properties": {"name": crs}})},')
    lines.append('  "features": [')
    body = [json.dumps(f, separators=(",", ":")) for f in features]
    lines += [f"    {line}{',' if i < len(body) - 1 else ''}" for i, line in enumerate(body)]
    path.write_text("\n".join([*lines, "  ]", "}", ""]))
    return str(path)


def test_feature_lines_and_document_agree(spark, tmp_path):
    features = [feature(i, {"pidn": str(i), "n": i, "none": None}) for i in range(5)] + [feature(9, {}, None)]
    lines = write_lines(tmp_path / "a.geojson", features, crs="EPSG:3738")
    whole = tmp_path / "b.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    a = F_.read_feature_lines(spark, lines, "x").drop("corrupt")
    b = F_.read_feature_document(spark, str(whole), "x")
    columns = ["feature_id", F.to_json("props").alias("p"), F.to_json("geom").alias("g")]
    rows = [tuple(r) for r in a.orderBy("src_ord").select(*columns).collect()]
    assert rows == [tuple(r) for r in b.orderBy("src_ord").select(*columns).collect()]
    assert len(rows) == 6 and rows[5][2] is None and '"n":"3"' in rows[3][1]
    assert F_.read_declared_crs(spark, lines, "x").collect()[0].crs_name == "EPSG:3738"


def test_small_blocks_keep_the_reading_order(spark, tmp_path):
    path = write_lines(tmp_path / "a.geojson", [feature(i, {"pidn": str(i)}) for i in range(300)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        df = F_.read_feature_lines(spark, path, "fremont_county_wy")
        assert df.select("src_ord.block").distinct().count() > 5
        out = standardize(df, bucket=F_.file_bucket()).select("global_parcel_uid", "county_parcel_id_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r[0]: r[1] for r in out} == {f"fremont_county_wy_{i + 1:06d}": str(i) for i in range(300)}


def test_corrupt_lines_are_set_apart(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text('{"type":"Feature","properties":{"a":"1"},"geometry":null},\n{"type":"Feature","prop\n')
    df = F_.read_feature_lines(spark, str(path), "x")
    assert df.where(F.col("corrupt").isNull()).count() == 1
    assert df.where(F.col("corrupt").isNotNull()).count() == 1


def test_json_records(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"Account #":"1","x":2}\n\n{"Account #":"3"}\n')
    (tmp_path / "a.json").write_text('[{"k":"1"},\n {"k":"2"}]')
    (tmp_path / "bad.json").write_text('{"nope": [1,2')
    lines = F_.read_json_records(spark, str(tmp_path / "l.jsonl")).orderBy("src_ord").collect()
    assert [dict(r.props) for r in lines] == [{"Account #": "1", "x": "2"}, {"Account #": "3"}]
    items = F_.read_json_records(spark, str(tmp_path / "a.json"), array=True).orderBy("src_ord").collect()
    assert [r.props["k"] for r in items] == ["1", "2"]
    with pytest.raises(Exception):
        F_.read_json_records(spark, str(tmp_path / "bad.json"), array=True).collect()


def test_text_decoding_falls_back(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("É".encode())
    (tmp_path / "l.txt").write_bytes("É".encode("latin-1"))
    out = F_.read_decoded_text(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in out) == ["É", "É"]


def test_absent_counties_are_reported(spark, tmp_path):
    path = write_lines(tmp_path / "a.geojson", [feature(1, {})])
    df, absent = F_.read_present(spark, {"here": path, "gone": str(tmp_path / "no")}, F_.read_feature_lines)
    assert absent == ["gone"] and df.count() == 1


def test_address_points(spark, tmp_path):
    path = write_lines(tmp_path / "p.geojson", [feature(1, {"FID": "1"}, {"type": "Point", "coordinates": [1.5, 2, 3]})])
    row = F_.read_address_points(spark, path).collect()[0]
    assert (row.px, row.py, row.props["FID"]) == (1.5, 2.0, "1")


def test_standardized_round_trip(spark, tmp_path):
    lines = write_lines(tmp_path / "a.geojson", [feature(1, {"pidn": "7", "ownername": "Ann"})])
    df = standardize(F_.read_feature_lines(spark, lines, "fremont_county_wy"), bucket=F_.file_bucket())
    SF.write_standardized(df, str(tmp_path / "s"))
    other = df.withColumn("county", F.lit("teton_county_wy"))
    SF.write_standardized(other, str(tmp_path / "s"))
    assert {r.county for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"fremont_county_wy", "teton_county_wy"}
    SF.write_feature_lines(df, str(tmp_path / "g"))
    text = spark.read.text(str(tmp_path / "g")).collect()[0].value
    out = json.loads(text)
    assert list(out) == ["type", "properties", "geometry"]
    assert out["properties"]["land_type/description"] is None and out["properties"]["owner_name"] == "Ann"
    assert out["geometry"]["coordinates"] == [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]]
    again = F_.read_feature_lines(spark, str(tmp_path / "g")).collect()[0]
    assert again.county == "fremont_county_wy" and again.props["owner_name"] == "Ann"


def test_merged_output_follows_input(spark, tmp_path):
    df = F_.read_feature_lines(spark, write_lines(tmp_path / "a.geojson", [feature(1, {"k": "v"})]), "x")
    SF.write_merged(df, str(tmp_path / "f"), as_features=True)
    SF.write_merged(df, str(tmp_path / "r"), as_features=False)
    assert json.loads(spark.read.text(str(tmp_path / "f")).collect()[0].value)["properties"] == {"k": "v"}
    assert json.loads(spark.read.text(str(tmp_path / "r")).collect()[0].value) == {"k": "v"}


def test_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    SF.write_split(df, F.col("ok"), str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def test_runs_latest_rollback_and_expiry(spark, tmp_path):
    base = str(tmp_path / "pub")
    for i in range(1, 8):
        ST.publish(spark.createDataFrame([(i,)], "v int"), base, f"20240101_00000{i}")

    def current():
        return [r.v for r in ST.latest(spark, base).collect()]

    assert current() == [7]
    ST.pin(spark, base, "20240101_000003")
    assert current() == [3]
    assert ST.expire_runs(spark, base, 5) == ["20240101_000001", "20240101_000002"]
    kept = sorted(r.run_ts for r in spark.read.parquet(f"{base}/runs").select("run_ts").distinct().collect())
    assert kept == [f"20240101_00000{i}" for i in range(3, 8)]
    ST.publish(spark.createDataFrame([(9,)], "v int"), base, "20240102_000000")
    assert current() == [9]


def test_dated_snapshots(spark, tmp_path):
    base = str(tmp_path / "d")
    ST.write_dated(spark.createDataFrame([("a", 1), ("b", 2)], "county string, v int"), base)
    day = spark.range(1).select(F.date_format(F.current_date(), "yyyyMMdd")).collect()[0][0]
    assert [r.v for r in ST.read_dated(spark, base, "b", day).collect()] == [2]
    ST.write_dated(spark.createDataFrame([("b", 3)], "county string, v int"), base)
    assert [r.v for r in ST.read_dated(spark, base, "b", day).collect()] == [3]
    assert [r.v for r in ST.read_dated(spark, base, "a", day).collect()] == [1]
    assert ST.dated_path("gs://x/", "b", "20240102") == "gs://x/b/ownership_data_20240102"


def test_frontier_and_counts(spark, one):
    rows = T.page_frontier(spark, "u", 243, 10, 2026, 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.chunk, []).append(r.page)
    assert sorted(p for ps in by.values() for p in ps) == list(range(1, 244))
    assert [len(by[c]) for c in range(10)] == [24] * 9 + [27]
    assert rows[0].url == "u?pageNumber=1&taxYear=2026&pageSize=100"
    assert one(T.result_count(F.lit("<b>24,254 results found"))) == 24254
    assert one(T.result_count(F.lit("none"))) is None
    assert one(T.page_count(F.lit(24254), 100)) == 243


def test_missing_files_and_catalogue(spark):
    present = spark.createDataFrame([(n,) for n in ["PCPARC00.DBF", "pcimpc00.dbf", "pclegl00.dbf", "pcland00.dbf", "pcsale00.dbf", "pcperm00.dbf"]], "file string")
    assert T.missing_files(spark, present).count() == 10
    assert T.layer_catalogue(spark).count() == 5 + len(EXTRA_LAYERS)


def test_layer_responses(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"features":[{"attributes":{"accountno":"R1","v":1}},{"attributes":{"accountno":"R2"}}]}\n{"error":{"code":400}}\n')
    rows = T.read_layer_responses(spark, str(path)).orderBy("ord").collect()
    assert [r.accountno for r in rows] == ["R1", "R2"] and rows[0].attributes["v"] == "1"


def test_nightly_refresh(spark, tmp_path):
    desc = "<table><tr><td>PIDN</td><td>22</td></tr><tr><td>Owner</td><td>Kim Lee</td></tr></table>"
    teton = write_lines(tmp_path / "t.geojson", [feature(1, {"description": desc})])
    lincoln = write_lines(tmp_path / "l.geojson", [feature(1, {"RWACCT": "R1", "OWNERSHIP": "Ann"}), feature(2, {"RWACCT": "R2"})])
    (tmp_path / "l.jsonl").write_text('{"Account #":"R1","Address":"old"}\n{"Account #":"R1","Address":"12 Elk","Description":null}\n')
    inputs = {
        "teton_county_wy": jobs.CountyInput(teton),
        "lincoln_county_wy": jobs.CountyInput(lincoln, str(tmp_path / "l.jsonl")),
        "sublette_county_wy": jobs.CountyInput(str(tmp_path / "absent")),
    }
    base = str(tmp_path / "base")
    failed = jobs.nightly_refresh(spark, inputs, base, "20240101_020000", 3)
    assert list(failed) == ["sublette_county_wy"]
    rows = {r.global_parcel_uid: r for r in ST.latest(spark, base).collect()}
    assert rows["teton_county_wy_000001"].owner_name == "Kim Lee"
    assert rows["lincoln_county_wy_000001"].physical_address == "12 Elk"
    assert rows["lincoln_county_wy_000002"].physical_address is None
    tokens = spark.read.parquet(f"{base}/search_index/postings")
    assert [r.uid for r in tokens.where("kind = 'word' and token = 'kim'").collect()] == ["teton_county_wy_000001"]
    counts = {r.county: r.features for r in jobs.county_counts(spark.read.parquet(f"{base}/standardized")).collect()}
    assert counts == {"teton_county_wy": 1, "lincoln_county_wy": 2, None: 3}


def test_unsupported_county_is_an_error(spark):
    with pytest.raises(ValueError, match="nowhere"):
        jobs.ownership(spark, {"nowhere": jobs.CountyInput("x")})


def test_assessor_job(spark, tmp_path):
    from lotbook.operators.assessor import TABLES

    for name, columns in TABLES.items():
        header = ",".join(s for s, _, _ in columns)
        values = ",".join("RP1" if t == "county_parcel_id" else "1" for _, t, _ in columns)
        (tmp_path / "src" / name).mkdir(parents=True)
        (tmp_path / "src" / name / "a.csv").write_text(f"{header}\n{values}\n")
    jobs.assessor_job(spark, str(tmp_path / "src"), str(tmp_path / "out"), "C")
    doc = spark.read.parquet(str(tmp_path / "out" / "documents")).collect()[0]
    assert doc.county_parcel_id == "RP1" and len(doc.developments) == 1 and doc.acreage_breakdown.residential == 1.0
    assert spark.read.json(str(tmp_path / "out" / "parcel_index" / "metadata")).collect()[0].total_parcels == 1


LIST_PAGE = (
    "<div class='ibox'><dl><dt>Account #</dt><dd><a>R1</a></dd><dt>Address</dt><dd>{}</dd></dl></div>"
    "<div class='ibox'><dl><dt>Address</dt><dd>lost</dd></dl></div>"
)


def test_list_page_job_feeds_the_address_join(spark, tmp_path):
    pages = [(1, "u", LIST_PAGE.format("old")), (2, "u", LIST_PAGE.format("new"))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    jobs.list_page_job(spark, str(tmp_path / "p"), str(tmp_path / "g"), str(tmp_path / "b"))
    rows = F_.read_json_records(spark, str(tmp_path / "g" / "records")).collect()
    assert [dict(r.props) for r in rows] == [{"Account #": "R1", "Address": "new"}]
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def test_page_documents_job(spark, tmp_path):
    pages = [(1, "u1", "<table><tr><td>PIDN</td><td>7</td></tr></table>"), (2, "u2", "<dl><dt>Lot</dt><dd>3</dd></dl>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    requests = spark.createDataFrame([(1, "u1", ""), (2, "u2", "Lincoln")], "page_id bigint, url string, county string")
    jobs.page_documents_job(spark, requests, str(tmp_path / "p"), str(tmp_path / "t"))
    out = {r.url: r for r in spark.read.parquet(str(tmp_path / "t" / "documents")).collect()}
    assert out["u1"].county_parcel_id == "7" and out["u2"].legal.lot == "3"


def test_part_files_keep_the_last_record(spark, tmp_path):
    from lotbook.operators.merge import last_records

    (tmp_path / "part_0.jsonl").write_text('{"Account #":"1","v":"a"}\n{"Account #":"2","v":"b"}\n{"v":"none"}\n')
    (tmp_path / "part_1.jsonl").write_text('{"Account #":"1","v":"c"}\n')
    rows = last_records(F_.read_json_records(spark, str(tmp_path)), "Account #").collect()
    assert sorted((r.props["Account #"], r.props["v"]) for r in rows) == [("1", "c"), ("2", "b")]


def test_a_collection_on_one_line_is_all_its_features(spark, tmp_path):
    def feature(i):
        point = '{"type": "Point", "coordinates": [1, 2]}'
        return f'{{"type": "Feature", "id": "{i}", "properties": {{"n": "{i}"}}, "geometry": {point}}}'

    head, five = '{"type": "FeatureCollection", "features": [', [feature(i) for i in range(5)]
    (tmp_path / "one.geojson").write_text(head + ", ".join(five) + "]}\n")
    (tmp_path / "lines.geojson").write_text(head + "\n" + ",\n".join(five) + "\n]}\n")
    (tmp_path / "bad.geojson").write_text(head + "\n" + five[0] + ",\n" + '{"type": "Feat\n]}\n')
    for name, good, bad in [("one", 5, 0), ("lines", 5, 0), ("bad", 1, 1)]:
        rows = F_.read_feature_lines(spark, str(tmp_path / f"{name}.geojson"), "c").orderBy("src_ord").collect()
        fine = [r for r in rows if r.corrupt is None and r.feature_id is not None]
        assert [r.feature_id for r in fine] == [str(i) for i in range(good)], name
        assert sum(r.corrupt is not None for r in rows) == bad


def test_positions_follow_the_source_over_files(spark, tmp_path):
    names = [source for source, _, _ in TABLES["sales"]]
    head = ",".join(names) + "\n"
    row = lambda v: ",".join([v, *[""] * (len(names) - 1)]) + "\n"
    (tmp_path / "a.csv").write_text(head + row("first"))
    (tmp_path / "b.csv").write_text(head + "".join(row(f"r{i:05}") for i in range(5000)))
    rows = T.read_assessor(spark, str(tmp_path), "sales").orderBy("ord").collect()
    assert [r[0] for r in rows] == ["first", *[f"r{i:05}" for i in range(5000)]]
