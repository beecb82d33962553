"""Nightly runs: rejects are kept, counties fail alone, runs show and go back as one."""

import json

import pytest
from pyspark.sql import functions as F

from lotbook.plans import jobs
from lotbook.sinks import runs
from lotbook.sinks import tables as ST


def feature(i, props):
    return json.dumps({"type": "Feature", "id": str(i), "properties": props, "geometry": None})


def collection(path, features):
    path.write_text('{"type":"FeatureCollection","features":[' + ",".join(features) + "]}")
    return str(path)


def teton(tmp_path, owner, extra=()):
    desc = f"<table><tr><td>PIDN</td><td>22</td></tr><tr><td>Owner</td><td>{owner}</td></tr></table>"
    return collection(tmp_path / "t.json", [feature(1, {"description": desc}), *extra])


def owners(spark, base):
    return {r.global_parcel_uid: r.owner_name for r in ST.latest(spark, base).collect()}


def words(spark, base):
    rows = runs.read_table(spark, base, "search_index/postings").where("kind = 'word'")
    return {r.token for r in rows.collect()}


def test_rejects_are_counted_and_kept(spark, tmp_path):
    bad = ['{"type":"Feature","properties":{"a": oops},"geometry":null}', '{"type":"Thing"}']
    lincoln = [feature(1, {"RWACCT": "R1", "OWNERSHIP": "Ann"}), feature(2, {"OWNERSHIP": "no key"})]
    (tmp_path / "l.jsonl").write_text('{"Account #":"R1","Address":"12 Elk"}\n{"Address":"lost"}\n')
    inputs = {
        "teton_county_wy": jobs.CountyInput(teton(tmp_path, "Kim Lee", bad)),
        "lincoln_county_wy": jobs.CountyInput(collection(tmp_path / "l.json", lincoln), str(tmp_path / "l.jsonl")),
        "sublette_county_wy": jobs.CountyInput(str(tmp_path / "absent")),
    }
    base = str(tmp_path / "base")
    assert list(jobs.nightly_refresh(spark, inputs, base, "20240101_020000", 3)) == ["sublette_county_wy"]
    report = {r.county: r for r in spark.read.parquet(f"{base}/reports").collect()}
    assert (report["teton_county_wy"].features, report["teton_county_wy"].rejects) == (1, 2)
    assert (report["lincoln_county_wy"].features, report["lincoln_county_wy"].rejects) == (1, 2)
    assert report["sublette_county_wy"].features is None and report["sublette_county_wy"].error
    lost = spark.read.parquet(f"{base}/quarantine")
    got = sorted((r.county, r.source, r.reason) for r in lost.collect())
    assert got == [
        ("lincoln_county_wy", "addresses", "no key"), ("lincoln_county_wy", "parcels", "no key"),
        ("teton_county_wy", "parcels", "no feature"), ("teton_county_wy", "parcels", "no feature"),
    ]
    assert lost.where(F.col("content").contains("oops")).count() == 1


def test_a_county_that_fails_at_run_time_keeps_its_old_rows(spark, tmp_path):
    base = str(tmp_path / "base")
    fremont = collection(tmp_path / "f.json", [feature(1, {"ownername": "Old Owner"})])
    inputs = {"teton_county_wy": jobs.CountyInput(teton(tmp_path, "Kim Lee")), "fremont_county_wy": jobs.CountyInput(fremont)}
    assert jobs.nightly_refresh(spark, inputs, base, "20240101_020000", 2) == {}
    assert words(spark, base) >= {"kim", "old"}
    fails = F.when(F.length(F.raise_error(F.lit("broken record"))) > 0, F.col("props"))
    inputs = {
        "teton_county_wy": jobs.CountyInput(teton(tmp_path, "Ann Day")),
        "fremont_county_wy": jobs.CountyInput(fremont, extra_stages=[lambda df: df.withColumn("props", fails)]),
    }
    failed = jobs.nightly_refresh(spark, inputs, base, "20240102_020000", 2)
    assert list(failed) == ["fremont_county_wy"]
    assert owners(spark, base) == {"teton_county_wy_000001": "Ann Day", "fremont_county_wy_000001": "Old Owner"}
    shown = {c: r for t, c, r in runs.manifest(spark, base) if t == "standardized"}
    assert shown == {"teton_county_wy": "20240102_020000", "fremont_county_wy": "20240101_020000"}
    assert "ann" in words(spark, base) and "old" in words(spark, base) and "kim" not in words(spark, base)
    # Going back moves rows and index together.
    ST.pin(spark, base, "20240101_020000")
    assert owners(spark, base)["teton_county_wy_000001"] == "Kim Lee" and "kim" in words(spark, base)
    ST.unpin(spark, base)
    # Two runs later the first is not shown, but Fremont's rows of it still are.
    inputs = {"teton_county_wy": jobs.CountyInput(teton(tmp_path, "Bo Fox"))}
    jobs.nightly_refresh(spark, inputs, base, "20240103_020000", 2)
    assert ST.list_folders(spark, f"{base}/manifests", "run_ts") == ["20240102_020000", "20240103_020000"]
    assert owners(spark, base) == {"teton_county_wy_000001": "Bo Fox", "fremont_county_wy_000001": "Old Owner"}
    assert ST.list_folders(spark, f"{base}/search_index/postings", "run_ts") == ["20240102_020000", "20240103_020000"]


def test_a_killed_run_is_not_seen(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "base")
    inputs = {"teton_county_wy": jobs.CountyInput(teton(tmp_path, "Kim Lee"))}
    jobs.nightly_refresh(spark, inputs, base, "20240101_020000", 2)
    teton(tmp_path, "Ann Day")

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(jobs, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        jobs.nightly_refresh(spark, inputs, base, "20240102_020000", 2)
    assert owners(spark, base) == {"teton_county_wy_000001": "Kim Lee"} and "kim" in words(spark, base)


def test_unread_pages_are_listed(spark, tmp_path, monkeypatch):
    pages = [(1, "u", "<div class='ibox'><dl><dt>Account #</dt><dd><a>R1</a></dd></dl></div>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    whole = jobs.page_elements

    def one_more(frame):
        rows = whole(frame)
        lost = rows.limit(1).withColumn("kind", F.lit(jobs.ERROR)).withColumn("text", F.lit("unreadable"))
        return rows.unionByName(lost.withColumn("page_id", F.lit(2).cast("bigint")))

    monkeypatch.setattr(jobs, "page_elements", one_more)
    jobs.list_page_job(spark, str(tmp_path / "p"), str(tmp_path / "g"), str(tmp_path / "b"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "g/unread_pages")).select("page_id", "error").collect()] == [(2, "unreadable")]
