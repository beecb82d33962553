"""Search scores, modes and skew."""

import pytest
from pyspark.sql import functions as F

from lotbook.operators import search as S
from lotbook.operators import search_index as X
from lotbook.schemas import SEARCH_REQUEST

ENTRY = (
    "global_parcel_uid string, pidn string, owner string, mailing_address string, physical_address string, "
    "county string, state string, bbox array<double>, clerk_rec string, property_det string, tax_info string"
)
SMITH = ("teton_county_wy_000001", "R-0012", "Smith, John & Mary", "PO Box 12", "100 Main St", "Teton County", "WY",
         [-110.8, 43.4, -110.78, 43.42], "link", "", "")
OTHER = ("fremont_county_wy_000001", "Q-77", "", "", "", "Fremont County", "WY", None, "", "", "")
TETON = ["teton_county_wy"]


@pytest.fixture(scope="module")
def prepared(spark):
    return X.prepare_entries(spark.createDataFrame([SMITH, OTHER], ENTRY)).cache()


def run(spark, prepared, q, counties=None, fields=None, lon=None, lat=None, rows=None, **options):
    request = spark.createDataFrame([(1, q, counties, fields, lon, lat, rows)], SEARCH_REQUEST)
    return {r.uid: r.score for r in S.search(request, prepared, **options).collect()}


@pytest.mark.parametrize(
    "q, indexed, scan",
    [
        ("john smith", 875, 800),
        ("main", 375, 300),
        ("mit", None, 1000),
        ("r-0012", None, 0),
        ("smith john mary", 1075, 1000),
        ("x y", None, 550),  # inside "box" and "mary"
        ("qq zz", None, 0),
    ],
)
def test_worked_scores(spark, prepared, q, indexed, scan):
    assert run(spark, prepared, q).get(SMITH[0]) == indexed
    assert run(spark, prepared, q, TETON).get(SMITH[0], 0) == scan


def test_cleaned_query(spark, prepared):
    assert run(spark, prepared, "r-0012", clean_query=True) == {SMITH[0]: 1075}


def test_chosen_fields(spark, prepared):
    assert run(spark, prepared, "0012", TETON, ["pidn"]) == {SMITH[0]: 400}
    assert run(spark, prepared, "smith", TETON, ["Owner", "county"]) == {SMITH[0]: 500}
    assert run(spark, prepared, "eton cou", TETON, ["county"]) == {SMITH[0]: 200}


@pytest.mark.parametrize("lon, boost", [(-110.795, 1000), (-110.85, 500), (-111.1, 100), (-112.0, 0)])
def test_near_boost(spark, prepared, lon, boost):
    assert run(spark, prepared, "main", TETON, lon=lon, lat=43.41) == {SMITH[0]: 300 + boost}


def test_blank_requests_and_unknown_county(spark, prepared):
    assert run(spark, prepared, "  ") == {}
    assert run(spark, prepared, "smith", ["park_county_wy"]) == {}


def many(spark, n):
    df = spark.range(n).select(
        F.concat(F.lit("teton_county_wy_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("global_parcel_uid"),
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("pidn"),
        F.concat(F.lit("Family Trust "), (F.col("id") % 7).cast("string")).alias("owner"),
        F.lit("").alias("mailing_address"), F.lit("").alias("physical_address"), F.lit("Teton County").alias("county"),
        F.lit("WY").alias("state"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("").alias("clerk_rec"),
        F.lit("").alias("property_det"), F.lit("").alias("tax_info"),
    )
    return X.prepare_entries(df)


def test_cap_limit_and_ties(spark):
    entries = many(spark, 500)
    requests = spark.createDataFrame(
        [(1, "trust", None, None, None, None, None), (2, "trust", None, None, None, None, 3), (3, "trust", TETON, None, None, None, 900)],
        SEARCH_REQUEST,
    )
    out = S.search(requests, entries).collect()
    by = {q: sorted((r.rank, r.uid) for r in out if r.qid == q) for q in (1, 2, 3)}
    assert [len(by[q]) for q in (1, 2, 3)] == [200, 3, 200]
    assert by[1][:3] == by[2] == by[3][:3]
    assert [u for _, u in by[2]] == [f"teton_county_wy_{i:06d}" for i in range(3)]


def test_repeated_requests_answer_each(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_REQUESTS", 5)
    entries = many(spark, 20)
    requests = spark.range(40).select(
        F.col("id").alias("qid"), F.lit("Trust 1 ").alias("q"), F.lit(None).cast("array<string>").alias("counties"),
        F.lit(None).cast("array<string>").alias("fields"), F.lit(None).cast("double").alias("lon"),
        F.lit(None).cast("double").alias("lat"), F.lit(2).alias("max_rows"),
    )
    out = S.search(requests, entries).groupBy("qid").count().collect()
    assert len(out) == 40 and {r["count"] for r in out} == {2}


def test_scan_finds_short_and_inner_substrings(spark, prepared):
    # every substring of a field must be found by the scan
    for q in ["j", "oh", "ohn", "ohn & m", "box 1", "0012", "ary"]:
        found = run(spark, prepared, q, TETON)
        text = "smith john mary\nr 0012\npo box 12\n100 main st"
        assert (SMITH[0] in found) == any(w in text for w in q.split())


def test_written_index_gives_the_same_answer(spark, prepared):
    index = X.postings(prepared)
    assert run(spark, prepared, "john smith", index=index) == run(spark, prepared, "john smith")


def test_stored_index_gives_the_same_answers_and_reads_its_folders_only(spark, prepared, tmp_path):
    from lotbook.sinks.features import read_search_index, write_search_index

    write_search_index(prepared.drop("uid", "county_code"), str(tmp_path))
    index = read_search_index(spark, str(tmp_path))
    assert index.entries.count() == prepared.count()
    for q in ["john smith", "j", "oh", "ohn & m", "box 1", "0012", "ary", "zzz", "zzz main", "r 0012"]:
        for counties in (None, TETON):
            args = (q, counties) if counties else (q,)
            assert run(spark, index.entries, *args, index=index) == run(spark, prepared, *args), q
    # The rarest key of a word decides, and a word with an unknown key is not looked up.
    request = spark.createDataFrame([(1, "smith qqsmith", TETON, None, None, None, None)], SEARCH_REQUEST)
    probes = X.rare_gram_probes(S.signed_requests(request), index.gram_counts).collect()
    assert len(probes) == 1 and probes[0].gram in "smith"
    plan = S.candidates(S.signed_requests(request), index.entries, index)
    text = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "bucket#" in text.split("PartitionFilters: [")[1]


def test_stats(spark, prepared):
    sizes = {r.kind: r.tokens for r in X.index_sizes(X.postings(prepared)).collect()}
    # "r 0012" has prefixes of 3..6 characters, "q 77" of 3 and 4
    assert sizes == {"owner": 1, "parcel": 6, "address": 2, "word": 6}
    stats = {r.county: r.entries for r in X.search_stats(prepared).collect()}
    assert stats == {"Teton County": 1, "Fremont County": 1, None: 2}


def test_no_nested_loop(spark, prepared):
    request = spark.createDataFrame([(1, "a", None, None, None, None, None)], SEARCH_REQUEST)
    plan = S.search(request, prepared)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_substring_keys_join_the_fields_once_per_entry(spark, prepared):
    plan = X.gram_postings(prepared)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1
    texts = spark.createDataFrame([(t,) for t in ("", "a", "ab", "abcab", "\u00e4 b\n\u00e4 b")], "t string")
    for row in texts.select("t", X.grams(F.col("t")).alias("g")).collect():
        want = {row.t[i : i + n] for n in (1, 2, 3) for i in range(len(row.t) - n + 1)}
        assert set(row.g) == want and len(row.g) == len(want)


def test_index_is_written_without_sampling_its_keys(spark, prepared, tmp_path, monkeypatch):
    """Ranges are sampled, which made every key of every entry twice."""
    from pyspark.sql import DataFrame

    from lotbook.sinks.features import write_search_index

    kind = type(prepared)
    for owner in {kind, DataFrame}:
        monkeypatch.setattr(owner, "repartitionByRange", None, raising=False)
    write_search_index(prepared.drop("uid", "county_code"), str(tmp_path))
