"""The refresh jobs.

A county is a list of frame-to-frame stages. A run builds one lazy union over all
counties and writes it once; nothing is materialized between stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lotbook.config import COUNTIES, County
from lotbook.operators.assessor import TABLES, typed_table
from lotbook.operators.documents import assessor_documents
from lotbook.operators.extract import extract_documents, routed_elements
from lotbook.operators.layers import layer_counts, layer_cover, layer_features
from lotbook.operators.lookup import write_documents
from lotbook.operators.merge import join_overwrite, split_keyed
from lotbook.operators.page_blocks import list_page_records
from lotbook.operators.search_index import StoredIndex, search_entries
from lotbook.operators.standardize import parse_descriptions, standardize
from lotbook.sinks.features import INDEX_TABLES, write_search_index
from lotbook.sinks.runs import (
    commit,
    drop_unnamed,
    manifest,
    read_table,
    write_county,
    write_table,
)
from lotbook.sinks.tables import load_table, unpin, write_parcel_index
from lotbook.sources.collections import read_collections
from lotbook.sources.features import file_bucket, read_feature_lines, read_json_records
from lotbook.sources.layers import read_layers
from lotbook.sources.pages import (
    ERROR,
    page_elements,
    page_errors,
    read_elements,
    read_pages,
    write_elements,
)
from lotbook.sources.tables import read_assessor

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class CountyInput:
    """Where a county's landed layers are.

    ``lines`` tells that every line of the parcels holds one feature or a whole collection; such
    files are read without a shuffle. Else any layout is read.
    """

    parcels: str
    addresses: str | None = None
    extra_stages: list[Stage] = field(default_factory=list)
    lines: bool = False


REJECTS = "county string, source string, reason string, content string"


def _rejected(df: DataFrame, county: str, source: str, reason: str, content: Column) -> DataFrame:
    values = {"county": county, "source": source, "reason": reason}
    return df.select(*[F.lit(v).alias(k) for k, v in values.items()], content.alias("content"))


def county_rows(
    spark: SparkSession, county: County, inputs: CountyInput
) -> tuple[DataFrame, DataFrame]:
    """A county's features after its stages, and what was rejected on the way.

    Rejected are texts that are no feature, and records without the property they are to be
    joined by. Stages: parse descriptions, join list-page records, extras.
    """
    read = read_feature_lines if inputs.lines else read_collections
    rows = read(spark, inputs.parcels, county.code)
    corrupt = rows.where(F.col("corrupt").isNotNull())
    rejects = _rejected(corrupt, county.code, "parcels", "no feature", F.col("corrupt"))
    df = rows.where(F.col("corrupt").isNull()).drop("corrupt")
    if county.parse_description:
        df = parse_descriptions(df)
    if county.address_join is not None and inputs.addresses is not None:
        parcel_key, address_key = county.address_join
        df, keyless = split_keyed(df, parcel_key)
        addresses, lost = split_keyed(read_json_records(spark, inputs.addresses), address_key)
        text = F.to_json("props")
        for source, bad in (("parcels", keyless), ("addresses", lost)):
            rejects = rejects.unionByName(_rejected(bad, county.code, source, "no key", text))
        df = join_overwrite(df, addresses, parcel_key, address_key).drop("matched")
    for stage in inputs.extra_stages:
        df = df.transform(stage)
    return df, rejects


def county_features(spark: SparkSession, county: County, inputs: CountyInput) -> DataFrame:
    return county_rows(spark, county, inputs)[0]


def unknown_counties(wanted: list[str], registry: dict[str, County] = COUNTIES) -> list[str]:
    return [code for code in wanted if code not in registry]


def ownership(
    spark: SparkSession,
    inputs: dict[str, CountyInput],
    registry: dict[str, County] = COUNTIES,
) -> tuple[DataFrame | None, dict[str, str]]:
    """All counties as one standardized frame, and the counties that could not be planned.

    A county whose files are missing or whose stages do not analyze is reported and
    does not stop the others.
    """
    unknown = unknown_counties(list(inputs), registry)
    if unknown:
        raise ValueError(f"unsupported counties: {', '.join(unknown)}")
    features, failed = None, {}
    for code, county_inputs in inputs.items():
        try:
            df = county_features(spark, registry[code], county_inputs)
            df.schema  # analysis errors surface here
        except Exception as error:  # noqa: BLE001 - reported per county
            failed[code] = str(error).splitlines()[0]
            continue
        features = df if features is None else features.unionByName(df)
    if features is None:
        return None, failed
    return standardize(features, registry, bucket=file_bucket()), failed


def county_counts(standardized: DataFrame) -> DataFrame:
    """Features per county, the total in the row whose county is null."""
    return (
        standardized.groupBy("county")
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("county")
        .agg(F.sum("n").alias("features"))
    )


def search_index_job(spark: SparkSession, standardized_path: str, index_path: str) -> None:
    """Search entries and postings from the standardized table."""
    write_search_index(search_entries(spark.read.parquet(standardized_path)), index_path)


def run_index(spark: SparkSession, base: str) -> StoredIndex:
    """The search index of the run that readers see."""
    return StoredIndex(*(read_table(spark, base, f"search_index/{t}") for t in INDEX_TABLES))


def assessor_job(
    spark: SparkSession, source: str, target: str, county: str, fmt: str = "csv"
) -> None:
    """Load the six tables, the parcel index and the nested documents."""
    raw = {name: read_assessor(spark, f"{source}/{name}", name, fmt) for name in TABLES}
    for name, df in raw.items():
        key = "county_parcel_id" if name == "parcels" else None
        load_table(typed_table(df, name, keep=("ord",)), f"{target}/{name}", key)
    loaded = {name: spark.read.parquet(f"{target}/{name}") for name in TABLES}
    write_parcel_index(loaded["parcels"], f"{target}/parcel_index", county, source)
    documents = assessor_documents(
        {**loaded, "parcels": loaded["parcels"].drop("ord", "last_updated")}, by_folder=True
    )
    write_documents(documents, f"{target}/documents", by_folder=True)


def list_page_job(spark: SparkSession, pages_path: str, good_path: str, bad_path: str) -> None:
    """List pages to account records, one per account; unusable boxes to a quarantine.

    Pages that could not be read are listed in ``unread_pages`` beside the records.
    """
    elements = page_elements(read_pages(spark, pages_path))
    kept = elements.where(F.col("kind").isin("dt", "dd", "div", ERROR))
    write_elements(kept, f"{good_path}/elements")
    stored = read_elements(spark, f"{good_path}/elements")
    page_errors(stored).write.mode("overwrite").json(f"{good_path}/unread_pages")
    records = list_page_records(stored.where(F.col("kind") != ERROR))
    last = F.struct("page_id", "box")
    good = records.where("valid").groupBy("account").agg(F.max_by("record", last).alias("record"))
    good.select(F.to_json("record").alias("value")).write.mode("overwrite").text(
        f"{good_path}/records"
    )
    records.where("not valid").select("page_id", "box", "record").write.mode("overwrite").json(
        bad_path
    )


def page_documents_job(
    spark: SparkSession, requests: DataFrame, pages_path: str, target: str
) -> None:
    """Saved pages to canonical documents.

    ``requests`` has ``page_id, url, county``. Element rows are written by route and
    kind first: pages are parsed once, and each rule reads only what it uses.
    """
    elements = routed_elements(requests, page_elements(read_pages(spark, pages_path)))
    elements.write.mode("overwrite").partitionBy("route", "kind").parquet(f"{target}/elements")
    errors = page_errors(spark.read.parquet(f"{target}/elements"))
    errors.write.mode("overwrite").json(f"{target}/unread_pages")
    stored = spark.read.parquet(f"{target}/elements")
    documents = extract_documents(requests, stored).join(
        requests.select("page_id", "url"), "page_id"
    )
    documents.write.mode("overwrite").parquet(f"{target}/documents")


def layers_job(spark: SparkSession, base: str, target: str) -> None:
    """Landed layers to features by data type, their map tiles by band, rejects and counts.

    Layers are under ``base/county=.../layer=.../``. The counts are written last.
    """
    rows, rejects = read_layers(spark, base)
    layer_features(rows).write.mode("overwrite").partitionBy("data_type").parquet(
        f"{target}/features"
    )
    features = spark.read.parquet(f"{target}/features")
    layer_cover(features).write.mode("overwrite").partitionBy("band").parquet(f"{target}/tiles")
    rejects.write.mode("overwrite").parquet(f"{target}/quarantine")
    lost = spark.read.parquet(f"{target}/quarantine")
    layer_counts(features, lost).write.mode("overwrite").parquet(f"{target}/counts")


def refresh_county(
    spark: SparkSession, county: County, inputs: CountyInput, base: str, run_ts: str
) -> tuple[int, int]:
    """Standardized rows and rejects of one county, written for a run; returns their numbers."""
    features, rejects = county_rows(spark, county, inputs)
    rows = standardize(features, {county.code: county}, bucket=file_bucket())
    counted = Observation()
    rows = rows.observe(counted, F.count(F.lit(1)).alias("n"))
    write_county(rows, base, "standardized", run_ts, county.code)
    lost = Observation()
    rejects = rejects.observe(lost, F.count(F.lit(1)).alias("n"))
    write_county(rejects, base, "quarantine", run_ts, county.code)
    return counted.get["n"], lost.get["n"]


def nightly_refresh(
    spark: SparkSession,
    inputs: dict[str, CountyInput],
    base: str,
    run_ts: str,
    keep: int,
    registry: dict[str, County] = COUNTIES,
) -> dict[str, str]:
    """A run of all counties and their search index, shown at once; returns failed counties.

    A county that fails, when planned or when run, keeps the rows of the run before, under
    that run's name; its reason is in ``reports``, as are the numbers of rows and rejects of
    the others. The run shows when its manifest is written, after all tables. Runs beyond
    ``keep`` are no longer shown, and rows that no shown run names are dropped.
    """
    unknown = unknown_counties(list(inputs), registry)
    if unknown:
        raise ValueError(f"unsupported counties: {', '.join(unknown)}")
    failed: dict[str, str] = {}
    shown = {c: r for t, c, r in manifest(spark, base) if t == "standardized"}
    report = []
    for code, county_inputs in inputs.items():
        try:
            good, bad = refresh_county(spark, registry[code], county_inputs, base, run_ts)
            shown[code] = run_ts
            report.append((code, good, bad, None))
        except Exception as error:  # noqa: BLE001 - reported per county
            failed[code] = str(error).splitlines()[0]
            report.append((code, None, None, failed[code]))
    reports = spark.createDataFrame(report, "county string, features long, rejects long, error string")
    write_table(reports, base, "reports", run_ts)
    if not shown:
        return failed
    rows = [("standardized", code, run) for code, run in shown.items()]
    rows += [(f"search_index/{part}", None, run_ts) for part in INDEX_TABLES]
    # The index is built from the rows that this run is going to show.
    parts = [
        spark.read.parquet(f"{base}/standardized/run_ts={r}/county={c}").withColumn(
            "county", F.lit(c)
        )
        for c, r in shown.items()
    ]
    standardized = reduce(DataFrame.unionByName, parts)
    write_search_index(search_entries(standardized), f"{base}/search_index", f"run_ts={run_ts}")
    commit(spark, base, run_ts, rows)
    unpin(spark, base)
    drop_unnamed(spark, base, keep)
    return failed
