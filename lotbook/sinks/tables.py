"""Assessor table loads and snapshot publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.operators.assessor import duplicate_keys, index_metadata, parcel_index
from lotbook.operators.snapshots import KEEP_RUNS, retained_runs
from lotbook.sinks import runs


class DuplicateKeyError(ValueError):
    """The table to load breaks its primary key."""


def load_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """Full refresh of one table; with ``key`` a duplicate aborts and old rows stay."""
    if key is not None:
        broken = duplicate_keys(df, key).take(1)
        if broken:
            raise DuplicateKeyError(f"duplicate {key}: {broken[0][key]!r}")
    df.write.mode("overwrite").parquet(path)


def write_parcel_index(parcels: DataFrame, path: str, county: str, source: str) -> None:
    """The sorted lookup list and its one-row metadata envelope."""
    parcel_index(parcels).write.mode("overwrite").parquet(f"{path}/parcels")
    index_metadata(parcels, county, source).write.mode("overwrite").json(f"{path}/metadata")


def dated_path(base: str, county: str, day: str) -> str:
    """``base/county/ownership_data_YYYYMMDD``."""
    return f"{base.rstrip('/')}/{county}/ownership_data_{day}"


def write_dated(df: DataFrame, base: str) -> None:
    """Write under ``county=/snapshot_date=`` of today; a rerun replaces the day's rows."""
    dated = df.withColumn("snapshot_date", F.date_format(F.current_date(), "yyyyMMdd"))
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("county", "snapshot_date")
        .parquet(base)
    )


def read_dated(spark: SparkSession, base: str, county: str, day: str) -> DataFrame:
    """One county's snapshot of one day, by partition pruning."""
    table = spark.read.parquet(base)
    return table.where((F.col("county") == county) & (F.col("snapshot_date") == day))


def publish(df: DataFrame, base: str, run_ts: str) -> None:
    """Write a run; readers of ``latest`` see it once its partition is complete."""
    (
        df.withColumn("run_ts", F.lit(run_ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_ts")
        .parquet(f"{base}/runs")
    )
    unpin(df.sparkSession, base)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def list_folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from its folders; no data is read."""
    files, target = _folder(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return sorted(n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}="))


def delete_folder(spark: SparkSession, path: str) -> None:
    files, target = _folder(spark, path)
    files.delete(target, True)


def list_runs(spark: SparkSession, base: str) -> list[str]:
    """Published runs: one folder per night."""
    return list_folders(spark, f"{base}/runs", "run_ts")


def pin(spark: SparkSession, base: str, run_ts: str) -> None:
    """Point readers at an earlier run until the next publish."""
    spark.createDataFrame([(run_ts,)], "run_ts string").write.mode("overwrite").parquet(
        f"{base}/pinned"
    )


def unpin(spark: SparkSession, base: str) -> None:
    spark.createDataFrame([], "run_ts string").write.mode("overwrite").parquet(f"{base}/pinned")


def latest(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the pinned run if it is still there, else of the newest.

    Where runs have manifests, the standardized rows that the run shows.
    """
    if runs.current_run_ts(spark, base) is not None:
        return runs.read_table(spark, base, "standardized")
    return _latest_published(spark, base)


def _latest_published(spark: SparkSession, base: str) -> DataFrame:
    published = list_runs(spark, base)
    pinned = [r.run_ts for r in spark.read.parquet(f"{base}/pinned").take(1)]
    run = pinned[0] if pinned and pinned[0] in published else max(published)
    return spark.read.parquet(f"{base}/runs").where(F.col("run_ts").cast("string") == run)


def expire_runs(spark: SparkSession, base: str, keep: int = KEEP_RUNS) -> list[str]:
    """Drop all but the newest runs; returns the dropped ones."""
    listed = spark.createDataFrame([(r,) for r in list_runs(spark, base)], "run_ts string")
    old = [r.run_ts for r in retained_runs(listed, keep).where(~F.col("kept")).collect()]
    for run in old:
        files, target = _folder(spark, f"{base}/runs/run_ts={run}")
        files.delete(target, True)
    return sorted(old)
