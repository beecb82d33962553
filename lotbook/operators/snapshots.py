"""Dated runs: which one is current, which ones are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Runs kept in production and in tests.
KEEP_RUNS = 5
KEEP_TEST_RUNS = 3


def run_list(snapshots: DataFrame) -> DataFrame:
    """Distinct runs; a partition column of the snapshot table, so a small frame."""
    return snapshots.select("run_ts").distinct()


def retained_runs(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """Each run with its age rank and whether it is kept.

    ``runs`` has one row per run, not per record: its length is the number of nights.
    """
    newest_first = Window.orderBy(F.col("run_ts").desc())
    return runs.withColumn("age", F.dense_rank().over(newest_first)).withColumn(
        "kept", F.col("age") <= keep
    )


def current_run(runs: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """One row: the pinned run if it is still there, else the newest."""
    if pinned is None:
        return runs.agg(F.max("run_ts").alias("run_ts"))
    marked = runs.join(
        F.broadcast(pinned.select("run_ts").distinct().withColumn("_pin", F.lit(True))),
        "run_ts",
        "left",
    )
    return marked.agg(
        F.coalesce(F.max(F.when(F.col("_pin"), F.col("run_ts"))), F.max("run_ts")).alias("run_ts")
    )


def current_snapshot(snapshots: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Rows of the current run. The run side has a single row."""
    return snapshots.join(F.broadcast(current_run(run_list(snapshots), pinned)), "run_ts")
