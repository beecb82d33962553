"""Runs of several tables that appear, and go back, together.

A run writes its tables beside those of earlier runs and its manifest last: for each table
and county the run whose rows count. Readers start at the manifest, so a run that was
killed, or a county that failed, leaves what was there before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table_name string, county string, data_run string"


def write_county(df: DataFrame, base: str, table: str, run_ts: str, county: str) -> None:
    """A county's rows of a run, in a folder of their own."""
    path = f"{base}/{table}/run_ts={run_ts}/county={county}"
    df.drop("county").write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, base: str, table: str, run_ts: str) -> None:
    """A table of a run that has no counties of its own."""
    df.write.mode("overwrite").parquet(f"{base}/{table}/run_ts={run_ts}")


def manifests(spark: SparkSession, base: str) -> DataFrame | None:
    """All manifests with ``run_ts``; a row per table and county, so a small table."""
    try:
        found = spark.read.option("basePath", f"{base}/manifests").parquet(f"{base}/manifests")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.withColumn("run_ts", F.col("run_ts").cast("string"))


def current_run_ts(spark: SparkSession, base: str) -> str | None:
    """The run that readers see: the one pinned if it is there, else the newest."""
    known = manifests(spark, base)
    if known is None:
        return None
    try:
        pins = spark.read.parquet(f"{base}/pinned").take(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        pins = []
    pinned = F.col("run_ts") == (pins[0].run_ts if pins else "")
    return known.agg(
        F.coalesce(F.max(F.when(pinned, F.col("run_ts"))), F.max("run_ts")).alias("run")
    ).first()["run"]


def manifest(spark: SparkSession, base: str, run_ts: str | None = None) -> list[tuple]:
    """``table_name, county, data_run`` of a run, of the current one by default."""
    run_ts = run_ts or current_run_ts(spark, base)
    if run_ts is None:
        return []
    rows = manifests(spark, base).where(F.col("run_ts") == run_ts)
    return sorted(map(tuple, rows.select("table_name", "county", "data_run").collect()), key=str)


def commit(spark: SparkSession, base: str, run_ts: str, rows: list[tuple]) -> None:
    """Show a run. One file is written, so readers see all of its manifest or none."""
    frame = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    frame.write.mode("overwrite").parquet(f"{base}/manifests/run_ts={run_ts}")


def read_table(spark: SparkSession, base: str, table: str, run_ts: str | None = None) -> DataFrame:
    """Rows of a table as a run shows them; the folders of other runs are not read."""
    rows = [(c, r) for t, c, r in manifest(spark, base, run_ts) if t == table]
    if not rows:
        raise ValueError(f"no run shows {table} under {base}")

    def part(county: str | None, run: str):
        here = F.col("run_ts").cast("string") == run
        return here if county is None else here & (F.col("county") == county)

    parts = reduce(lambda a, b: a | b, (part(*row) for row in rows))
    return spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").where(parts)


def drop_unnamed(spark: SparkSession, base: str, keep: int) -> list[str]:
    """Stop showing all but the newest ``keep`` runs; drop runs that no shown one names.

    Manifests go first, so a reader never finds a run whose rows are gone. Returns the runs that
    are no longer shown.
    """
    from lotbook.sinks.tables import delete_folder, list_folders

    known = list_folders(spark, f"{base}/manifests", "run_ts")
    gone = sorted(known)[: max(0, len(known) - keep)]
    for run in gone:
        delete_folder(spark, f"{base}/manifests/run_ts={run}")
    left = manifests(spark, base)
    named = {(r.table_name, r.data_run) for r in left.select("table_name", "data_run").distinct().collect()}
    for table in {t for t, _ in named}:
        for run in list_folders(spark, f"{base}/{table}", "run_ts"):
            if (table, run) not in named and run <= max(known):
                delete_folder(spark, f"{base}/{table}/run_ts={run}")
    return gone
