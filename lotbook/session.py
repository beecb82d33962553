"""Session settings the jobs expect, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from real sizes and splits skewed partitions. No broadcast
# threshold is raised: Spark's own size check decides which side is small enough.
JOB_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def job_session(app: str, **extra: str) -> SparkSession:
    """A session with the job settings; the cluster's own settings win where already set."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**JOB_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    A warehouse on the driver's own disk is shared only where driver and executors are one
    process; elsewhere it is an error not to name a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.conf.get("spark.master", "local")
    local = master == "local" or master.startswith("local[")
    if warehouse.startswith(("file:", "/")) and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/lotbook-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
