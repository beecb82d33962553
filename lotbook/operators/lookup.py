"""Documents of given parcels, without building or reading those of all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.operators.assessor import KEY, lookup_all
from lotbook.operators.documents import assessor_documents
from lotbook.operators.search_index import key_bucket, pruned
from lotbook.session import checkpointed

# Keys that documents are held against at a time: at most one such table per folder, some
# megabytes each.
PART_KEYS = 100_000


def _wanted(keys: DataFrame) -> DataFrame:
    ids = keys.select(F.col("parcel_id").alias(KEY))
    return ids.where(F.col(KEY).isNotNull()).distinct()


def documents_of(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Documents of the parcels in ``keys`` (``parcel_id``) from the six assessor tables.

    Rows of other parcels leave each table before anything is grouped. The keys are joined
    without a hint: Spark broadcasts few of them by its own size check.
    """
    wanted = _wanted(keys)
    return assessor_documents(
        {name: table.join(wanted, KEY, "left_semi") for name, table in tables.items()}
    )


def write_documents(documents: DataFrame, path: str, by_folder: bool = False) -> None:
    """Documents in a folder per bucket of their key, sorted by key inside each file.

    Rows are ranged by bucket and key, so a folder has as many files as it needs, and the
    statistics of a file's row groups tell which keys it can hold. With ``by_folder`` they are
    written where they lie, as ``assessor_documents`` deals them on request: a folder then has a
    file per task that holds its bucket.
    """
    bucketed = documents.withColumn("bucket", key_bucket(KEY))
    ranged = bucketed if by_folder else bucketed.repartitionByRange("bucket", KEY)
    placed = ranged.sortWithinPartitions("bucket", KEY)
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def asked_documents(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of ``write_documents`` that ``keys`` name, from the folders they lie in.

    As many keys as the Parquet reader tests one by one
    (``spark.sql.parquet.pushdown.inFilterThreshold``) are values of the scan's filter, which
    leaves out row groups too. More keys are joined to the rows of their folders, so many
    folders at a time that their keys, counted first, are a table of a few megabytes. That is
    broadcast, and documents are read but not shuffled. Folders with more keys than that are
    joined without a hint.
    """
    spark = stored.sparkSession
    wanted = _wanted(keys)
    tested = int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
    few = [row[KEY] for row in wanted.limit(tested + 1).collect()]
    if len(few) <= tested:
        folders = pruned(stored, wanted.withColumn("bucket", key_bucket(KEY))).drop("bucket")
        return folders.where(F.col(KEY).isin(few))
    held = checkpointed(wanted.withColumn("bucket", key_bucket(KEY)))
    counts = {row["bucket"]: row["count"] for row in held.groupBy("bucket").count().collect()}
    small, large = _folder_groups(counts, PART_KEYS)

    def of(buckets: list[int]) -> tuple[DataFrame, DataFrame]:
        inside = F.col("bucket").isin(buckets)
        return stored.where(inside).drop("bucket"), held.where(inside).select(KEY)

    found = None
    for group in small:
        documents, named = of(group)
        part = documents.join(F.broadcast(named), KEY, "left_semi")
        found = part if found is None else found.unionByName(part)
    if large:
        documents, named = of(large)
        part = documents.join(named, KEY, "left_semi")
        found = part if found is None else found.unionByName(part)
    return found


def _folder_groups(counts: dict[int, int], most: int) -> tuple[list[list[int]], list[int]]:
    """Buckets in groups of at most ``most`` keys, and the buckets with more than that."""
    groups, held = [], most
    for bucket, n in sorted(counts.items()):
        if n > most:
            continue
        if held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(bucket)
        held += n
    return groups, [bucket for bucket, n in sorted(counts.items()) if n > most]


def lookup_stored(stored: DataFrame, keys: DataFrame, county: str, source: str) -> DataFrame:
    """``lookup_all`` over stored documents; reads only what the keys name."""
    return lookup_all(asked_documents(stored, keys), keys, county, source)
