"""Key merges: overwrite rules, last record wins, hot and missing keys."""

import pytest
from pyspark.sql import functions as F

from lotbook.operators import merge
from lotbook.operators.skew import hot_keys, salted_join

SCHEMA = "src_ord bigint, props map<string,string>"


def frames(spark):
    left = spark.createDataFrame([(1, {"id": "1", "a": "x", "b": "y"}), (2, {"id": "9", "a": "k"})], SCHEMA)
    right = spark.createDataFrame(
        [(1, {"id": "1", "a": "", "b": "q"}), (2, {"id": "1", "a": "z", "b": None}), (3, {"id": "", "a": "n"})],
        SCHEMA,
    )
    return left, right


def result(df):
    return {r.src_ord: (dict(r.props), r.matched) for r in df.collect()}


def test_truthy_merge(spark):
    out = result(merge.merge_by_id(*frames(spark), "id", "id"))
    assert out[1] == ({"id": "1", "a": "z", "b": "y"}, True)
    assert out[2] == ({"id": "9", "a": "k"}, False)


def test_unconditional_merge(spark):
    out = result(merge.join_overwrite(*frames(spark), "id", "id"))
    assert out[1][0] == {"id": "1", "a": "z", "b": None}


def test_missing_key_property_is_an_error(spark):
    left, right = frames(spark)
    with pytest.raises(Exception, match="without key property nope"):
        merge.join_overwrite(left, right, "nope", "id").collect()


def test_scraped_merge_keeps_the_key(spark):
    left, right = frames(spark)
    out = result(merge.merge_scraped(left, right, "id"))
    assert out[1][0] == {"id": "1", "a": "z", "b": "y"}


def test_empty_keys_never_match(spark):
    left = spark.createDataFrame([(1, {"id": ""}), (2, {"id": None}), (3, {})], SCHEMA)
    right = spark.createDataFrame([(1, {"id": "", "a": "n"})], SCHEMA)
    out = result(merge.merge_by_id(left, right, "id", "id"))
    assert [m for _, m in out.values()] == [False] * 3


def test_hot_keys_give_the_same_rows(spark):
    left = spark.range(2000).select(
        F.col("id").alias("src_ord"),
        F.create_map(
            F.lit("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "").otherwise(F.col("id").cast("string"))
        ).alias("props"),
    )
    right = spark.createDataFrame([(1, {"id": "hot", "v": "H"}), (2, {"id": "5", "v": "F"})], SCHEMA)
    plain = result(merge.merge_by_id(left, right, "id", "id"))
    salted = result(merge.merge_by_id(left, right, "id", "id", hot_rows=50))
    assert plain == salted and len(salted) == 2000
    assert sum(m for _, m in salted.values()) == 667 + 1


def test_hot_key_parts(spark):
    df = spark.range(100).select(F.when(F.col("id") < 70, 1).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, ["k"], 20).collect()] == [(1, 4)]


def test_salted_join_kinds(spark):
    left = spark.range(90).select("id", (F.col("id") % 2).alias("k"))
    right = spark.createDataFrame([(0, "zero")], "k bigint, v string")
    inner = salted_join(left, right, "k", "inner", "id", 10)
    outer = salted_join(left, right, "k", "left", "id", 10)
    anti = salted_join(left, right, "k", "left_anti", "id", 10)
    assert (inner.count(), outer.count(), anti.count()) == (45, 90, 45)


def test_merge_counts(spark):
    row = merge.merge_counts(merge.merge_by_id(*frames(spark), "id", "id")).collect()[0]
    assert (row.records, row.updated) == (2, 1)
