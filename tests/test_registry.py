"""The registered queries and their SQL."""

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
