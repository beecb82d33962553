"""Rows keep their numbers when a scan is split anew between two passes."""

import pytest

from lotbook.llm import common, licences, near_dups, warc

SPLITS = "spark.sql.files.minPartitionNum"
PROSE = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]


@pytest.fixture
def cores_change(spark, monkeypatch):
    """After every stored table a scan of small files is one task, or one task per file, in turn."""
    passes = []

    def stored(df, name):
        out = common_stored(df, name)
        passes.append(name)
        spark.conf.set(SPLITS, 1 if len(passes) % 2 else 64)
        return out

    common_stored = common.stored
    for module in (common, licences, near_dups, warc):
        monkeypatch.setattr(module, "stored", stored)
    spark.conf.set(SPLITS, 64)
    yield passes
    spark.conf.unset(SPLITS)


def files(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def both_splits(spark, frame):
    """Rows of a result that is planned under either split."""
    out = []
    for n in (1, 64):
        spark.conf.set(SPLITS, n)
        out.append(sorted(map(tuple, frame.select("*").collect()), key=str))
    return out


def test_near_duplicates(spark, tmp_path, cores_change):
    rows = [(i, t + end) for i, t in enumerate(PROSE) for end in ("", " more")]
    docs = files(spark, tmp_path, rows, "doc_id long, text string")
    for got in both_splits(spark, near_dups.near_duplicates_removed(docs)):
        assert sorted(r[0] for r in got) == list(range(12))


def test_revisits(spark, tmp_path, cores_change):
    rows = [(100 * copy + i, "u", t) for i, t in enumerate(PROSE) for copy in (0, 1)]
    pages = files(spark, tmp_path, rows, "page_id long, url string, html string")
    for got in both_splits(spark, warc.with_revisits(pages).select("page_id", "refers_to")):
        assert got == sorted([(i, None) for i in range(12)] + [(100 + i, i) for i in range(12)], key=str)


def test_licences(spark, tmp_path, cores_change):
    rows = [(i, t + ("\nAll rights reserved." if i % 2 else "")) for i, t in enumerate(PROSE)]
    docs = files(spark, tmp_path, rows, "doc_id long, text string")
    found = licences.scan_documents(docs).select("doc_id", "families")
    for got in both_splits(spark, found):
        assert {r[0]: r[1] for r in got} == {
            i: ["all-rights-reserved"] if i % 2 else [] for i in range(12)
        }
