"""The corpus pipeline on the small table: every stage takes effect and keeps what it should."""

import __spark_entry__ as entry
import corpus_pipeline
from lotbook.llm import near_dups, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        rows = docs.collect()
        if name == "quality_rules":
            assert 0 < len(rows) < before
            for r in rows:
                words, *counts = quality_rules.base_counts(r.text)
                assert len(words) >= 50 and 100 * counts[-1] <= 50 * len(words)
        if name == "near_duplicates":
            sets = [near_dups.shingle_set(r.text) for r in rows]
            for i, a in enumerate(sets):
                for b in sets[:i]:
                    both = len(a & b)
                    assert not both or both < 0.8 * (len(a) + len(b) - both)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == ids
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_of_odd_rows_and_of_an_empty_table(spark, tmp_path):
    """Null, empty and repeated rows and clashing names pass all stages but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).selectExpr("doc_id", "text", "lang", "source", "n_chars")
    nulls = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema)
    extra = "1 as _row", "2 as _score", "3 as _judged", "4 as _copies", "'x' as _node", "5 as _kept"
    for table in (odd.unionByName(nulls).selectExpr("*", *extra), docs.limit(0).selectExpr("*", *extra)):
        out, before = table, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, out, SF), name)
            assert out.columns == table.columns, name
            if name == "near_duplicates":
                assert out.count() <= before / 2
        packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in out.collect()}


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
