"""Targets and taken words against plain arithmetic."""

import pytest

from lotbook.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_targets_and_takings(spark):
    rows = []
    for i in range(400):
        source = [None, "b", "a", "é", "b", "b"][i % 6]
        rows.append((i, source, " ".join(["w"] * (i * 13 % 90))))
    data = [(i, t, s, 1, "x") for i, s, t in rows]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix_table(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    source_of = {i: s for i, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45
    again = {r.doc_id: r.taken for r in mixing.mix_table(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    rows_out = mixing.mixed(docs)
    assert rows_out.columns == docs.columns
    counts = {}
    for r in rows_out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in got)


def test_one_source_repeats_and_nulls(spark):
    same = [(1, "a b c", "s", 0, "")] * 3 + [(None, None, None, 0, ""), (2, "", "s", 0, "")]
    got = mixing.mix_table(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 5
    assert {r.taken for r in got if r.doc_id == 1} <= {3, 6}
    assert all(r.taken == 0 for r in got if r.doc_id != 1)


def test_clashing_names_stay(spark):
    names = "_copies", "_copy", "_whole", "_cut", "_closed", "_mix_key", "_mix", "whole", "H"
    rows = [(i, "a b c", "s", *range(9)) for i in range(10)] + [(None, None, None, *range(9))]
    columns = ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {columns}")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {tuple(r)[3:] for r in got} == {tuple(range(9))} and len(got) >= 10


def test_empty_table(spark):
    assert mixing.mix_table(spark.createDataFrame([], SCHEMA)).count() == 0
