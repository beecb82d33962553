"""Signatures against weighted similarity, classes against brute force."""

import random

import numpy as np

from lotbook.llm import near_dups

SCHEMA = "doc_id long, text string, label string, _row string"


def classes_of(rows):
    """Brute force: classes by least id, over all pairs."""
    sets = [near_dups.shingle_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(tuple(sorted(g)) for g in groups.values())


def write(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    elements = near_dups.mix(np.arange(300, dtype=np.uint64))
    for a, b in (
        (rng.random(300) * 5, rng.random(300) * 5),
        (np.r_[np.ones(250), np.zeros(50)], np.r_[np.zeros(50), np.ones(250)]),
    ):
        sides = [(elements[w > 0], w[w > 0]) for w in (a, b)]
        signed = near_dups.dart_minhash(
            np.concatenate([s[0] for s in sides]),
            np.concatenate([s[1] for s in sides]),
            np.array([len(s[0]) for s in sides]),
            4000,
        )
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signed[0] == signed[1]).mean() - want) < 0.03
    alone = near_dups.dart_minhash(elements[:1], np.ones(1), np.array([1]), 50)
    assert (alone != 0).all()


def test_classes_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 150))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.05, 0.1):
            rows.append((n, " ".join(edited(rng, base, share))))
            n += 1
    for _ in range(40):
        rows.append((n, " ".join(passage + [word() for _ in range(rng.randrange(3, 40))])))
        n += 1
    rows += [(n, "few words"), (n + 1, "few  words"), (n + 2, "")]
    got = near_dups.duplicate_classes(write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in groups.values()) == classes_of(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_buckets_of_unlike_texts_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dups, "BUCKET_PAIRS", 3)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, share))) for i, share in enumerate([0.03, 0.06] * 30)]
    got = near_dups.duplicate_classes(write(spark, tmp_path, rows)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in groups.values()) == classes_of(rows)


def test_odd_rows(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (None, text), (7, text), (7, text), (8, "x" * 50_000)]
    docs = write(spark, tmp_path, rows)
    got = near_dups.duplicate_classes(docs).collect()
    assert len(got) == 8
    same = [r for r in got if r.class_id == 7]
    assert len(same) == 3 and sum(r.kept for r in same) == 1
    assert all(r.kept for r in got if r.class_id != 7)
    left = near_dups.near_duplicates_removed(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(1, None), (2, None), (3, ""), (4, " \n"), (7, text), (8, "x" * 50_000)], key=str
    )
    assert {r._row for r in left.collect()} == {"y"}


def test_of_rows_without_id_one_stays_and_names_may_clash(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text, i, i) for i in range(5)] + [(3, "other words", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _KEPT int, _node int")
    left = near_dups.near_duplicates_removed(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[5]], key=str)
    assert near_dups.near_duplicates_removed(docs.limit(0)).count() == 0


def test_empty_table(spark, tmp_path):
    docs = write(spark, tmp_path, [])
    assert near_dups.duplicate_classes(docs).count() == 0
