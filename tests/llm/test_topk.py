"""Top-k search against sorting all scores."""

import math

from lotbook.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def brute(rows, k, every):
    ok = [
        (i, tuple(math.floor(64 * x) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {r for r in ok if r[0] % every == 0}:
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b, strict=True)), i)
            for i, b in ok
            if i != q and len(a) == len(b)
        )
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = topk.top_k(topk.integer_vectors(frame), **options)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    import random

    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = random.Random(2)
    vector = lambda: [rng.uniform(-1, 1) * rng.choice([1, 1, 30]) for _ in range(5)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(120)]
    rows += [(9, [0.5] * 5), (20, rows[20][1]), (None, [1.0] * 5), (501, None), (502, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(503, [float("nan")] * 5), (520, [float("inf")] * 5), (540, [1.0, 2.0]), (541, [3.0, 1.0])]
    rows = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert search(spark, rows) == brute(rows, 20, 20)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 3.0])]
    assert search(spark, rows) == brute(rows, 20, 20)
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**21, 1.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 0.0]), (3, [2.0**20, 5.0])]
    assert search(spark, rows) == brute(rows, 20, 20)
