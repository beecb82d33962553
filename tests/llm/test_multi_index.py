"""Hard negatives against sorting all scores, and the heap's early stop."""

import math
import random

import numpy as np

from lotbook.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, score long, i string"


def brute(rows, every=50):
    ok = []
    for i, v, label in rows:
        if None in (i, v, label) or not all(x is not None and math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        ok.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, own, v in {r for r in ok if r[0] % every == 0}:
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, label)
            for i, label, w in ok
            if i != a and len(v) == len(w)
        )
        for p, i, _ in [s for s in scored if s[2] == own][:5]:
            inside = [s for s in scored if s[2] != own and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(inside[:3])]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)
    vectors = multi_index.labelled_vectors(frame)
    got = multi_index.hard_negatives(multi_index.shifted_labels(vectors))
    assert got.columns == [c.split()[0] for c in multi_index._RESULT.split(", ")]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, seed, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [
        (i, [x + rng.gauss(0, 0.15) for x in centres[i % 12]], (i % 12) % 10) for i in range(n)
    ]


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PART_ROWS", 40)
    monkeypatch.setattr(multi_index, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(multi_index, "CODES", 8)
    monkeypatch.setattr(multi_index, "SEED_CELLS", 3)
    monkeypatch.setattr(multi_index, "SLICE", 2)
    rows = clustered(500, 1)
    # A vector that a third of the rows share, an anchor among them, and repeated rows.
    rows += [(500 + i, rows[3][1], i % 10) for i in range(250)]
    rows += [rows[7], (100, rows[100][1], rows[100][2]), (100, [1.0] * 6, 3), (50, [0.0] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (2000, None, 1), (2050, [1.0] * 6, None), (2100, [None] * 6, 1)]
    rows += [(2150, [float("nan")] * 6, 1), (2200, [float("inf")] * 6, 1)]
    rows += [(2250, [1.0, 2.0, 0.5], 4), (2251, [1.0, 2.0, 0.6], 4), (2252, [0.9, 1.2, 0.5], 5)]
    rows += [(2300, [], 1), (2301, [], 1), (2302, [], 3), (2350, [2.0], 1), (2351, [1.5], 1), (2352, [1.0], 2)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 2), (2, [0.9, 0.1], 2), (3, [0.7, 0.1], 1)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_bounds_hold_and_the_heap_stops_early(spark):
    rows = clustered(600, 5, dim=8)
    frame = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)
    vectors = multi_index.labelled_vectors(frame)
    search = multi_index._Search(vectors, [8], 1)
    index = search.indexes[8]
    assert index.rows.sum() == 600
    held = search.rows.toPandas()
    matrix = np.array(held["v"].tolist(), dtype=float)
    for vector in matrix[:20]:
        scores = matrix @ vector
        most, least = index.bounds(vector)
        order = list(multi_index.cells(most, least, index.rows))
        assert [c[0] for c in order] == sorted((c[0] for c in order), reverse=True)
        assert {c[2:] for c in order} == set(zip(held["i"], held["j"], strict=True))
        bound = {c[2:]: c for c in order}
        for score, i, j in zip(scores, held["i"], held["j"], strict=True):
            assert bound[i, j][1] <= score <= bound[i, j][0]
        best = int(np.sort(scores)[-5])
        seen = {}
        for seed in (True, False):
            for i, bits in multi_index.visited(index, vector, best, 1 << 62, seed).items():
                assert not seen.get(i, 0) & bits
                seen[i] = seen.get(i, 0) | bits
        inside = [bool(seen.get(i, 0) >> j & 1) for i, j in zip(held["i"], held["j"], strict=True)]
        assert all(ok for ok, s in zip(inside, scores, strict=True) if s >= best)
        assert sum(inside) < 300
