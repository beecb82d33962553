"""Ranked search against scoring every document, and the limit on accumulators."""

import math
import random
import re
from collections import Counter

import numpy as np

from lotbook.llm import lexical

DOCS = "doc_id long, text string, item_id string, n int, terms string, score double"
ITEMS = "item_id long, text string, doc_id long, rank string"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall(lexical.TERM_PATTERN, (text or "").translate(UPPER))


def brute(docs, items, k=50):
    counted = [(i, terms_of(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in counted if t]
    documents, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * documents) // total
            s = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                s += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def search(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 0.5) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 3, "r") for i, t in items], ITEMS)
    got = lexical.ranked(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 30)
    monkeypatch.setattr(lexical, "PAIRS", 20)
    docs = corpus(400, 1)
    # A text and a word that a third of the rows share, repeated rows, ids that are null.
    docs += [(1000 - i, "w0 w1 the same text w250") for i in range(200)]
    docs += [docs[5], (7, "w250"), (None, "w250 w250"), (None, "w251"), (3000, None), (3001, "")]
    docs += [(3002, " ,.;\n"), (3003, "W250 É é ñandú日本 a\x7fb"), (3004, "w250 " * 5_000)]
    items = [(i, " ".join(f"w{j}" for j in range(i, 300, 23))) for i in range(12)]
    items += [(1, "w250 É"), (50, "nothing here"), (51, None), (52, ""), (None, "w7 w250"), (53, "É ñandú日本 B")]
    assert search(spark, docs, items) == brute(docs, items)


def test_fewer_documents_than_asked_and_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "b c"), (3, "d")], [(1, "a b b"), (2, "x")]
    assert search(spark, docs, items) == brute(docs, items) != []
    assert search(spark, [], items) == []
    assert search(spark, docs, []) == []
    assert search(spark, [(1, None), (2, ".")], items) == []


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(4)
    documents, postings, weights = 5_000, {}, {}
    for term in range(20):
        # Rare terms weigh much.
        found = np.flatnonzero(rng.random(documents) < 0.01 * 1.28**term)
        weights[term] = lexical.term_weight(documents, len(found))
        tf = rng.integers(1, 4, len(found))
        postings[term] = found, lexical.term_score(weights[term], tf, np.full(len(found), 100))
    whole = np.zeros(documents, dtype=np.int64)
    for found, added in postings.values():
        whole[found] += added
    search = lexical.Accumulators(postings, documents)
    found, scores = search.search(list(range(20)), 10, 0)
    assert (whole[found] == scores).all()
    kth = np.sort(whole)[-10]
    assert set(np.flatnonzero(whole >= kth)) <= set(found)
    assert search.created < sum(len(f) for f, _ in postings.values()) / 2
    # With a score to reach from the start there are fewer still.
    again = lexical.Accumulators(postings, documents)
    found, scores = again.search(list(range(20)), 10, int(kth))
    assert set(np.flatnonzero(whole >= kth)) <= set(found) and again.created <= search.created


def test_length_norm_of_huge_tables():
    n = np.array([1, 10**9])
    want = [50 + 50 * x * 10**11 // 10**13 for x in (1, 10**9)]
    assert lexical.length_norm(n, 10**11, 10**13).tolist() == want
