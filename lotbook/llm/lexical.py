"""Ranked lexical search, term at a time with a limited number of accumulators.

One pass counts documents, terms and the documents that hold each term of the queries, and
writes what the search needs of a document: its number of terms and the counts of those
that queries ask for. A second pass searches these rows in blocks. In a block a query takes
its terms rarest first; a document gets an accumulator when a term finds it, until
what the other terms can add at most is below the k-th partial score. From then on only
the documents that have an accumulator are updated, to their exact scores. A task carries
its best rows of each query from block to block, so later blocks stop sooner. The rows of
all tasks are ranked once more.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lotbook.llm.common import stored

K = 50
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Pairs of query and term that are searched in one pass over the documents; a single query
# may have more.
PAIRS = 100_000
# Postings that a block of documents holds, about; a single document may have more.
BLOCK_POSTINGS = 1 << 20
# Documents of a block at most: an accumulator each, for one query at a time.
BLOCK_DOCUMENTS = 1 << 16
_NO_ID = np.iinfo(np.int64).max

_find_terms = re.compile(TERM_PATTERN).findall


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order; only A-Z are lower-cased."""
    if not text:
        return []
    # Lower-casing of bytes touches A-Z alone.
    return _find_terms(text.encode("utf-8", "replace").lower().decode())


def length_norm(n, documents: int, terms: int):
    """100 - 50 + 50 * n / average length, in whole numbers; ``n`` is an array."""
    if 50 * int(n.max(initial=0)) * documents >= 1 << 62:
        return np.array([50 + (50 * own * documents) // terms for own in n.tolist()], dtype=np.int64)
    return 50 + (50 * n * documents) // terms


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_score(weight, tf, norm):
    """What a term adds; also of arrays."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm))


def _term_lists(items: DataFrame) -> DataFrame:
    """``item_id`` and its distinct terms, one row per id; a null text has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"].astype("Int64"), "terms": terms})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    lists = rows.mapInPandas(cut, "item_id long, terms array<string>")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms"))))
    return lists.groupBy("item_id").agg(every.alias("terms"))


def _query_blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Queries in blocks of at most ``PAIRS`` terms, read a partition at a time."""
    block: list[Row] = []
    held = 0
    for row in items.toLocalIterator():
        if block and held + len(row["terms"]) > PAIRS:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["terms"])
    if block:
        yield block


def _counted(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``doc_id``, number of terms, and numbers and counts of the ``terms`` each row holds."""
    kind = pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column(1):
                own = terms_of(text.as_py())
                found = Counter(own)
                # Walk through the smaller of the two.
                if len(found) < len(terms):
                    some = [(terms[t], c) for t, c in found.items() if t in terms]
                else:
                    some = [(i, found[t]) for t, i in terms.items() if t in found]
                n.append(len(own))
                at.append([i for i, _ in some])
                tf.append([c for _, c in some])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(at, kind), pa.array(tf, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


class Accumulators:
    """The search of one block of documents, a query at a time."""

    def __init__(self, postings: dict[int, tuple[np.ndarray, np.ndarray]], documents: int):
        # Documents of each term, ascending, with what the term adds to their scores.
        self.postings = postings
        self.most = {t: int(added.max()) for t, (_, added) in postings.items()}
        self.documents = documents
        self.created = self.updated = 0

    def search(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with exact scores; those of the block's ``k`` best are among them.

        ``terms`` come rarest first. ``least`` is a score that a document has to reach.
        """
        terms = [t for t in terms if t in self.postings]
        rest = np.cumsum([0, *(self.most[t] for t in reversed(terms))])[::-1].tolist()
        scores = np.zeros(self.documents, dtype=np.int64)
        kth, step = least, 0
        # A document without accumulator scores at most rest[step]; equality may still win.
        while step < len(terms) and rest[step] >= max(1, kth):
            found, added = self.postings[terms[step]]
            scores[found] += added
            self.created += len(found)
            step += 1
            partial = scores[scores > kth]
            if len(partial) >= k:
                kth = max(kth, int(np.partition(partial, -k)[-k]))
        alive = np.flatnonzero(scores)
        own = scores[alive]
        for at in range(step, len(terms)):
            # What cannot reach the k-th partial score any more needs no update.
            able = own + rest[at] >= kth
            alive, own = alive[able], own[able]
            if not len(alive):
                break
            found, added = self.postings[terms[at]]
            place = np.minimum(np.searchsorted(found, alive), len(found) - 1)
            own = own + np.where(found[place] == alive, added[place], 0)
            self.updated += len(alive)
            if len(own) >= k:
                kth = max(kth, int(np.partition(own, -k)[-k]))
        return alive, own


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows in order: highest score, then least id."""
    if len(scores) > k:
        able = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[able], scores[able]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(
    counted: DataFrame, queries: list[list[int]], weights: list[int], size: tuple[int, int], k: int
) -> DataFrame:
    """Best rows of each query (its place in ``queries``) in every task."""
    documents, terms = size

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if rows >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                yield held
                held, rows, postings = [], 0, 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        weight_of = np.array(weights, dtype=np.int64)
        for block in blocks(batches):
            column = lambda name: pa.chunked_array([b.column(name) for b in block])  # noqa: E731, B023
            ids = column("doc_id").fill_null(_NO_ID).to_numpy()
            # Equal scores are ordered by id, so documents stand by id.
            sizes = np.diff([0, *np.cumsum([len(x) for b in block for x in b.column("terms")])])
            owner = np.repeat(np.arange(len(ids)), sizes)
            own_term = np.concatenate([b.column("terms").flatten().to_numpy() for b in block])
            tf = np.concatenate([b.column("tf").flatten().to_numpy() for b in block]).astype(np.int64)
            norm = length_norm(column("n").to_numpy(), documents, terms)[owner]
            added = term_score(weight_of[own_term], tf, norm)
            order = np.lexsort((owner, own_term))
            own_term, owner, added = own_term[order], owner[order], added[order]
            starts = np.flatnonzero(np.r_[True, own_term[1:] != own_term[:-1]]) if len(owner) else []
            ends = [*starts[1:], len(owner)]
            postings = {
                int(own_term[a]): (owner[a:b], added[a:b])
                for a, b in zip(starts, ends, strict=False)
            }
            search = Accumulators(postings, len(ids))
            for at, query in enumerate(queries):
                held_ids, held_scores = best[at]
                least = int(held_scores[-1]) if len(held_scores) == k else 0
                found, scores = search.search(query, k, least)
                able = scores > 0
                merged_ids = np.r_[held_ids, ids[found[able]]]
                best[at] = _best(merged_ids, np.r_[held_scores, scores[able]], k)
        for at, (ids, scores) in enumerate(best):
            if len(ids):
                names = pa.array(np.full(len(ids), at, dtype=np.int32))
                doc_ids = pa.array(ids, mask=ids == _NO_ID)
                columns = [names, doc_ids, pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return counted.mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` (``doc_id``, ``text``) and ``items`` (``item_id``, ``text``); other columns are not
    read. A document scores the sum over the item's distinct terms, and only scores above 0
    count; equal scores rank by ascending id, a null id last. Rows that repeat an id are
    documents each. Items that repeat an id, null included, are one item with the terms of
    all. A null or empty text has no terms. Without documents or terms there are no rows.
    """
    spark = docs.sparkSession
    lists = stored(_term_lists(items), "queries")
    out = None
    for block in _query_blocks(lists.where(F.size("terms") > 0)):
        found = _block_ranked(docs, block, k)
        if found is not None:
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], _RESULT) if out is None else out


_RESULT = "item_id long, rank int, doc_id long, score long"


def _block_ranked(docs: DataFrame, block: list[Row], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    terms = sorted({t for row in block for t in row["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    counted = stored(_counted(docs, number), "counted")
    size = counted.where(F.col("n") > 0).agg(F.count(F.lit(1)), F.sum("n")).first()
    if not size[0]:
        return None
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = dict.fromkeys(range(len(terms)), 0) | {r["term"]: r["count"] for r in holding}
    queries = [sorted((number[t] for t in row["terms"]), key=lambda t: (df[t], t)) for row in block]
    weights = [term_weight(size[0], df[t]) for t in range(len(terms))]
    found = stored(_searched(counted, queries, weights, (size[0], size[1]), k), "found")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(
        [(i, row["item_id"]) for i, row in enumerate(block)], "query int, item_id long"
    )
    return best.join(names, "query").select("item_id", "rank", "doc_id", "score")
