"""Exact top-k inner products by distributed histogram selection.

Queries and candidates meet in blocks of bounded size. Each block scores all its pairs and
counts scores in a histogram per query; the sums over blocks show which bucket holds the
k-th score, and the next pass cuts only that bucket, until a bucket is one score. A last
pass keeps what lies above, and the smallest ids of those that equal it. No scores are
stored or sorted; a query's rows are at most k from each block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.llm.common import stored

K = 20
SCALE = 64
QUERY_EVERY = 20
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 16_384
BUCKET_BITS = 10
BUCKETS = 1 << BUCKET_BITS
# Queries scored at a time inside a block: their scores take about 30 MB.
SLICE = 256


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dim`` and ``v``: each component as floor(scale * x).

    Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without an id.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("dim"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"),
    )


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), -1)


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if most * max(1, queries.shape[1]) < 2.0**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


def _slices(queries: pd.DataFrame, candidates: pd.DataFrame):
    """Scores of a block a slice of queries at a time; a query's own rows are marked out."""
    right = _matrix(candidates["v"])
    ids = candidates["vec_id"].to_numpy(np.int64)
    for first in range(0, len(queries), SLICE):
        part = queries.iloc[first : first + SLICE]
        scores = scores_of(_matrix(part["v"]), right)
        other = ids[None, :] != part["query_id"].to_numpy(np.int64)[:, None]
        yield part, scores, other, ids


def _least_kept(scores: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """A bound that the k-th score of all rows cannot be below, per query."""
    lowest = np.iinfo(np.int64).min
    masked = np.where(other, scores, lowest)
    if masked.shape[1] < k:
        return np.full(len(masked), lowest + 1)
    return np.maximum(lowest + 1, np.partition(masked, -k, axis=1)[:, -k])


def _blocks(rows: DataFrame, queries: DataFrame, sizes: dict[int, tuple[int, int]]):
    """Both sides keyed by block: each candidate once per block of queries, and in reverse."""
    grid = F.create_map(*[F.lit(x) for d, (r, c) in sizes.items() for x in (d, r)])
    cells = F.create_map(*[F.lit(x) for d, (r, c) in sizes.items() for x in (d, c)])
    left = (
        rows.withColumn("c", F.pmod(F.col("_row"), cells[F.col("dim")]).cast("int"))
        .withColumn("r", F.explode(F.sequence(F.lit(0), grid[F.col("dim")] - 1)))
        .groupBy("dim", "r", "c")
    )
    right = (
        queries.withColumn("r", F.pmod(F.col("_query"), grid[F.col("dim")]).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), cells[F.col("dim")] - 1)))
        .groupBy("dim", "r", "c")
    )
    return left, right


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """The ``k`` best rows of each query, a row whose id is divisible by ``every``.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id. All
    rows but those with the query's own id are candidates, vectors of another length
    excepted. Query rows that repeat id and vector are one query; repeated candidates
    are candidates each. A table without queries gives no rows.
    """
    rows = stored(
        vectors.withColumn("_row", F.monotonically_increasing_id()), "vectors"
    )
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), "dim", "v"
    )
    queries = stored(
        queries.distinct().withColumn("_query", F.monotonically_increasing_id()), "queries"
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    of_rows = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
    asked = queries.groupBy("dim").agg(F.count("*").alias("n")).collect()
    of_queries = {r["dim"]: r["n"] for r in asked}
    of_rows = [r for r in of_rows if r["dim"] in of_queries]
    sizes = {
        r["dim"]: (-(-of_queries[r["dim"]] // QUERY_BLOCK), -(-r["n"] // CANDIDATE_BLOCK))
        for r in of_rows
    }
    empty = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return rows.sparkSession.createDataFrame([], empty)
    longest = F.create_map(*[F.lit(x) for r in of_rows for x in (r["dim"], float(r["norm"]))])
    # No score is beyond the product of the norms.
    bound = F.ceil(F.sqrt(norm * longest[F.col("dim")])).cast("long") + 1
    state = queries.select(
        "_query",
        (-bound).alias("low"),
        _bucket_width(2 * bound + 1).alias("width"),
        (2 * bound + 1).alias("span"),
        F.lit(0).cast("long").alias("above"),
    )
    state = stored(state, "bounds")
    while True:
        left, right = _blocks(rows, queries.join(state, "_query"), sizes)
        counts = left.cogroup(right).applyInPandas(_histogram(k), "_query long, bucket int, n long")
        counts = counts.groupBy("_query", "bucket").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy("_query").orderBy(F.desc("bucket"))
        running = F.sum("n").over(higher.rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("up_to", running).join(state, "_query")
        reached = reached.where(F.col("above") + F.col("up_to") >= k)
        at = reached.groupBy("_query").agg(F.max(F.struct("bucket", "n", "up_to")).alias("at"))
        final = state.agg(F.max("width")).first()[0] == 1
        state = state.join(at, "_query", "left").select(
            "_query",
            # Fewer than k candidates: everything from the lowest score on.
            F.when(F.col("at").isNull(), F.col("low"))
            .otherwise(F.col("low") + F.col("at.bucket") * F.col("width"))
            .alias("low"),
            _bucket_width(F.col("width")).alias("width"),
            F.col("width").alias("span"),
            (F.col("above") + F.coalesce(F.col("at.up_to") - F.col("at.n"), F.lit(0))).alias(
                "above"
            ),
        )
        state = stored(state, "bounds")
        if final:
            break
    left, right = _blocks(rows, queries.join(state, "_query"), sizes)
    found = left.cogroup(right).applyInPandas(
        _select(k), "_query long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _bucket_width(span: Column) -> Column:
    """Least width with which the buckets cover the span, in whole numbers."""
    return F.shiftright(span + (BUCKETS - 1), BUCKET_BITS)


def _histogram(k: int):
    """Counts of scores by bucket of the query's present range, from the local k-th on.

    The k-th best of all rows is at least the k-th best of any block, so what lies below
    the block's own needs no count.
    """

    def count(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            for part, scores, other, _ in _slices(queries, candidates):
                low = part["low"].to_numpy(np.int64)[:, None]
                width = part["width"].to_numpy(np.int64)[:, None]
                span = part["span"].to_numpy(np.int64)[:, None]
                least = np.maximum(low, _least_kept(scores, other, k)[:, None])
                # The local bound may lie inside a bucket; that bucket is counted whole.
                least = low + (least - low) // width * width
                inside = other & (scores >= least) & (scores < low + span)
                at, col = np.nonzero(inside)
                bucket = (scores[at, col] - low[at, 0]) // width[at, 0]
                keys, n = np.unique(at * BUCKETS + bucket, return_counts=True)
                names = part["_query"].to_numpy(np.int64)[keys // BUCKETS]
                out.append(pd.DataFrame({"_query": names, "bucket": keys % BUCKETS, "n": n}))
        if not out:
            return pd.DataFrame({"_query": [], "bucket": [], "n": []}, dtype="int64")
        return pd.concat(out)

    return count


def _select(k: int):
    """Rows above the k-th score, and of those equal to it the smallest ids still needed."""

    def pick(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            for part, scores, other, ids in _slices(queries, candidates):
                low = part["low"].to_numpy(np.int64)[:, None]
                at, col = np.nonzero(other & (scores > low))
                need = k - part["above"].to_numpy(np.int64)
                tie_at, tie_col = np.nonzero(other & (scores == low))
                order = np.lexsort((ids[tie_col], tie_at))
                tie_at, tie_col = tie_at[order], tie_col[order]
                place = np.arange(len(tie_at)) - np.searchsorted(tie_at, tie_at)
                few = place < need[tie_at]
                at, col = np.r_[at, tie_at[few]], np.r_[col, tie_col[few]]
                out.append(
                    pd.DataFrame(
                        {
                            "_query": part["_query"].to_numpy(np.int64)[at],
                            "query_id": part["query_id"].to_numpy(np.int64)[at],
                            "vec_id": ids[col],
                            "score": scores[at, col],
                        }
                    )
                )
        if not out:
            names = ["_query", "query_id", "vec_id", "score"]
            return pd.DataFrame({n: [] for n in names}, dtype="int64")
        return pd.concat(out)

    return pick
