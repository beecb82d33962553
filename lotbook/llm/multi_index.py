"""Hard negatives from an inverted multi-index, exact by certified windows.

Vectors are cut in two halves, each with a codebook; a pair of codes is a cell. For an
anchor a cell's bound is the sum of both halves' products with the code, each widened by
the code's radius times the length of the anchor's half, so no row of the cell scores
above it. A heap over both codebooks, sorted by bound, gives the cells in falling order. A
first round visits the best cells and leaves a k-th score per window; the second
visits every cell from there on until the next bound is below it, which certifies the
window. Cells whose rows all score above the windows are left out by the bound from below.

Visits and rows meet by first code. A code with many rows is dealt into parts by row number
and anchors go in blocks, so a vector that a third of the rows repeat fills many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotbook.llm.common import stored
from lotbook.llm.topk import scores_of

SCALE = 256
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
# Codes of a half; a visit keeps its cells of one first code as the bits of a long.
CODES = 64
# Numbers in the rows that codebooks are trained on, at most.
SAMPLE_VALUES = 1 << 20
TRAINING_ROUNDS = 10
# Cells that the first round visits.
SEED_CELLS = 64
PART_ROWS = 16_384
ANCHOR_BLOCK = 2_048
# Anchors whose cells one task lists.
ANCHORS_PER_TASK = 64
SLICE = 256
_LEAST, _MOST = -(1 << 62), 1 << 62


def labelled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``dim`` and ``v``: each component as floor(scale * x).

    Rows without id, label or vector, or with a null or non-finite component, take no part.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    return embeddings.where(whole & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("dim"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"),
    )


def shifted_labels(vectors: DataFrame, every: int = SHIFT_EVERY, labels: int = LABELS) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next label."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
    return vectors.withColumn("label", moved.otherwise(F.col("label")))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), -1)


def _nearest(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest code, and the distance to it."""
    at = ((codes * codes).sum(1)[None] - 2 * rows @ codes.T).argmin(axis=1)
    return at, np.linalg.norm(rows - codes[at], axis=1)


def _codebook(rows: np.ndarray, codes: int) -> np.ndarray:
    """Centres of ``rows`` by Lloyd's rounds from evenly spaced distinct rows."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    centres = centres.astype(np.float64)
    for _ in range(TRAINING_ROUNDS):
        at, _ = _nearest(rows, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, rows)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


@dataclass
class MultiIndex:
    """Codebooks, radii and rows per cell of the vectors of one length; all bounded by CODES."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    # Parts that the rows of each first code are dealt into, and cells of the first round.
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    seed_cells: int = 0

    def halves(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both halves with their codes."""
        cut = self.codes[0].shape[1]
        return [(vectors[:, :cut], self.codes[0]), (vectors[:, cut:], self.codes[1])]

    def bounds(self, vector: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Most and least that a row of each code adds to the score, for both halves."""
        most, least = [], []
        for (own, codes), radii in zip(self.halves(vector[None]), self.radii, strict=True):
            centre = codes @ own[0]
            # Wide enough for what floating point rounds away.
            reach = np.linalg.norm(own) * radii * (1 + 1e-9) + np.abs(centre) * 1e-9 + 1e-3
            most.append(centre + reach)
            least.append(centre - reach)
        return most, least


def train(vectors: DataFrame, dims: list[int], codes: int | None = None) -> dict[int, MultiIndex]:
    """Codebooks per length of vector from a sample of bounded size, chosen by hash.

    A length without a row in the sample has one code, the zero vector.
    """
    codes = CODES if codes is None else codes
    if not 1 <= codes <= 64:
        raise ValueError("a codebook has 1 to 64 codes")
    most = max(1, SAMPLE_VALUES // max(1, max(dims)))
    order = [F.xxhash64("vec_id"), F.xxhash64("v"), "vec_id", "v"]
    sample = vectors.where(F.col("dim").isin(dims)).orderBy(*order).limit(most).select("dim", "v")
    sample, out = sample.toPandas(), {}
    for dim in dims:
        rows, cut = sample[sample["dim"] == dim]["v"], dim - dim // 2
        whole = _matrix(rows).astype(np.float64) if len(rows) else np.zeros((1, dim))
        out[dim] = MultiIndex((_codebook(whole[:, :cut], codes), _codebook(whole[:, cut:], codes)))
    return out


def cells(
    most: list[np.ndarray], least: list[np.ndarray], rows: np.ndarray
) -> Iterator[tuple[float, float, int, int]]:
    """Cells with rows as (bound, bound from below, codes), in falling order of the bound."""
    first, second = (np.argsort(-half, kind="stable") for half in most)
    heap = [(-(most[0][first[0]] + most[1][second[0]]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        i, j = int(first[a]), int(second[b])
        if rows[i, j]:
            yield -bound, least[0][i] + least[1][j], i, j
        if b + 1 < len(second):
            heapq.heappush(heap, (-(most[0][i] + most[1][second[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(first):
            heapq.heappush(heap, (-(most[0][first[a + 1]] + most[1][j]), a + 1, 0))


def visited(
    index: MultiIndex, vector: np.ndarray, least: int, most: int, seed: bool
) -> dict[int, int]:
    """First code to the bits of the second codes, of the cells that a round visits.

    The first round takes the ``seed_cells`` best. The other goes on behind them until a bound
    is below ``least``; from there on no row can reach it.
    """
    out: dict[int, int] = {}
    for n, (bound, below, i, j) in enumerate(cells(*index.bounds(vector), index.rows)):
        if bound < least or (seed and n == index.seed_cells):
            break
        if below <= most and seed == (n < index.seed_cells):
            out[i] = out.get(i, 0) | (1 << j)
    return out


_VISITS = (
    "dim int, i int, part int, block int, ask long, own_id long, label long, v array<long>, "
    "marks array<long>, lows array<long>, highs array<long>, cells long"
)


def _visits(asks: DataFrame, indexes: dict[int, MultiIndex], seed: bool) -> DataFrame:
    """A row per ask, first code and part, with the cells to visit there."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ask in batch.itertuples(index=False):
                index, vector = indexes[ask.dim], np.asarray(ask.v, dtype=np.float64)
                found = visited(index, vector, min(ask.lows), max(ask.highs), seed)
                for i, bits in found.items():
                    bits = bits - (1 << 64) if bits >> 63 else bits
                    out += [
                        (ask.dim, i, part, ask.block, ask.ask, ask.own_id, ask.label, ask.v,
                         ask.marks, ask.lows, ask.highs, bits)
                        for part in range(index.parts[i])
                    ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _VISITS.split(", ")])

    return asks.mapInPandas(walk, _VISITS)


def _score(k: int, same: bool):
    """Best rows of a part for each ask and window that visits it."""

    def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("vec_id", kind="stable")
            right, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy(np.int64)
            labels, codes = rows["label"].to_numpy(np.int64), rows["j"].to_numpy(np.uint64)
            for first in range(0, len(asks), SLICE):
                some = asks.iloc[first : first + SLICE]
                scores = scores_of(_matrix(some["v"]), right)
                seen = some["cells"].to_numpy(np.int64).view(np.uint64)[:, None] >> codes[None]
                able = (seen & np.uint64(1)).astype(bool)
                able &= (some["label"].to_numpy(np.int64)[:, None] == labels[None]) == same
                able &= some["own_id"].to_numpy(np.int64)[:, None] != ids[None]
                names = some["ask"].to_numpy(np.int64)
                for w in range(max(map(len, some["marks"]))):
                    has = np.array([len(m) > w for m in some["marks"]])
                    low, high, mark = (
                        np.array([x[w] if len(x) > w else 0 for x in some[c]], dtype=np.int64)
                        for c in ("lows", "highs", "marks")
                    )
                    inside = able & has[:, None] & (scores >= low[:, None])
                    left = np.where(inside & (scores <= high[:, None]), scores, _LEAST)
                    # Rows stand by id, so the first of equal scores has the least id.
                    for _ in range(min(k, len(ids))):
                        at = left.argmax(axis=1)
                        some_left = np.flatnonzero(left[np.arange(len(some)), at] > _LEAST)
                        if not len(some_left):
                            break
                        at = at[some_left]
                        found = left[some_left, at]
                        out.append((names[some_left], mark[some_left], ids[at], found))
                        left[some_left, at] = _LEAST
        columns = ["ask", "mark", "vec_id", "score"]
        if not out:
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return score


class _Search:
    """Rows by cell, and the search of windows among them."""

    def __init__(self, vectors: DataFrame, dims: list[int], blocks: int, tasks: int = 1):
        self.blocks, self.tasks = blocks, tasks
        self.indexes = train(vectors, dims)
        indexes = self.indexes

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, rows in batch.groupby("dim"):
                    halves = indexes[dim].halves(_matrix(rows["v"]).astype(np.float64))
                    (i, near), (j, far) = (_nearest(*half) for half in halves)
                    yield rows.assign(i=i, j=j, near=near, far=far)

        known = vectors.where(F.col("dim").isin(dims)).withColumn(
            "_row", F.monotonically_increasing_id()
        )
        schema = "vec_id long, label long, dim int, v array<long>, _row long, i int, j int, near double, far double"
        self.rows = stored(known.mapInPandas(assign, schema), "cells")
        held = self.rows.groupBy("dim", "i", "j").agg(
            F.count(F.lit(1)).alias("n"), F.max("near").alias("near"), F.max("far").alias("far")
        )
        held = held.toPandas()  # at most a row per cell
        for dim, index in indexes.items():
            own = held[held["dim"] == dim]
            i, j = own["i"].to_numpy(int), own["j"].to_numpy(int)
            index.rows = np.zeros([len(c) for c in index.codes], dtype=np.int64)
            index.rows[i, j] = own["n"]
            index.parts = np.maximum(1, -(-index.rows.sum(axis=1) // PART_ROWS))
            index.seed_cells = SEED_CELLS
            index.radii = tuple(np.zeros(len(c)) for c in index.codes)
            np.maximum.at(index.radii[0], i, own["near"].to_numpy(float))
            np.maximum.at(index.radii[1], j, own["far"].to_numpy(float))

    def _round(self, asks: DataFrame, k: int, same: bool, seed: bool) -> DataFrame:
        parts = F.create_map(
            *[F.lit(x) for d, ix in self.indexes.items() for x in (d, ix.parts.tolist())]
        )
        rows = self.rows.withColumn(
            "part",
            F.pmod(F.xxhash64("_row"), F.get(parts[F.col("dim")], F.col("i"))).cast("int"),
        ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        keys = ["dim", "i", "part", "block"]
        met = rows.select(*keys, "vec_id", "label", "j", "v").groupBy(*keys)
        # A walk costs far more than its row's size tells, so anchors are dealt out by number.
        asks = asks.repartition(self.tasks, "ask")
        found = met.cogroup(_visits(asks, self.indexes, seed).groupBy(*keys)).applyInPandas(
            _score(k, same), "ask long, mark long, vec_id long, score long"
        )
        return _ranked(found, k)

    def best(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """The ``k`` best rows of every window: ``ask``, ``mark``, ``vec_id``, ``score``, ``rank``.

        ``asks``: ``ask``, ``dim``, ``block``, ``own_id``, ``label``, ``v`` and the windows, as
        ``marks`` (distinct names), ``lows`` and ``highs``, both ends included.
        """
        first = stored(self._round(asks, k, same, seed=True), "first")
        kth = first.where(F.col("rank") == k).groupBy("ask").agg(
            F.map_from_entries(F.collect_list(F.struct("mark", "score"))).alias("kth")
        )
        lows = F.zip_with(
            "marks", "lows", lambda m, low: F.coalesce(F.try_element_at("kth", m), low)
        )
        lows = F.when(F.col("kth").isNull(), F.col("lows")).otherwise(lows)
        sharper = asks.join(kth, "ask", "left").withColumn("lows", lows).drop("kth")
        second = self._round(sharper, k, same, seed=False)
        return stored(_ranked(first.drop("rank").union(second.drop("rank")), k), "best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """For each anchor and positive the first rows of other labels in the positive's window.

    ``vectors`` as ``labelled_vectors`` gives them. Anchors are rows whose id is divisible by
    ``every``; a positive is one of an anchor's ``positives`` best rows of its own label. A
    negative is one of the ``negatives`` best rows of other labels whose score lies between
    LOW and HIGH hundredths of the positive's; a positive below 0 has none. Returns ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Only vectors of the anchor's length are compared with it, and no row that has its id.
    Anchors that repeat id, label and vector are one; other repeated rows count as a row
    each. Without anchors, positives or negatives there are no rows.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.select("vec_id", "label", "dim", "v"), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0).distinct()
    asked = asked.select(F.col("vec_id").alias("own_id"), "label", "dim", "v")
    asked = stored(asked.withColumn("ask", F.monotonically_increasing_id()), "anchors")
    held = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()
    if not held:
        return spark.createDataFrame([], _RESULT)
    blocks = -(-max(r["n"] for r in held) // ANCHOR_BLOCK)
    tasks = -(-sum(r["n"] for r in held) // ANCHORS_PER_TASK)
    search = _Search(vectors, sorted(r["dim"] for r in held), blocks, tasks)
    block = F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int").alias("block")

    def ends(*values) -> list:
        names = ("marks", "lows", "highs")
        return [F.array(F.lit(x).cast("long")).alias(n) for n, x in zip(names, values, strict=True)]

    whole = asked.select("*", block, *ends(0, _LEAST + 1, _MOST))
    near = search.best(whole, positives, same=True).select(
        "ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    windows = (
        near.where(F.col("positive_score") >= 0)
        .groupBy("ask")
        .agg(F.sort_array(F.collect_set("positive_score")).alias("marks"))
    )
    # Whole numbers s with LOW * p <= 100 * s <= HIGH * p.
    windows = windows.selectExpr(
        "ask",
        "marks",
        f"transform(marks, p -> (p * {LOW} + 99) div 100) as lows",
        f"transform(marks, p -> (p * {HIGH}) div 100) as highs",
    )
    found = search.best(asked.select("*", block).join(windows, "ask"), negatives, same=False)
    return (
        near.join(
            found.select(
                "ask",
                F.col("mark").alias("positive_score"),
                "rank",
                F.col("vec_id").alias("negative_id"),
                F.col("score").alias("negative_score"),
            ),
            ["ask", "positive_score"],
        )
        .join(asked.select("ask", F.col("own_id").alias("anchor_id")), "ask")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)
