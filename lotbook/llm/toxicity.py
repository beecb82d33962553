"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents of the training fold
are unlabelled and hold toxic ones at a known rate (the class prior). The risk of
calling unlabelled text toxic is corrected by that prior and held at zero or above
(Kiryo et al. 2017). Features are the distinct words of a text and their beginnings,
hashed; only those that confirmed texts use more often than others stay in the model.
Learning sees a bounded sample, gathered by hash; scoring is one narrow pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import free_name, stored

THRESHOLD = 0.3
# At most so many confirmed and so many unlabelled documents take part in learning.
MAX_POSITIVES = 3_000
MAX_UNLABELLED = 9_000
HASH_BITS = 20
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 200_000
_word = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the checksum of the id as text falls in the part kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts == part


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(name.encode("utf-8", "replace")) >> (32 - HASH_BITS) for name in names]


def distinct_words(text: str | None) -> set[str]:
    return set(_word(text.lower())) if isinstance(text, str) else set()


@dataclass
class Model:
    """Weights of kept features, in order of their hash, and an offset."""

    features: np.ndarray
    weights: np.ndarray
    offset: float

    def word_weights(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))


class _Scorer:
    def __init__(self, model: Model):
        self.weights = model.word_weights()
        self.offset = model.offset
        self.words: dict[str, tuple] = {}

    def evidence(self, word: str) -> tuple:
        found = self.words.get(word)
        if found is None:
            found = tuple(f for f in word_features(word) if f in self.weights)
            self.words[word] = found
        return found

    def score(self, text: str | None) -> float:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        found: set[int] = set()
        for word in distinct_words(text):
            found.update(self.evidence(word))
        z = self.offset + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def informative(in_positives, in_unlabelled, n_positives: int, n_unlabelled: int) -> np.ndarray:
    """Which features take part: those of at least three positives whose rate among
    positives is well above their rate among unlabelled texts."""
    rate_p = in_positives / max(1, n_positives)
    rate_u = (in_unlabelled + 1) / (n_unlabelled + 2)
    noise = 3 * np.sqrt(rate_p / max(1, n_positives))
    return (in_positives >= 3) & (rate_p - noise > 2 * rate_u)


def learn(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Select features of whole texts (arrays of distinct hashes) and fit."""
    sides = [np.concatenate(docs) if docs else np.zeros(0, int) for docs in (positives, unlabelled)]
    names = np.unique(sides[0])
    counts = [np.searchsorted(np.sort(x), names, "right") - np.searchsorted(np.sort(x), names) for x in sides]
    features = names[informative(*counts, len(positives), len(unlabelled))].astype(np.int64)
    kept = [[d[np.isin(d, features)] for d in docs] for docs in (positives, unlabelled)]
    return fit(kept[0], kept[1], features, prior)


def fit(
    positives: list[np.ndarray], unlabelled: list[np.ndarray], features: np.ndarray, prior: float
) -> Model:
    """Non-negative PU learning of a linear model over sets of the given features.

    With no positives or no features every score is low.
    """
    prior = float(np.clip(prior, 0.01, 0.9))
    base = float(np.log(prior / (1 - prior)))
    if not len(features) or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), base)
    sides = []
    for docs in (positives, unlabelled):
        rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        cols = np.concatenate(docs) if docs else np.zeros(0, int)
        sides.append((rows, np.searchsorted(features, cols.astype(np.int64)), len(docs)))
    w = np.zeros(len(features))
    b = base
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def margin(side):
        rows, cols, n = side
        return b + np.bincount(rows, w[cols], n)

    def gradient(side, slope):
        rows, cols, n = side
        return np.r_[np.bincount(cols, slope[rows], len(w)), slope.sum()] / n

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, 401):
        p, u = sigmoid(margin(sides[0])), sigmoid(margin(sides[1]))
        # Logistic losses: -log s for "toxic", -log(1 - s) for "not toxic".
        loss = lambda s: -np.log(np.maximum(1e-12, s)).mean()
        negative = loss(1 - u) - prior * loss(1 - p)
        if negative >= 0:
            grad = (
                prior * gradient(sides[0], p - 1)
                + gradient(sides[1], u)
                - prior * gradient(sides[0], p)
            )
        else:
            # The corrected risk would turn negative: step back from fitting it.
            grad = prior * gradient(sides[0], p) - gradient(sides[1], u)
        grad[:-1] += 2e-4 * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = 0.1 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return Model(features.astype(np.int64), w, float(b))


def sample_of(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    fold: Column,
    rows: dict[int, int],
    unlabelled: int | None = None,
) -> DataFrame:
    """A bounded sample of the training fold: at most ``rows[k]`` texts labelled ``k``.

    Texts without a label count as kind ``unlabelled``, or take no part. Rows are thinned by a
    hash of their id to about twice the bound, then the least hashes are taken, so the
    sample is the same in every run and only it reaches the driver. A document with several
    labels takes the greatest.
    """
    marks = (
        labels.where(F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(
        F.col("_id").isNotNull() & ~fold
    )
    hashed = F.xxhash64("_id").alias("_h")
    ids = base.select("_id").join(marks, "_id", "left")
    kind_of = F.coalesce(F.col("_y"), F.lit(unlabelled).cast("int"))
    kinds = ids.select("_id", kind_of.alias("_y"), hashed).where(F.col("_y").isNotNull())
    totals = {r["_y"]: r["n"] for r in kinds.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    wanted = F.lit(False)
    for kind, most in rows.items():
        share = min(1.0, 2 * most / max(1, totals.get(kind, 0)))
        bound = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
        wanted = wanted | ((F.col("_y") == kind) & (F.col("_h") <= bound))
    chosen = kinds.where(wanted)
    parts = [
        chosen.where(F.col("_y") == kind).orderBy("_h", "_id").limit(most)
        for kind, most in rows.items()
    ]
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    picked = picked.dropDuplicates(["_id"])
    return base.join(F.broadcast(picked), "_id").select("_id", "_y", "text")


def class_prior(labels: DataFrame, label: str, fold: Column) -> float:
    row = labels.where(F.col(label).isNotNull() & ~fold).agg(
        F.avg((F.col(label) == 1).cast("double"))
    )
    return row.first()[0] or 0.0


def train(docs: DataFrame, labels: DataFrame, fold: Column, prior: float | None = None) -> Model:
    """Learn from the rows outside ``fold``, a condition on ``doc_id`` (here ``_id``).

    ``prior`` is the share of toxic texts; by default that of the labelled rows.
    """
    if prior is None:
        prior = class_prior(labels.withColumn("_id", F.col("doc_id").cast("long")), "toxic", fold)
    sample = sample_of(
        docs, labels, "toxic", fold, {1: MAX_POSITIVES, 0: MAX_UNLABELLED}, unlabelled=0
    )

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                np.array(sorted({f for w in distinct_words(t) for f in word_features(w)}), "i4")
                for t in batch["text"]
            ]
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "features": rows})

    found = stored(
        sample.mapInPandas(featured, "_id long, _y int, features array<int>"), "features"
    )
    sizes = {r["_y"]: r["n"] for r in found.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n_positives, n = sizes.get(1, 0), sizes.get(0, 0)
    # Unlabelled means drawn from all texts: put the positives' share back in.
    back = min(n_positives, int(round(n * prior / max(1e-6, 1 - prior))))
    counts = (
        found.select("_y", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("u"))
        .where(F.col("p") >= 3)
        .orderBy("feature")
        .toPandas()
    )
    in_unlabelled = counts["u"] + counts["p"] * (back / max(1, n_positives))
    taken = informative(counts["p"], in_unlabelled, n_positives, n + back)
    features = counts.loc[taken, "feature"].to_numpy(np.int64)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [f[np.isin(f, features)] for f in batch["features"]]
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "features": hits})

    rows = found.mapInPandas(kept, found.schema).toPandas().sort_values("_id", kind="stable")
    groups = [list(rows.loc[rows["_y"] == y, "features"]) for y in (1, 0)]
    return fit(groups[0], groups[1] + groups[0][:back], features, prior)


def score_documents(docs: DataFrame, model: Model, into: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``into`` (0 to 1, higher: likelier toxic), replaced if there.

    A null or empty text has no evidence and gets the score of the offset alone. Texts
    are read whole; repeated rows score alike; no other column is an input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    return docs.withColumn(into, score(F.col("text")))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt outside the held-out part."""
    model = train(docs, labels, held_out(F.col("_id"), 4, 2))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxic_removed(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    own = free_name(docs, "_score")
    return score_documents(docs, model, own).where(F.col(own) < threshold).drop(own)
