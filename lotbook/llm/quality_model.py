"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Every passage is encoded, a
gated attention network (Ilse et al. 2018) weighs the passages, and the weighted
representation is scored; encoder, attention and score are learnt together from labels
of documents alone. Learning sees a bounded sample; scoring is one narrow pass over
whole texts, a passage matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import find_words
from lotbook.llm.toxicity import held_out, sample_of

THRESHOLD = 0.5
PASSAGE_WORDS = 64
# At most so many documents of each label take part in learning.
MAX_SAMPLE = 1_500
HIDDEN = 16
BIGRAMS = 32

_CLASSES = ("space", "upper", "lower", "digit", "symbol", "bang", "stop", "point", "high", "line")


def _byte_classes() -> np.ndarray:
    """Byte value to class; all classes of a byte are exclusive but ``line``."""
    table = np.zeros((256, len(_CLASSES)), dtype=np.float32)
    for byte in range(256):
        char = chr(byte)
        if byte >= 128:
            kind = "high"
        elif char in " \t\n\x0b\x0c\r":
            kind = "space"
        elif char.isupper():
            kind = "upper"
        elif char.islower():
            kind = "lower"
        elif char.isdigit():
            kind = "digit"
        elif char in "#*$%&|<>":
            kind = "symbol"
        elif char == "!":
            kind = "bang"
        elif char in ".?":
            kind = "stop"
        else:
            kind = "point"
        table[byte, _CLASSES.index(kind)] = 1
    table[ord("\n"), _CLASSES.index("line")] = 1
    return table


_TABLE = _byte_classes()
_SPACE = _TABLE[:, 0] > 0
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
WIDTH = len(_CLASSES) + 4 + BIGRAMS
# Bytes whose classes are looked up at a time, so a very long text needs no large table.
_SLICE_PASSAGES = 512


def passages(text: str | None) -> np.ndarray:
    """Features of each passage of a text, one row each; one zero row for an empty text."""
    words = find_words(text) if isinstance(text, str) else []
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    blank = _SPACE[raw]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    cuts = np.r_[starts[::PASSAGE_WORDS], len(raw)]
    out = np.empty((len(cuts) - 1, WIDTH), dtype=np.float32)
    for first in range(0, len(out), _SLICE_PASSAGES):
        last = min(len(out), first + _SLICE_PASSAGES)
        part = raw[cuts[first] : cuts[last]]
        at = cuts[first:last] - cuts[first]
        sizes = np.diff(np.r_[at, len(part)]).astype(np.float32)[:, None]
        out[first:last, : len(_CLASSES)] = np.add.reduceat(_TABLE[part], at, axis=0) / sizes
        low = _LOWER[part]
        pairs = (low[:-1] * 31 + low[1:]) % BIGRAMS
        row = np.repeat(np.arange(last - first), sizes[:, 0].astype(np.int64))[:-1]
        grid = np.bincount(row * BIGRAMS + pairs, minlength=(last - first) * BIGRAMS)
        out[first:last, -BIGRAMS:] = grid.reshape(-1, BIGRAMS) / sizes * 4
    base = len(_CLASSES)
    for i in range(len(out)):
        own = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        n = len(own)
        out[i, base] = len(set(own)) / n
        out[i, base + 1] = sum(map(str.__eq__, own[1:], own)) / n
        out[i, base + 2] = min(2.0, sum(map(len, own)) / n / 8)
        out[i, base + 3] = n / PASSAGE_WORDS
    return out


@dataclass
class Model:
    """Scaling of passage features and weights of encoder, gates and score."""

    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, bag: np.ndarray) -> float:
        x = (bag - self.center) / self.scale
        return float(forward(self.weights, x, np.array([0]), np.zeros(len(x), np.int64))["p"][0])


def forward(w: dict, x: np.ndarray, starts: np.ndarray, bag_of: np.ndarray) -> dict:
    """Scores of bags; rows of a bag are adjacent and begin at ``starts``."""
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t = np.tanh(h @ w["v"])
    g = 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
    e = (t * g) @ w["att"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag_of])
    a = e / np.add.reduceat(e, starts)[bag_of]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = 200, seed: int = 7) -> Model:
    """Learn from bags of passages and the label of each bag; both labels weigh the same."""
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    y = labels.astype(np.float64)
    center = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(WIDTH)
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "enc": normal(WIDTH, HIDDEN), "enc_b": np.zeros(HIDDEN), "v": normal(HIDDEN, HIDDEN),
        "u": normal(HIDDEN, HIDDEN), "att": normal(HIDDEN), "out": normal(HIDDEN),
        "out_b": np.zeros(1),
    }
    if not bags or len(set(y)) < 2:
        # Nothing to tell apart: every document gets the only label seen, or one half.
        w = {k: np.zeros_like(v) for k, v in w.items()}
        w["out_b"] = np.array([4.0 * (2 * y[0] - 1) if len(y) else 0.0])
        return Model(center, scale, w)
    x = (x - center) / scale
    sizes = np.array([len(b) for b in bags])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    bag_of = np.repeat(np.arange(len(bags)), sizes)
    importance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        f = forward(w, x, starts, bag_of)
        slope = (f["p"] - y) * importance
        dz = slope[:, None] * w["out"]
        spread = dz[bag_of]
        da = (spread * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag_of])
        dt = de[:, None] * w["att"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * w["att"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * spread + dt @ w["v"].T + dg @ w["u"].T
        dh *= 1 - f["h"] ** 2
        grads = {
            "enc": x.T @ dh, "enc_b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ slope,
            "out_b": np.array([slope.sum()]),
        }
        for k, grad in grads.items():
            grad = grad + 1e-4 * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            square[k] = 0.999 * square[k] + 0.001 * grad**2
            rate = 0.02 / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            w[k] = w[k] - rate * mean[k]
    return Model(center, scale, w)


def train(docs: DataFrame, labels: DataFrame, fold: Column) -> Model:
    """Learn from labelled rows outside ``fold`` (a condition on the id, here ``_id``)."""
    sample = sample_of(docs, labels, "quality", fold, {1: MAX_SAMPLE, 0: MAX_SAMPLE})

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [passages(t).astype("<f4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "bag": packed})

    rows = sample.mapInPandas(encoded, "_id long, _y int, bag binary").toPandas()
    rows = rows.sort_values("_id", kind="stable")
    bags = [np.frombuffer(b, dtype="<f4").reshape(-1, WIDTH) for b in rows["bag"]]
    return fit(bags, rows["_y"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_score`` (0 to 1, higher: likelier good).

    A null or empty text is one passage without features and is scored as such. Texts
    are read whole; repeated rows score alike; no other column is an input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for batch in batches:
            yield pd.Series([own.score(passages(t)) for t in batch], dtype="float64")

    return docs.withColumn("_score", score(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt outside the held-out part."""
    model = train(docs, labels, held_out(F.col("_id"), 3, 1))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
