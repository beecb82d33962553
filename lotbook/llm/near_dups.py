"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

Signatures follow DartMinHash (Christiani 2020): every element throws hashed darts into
the plane of weight and rank, a dart counts if it lies below the element's weight, and
each coordinate of the signature keeps its earliest dart. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Bands of
coordinates are join keys; every candidate pair is then checked exactly.

Copies of a text are one node. In a bucket each node is compared with the bucket's
leader, not with all others. What is left apart is compared pairwise where that is
little work; large buckets of unlike texts (a shared passage makes them) are dealt anew
by their rarest shingles, an exact prefix filter, so no link is lost to a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import (
    WORD_PATTERN,
    find_words,
    free_name,
    key_filter,
    stored,
    with_maybe,
)

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 30, 5
CACHE_WORDS = 200_000
# Pairs that a bucket may compare directly; larger buckets are dealt anew.
BUCKET_PAIRS = 4_096
# Words of 64 bits in the bitmaps that bound the difference of two sets of shingles.
BITMAP_WORDS = 16
_WORDS = range(BITMAP_WORDS)
# Shingles whose darts are thrown together.
BATCH_ELEMENTS = 1 << 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWEST_RANK = 2.0**-4


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_poisson: dict[float, np.ndarray] = {}


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count with that mean."""
    if area not in _poisson:
        most = int(area + 12 * np.sqrt(area) + 24)
        logs = np.arange(1, most + 1)
        terms = -area + np.r_[0, np.cumsum(np.log(area) - np.log(logs))]
        _poisson[area] = np.cumsum(np.exp(terms))
    return _poisson[area]


def dart_minhash(
    elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, coordinates: int
) -> np.ndarray:
    """Signatures of several weighted sets, one row each.

    ``elements`` (64-bit hashes) and positive ``weights`` of the sets stand one after
    another, ``sizes`` (at least 1) tells how many each set has. The plane is cut into
    rank bands and weight bands of doubling width; the number of darts in a cell and
    each dart's place, rank and coordinate depend on the element and the cell alone.
    Rank bands are thrown in order until every coordinate has a dart.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), coordinates), dtype=np.uint64)
    done = np.zeros((len(sizes), coordinates), dtype=bool)
    rank_low, rank_high, band = 0.0, _LOWEST_RANK, 0
    while True:
        active = ~done.all(axis=1)
        if not active.any():
            return out
        inside = active[owner]
        own, hashes, heights = owner[inside], elements[inside], weights[inside]
        slots, ranks, names = [], [], []
        low, high, level = 0.0, 1.0, 0
        while len(own):
            cell = mix(hashes ^ mix(np.array([band * 64 + level], dtype=np.uint64)))
            steps = _poisson_steps((high - low) * (rank_high - rank_low))
            counts = np.searchsorted(steps, _unit(cell), side="right")
            total = int(counts.sum())
            first = np.cumsum(counts) - counts
            index = np.arange(total) - np.repeat(first, counts)
            dart = mix(np.repeat(cell, counts) + index.astype(np.uint64) * _GOLD)
            place = mix(dart ^ np.uint64(1))
            below = low + (high - low) * _unit(place) < np.repeat(heights, counts)
            dart = dart[below]
            slot = np.repeat(own, counts)[below] * coordinates
            slot += (mix(dart ^ np.uint64(2)) % np.uint64(coordinates)).astype(np.int64)
            slots.append(slot)
            ranks.append(mix(dart ^ np.uint64(3)))
            names.append(dart)
            taller = heights > high
            own, hashes, heights = own[taller], hashes[taller], heights[taller]
            low, high, level = high, high * 2, level + 1
        slot, rank, name = map(np.concatenate, (slots, ranks, names))
        new = ~done.reshape(-1)[slot]
        slot, rank, name = slot[new], rank[new], name[new]
        order = np.lexsort((name, rank, slot))
        slot, name = slot[order], name[order]
        earliest = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        out.reshape(-1)[slot[earliest]] = name[earliest]
        done.reshape(-1)[slot[earliest]] = True
        rank_low, rank_high, band = rank_high, rank_high * 2, band + 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        self[word] = value
        return value


_hashes = _WordHashes()


def shingle_hashes(words: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hash of each run of ``size`` words; of all words where there are fewer."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    ids = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(ids))
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out ^ ids[i : len(ids) - size + 1 + i])
    return out


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> frozenset[tuple[str, ...]]:
    """The distinct runs of words themselves, for exact comparison."""
    words = find_words(text)
    size = min(size, len(words))
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False))


def signatures(docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """``bands`` keys per row of (``_digest``, ``_id``, ``text``), null without words, and ``_row``.

    Rows get their number here, in the scan that is written; no other scan is numbered.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list = [None] * len(batch)
            held: list = []
            waiting = 0

            def flush(held, keys):
                if held:
                    sizes = np.array([len(e) for _, e, _ in held])
                    elements = np.concatenate([e for _, e, _ in held])
                    weights = np.concatenate([w for _, _, w in held])
                    signed = dart_minhash(elements, weights, sizes, bands * rows)
                    signed = signed.reshape(len(held), bands, rows)
                    key = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(held), 0)
                    for i in range(rows):
                        key = mix(key ^ signed[:, :, i])
                    for (at, _, _), own in zip(held, key.view(np.int64), strict=True):
                        keys[at] = own

            for at, text in enumerate(batch["text"]):
                words = find_words(text) if isinstance(text, str) else []
                if not words:
                    continue
                elements, counts = np.unique(shingle_hashes(words), return_counts=True)
                weights = counts if weighted else np.ones(len(counts))
                held.append((at, elements, weights.astype(np.float64)))
                waiting += len(elements)
                if waiting > BATCH_ELEMENTS:
                    flush(held, keys)
                    held, waiting = [], 0
            flush(held, keys)
            out = batch[["_digest", "_id"]].copy()
            out["_id"] = out["_id"].astype("Int64")
            out["_keys"] = keys
            yield out

    schema = "_digest binary, _id long, _keys array<long>"
    signed = docs.select("_digest", "_id", "text").mapInPandas(sign, schema)
    return signed.withColumn("_row", F.monotonically_increasing_id())


def _jaccards(pairs: DataFrame) -> DataFrame:
    """Exact similarity of (``a``, ``b``, ``text_a``, ``text_b``); rows of one b are adjacent."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, right = None, frozenset()
        for batch in batches:
            found = []
            for a, b in zip(batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, right = b, shingle_set(b)
                left = shingle_set(a)
                both = len(left & right)
                found.append(both / max(1, len(left) + len(right) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "sim": found})

    return pairs.mapInPandas(compare, "a long, b long, sim double")


def _shingles_of(texts: DataFrame) -> DataFrame:
    """``_node``, ``key``: hashes of the distinct shingles of each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.iloc[first : first + 256]
                own = [np.unique(shingle_hashes(find_words(t))) for t in part["text"]]
                nodes = part["_node"].to_numpy().repeat([len(o) for o in own])
                keys = np.concatenate(own).view(np.int64)
                yield pd.DataFrame({"_node": nodes, "key": keys})

    return texts.mapInPandas(cut, "_node long, key long")


def _bitmaps_of(texts: DataFrame) -> DataFrame:
    """``_node`` and the words of its bitmap: a bit is set if an odd number of shingles hash there."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = []
            for text in batch["text"]:
                own = np.unique(shingle_hashes(find_words(text)))
                odd = np.bincount((own % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)) % 2
                odd = np.pad(odd, (0, 64 * BITMAP_WORDS - len(odd))).astype(bool)
                bits.append(np.packbits(odd, bitorder="little").view("<i8"))
            yield pd.DataFrame({"_node": batch["_node"], "bits": bits})

    marked = texts.mapInPandas(mark, "_node long, bits array<long>")
    return marked.select("_node", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in _WORDS])


class _Linker:
    """Verified links between nodes that share a key."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, similarity: float):
        self.docs, self.nodes, self.similarity = docs, nodes, similarity
        self.links: list[DataFrame] = []
        self.texts: DataFrame | None = None

    def gather(self, active: DataFrame) -> None:
        """Texts of the nodes that share a key at all, fetched from the documents once."""
        if self.texts is None:
            wanted = active.select("_node").distinct()
            rows = self.nodes.join(wanted, "_node", "left_semi").select("_node", "_digest", "_id")
            rows = stored(rows, "wanted")
            same = F.col("d._digest") == F.col("r._digest")
            same &= F.col("d._id").eqNullSafe(F.col("r._id"))
            # Most rows share no key; they are left out before the others travel.
            docs = with_maybe(self.docs, F.col("_digest"), key_filter(rows, "_digest"), "_maybe")
            docs = docs.where("_maybe").drop("_maybe")
            texts = docs.alias("d").join(rows.alias("r"), same).select("_node", "text")
            # Rows that repeat id and text are still there; they merge before they travel.
            texts = texts.groupBy("_node").agg(F.first("text").alias("text"))
            self.texts = stored(texts, "texts")

    def verify(self, pairs: DataFrame, few: str = "ab") -> DataFrame:
        """``pairs`` (``a``, ``b``) with their exact similarity; keeps those that link.

        ``few`` names the sides with few of the nodes, whose texts are filtered first.
        """
        pairs = stored(pairs, "pairs")
        both = pairs
        for side in ("a", "b"):
            texts = self._likely(pairs, side) if side in few else self.texts
            texts = texts.withColumnsRenamed({"_node": side, "text": f"text_{side}"})
            both = both.join(texts, side)
        tested = stored(_jaccards(both), "tested")
        self.links.append(tested.where(F.col("sim") >= self.similarity).select("a", "b"))
        return tested

    def _likely(self, wanted: DataFrame, key: str) -> DataFrame:
        """Texts whose node is in ``key`` of ``wanted``, and few others."""
        texts = with_maybe(self.texts, F.col("_node"), key_filter(wanted, key), "_maybe")
        return texts.where("_maybe").drop("_maybe")

    def classes(self) -> DataFrame:
        return components(reduce(DataFrame.union, self.links).distinct())

    def link(self, keys: DataFrame, exact: bool) -> None:
        """Link all similar nodes that share a key in ``keys`` (``key``, ``_node``).

        The nodes of a bucket are compared with its leader. A node outside the leader's
        class afterwards is compared with the nodes that exact bounds leave possible: the
        triangle inequality of the Jaccard distance, the shingles no other node has, and
        the difference of bitmaps (Sandes et al. 2020). Buckets with too many such nodes
        go by their rarest shingles; those that came from there (``exact``) are compared.
        """
        active, apart = stored(keys, "keys"), 1 - self.similarity
        sizes = stored(
            active.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1),
            "sizes",
        )
        # Few keys are shared; the rows of the others do not travel again.
        active = with_maybe(active, F.col("key"), key_filter(sizes, "key"), "_maybe")
        active = active.where("_maybe").drop("_maybe")
        active = stored(active.join(sizes, "key"), "shared")
        self.gather(active)
        # The node that shares keys with most others is the likeliest centre of a bucket.
        central = active.groupBy("_node").agg(F.sum("n").alias("weight"))
        leaders = (
            active.join(central, "_node")
            .groupBy("key")
            .agg(F.max(F.struct("weight", "_node")).alias("best"))
            .select("key", F.col("best._node").alias("leader"))
        )
        members = stored(
            active.join(leaders, "key")
            .where(F.col("_node") != F.col("leader"))
            .select("key", "_node", "leader"),
            "members",
        )
        pairs = members.select(F.col("_node").alias("a"), F.col("leader").alias("b"))
        tested = self.verify(pairs.distinct(), few="b")
        classes = self.classes()
        near = members.join(
            tested.select(F.col("a").alias("_node"), F.col("b").alias("leader"), "sim"),
            ["_node", "leader"],
        )
        out = classes.select(F.col("node").alias("_node"), F.col("label").alias("own"))
        of_leader = classes.select(
            F.col("node").alias("leader"), F.col("label").alias("theirs")
        )
        near = stored(
            near.join(out, "_node", "left")
            .join(of_leader, "leader", "left")
            .withColumn("own", F.coalesce("own", "_node"))
            .withColumn("loose", F.col("own") != F.coalesce("theirs", "leader"))
            .select("key", "_node", "sim", "own", "loose"),
            "near",
        )
        open_ = near.groupBy("key").agg(F.max("loose").alias("any")).where("any").select("key")
        near = self._possible(near.join(open_, "key", "left_semi"))
        loose = F.count(F.when(F.col("loose"), 1))
        work = stored(
            near.groupBy("key")
            .agg((loose * F.count(F.lit(1))).alias("work"))
            .where(F.col("work") > 0),
            "work",
        )
        if work.isEmpty():
            return
        small = work.where(F.col("work") <= BUCKET_PAIRS).select("key")
        large = stored(work.where(F.col("work") > BUCKET_PAIRS).select("key"), "large")
        self._compare_loose(near.join(small, "key", "left_semi"), apart)
        if large.isEmpty():
            return
        if exact:
            # What still can be similar after both filters is compared.
            self._compare_loose(near.join(large, "key", "left_semi"), apart)
            return
        rest = near.join(large, "key", "left_semi").select("_node").distinct()
        self.link(self.prefix_keys(rest), exact=True)
        return

    def _possible(self, near: DataFrame) -> DataFrame:
        """Rows whose node can still have a partner, with its number of shingles.

        ``most`` is how many of them other nodes in question have at all. A partner shares no
        more, so a node with too many shingles of its own is settled without comparison.
        """
        near = stored(near, "open_near")
        texts = self._likely(near, "_node")
        texts = texts.join(near.select("_node").distinct(), "_node", "left_semi")
        shingles = stored(_shingles_of(texts), "shingles")
        alone = (
            shingles.groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_node").alias("_node"))
            .where(F.col("n") == 1)
            .groupBy("_node")
            .agg(F.count(F.lit(1)).alias("alone"))
        )
        total = shingles.groupBy("_node").agg(F.count(F.lit(1)).alias("size"))
        known = total.join(alone, "_node", "left").select(
            "_node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most")
        )
        able = known.where(F.col("most") >= self.similarity * F.col("size") - 1e-9)
        able = stored(able, "able")
        texts = self._likely(able, "_node").join(able.select("_node"), "_node", "left_semi")
        return stored(near.join(able, "_node").join(_bitmaps_of(texts), "_node"), "possible")

    def _compare_loose(self, near: DataFrame, apart: float) -> None:
        """Loose nodes against those of their bucket that can be similar to them at all."""
        a, b = near.where("loose").alias("a"), near.alias("b")
        shared = F.least("a.most", "b.most")
        both = F.col("a.size") + F.col("b.size")
        # At least so many shingles are in one of the two sets only.
        apart_bits = reduce(
            lambda x, y: x + y,
            [F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in _WORDS],
        )
        most_apart = both * ((1 - self.similarity) / (1 + self.similarity))
        pairs = a.join(
            b,
            (F.col("a.key") == F.col("b.key"))
            # Distances to the leader of two similar nodes differ by at most ``apart``.
            & (F.abs(F.col("a.sim") - F.col("b.sim")) <= apart + 1e-9)
            & (shared >= self.similarity * (both - shared) - 1e-9)
            & (apart_bits <= most_apart + 1e-9)
            & (F.col("a.own") != F.col("b.own"))
            & (~F.col("b.loose") | (F.col("a._node") < F.col("b._node"))),
        )
        pairs = pairs.select(F.col("a._node").alias("a"), F.col("b._node").alias("b"))
        self.verify(pairs.distinct())

    def prefix_keys(self, nodes: DataFrame) -> DataFrame:
        """Rarest shingles of each node: similar sets share one of them, without exception."""
        similarity = self.similarity
        nodes = stored(nodes, "rest")
        texts = self._likely(nodes, "_node").join(nodes, "_node", "left_semi")
        shingles = stored(_shingles_of(texts), "shingles")
        counts = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        # A shingle of one node alone is rarest of all; it needs no key but takes a place.
        ranked = shingles.join(counts, "key", "left").groupBy("_node").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key")))
            .alias("all")
        )
        length = F.size("all")
        most = (length - F.ceil(F.lit(similarity) * length - 1e-9) + 1).cast("int")
        return (
            ranked.select("_node", F.explode(F.slice("all", F.lit(1), most)).alias("s"))
            .where(F.col("s.n") > 1)
            .select(F.col("s.key").alias("key"), "_node")
        )


def components(links: DataFrame) -> DataFrame:
    """Class label (least node) of every node in ``links`` (``a``, ``b``).

    Labels travel along links in both directions and then along labels, which halves
    the way each round. Every round is written, so a lost executor costs little.
    """
    links = stored(links, "links")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        links.select("b", "a")
    )
    labels = stored(
        both.groupBy("node")
        .agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        told = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        nearest = (
            told.select("node", "label", F.lit(None).cast("long").alias("old"))
            .union(labels.select("node", "label", F.col("label").alias("old")))
            .groupBy("node")
            .agg(F.min("label").alias("next"), F.min("old").alias("old"))
        )
        nearest = stored(nearest, "nearest")
        jumped = nearest.join(
            nearest.select(F.col("node").alias("next"), F.col("next").alias("far")), "next"
        )
        label = F.least("next", "far")
        new = jumped.select("node", label.alias("label"), (label != F.col("old")).alias("changed"))
        labels = stored(new, "labels")
        if labels.where("changed").isEmpty():
            return labels.drop("changed")


def _order(id_: Column, row: Column) -> Column:
    return F.struct(id_.isNull().alias("none"), id_.alias("id"), row.alias("row"))


def duplicate_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    weighted: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``_row``, ``doc_id``, ``class_id``, ``kept``.

    Two texts are linked if the sets of their runs of five words (shorter texts: of all
    words) have a Jaccard similarity of at least ``similarity``; classes are what links
    connect. ``class_id`` is the least id of a class, and ``kept`` marks one row of it, the
    first by id. Signatures weigh shingles alike, or by their count with ``weighted``. A
    null or empty text, or one of white space, is a class of its own per row. Rows that
    repeat id and text are copies of each other; rows without an id can be copies too
    and are kept only if none of their class has an id. Texts are not written again: rows
    are numbered (``_row``) with their signatures, and texts are found by id and digest.
    """
    joined = _labelled(docs, similarity, bands, band_rows, weighted)
    return joined.select(
        "_row",
        F.col("_id").alias("doc_id"),
        F.when(F.col("head").isNull(), F.col("_id")).otherwise(F.col("head.id")).alias("class_id"),
        (F.col("head").isNull() | (F.col("head.row") == F.col("_row"))).alias("kept"),
    )


def _digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _labelled(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    weighted: bool = False,
) -> DataFrame:
    """Rows with the label and head of their class; null where a row has no words."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), "text", _digest_of("text").alias("_digest")
    )
    signed = stored(signatures(rows, bands, band_rows, weighted), "signatures")
    some = signed.where(F.col("_keys").isNotNull())
    # A text is named by the number of its first row, which is shorter than its digest.
    nodes = stored(
        some.groupBy("_digest")
        .agg(F.min(_order(F.col("_id"), F.col("_row"))).alias("least"))
        .select("_digest", F.col("least.id").alias("_id"), F.col("least.row").alias("_node")),
        "nodes",
    )
    keys = some.join(nodes, F.col("_row") == F.col("_node"), "left_semi").select(
        F.explode("_keys").alias("key"), F.col("_row").alias("_node")
    )
    linker = _Linker(rows, nodes, similarity)
    linker.link(keys, exact=False)
    labelled = nodes.join(
        linker.classes().select(F.col("node").alias("_node"), "label"), "_node", "left"
    ).select("_digest", "_node", "_id", F.coalesce("label", "_node").alias("label"))
    labelled = stored(labelled, "labelled")
    heads = stored(
        labelled.groupBy("label").agg(F.min(_order(F.col("_id"), F.col("_node"))).alias("head")),
        "heads",
    )
    of_node = stored(labelled.join(heads, "label").select("_digest", "head", "label"), "of_node")
    joined = signed.select(
        "_row", "_id", F.when(F.col("_keys").isNotNull(), F.col("_digest")).alias("_digest")
    ).join(of_node, "_digest", "left")
    return joined


def _busy(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests in classes of several rows, and the heads of these with the rows that repeat them."""
    rows = joined.where(F.col("head").isNotNull())
    counts = rows.groupBy("_digest", "_id", "label", "head").agg(
        F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")
    )
    counts = stored(counts, "copies")
    several = stored(
        counts.groupBy("label").agg(F.sum("n").alias("rows")).where(F.col("rows") > 1), "several"
    )
    busy = stored(counts.join(several, "label"), "busy")
    heads = busy.where(F.col("first") == F.col("head.row")).select("_digest", "_id", "n")
    return busy.select("_digest").distinct(), heads


def near_duplicates_removed(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with its own columns.

    Of rows that repeat the id and text of a class's head, the one whose other columns come
    first as JSON stays. Rows without words all stay. No column of ``docs`` is renamed.
    """
    own = free_name(docs, "_kept")
    busy, heads = _busy(_labelled(docs, **options))
    heads = stored(heads.select(F.struct("_digest", "_id", "n").alias(own)), "kept")
    # Rows that are a class of their own stay where they are; only the others are joined.
    maybe = free_name(docs, "_maybe")
    marked = with_maybe(docs, _digest_of("text"), key_filter(busy, "_digest"), maybe)
    alone = marked.where(~F.col(maybe)).select(*docs.columns)
    text, id_ = F.col("text"), F.col("doc_id").cast("long")
    wordless = text.isNull() | ~text.rlike(WORD_PATTERN)
    rest = marked.where(F.col(maybe)).select(*docs.columns)
    at = lambda name: F.col(own)[name]
    same = (_digest_of("text") == at("_digest")) & id_.eqNullSafe(at("_id"))
    found = rest.where(~wordless).join(heads, same)
    one = found.where(at("n") == 1).select(*docs.columns)
    several = found.where(at("n") > 1).groupBy(at("_digest"), at("_id"))
    row = F.struct(*docs.columns)
    several = several.agg(F.min_by(row, F.to_json(row)).alias(own)).select(f"{own}.*")
    return alone.unionByName(one).unionByName(several).unionByName(rest.where(wordless))
