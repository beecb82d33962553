"""Pack documents into sequences of fixed length, refined by a swap-based local search.

Tokenising is one narrow pass. Only lengths travel: pieces meet in cells of bounded
size, each cell is packed by best fit and then improved by moving documents between
underfull bins, by exchanging one for one and two for one; every step raises the sum
of squared fills, which drains the emptiest bins until they vanish. Bins left underfull
in their cells are pooled and improved again in fewer cells, round after round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import stored
from lotbook.llm.tokens import bpe_ids, crc_of, vocabulary_path

CAPACITY = 1024
END_ID = 2
# Pieces packed together in one task; a cell's state is a few MB.
CELL_PIECES = 8192

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    ranks_path: str | None = None,
    added_path: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: its place in the document, length and checksum.

    A document is its token ids and an end id. Those longer than ``capacity`` are cut
    so that all pieces but the first are full. ``ids_crc32`` is taken over the ids as
    little-endian unsigned 32-bit numbers; ``keep_ids`` adds them as ``ids`` (binary).
    Tokens that the file at ``added_path`` adds are found in a text as that file's library
    finds them.
    A null or empty text is a document of the end id alone. Rows that repeat a document
    id are documents of their own.
    """
    path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
    added = added_path or vocabulary_path("byte_bpe_50k.json")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe_ids(path, added)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encoder.of(text) if isinstance(text, str) else b"") + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, crc_of(part))
                    rows.append((*row, part) if keep_ids else row)
                    start, piece = start + length, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            out = pd.DataFrame(rows, columns=names + ["ids"] * keep_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (``length`` at most ``capacity``) in sequences.

    Adds ``sequence_id`` (the row number of the piece that opens the sequence, so it is
    unique) and ``offset`` (gapless from 0). Runs as many rounds as still save a
    sequence; each round handles only the pieces of underfull sequences. An empty table
    gives an empty result.
    """
    numbered = stored(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    keep = [c for c in numbered.columns if c not in ("_uid", "length")]
    placed = numbered.where(F.col("length") >= capacity).select(
        "_uid", F.col("_uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    waiting = numbered.where(F.col("length") < capacity).select(
        "_uid", "length", F.col("_uid").alias("bin")
    )
    count, before, salt = waiting.count(), None, 0
    while count:
        cells = -(-count // CELL_PIECES)
        round_ = stored(_pack_round(waiting, cells, salt, capacity, fresh=before is None), "bins")
        placed = placed.unionByName(
            round_.where(F.col("full")).select("_uid", F.col("bin").alias("sequence_id"), "offset")
        )
        opened = round_.where(~F.col("full"))
        count, bins = opened.agg(
            F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))
        ).first()
        if cells == 1 or (before is not None and bins >= before):
            placed = placed.unionByName(
                opened.select("_uid", F.col("bin").alias("sequence_id"), "offset")
            )
            break
        before, salt = bins, salt + 1
        waiting = opened.select("_uid", "length", "bin")
    return numbered.join(placed, "_uid").select(
        *keep[:3], "length", *keep[3:], "sequence_id", "offset"
    )


def _pack_round(
    waiting: DataFrame, cells: int, salt: int, capacity: int, fresh: bool
) -> DataFrame:
    """One round: bins of a cell together; ``fresh`` packs anew, else bins are improved."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_uid"], ascending=[False, True], kind="stable")
        lengths = group["length"].to_numpy(np.int64)
        bins = best_fit(lengths, capacity) if fresh else pd.factorize(group["bin"])[0]
        bins = improve(lengths, np.asarray(bins, dtype=np.int64), capacity)
        order = np.argsort(bins, kind="stable")
        bins, lengths = bins[order], lengths[order]
        uids = group["_uid"].to_numpy(np.int64)[order]
        firsts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        sizes = np.diff(np.r_[firsts, len(bins)])
        ends = np.cumsum(lengths)
        before = np.repeat(ends[firsts] - lengths[firsts], sizes)
        fills = np.repeat(np.add.reduceat(lengths, firsts), sizes)
        return pd.DataFrame(
            {
                "_uid": uids,
                "length": lengths,
                "bin": np.repeat(uids[firsts], sizes),
                "offset": ends - lengths - before,
                "full": fills == capacity,
            }
        )

    cell = F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(cells))
    schema = "_uid long, length long, bin long, offset long, full boolean"
    # A cell costs far more than its few bytes tell; dealt by number, cells are not merged.
    dealt = waiting.withColumn("_cell", cell).repartition(cells, "_cell")
    return dealt.groupBy("_cell").applyInPandas(pack, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[int]:
    """Bin of each item, items taken in order, each into the fullest bin that holds it."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, out, bins = 0, [], 0
    for length in lengths.tolist():
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, chosen, bins = capacity, bins, bins + 1
        left = space - length
        if left:
            by_space[left].append(chosen)
            spaces |= 1 << left
        out.append(chosen)
    return out


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Drain the emptiest bins into fuller ones until no step raises the squared fill.

    The emptiest bin gives: an item moves into a fuller bin; or one of its items, or
    two together, go against one smaller item of a fuller bin. A step takes the
    exchange that fills most. A bin that can give nothing more is passed over until
    the end; a bin without items is gone.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    stuck: set[int] = set()
    open_items = np.flatnonzero(fill[bins] < capacity)
    while True:
        used = np.flatnonzero(fill > 0)
        if len(used) <= least:
            break
        givers = [b for b in used[np.argsort(fill[used], kind="stable")] if b not in stuck]
        givers = [b for b in givers if fill[b] < capacity]
        if not givers:
            break
        giver = givers[0]
        while fill[giver] > 0 and _give(giver, lengths, bins, fill, open_items, capacity):
            pass
        stuck.add(int(giver))
        if fill[giver] > 0 and len(givers) == 1:
            break
    return bins


def _give(giver, lengths, bins, fill, open_items, capacity) -> bool:
    own = np.flatnonzero(bins == giver)
    own = own[np.argsort(-lengths[own], kind="stable")]
    room = capacity - fill
    usable = (fill >= fill[giver]) & (room > 0)
    usable[giver] = False
    # A move: the largest item that fits, into the bin it fills most.
    for item in own:
        fits = np.flatnonzero(usable & (room >= lengths[item]))
        if len(fits):
            target = fits[np.argmin(room[fits])]
            bins[item] = target
            fill[target] += lengths[item]
            fill[giver] -= lengths[item]
            return True
    others = open_items[usable[bins[open_items]]]
    if not len(others):
        return False
    other_lengths, other_room = lengths[others], room[bins[others]]
    best, gain = None, 0
    pairs = [(int(a),) for a in own]
    pairs += [(int(a), int(b)) for i, a in enumerate(own) for b in own[i + 1 :]]
    for offer in pairs:
        size = int(lengths[list(offer)].sum())
        more = size - other_lengths
        more = np.where((more > 0) & (more <= other_room), more, 0)
        at = int(np.argmax(more))
        if more[at] > gain:
            best, gain = (offer, int(others[at])), int(more[at])
    if best is None:
        return False
    offer, other = best
    target = bins[other]
    bins[list(offer)] = target
    bins[other] = giver
    fill[target] += gain
    fill[giver] -= gain
    return True


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) with their sequence and offset.

    Defined for null ids and texts, empty and very long texts and repeated rows (see
    ``cut_documents``); other columns are not read.
    """
    return pack_pieces(cut_documents(docs, capacity, **options), capacity)
