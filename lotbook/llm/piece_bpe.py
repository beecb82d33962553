"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text is a row of one-character symbols. An agenda holds every adjacent pair whose
concatenation is a piece; the pair of the highest score, of equal ones the leftmost, is
merged, and the pairs it makes with its neighbours join the agenda, until it is empty.
Characters without a piece become their UTF-8 bytes.

Where no piece of a vocabulary has a space mark behind another character, no merge crosses
the start of a run of marks, nor one of a character without a piece. The parts between are
then independent. The ids of parts seen before come from a bounded dictionary; short parts
go through their agendas together, a row of a matrix each.

Texts go through in Arrow batches and are held against the library there: the ids of each
part that enters the dictionary, the ids of some whole texts, and every decoded text.
"""

from __future__ import annotations

import codecs
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Parts a dictionary may hold before it is emptied; about 40 MB in a Python worker.
CACHE_PARTS = 200_000
# Texts of a batch are handed to Spark in pieces of about this many characters.
SLICE_CHARS = 1 << 20
# One text in so many is held against the library as a whole, by a hash of the text.
CHECK_EVERY = 32
# Kinds of pieces as the model file numbers them.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

# Parts of at most so many characters share a matrix of their length; longer ones use a heap.
WIDTHS = (8, 16, 32)
MATRIX_ROWS = 1 << 15
_NO_PAIR = np.iinfo(np.int32).max


def _one_per_byte(error: UnicodeError) -> tuple[str, int]:
    """One replacement character for each byte that belongs to no character."""
    return "�", error.start + 1


codecs.register_error("lotbook_piece_bytes", _one_per_byte)


class PieceBpe(dict):
    """Ids of texts and texts of ids. As a dictionary: part of a text to its ids."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError("not a merge-type vocabulary")
        if not model.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("vocabularies need byte pieces, and none unused or set by users")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("vocabularies that rewrite characters or spaces are not read")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.prefix = rules.add_dummy_prefix
        # The same vocabulary for parts, to which no mark is to be added.
        rules.add_dummy_prefix = False
        self.of_parts = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # Parts whose ids the library does not give.
        self.odd: set[str] = set()
        self.scores, self.ids, self.bytes, self.surface = {}, {}, {}, []
        for at, piece in enumerate(model.pieces):
            own = b""
            if piece.type == _NORMAL:
                self.scores[piece.piece], self.ids[piece.piece] = piece.score, at
                own = piece.piece.replace(SPACE, " ").encode()
            elif piece.type == _BYTE:
                own = bytes([int(piece.piece[3:5], 16)])
                self.bytes[own[0]] = at
            elif piece.type == _UNKNOWN:
                own = (model.trainer_spec.unk_surface or " ⁇ ").encode()
            self.surface.append(own)
        marked = {self.ids[p] for p in self.ids if p.startswith(SPACE)}
        self.leads = np.array([at in marked for at in range(len(self.surface))])
        self._surfaces = pa.array(self.surface, pa.binary())
        self.controls = [at for at, piece in enumerate(model.pieces) if piece.type == _CONTROL]
        # Where parts of a text begin and end: at runs of marks and at characters without piece.
        divides = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        alone = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in self.ids)
        inside = f"[^{SPACE}{alone}]"
        pattern = f"{SPACE}+{inside}*|{inside}+" + (f"|[{alone}]" if alone else "")
        self.parts = re.compile(pattern).findall if divides else lambda text: [text]
        self._pairs()

    def _pairs(self) -> None:
        """Tables of the matrix form: ids of characters, and rank and result of pairs of ids."""
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for piece, at in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = at
        # Equal scores have equal ranks, as the leftmost of them is merged first.
        ranks = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.size, found = len(self.surface), []
        for piece, at in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.size + right, ranks[self.scores[piece]], at))
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self._codes, self.rank, self.result = table[:, 0], table[:, 1], table[:, 2]
        # Open addressing: a code stands at its hash or a few places behind it.
        bits = max(4, int(len(table)).bit_length() + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._slots = np.full(1 << bits, -1, dtype=np.int64)
        waiting, self._probes = np.arange(len(table)), 0
        home = self._home(self._codes)
        while len(waiting):
            place = (home[waiting] + self._probes) & self._mask
            first = np.unique(place, return_index=True)[1]
            first = first[self._slots[place[first]] < 0]
            self._slots[place[first]] = waiting[first]
            waiting, self._probes = np.delete(waiting, first), self._probes + 1
        self._codes = np.r_[self._codes, -2]
        self.rank = np.r_[self.rank, _NO_PAIR].astype(np.int32)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self._shift).astype(np.int64)

    def _place(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of pairs of ids, and where they stand in the table; negative ids have no pair."""
        codes = left.astype(np.int64) * self.size + right
        codes[(left < 0) | (right < 0)] = -1
        home = self._home(codes)
        at = self._slots[home]
        # An empty slot is -1, the last entry, which is no pair.
        behind = np.flatnonzero((self._codes[at] != codes) & (at >= 0))
        for probe in range(1, self._probes):
            if not len(behind):
                break
            at[behind] = self._slots[(home[behind] + probe) & self._mask]
            behind = behind[(self._codes[at[behind]] != codes[behind]) & (at[behind] >= 0)]
        at[behind] = -1
        return self.rank[at], at

    def merged_rows(self, parts: list[str], width: int) -> list[bytes]:
        """Ids of parts of at most ``width`` characters; a row holds a part's own agenda.

        In each step a row takes the pair of the highest score, the leftmost of equal ones.
        """
        lengths = np.array([len(p) for p in parts])
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        inside = np.arange(width)[None] < lengths[:, None]
        # Characters without a piece are kept as negative numbers, the end as the least one.
        ids = self.of_char[chars]
        symbols = np.full(inside.shape, np.iinfo(np.int32).min, dtype=np.int32)
        symbols[inside] = np.where(ids < 0, -chars - 1, ids)
        agenda = np.full((len(parts), width - 1), _NO_PAIR, dtype=np.int32)
        pairs = inside[:, 1:]
        agenda[pairs], _ = self._place(symbols[:, :-1][pairs], symbols[:, 1:][pairs])
        columns = np.arange(width)
        while len(rows := np.flatnonzero(agenda.min(axis=1) < _NO_PAIR)):
            at = agenda[rows].argmin(axis=1)
            _, place = self._place(symbols[rows, at], symbols[rows, at + 1])
            # What stands right of the pair moves one place to the left.
            moved = np.minimum(columns[None] + (columns[None] > at[:, None]), width - 1)
            own = np.take_along_axis(symbols[rows], moved, axis=1)
            own[:, -1] = np.iinfo(np.int32).min
            every = np.arange(len(rows))
            own[every, at] = self.result[place]
            ranks = np.take_along_axis(agenda[rows], np.minimum(moved[:, :-1], width - 2), axis=1)
            ranks[:, -1] = _NO_PAIR
            left = np.maximum(at - 1, 0)
            ranks[every, left], _ = self._place(own[every, left], own[every, left + 1])
            right = np.minimum(at, width - 2)
            ranks[every, right], _ = self._place(own[every, right], own[every, right + 1])
            symbols[rows], agenda[rows] = own, ranks
        kept = symbols > np.iinfo(np.int32).min
        flat, ends = symbols[kept].astype("<i4"), np.cumsum(kept.sum(axis=1))
        whole, starts = flat.tobytes(), np.r_[0, ends[:-1]]
        out = [whole[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for at in np.flatnonzero((kept & (symbols < 0)).any(axis=1)).tolist():
            row: list[int] = []
            for own in symbols[at][kept[at]].tolist():
                row.extend([own] if own >= 0 else map(self.bytes.get, chr(-own - 1).encode()))
            out[at] = np.array(row, dtype="<i4").tobytes()
        return out

    def learn(self, texts: list[list[str]], check: bool) -> None:
        """Put the short parts of ``texts`` into the dictionary, those that are not there."""
        new = set().union(*texts)
        if len(self) + len(new) > CACHE_PARTS:
            self.clear()
            self.odd.clear()
        new, least = list(new.difference(self)), 0
        for width in WIDTHS:
            parts = [part for part in new if least < len(part) <= width]
            least = width
            for first in range(0, len(parts), MATRIX_ROWS):
                some = parts[first : first + MATRIX_ROWS]
                own = self.merged_rows(some, width)
                self.update(zip(some, own, strict=True))
                if check:
                    library = self.of_parts.encode(some)
                    ids = np.frombuffer(b"".join(own), dtype="<i4").tolist()
                    sizes = [4 * len(a) for a in library]
                    if sizes != list(map(len, own)) or list(chain.from_iterable(library)) != ids:
                        both = zip(some, library, own, strict=True)
                        self.odd.update(p for p, a, b in both if np.array(a, "<i4").tobytes() != b)

    def merged(self, text: str) -> list[int]:
        """Ids of escaped text by the agenda."""
        scores, symbols = self.scores, list(text)
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbols[left] + symbols[right]
                score = scores.get(both)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, both))

        for at in range(1, len(symbols)):
            offer(at - 1, at)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            # A symbol that was merged since is empty or longer.
            if not symbols[left] or not symbols[right]:
                continue
            if after[left] != right or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                own = self.ids.get(symbol)
                out.extend([own] if own is not None else map(self.bytes.get, symbol.encode()))
        return out

    def __missing__(self, part: str) -> bytes:
        return np.array(self.merged(part), dtype="<i4").tobytes()

    def encode(self, texts: list[str], check: bool = False) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of whole texts, without begin or end ids, and whether the library's are the same.

        With ``check`` the library gives the ids of every new part of up to the greatest
        of ``WIDTHS`` characters, and those of longer parts and of one in ``CHECK_EVERY`` texts
        with the whole text.
        """
        marked = [t and (SPACE if self.prefix else "") + t.replace(" ", SPACE) for t in texts]
        parts = [self.parts(t) if t else [] for t in marked]
        self.learn(parts, check)
        ids = [np.frombuffer(b"".join(map(self.__getitem__, p)), dtype="<i4") for p in parts]
        agree = [True] * len(texts)
        for at, text in enumerate(texts) if check else ():
            if zlib.crc32(text.encode()) % CHECK_EVERY == 0 or max(map(len, parts[at]), default=0) > WIDTHS[-1]:
                agree[at] = ids[at].tolist() == self.library.encode(text)
            if self.odd and not self.odd.isdisjoint(parts[at]):
                agree[at] = False
        return ids, agree

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character are a replacement character each."""
        first = next((at for at in ids if self.surface[at]), None)
        runs = [ids]
        if any(c in ids for c in self.controls):
            # An id without a text still ends a run of bytes.
            cuts = [-1, *(i for i, at in enumerate(ids) if at in self.controls), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
        texts = [
            b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "lotbook_piece_bytes")
            for run in runs
        ]
        text = "".join(texts)
        return text[1:] if self.prefix and first is not None and self.leads[first] else text

    def decode_rows(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of ids that stand one text after another; ``starts`` has an end for the last."""
        if not len(ids):
            return [""] * (len(starts) - 1)
        surfaces = self._surfaces.take(pa.array(ids))
        whole = surfaces.buffers()[2].to_pybytes()
        ends = np.frombuffer(surfaces.buffers()[1], dtype=np.int32)[starts]
        # The mark that leads a text is not part of it; its surface is one space.
        first = ends[:-1].copy()
        some = starts[:-1] < starts[1:]
        first[some] += self.leads[ids[starts[:-1][some]]] & self.prefix
        out = [
            whole[a:b].decode("utf-8", "lotbook_piece_bytes")
            for a, b in zip(first.tolist(), ends[1:].tolist(), strict=True)
        ]
        odd = np.flatnonzero(np.isin(ids, self.controls))
        for at in np.unique(np.searchsorted(starts, odd, side="right") - 1).tolist():
            out[at] = self.decode(ids[starts[at] : starts[at + 1]].tolist())
        return out


_loaded: dict[str, PieceBpe] = {}


def piece_bpe(model_path: str) -> PieceBpe:
    """One vocabulary per worker process and file."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceBpe(model_path)
    return _loaded[model_path]


def _added(docs: DataFrame, columns: list[tuple[str, T.DataType]], batch_of) -> DataFrame:
    """``docs`` with columns made from its Arrow batches; those replace columns of their names."""
    taken = {name.lower() for name, _ in columns}
    kept = [field for field in docs.schema.fields if field.name.lower() not in taken]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, more in batch_of(batch):
                own = [part.column(field.name) for field in kept]
                yield pa.RecordBatch.from_arrays([*own, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sliced(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose sizes add up to about ``SLICE_CHARS``; a longer row is alone."""
    sizes = sizes.fill_null(0).to_pylist()
    first = total = 0
    for at, size in enumerate(sizes):
        if total and total + size > SLICE_CHARS:
            yield batch.slice(first, at - first)
            first, total = at, 0
        total += size
    if len(sizes) > first:
        yield batch.slice(first, len(sizes) - first)


def _ids_of(coder: PieceBpe, texts: pa.Array, check: bool) -> tuple[pa.Array, pa.Array]:
    own, agree = coder.encode([t or "" for t in texts.to_pylist()], check)
    starts = np.cumsum([0, *map(len, own)]).astype(np.int32)
    values = np.concatenate(own) if own else np.zeros(0, dtype="<i4")
    ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(values, pa.int32()))
    return ids, pa.array(agree, pa.bool_())


def _texts_of(coder: PieceBpe, ids: pa.Array, check: bool) -> tuple[pa.Array, pa.Array]:
    values = ids.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
    texts = coder.decode_rows(values, starts)
    agree = [True] * len(texts)
    if check:
        own = [values[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
        agree = [t == coder.library.decode(i) for t, i in zip(texts, own, strict=True)]
    return pa.array(texts, pa.string()), pa.array(agree, pa.bool_())


_IDS, _TEXT, _AGREES = T.ArrayType(T.IntegerType()), T.StringType(), T.BooleanType()


def encoded(
    docs: DataFrame,
    text: str = "text",
    model_path: str | None = None,
    ids: str = "ids",
    agrees: str | None = "ids_agree",
) -> DataFrame:
    """``docs`` with the ids of the whole ``text`` in ``ids``, an array of int.

    A null or empty text has no ids. ``agrees`` names a column that tells whether the
    library gives the same ids (see ``PieceBpe.encode``); None leaves the library out. Rows
    are independent: repeats and other columns, whatever they hold, pass through. A column
    that has one of the new names is replaced. An empty table gives an empty one.
    """
    model_path = model_path or vocabulary_path(MODEL)
    columns = [(ids, _IDS), *([(agrees, _AGREES)] if agrees else [])]

    def batch_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        coder = piece_bpe(model_path)
        for part in _sliced(batch, pc.utf8_length(batch.column(text))):
            yield part, list(_ids_of(coder, part.column(text), bool(agrees)))[: len(columns)]

    return _added(docs, columns, batch_of)


def decoded(
    docs: DataFrame,
    ids: str = "ids",
    model_path: str | None = None,
    text: str = "decoded",
    agrees: str | None = "text_agrees",
) -> DataFrame:
    """``docs`` with the text of the array ``ids``, and whether the library gives the same.

    Null is read as no ids, which is an empty text. An id outside the vocabulary, or null
    among the ids, ends the task with an error. Else as ``encoded``.
    """
    model_path = model_path or vocabulary_path(MODEL)
    columns = [(text, _TEXT), *([(agrees, _AGREES)] if agrees else [])]

    def batch_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        coder = piece_bpe(model_path)
        for part in _sliced(batch, pc.list_value_length(batch.column(ids))):
            yield part, list(_texts_of(coder, part.column(ids), bool(agrees)))[: len(columns)]

    return _added(docs, columns, batch_of)


def round_trip(docs: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """``decoded`` of ``encoded`` in one pass: ``ids``, ``decoded`` and ``agrees`` for both."""
    model_path = model_path or vocabulary_path(MODEL)

    def batch_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        coder = piece_bpe(model_path)
        for part in _sliced(batch, pc.utf8_length(batch.column(text))):
            ids, ids_agree = _ids_of(coder, part.column(text), True)
            texts, texts_agree = _texts_of(coder, ids, True)
            yield part, [ids, texts, pc.and_(ids_agree, texts_agree)]

    return _added(docs, [("ids", _IDS), ("decoded", _TEXT), ("agrees", _AGREES)], batch_of)


def piece_table(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per row of (``doc_id``, ``text``): number and digest of its ids, digest of their text.

    ``agrees`` tells whether the library gives the same ids and the same text.
    """
    rows = round_trip(docs.select("doc_id", "text"), "text", model_path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
