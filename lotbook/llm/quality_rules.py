"""Quality rules with tokeniser fertility as the deciding measure.

Base rules look at words, lines and repetitions. The method's verdict then measures how
public vocabularies cut the words: characters per token, share of byte-fallback tokens
and entropy of the tokens. Each measure has a band per language or script, and a document
outside its band is rejected. One narrow pass: no shuffle, and a document is judged by itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import WHITE, find_words, free_name
from lotbook.llm.tokens import CACHE_WORDS, vocabulary_path

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted values of a language or script."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy_share: float


# Bands by language, else by script. The Latin languages' bands lie outside all values
# that documents labelled good take; the others are wide.
BANDS = {
    "en": Band((2.25, 9.0), 0.10, 0.70),
    "de": Band((2.20, 9.0), 0.10, 0.70),
    "fr": Band((2.15, 9.0), 0.10, 0.70),
    "es": Band((2.10, 9.0), 0.10, 0.70),
    "latin": Band((1.50, 9.0), 0.15, 0.65),
    "cyrillic": Band((1.00, 9.0), 0.15, 0.65),
    "greek": Band((0.60, 9.0), 0.50, 0.60),
    "han": Band((0.30, 9.0), 0.80, 0.60),
    "other": Band((0.20, 9.0), 0.90, 0.50),
}
# A text's entropy stops growing with its length once common tokens dominate.
ENTROPY_TOKENS = 400
_SCRIPTS = {
    "latin": re.compile("[A-Za-zªºÀ-ɏḀ-ỿ]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "greek": re.compile("[Ͱ-Ͽἀ-῿]"),
    "han": re.compile("[぀-ヿ㐀-鿿가-힯]"),
}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, band string, chars_per_token double, byte_share double, "
    "entropy_share double, kept boolean"
)


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = find_words(text)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    symbols = sum(map(text.count, SYMBOLS))
    return (
        words,
        sum(map(len, words)),
        symbols,
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * len(numbers) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= again
    return int(covered.sum())


def script_of(words: list[str]) -> str:
    """Script with the most letters over the distinct words; ``latin`` where there are none."""
    joined = "".join(dict.fromkeys(words))
    counts = {name: len(p.findall(joined)) for name, p in _SCRIPTS.items()}
    letters = sum(map(str.isalpha, joined))
    counts["other"] = letters - sum(counts.values())
    return max(counts, key=counts.__getitem__) if letters else "latin"


class _Pieces(dict):
    """Word to (byte tokens, ids) of that word in a vocabulary with byte fallback."""

    def __init__(self, pieces_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.bytes = {i for i in range(self.model.vocab_size()) if self.model.is_byte(i)}

    def learn(self, words: list[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [w for w in set(words) if w not in self]
        for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self[word] = (
                sum(i in self.bytes for i in ids),
                np.array(ids, dtype="<u4").tobytes(),
            )


@lru_cache(maxsize=4)
def _pieces(pieces_path: str) -> _Pieces:
    return _Pieces(pieces_path)


def fertility(words: list[str], pieces: _Pieces) -> tuple[float, float, float]:
    """Characters per token, byte-token share, entropy as a share of its maximum."""
    if not words:
        return 0.0, 0.0, 0.0
    pieces.learn(words)
    byte_tokens, ids = zip(*map(pieces.__getitem__, words), strict=True)
    stream = np.frombuffer(b"".join(ids), dtype="<u4")
    counts = np.unique(stream, return_counts=True)[1]
    shares = counts / max(1, len(stream))
    most = math.log(min(len(stream), ENTROPY_TOKENS)) if len(stream) > 1 else 1.0
    entropy = float(-(shares * np.log(shares)).sum()) / most
    # The space that leads a word belongs to its tokens.
    chars = sum(map(len, words)) + len(words)
    return chars / max(1, len(stream)), sum(byte_tokens) / max(1, len(stream)), entropy


def outside(band: Band, chars: float, byte_share: float, entropy: float) -> bool:
    low, high = band.chars_per_token
    return not (low <= chars <= high) or byte_share > band.byte_share or entropy < band.entropy_share


def judge_documents(
    docs: DataFrame,
    bands: dict[str, Band] | None = None,
    pieces_path: str | None = None,
    into: str = "_judged",
) -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` of measures and verdict.

    The band is that of ``lang`` where it has one, else of the text's script. A null or
    empty text has no words, fails the base rules and is not kept. Very long texts are
    measured whole; repeated rows are judged alike; ids may be null. The result is one
    struct column, so no name of ``docs`` can clash but ``into``, which is replaced.
    """
    bands = bands or BANDS
    model = pieces_path or vocabulary_path("piece_bpe_32k.model")

    @F.pandas_udf(MEASURES)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model)
        names = [part.split()[0] for part in MEASURES.split(", ")]
        for texts, langs in batches:
            rows = []
            for text, lang in zip(texts, langs, strict=True):
                words, *counts = base_counts(text if isinstance(text, str) else "")
                n, repeated = len(words), counts[-1]
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                band = lang if lang in bands else script_of(words)
                measures = fertility(words, pieces)
                kept = not failed and not outside(bands[band], *measures)
                rows.append((n, *counts, failed, band, *measures, kept))
            yield pd.DataFrame(rows, columns=names)

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn(into, judge(F.col("text"), lang))


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: its id, the measures and the verdict."""
    wanted = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return judge_documents(docs.select(*wanted)).select("doc_id", "_judged.*")


def rejects_removed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    own = free_name(docs, "_judged")
    return judge_documents(docs, into=own).where(F.col(own)["kept"]).drop(own)
