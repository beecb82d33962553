"""Packing against the tokenizers library and the rules of a valid packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotbook.llm import packing
from lotbook.llm.tokens import bpe_ids, vocabulary_path

DOCS = "doc_id long, text string, length string, _uid long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.sampled_from(list("ab Ñé1.,'\t\n 　日<|>'s  ")), st.just("<|endoftext|>"), st.just(" <|endoftext")
        ),
        max_size=60,
    ).map("".join)
)
def test_ids_equal_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    paths = map(vocabulary_path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    got = bpe_ids(*paths).of(text)
    want = _TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got, dtype="<u4").tolist() == want


def test_words_that_do_not_repeat_are_encoded_with_their_text(tokenizer, monkeypatch):
    from lotbook.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    paths = map(vocabulary_path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    encoder = tokens.BpeIds(*paths)
    for repeats in (True, False):
        for i in range(40):
            words = ["the"] * 400 if repeats else []
            text = " ".join([*words, *(f"w{i}x{j}.\nY {j}" for j in range(8)), "<|endoftext|>"])
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.of(text), dtype="<u4").tolist() == want
        assert encoder._whole is not repeats


def test_pieces_and_sequences(spark, tokenizer):
    texts = {1: "one two three", 2: None, 3: "", 4: "word " * 3000, 5: "a  b\n c <|endoftext|>"}
    texts |= {6: "a <|endoftext|> b", 7: "<|endoftext|><|endoftext|>", 8: "<|endoftext|"}
    texts |= {10 + i: "some more words here " * (i * 7 % 60) for i in range(300)}
    rows = [(i, t, "x", 0) for i, t in texts.items()] + [(1, "one two three", "y", 0)] * 2
    rows.append((None, "no id", None, None))
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack_documents(docs, keep_ids=True).toPandas()
    by_doc = {}
    for row in got.itertuples():
        by_doc.setdefault(None if row.doc_id != row.doc_id else int(row.doc_id), []).append(row)
    for i, text in texts.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        if i != 1:
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
            assert all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            assert zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(by_doc[1]) == 3 and len(by_doc[None]) == 1
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        ends = np.cumsum(group["length"])
        assert ends.iloc[-1] <= 1024
        assert group["offset"].tolist() == [0, *ends[:-1]]
    least = -(-int(got["length"].sum()) // 1024)
    assert got["sequence_id"].nunique() <= least + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
def test_local_search_keeps_packings_valid_and_never_opens_bins(sizes):
    lengths = np.array(sorted(sizes, reverse=True))
    first = np.array(packing.best_fit(lengths, 100))
    better = packing.improve(lengths, first, 100)
    assert np.bincount(better, weights=lengths).max() <= 100
    assert len(set(better)) <= len(set(first))
    fill = lambda b: (np.bincount(b, weights=lengths) ** 2).sum()
    assert fill(better) >= fill(first)


def test_exchanges_empty_a_bin():
    # Bins 60+30, 50+40, 10+10 of 100: the last is drained.
    lengths = np.array([60, 50, 40, 30, 10, 10])
    bins = np.array([0, 1, 1, 0, 2, 2])
    assert len(set(packing.improve(lengths, bins, 100))) == 2
    # Two for one: 30+30 against 50 lets the fuller bin close.
    lengths, bins = np.array([50, 40, 30, 30]), np.array([0, 0, 1, 1])
    fill = np.bincount(bins, weights=lengths).astype(int)
    assert packing._give(1, lengths, bins, fill, np.arange(4), 100)
    assert fill.tolist() == [100, 50] and bins.tolist() == [1, 0, 0, 0]
