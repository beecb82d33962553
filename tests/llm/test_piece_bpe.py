"""Merge-type encoding against the sentencepiece library and a plain search for the best pair."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotbook.llm import piece_bpe
from lotbook.llm.tokens import vocabulary_path

LETTERS = list("abcdehinorst the and ▁ñé日本𝕏ﬁ\x00\n\t\r　﻿<0x>123")


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.piece_bpe(vocabulary_path(piece_bpe.MODEL))


def by_search(coder, text):
    """Best pair of the whole text, again and again."""
    if not text:
        return []
    symbols = list("▁" + text.replace(" ", "▁"))
    while True:
        pairs = [
            (-coder.scores[a + b], i)
            for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            if a + b in coder.scores
        ]
        if not pairs:
            break
        at = min(pairs)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    out = []
    for s in symbols:
        out += [coder.ids[s]] if s in coder.ids else [coder.bytes[b] for b in s.encode()]
    return out


_texts = st.text(alphabet=st.one_of(st.sampled_from(LETTERS), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(_texts)
def test_ids_and_texts_equal_the_library_and_a_plain_search(text):
    coder = piece_bpe.piece_bpe(vocabulary_path(piece_bpe.MODEL))
    (ids,), (agree,) = coder.encode([text], check=True)
    ids = ids.tolist()
    assert agree
    assert ids == coder.library.encode(text) == by_search(coder, text)
    assert coder.decode(ids) == coder.library.decode(ids) == text.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    coder = piece_bpe.piece_bpe(vocabulary_path(piece_bpe.MODEL))
    text = coder.library.decode(ids)
    assert coder.decode(ids) == text
    rows = np.array([*ids, *ids], dtype=np.int32)
    starts = np.array([0, 0, len(ids), 2 * len(ids), 2 * len(ids)])
    assert coder.decode_rows(rows, starts) == ["", text, text, ""]


def test_heap_and_matrix_agree_and_the_dictionary_may_empty(coder, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 32))) for _ in range(500)]
    want = [coder.library.encode(t) for t in texts]
    assert [coder.merged("▁" + t) for t in texts] == want
    monkeypatch.setattr(piece_bpe, "CACHE_PARTS", 10)
    assert [o.tolist() for t in texts for o in coder.encode([t])[0]] == want
    monkeypatch.setattr(piece_bpe, "WIDTHS", ())
    coder.clear()
    assert [o.tolist() for o in coder.encode(texts)[0]] == want
    monkeypatch.setattr(coder, "parts", lambda text: [text])
    assert [o.tolist() for o in coder.encode(texts)[0]] == want


def test_table_of_odd_rows(spark, coder, monkeypatch):
    monkeypatch.setattr(piece_bpe, "SLICE_CHARS", 50)
    long_text = "".join(random.Random(1).choices("abcdei nors\n", k=60_000)) + "x" * 5_000
    texts = {1: "one two  three", 2: None, 3: "", 4: long_text, 5: " ▁\x00 日本𝕏", 6: "   "}
    rows = [(i, t, "ids", 0.5) for i, t in texts.items()] * 2 + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, Decoded double")
    got = piece_bpe.piece_table(docs).collect()
    assert len(got) == 13 and all(r.agrees for r in got)
    apart = piece_bpe.decoded(piece_bpe.encoded(docs)).collect()
    assert all(r.ids_agree and r.text_agrees for r in apart)
    for r in got:
        text = (texts[r.doc_id] if r.doc_id else "no id") or ""
        ids = coder.library.encode(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()
    both = piece_bpe.decoded(piece_bpe.encoded(docs, agrees=None), agrees=None)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in both.collect()}[6] == "   "
    empty = piece_bpe.piece_table(docs.where("false"))
    assert empty.count() == 0 and empty.columns[1] == "n_tokens"


def test_wrong_ids_of_a_part_are_told(monkeypatch):
    coder = piece_bpe.PieceBpe(vocabulary_path(piece_bpe.MODEL))
    monkeypatch.setattr(piece_bpe, "CHECK_EVERY", 1 << 40)
    whole = coder.merged_rows
    wrong = lambda parts, width: [b"\0\0\0\0" if p == "▁two" else o for p, o in zip(parts, whole(parts, width), strict=True)]
    monkeypatch.setattr(coder, "merged_rows", wrong)
    texts = ["one two", "one three", "two", ""]
    assert coder.encode(texts, check=True)[1] == [False, True, False, True]
    assert coder.encode(["x two"], check=True)[1] == [False]


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(vocabulary_path(piece_bpe.MODEL), "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(path))
