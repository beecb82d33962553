"""Quality rules against plain counting, and the two learnt scores on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotbook.llm import quality_model, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def brute(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(inside),
    )


def test_base_counts_equal_plain_counting(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x y z\x0bq", "l\nl\n\nl\r\nl", "#*$%&|<> é"]
    texts += ["w1 w2 w3 w4 " * 3 + "end", "a a a a a", "one\n two\n one"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, None, None), (None, "a b", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.quality_table(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is not None:
            text = texts[row.doc_id]
            assert tuple(row[1:6]) == brute(text), text
            assert row.base_failed == (
                row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
            )
            assert not (row.base_failed and row.kept)


def test_good_documents_are_kept_and_junk_is_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.quality_table(docs).join(labels, "doc_id").where(~F.col("base_failed"))
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.5


def test_removal_keeps_columns_and_clashing_names(spark):
    # No run of three words comes twice.
    text = (
        "The old road runs along the river and then climbs to a village where people grow "
        "apples, keep bees and repair boats. In spring the water rises over its banks, so every "
        "house stands on stone pillars. Travellers who arrive late find a lamp at the bridge "
        "and warm soup in the kitchen of an inn that has been open for more than two hundred "
        "years without closing once."
    )
    rows = [(1, text, 3, "x", 0.5), (2, "short", 4, "y", 0.5), (3, None, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, n_words int, band string, _judged double"
    )
    out = quality_rules.rejects_removed(docs)
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.collect()] == [1]


def test_verdict_equals_plain_measures(spark):
    """Fertility from the library's ids of each word, counted plainly."""
    import math
    import re
    from collections import Counter

    import sentencepiece

    from lotbook.llm.tokens import vocabulary_path

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4_000)
    langs = {r.doc_id: (r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()}
    seen = Counter()
    for row in quality_rules.quality_table(docs).collect():
        text, lang = langs[row.doc_id]
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
        ids = [i for w in words for i in model.encode(w)]
        if not words:
            assert not row.kept
            continue
        chars = sum(len(w) + 1 for w in words) / len(ids)
        share = sum(model.is_byte(i) for i in ids) / len(ids)
        shares = [n / len(ids) for n in Counter(ids).values()]
        most = math.log(min(len(ids), quality_rules.ENTROPY_TOKENS)) if len(ids) > 1 else 1.0
        entropy = -sum(s * math.log(s) for s in shares) / most
        assert (row.chars_per_token, row.byte_share) == pytest.approx((chars, share))
        assert row.entropy_share == pytest.approx(entropy, abs=1e-9)
        band = quality_rules.BANDS[row.band]
        assert row.band == lang or lang not in quality_rules.BANDS
        low, high = band.chars_per_token
        inside = low <= chars <= high and share <= band.byte_share
        inside = inside and row.entropy_share >= band.entropy_share
        assert row.kept == (not row.base_failed and inside)
        seen[row.kept] += 1
    assert min(seen[True], seen[False]) > 50


def test_toxic_removal_keeps_columns_and_clashing_names(spark):
    model = toxicity.learn([], [], 0.1)
    docs = spark.createDataFrame([(1, "a", 0.7), (2, None, None)], "doc_id long, text string, _SCORE double")
    out = toxicity.toxic_removed(docs, model, threshold=1.1)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0.7), (2, None, None)]


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_scores(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = quality_model.quality_scores if kind == "quality" else toxicity.toxicity_table
    got = table(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good = got["predicted"] == got[kind]
    assert got["score"].between(0, 1).all()
    assert good.mean() > 0.9
    assert table(docs, labels).count() == docs.count()


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_scores_of_odd_rows(spark, kind):
    rows = [(1, None, 0), (2, "", 0), (2, "", 1), (None, "a word", 2), (3, "idiot " * 30_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    table = quality_model.quality_scores if kind == "quality" else toxicity.toxicity_table
    got = table(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert table(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_part_is_the_checksum_of_the_id(spark):
    import zlib

    ids = [0, 1, 77, 123456]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = [r[0] for r in frame.select(toxicity.held_out(F.col("doc_id"), 3, 1)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


def test_positive_unlabelled_learning_needs_no_negatives():
    rng = np.random.default_rng(3)
    toxic = lambda: np.array(sorted({1, *rng.integers(100, 900, 20)}))
    clean = lambda: np.array(sorted(set(rng.integers(100, 900, 20))))
    positives = [toxic() for _ in range(60)]
    unlabelled = [toxic() if i % 10 == 0 else clean() for i in range(600)]
    model = toxicity.learn(positives, unlabelled, 0.1)
    assert model.features.tolist().count(1) == 1
    weight = model.word_weights()[1]
    assert 1 / (1 + np.exp(-model.offset - weight)) > 0.6 > 0.3 > 1 / (1 + np.exp(-model.offset))
    assert toxicity.learn([], [], 0.1).offset < 0


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(5)
    bags, labels = [], []
    for i in range(200):
        bag = rng.normal(0, 1, (6, quality_model.WIDTH)).astype("f4")
        if i % 2:
            bag[rng.integers(6), :4] += 6
        bags.append(bag)
        labels.append(i % 2)
    model = quality_model.fit(bags[:150], np.array(labels[:150]))
    right = [(model.score(b) >= 0.5) == bool(y) for b, y in zip(bags[150:], labels[150:], strict=True)]
    assert np.mean(right) > 0.9
