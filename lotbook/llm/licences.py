"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

Paragraphs are scored by a multinomial logistic regression over sparse word n-grams of
the licence templates, with a class for text that is no licence. Probabilities are
calibrated by a temperature fitted on examples kept from training. A prediction holds if
it is probable and shares enough runs of words with a template of its family. Paragraphs
that share no run with any template cannot be confirmed, so they need no score. DataFrame
operations and the JVM's own learner only.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.llm.common import numbered, stored

UNKNOWN = "unknown"
# Sentences by which public licences are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "public-domain": (
        "Released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without permission",
    ),
}
FAMILIES = [*TEMPLATES, UNKNOWN]
# Words of licences: paragraphs with one of them are no examples of other text.
CUES = (
    "licen[sc]\\w*|copyright|rights reserved|permission|permitted|redistribut\\w*|"
    "public domain|cc0|cc[ -]by|creative commons"
)
# Paragraphs of the corpus that serve as examples of no licence.
MAX_NEGATIVES = 4_000
# Part of the examples kept for calibration.
CALIBRATE = (5, 0)
LEAST_PROBABILITY = 0.5
# Share of a template's runs of three words, or of the paragraph's, that must agree.
LEAST_OVERLAP = 0.5
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
# Lines are one paragraph up to the end of a sentence at a line's end, or an empty line.
_PARAGRAPH = (
    r"(?<=(?<![vV])[.!?][\"')\]*\s]{0,4})\n|\n(?=[^\S\n]*(?:\n|\z))|(?<=\n[^\S\n]{0,4})\n"
)
_WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"


def words_of(text: Column) -> Column:
    """Lower-case words; dots and hyphens stay inside versions and names."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    joined = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))
    return F.coalesce(joined, F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    """Words and their runs of two and three."""
    return F.concat(words, _runs(words, 2), _runs(words, 3))


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())


def _plain_runs(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


TEMPLATE_RUNS = {
    run
    for sentences in TEMPLATES.values()
    for sentence in sentences
    for run in _plain_runs(_plain_words(sentence), 3)
}
LONGEST = max(len(_plain_words(s)) for sentences in TEMPLATES.values() for s in sentences)


def vocabulary() -> list[str]:
    """All n-grams of the templates, in order of their first use."""
    found: dict[str, None] = {}
    for sentences in TEMPLATES.values():
        for sentence in sentences:
            words = _plain_words(sentence)
            for n in (1, 2, 3):
                found.update(dict.fromkeys(_plain_runs(words, n)))
    return list(found)


def _examples(spark: SparkSession) -> DataFrame:
    """Parts of the templates, and the same words out of order as examples of no licence."""
    rows: dict[tuple[str, str], None] = {}
    for family, sentences in TEMPLATES.items():
        for sentence in sentences:
            words = _plain_words(sentence)
            least = max(3, math.ceil(0.6 * len(words)))
            for size in range(least, len(words) + 1):
                for at in range(len(words) - size + 1):
                    part = words[at : at + size]
                    rows[family, " ".join(part)] = None
                    rows[UNKNOWN, " ".join(sorted(part))] = None
                    rows[UNKNOWN, " ".join(part[::-1])] = None
    return _lines(spark, [f"{family}\t{text}" for family, text in rows]).select(
        F.element_at("line", 1).alias("family"), F.element_at("line", 2).alias("text")
    )


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Fixed lines of tab-separated values as rows of ``line`` (array)."""
    each = F.explode(F.split(F.lit("\n".join(lines)), "\n"))
    return spark.range(1).select(each.alias("l")).select(F.split("l", "\t").alias("line"))


def _shares_run(text: Column) -> Column:
    """Whether a run of three words is one of a template: else its overlap is 0."""
    runs = F.array(*map(F.lit, sorted(TEMPLATE_RUNS)))
    # The words are bound by the outer lambda: inside the runs they would be found anew each time.
    return F.exists(F.array(words_of(text)), lambda w: F.arrays_overlap(_runs(w, 3), runs))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """``_row``, ``doc_id``, ``paragraph``, ``line`` and ``text`` of what can be confirmed.

    That is each line that shares a run with a template and, with a null ``line``, each
    stretch of such runs in a paragraph of several lines, where a notice may be wrapped.
    A stretch ends where the longest template's words pass without a run.
    """
    paragraphs = docs.select("_row", "doc_id", F.posexplode(F.split("text", _PARAGRAPH)))
    paragraphs = paragraphs.withColumnsRenamed({"pos": "paragraph", "col": "text"})
    paragraphs = stored(paragraphs.where(_shares_run(F.col("text"))), "sharing")
    lines = paragraphs.select(
        "_row", "doc_id", "paragraph", F.posexplode(F.split("text", "\n")).alias("line", "text")
    ).where(_shares_run(F.col("text")))
    runs = F.array(*map(F.lit, sorted(TEMPLATE_RUNS)))
    several = (
        paragraphs.where(F.contains(F.trim("text"), F.lit("\n")))
        .withColumn("_words", words_of(F.col("text")))
        .withColumn("_runs", _runs(F.col("_words"), 3))
        .withColumn("_at", F.transform("_runs", lambda r, i: F.when(F.array_contains(runs, r), i)))
        .withColumn("_at", F.filter("_at", lambda i: i.isNotNull()))
    )
    before = lambda i: F.get("_at", i - 1)
    after = lambda i: F.get("_at", i + 1)
    first = F.filter("_at", lambda at, i: before(i).isNull() | (at - before(i) > LONGEST))
    last = F.filter("_at", lambda at, i: after(i).isNull() | (after(i) - at > LONGEST))
    stretches = several.select(
        "_row", "doc_id", "paragraph", "_words",
        F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("_at"),
    ).select(
        "_row", "doc_id", "paragraph", F.lit(None).cast("int").alias("line"),
        F.concat_ws(
            " ", F.slice("_words", F.col("_at.first") + 1, F.col("_at.last") - F.col("_at.first") + 3)
        ).alias("text"),
    )
    return lines.unionByName(stretches)


def _with_features(rows: DataFrame) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(vocabulary(), "_grams", "_features")
    model = model.setBinary(True)
    # Words are a column of their own: inside the n-grams they would be found anew each time.
    worded = rows.withColumn("_words", words_of(F.col("text")))
    return model.transform(worded.withColumn("_grams", grams(F.col("_words"))))


def _loss(raw: Column, label: Column, temperature: float) -> Column:
    """Negative log of the probability of the label's class, scores over the temperature."""
    own = F.element_at(raw, (label + 1).cast("int")) - F.array_max(raw)
    return -own / F.lit(temperature) - F.log(_highest_probability(raw, temperature))


def _highest_probability(raw: Column, temperature: float) -> Column:
    powers = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / F.lit(temperature)))
    return 1 / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)


def train(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and its temperature.

    Negative examples are a bounded sample of the last paragraphs of documents, those
    with the least hashes among those without a cue or a template's run. Calibration takes the temperature with
    the least loss on the fifth of the examples that training does not see.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64("text")
    # Documents are thinned by hash to a few times the bound before the least hashes are taken.
    share = min(1.0, 4 * MAX_NEGATIVES / max(1, docs.count()))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    thinned = docs.where(F.xxhash64("doc_id", "_row") <= bound)
    plain = (
        thinned.where(F.col("text").isNotNull())
        .select(F.element_at(F.split("text", "\n"), -1).alias("text"))
        .where((F.trim("text") != "") & ~F.lower("text").rlike(rf"\b(?:{CUES})\b"))
        .where(~_shares_run(F.col("text")))
        .select("text", hashed.alias("_h"))
        .orderBy("_h", "text")
        .limit(MAX_NEGATIVES)
        .select(F.lit(UNKNOWN).alias("family"), "text")
    )
    # Bounded in number, so one partition: the learner passes over them many times.
    examples = stored(_examples(spark).unionByName(plain).distinct(), "examples").coalesce(1)
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    examples = _with_features(examples).withColumn("label", number.cast("double"))
    part = F.pmod(F.xxhash64("text"), F.lit(CALIBRATE[0])) == CALIBRATE[1]
    learner = LogisticRegression(
        family="multinomial", featuresCol="_features", regParam=2e-4, maxIter=40
    )
    model = learner.fit(examples.where(~part))
    scored = model.transform(examples.where(part)).select(
        vector_to_array("rawPrediction").alias("_raw"), "label"
    )
    scored = stored(scored, "calibration")
    losses = [
        F.avg(_loss(F.col("_raw"), F.col("label"), t)).alias(f"t{i}")
        for i, t in enumerate(TEMPERATURES)
    ]
    row = scored.agg(*losses).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: (row[i] is None, row[i]))
    return model, TEMPERATURES[best]


def _template_runs(spark: SparkSession) -> DataFrame:
    """Per family, the distinct runs of three words of each template."""
    lines = [
        "\t".join([family, *dict.fromkeys(_plain_runs(_plain_words(sentence), 3))])
        for family, sentences in TEMPLATES.items()
        for sentence in sentences
    ]
    runs = F.slice("line", 2, F.size("line") - 1)
    return (
        _lines(spark, lines)
        .groupBy(F.element_at("line", 1).alias("family"))
        .agg(F.collect_list(runs).alias("_templates"))
    )


def _overlap(own: Column, templates: Column) -> Column:
    """Greatest agreement in runs of three words with a template of the family.

    The share of the template's runs or of the paragraph's, whichever is greater, so both
    a notice inside a paragraph and a part of a long licence agree.
    """

    def agreement(template: Column) -> Column:
        both = F.size(F.array_intersect(own, template))
        of_own = F.when(both >= 3, both / F.size(F.array_distinct(own))).otherwise(0.0)
        return F.greatest(both / F.size(template), of_own)

    return F.coalesce(F.array_max(F.transform(templates, agreement)), F.lit(0.0))


def scan_paragraphs(docs: DataFrame) -> DataFrame:
    """Lines and wrapped notices that share a run: family, calibrated probability, overlap, verdict.

    ``confirmed`` says that the family is not ``unknown``, its probability is at least
    one half and a template agrees. All other text is ``unknown`` and not listed.
    """
    model, temperature = train(docs)
    scored = model.transform(_with_features(paragraphs_of(docs))).select(
        "_row",
        "doc_id",
        "paragraph",
        "line",
        "text",
        vector_to_array("rawPrediction").alias("_raw"),
        _runs(F.col("_words"), 3).alias("_runs"),
    )
    # Few share a run; written, so that what follows is planned on plain columns.
    scored = stored(scored, "scored")
    families = F.array(*map(F.lit, FAMILIES))
    place = F.array_position("_raw", F.array_max("_raw")).cast("int")
    scored = (
        scored.withColumn("family", F.element_at(families, place))
        .withColumn("probability", _highest_probability(F.col("_raw"), temperature))
        .join(_template_runs(docs.sparkSession), "family", "left")
    )
    confirmed = (
        (F.col("family") != UNKNOWN)
        & (F.col("probability") >= LEAST_PROBABILITY)
        & (F.col("overlap") >= LEAST_OVERLAP)
    )
    return (
        scored.withColumn("overlap", _overlap(F.col("_runs"), F.col("_templates")))
        .withColumn("confirmed", confirmed)
        .select(
            "_row", "doc_id", "paragraph", "line", "text", "family", "probability", "overlap",
            "confirmed",
        )
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``n_paragraphs``, licence ``families`` found, and how many
    paragraphs carry one.

    Families are those of confirmed lines and wrapped notices, in order of name; a wrapped
    notice counts once, unless lines of it count. The list is empty where there is none, and also for null, empty and white texts. Repeated rows are documents of
    their own; ids may be null. Rows are written once with their numbers. Very long texts are read whole, a paragraph at a time.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text"), "numbered")
    found = stored(
        scan_paragraphs(rows)
        .where("confirmed")
        .groupBy("_row", "paragraph", "family")
        .agg(
            F.count(F.lit(1)).alias("all"),
            F.count("line").alias("lines"),
            F.min("probability").alias("least"),
            F.min(F.when(F.col("line").isNotNull(), F.col("probability"))).alias("least_line"),
        )
        .groupBy("_row")
        .agg(
            F.sort_array(F.collect_set("family")).alias("families"),
            F.sum(F.when(F.col("lines") > 0, F.col("lines")).otherwise(F.col("all"))).alias(
                "n_licence_paragraphs"
            ),
            F.min(F.coalesce("least_line", "least")).alias("least_probability"),
        ),
        "licences",
    )
    count = F.size(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != ""))
    n = F.when(F.col("text").isNull(), 0).otherwise(count).cast("long")
    base = rows.select("_row", "doc_id", n.alias("n_paragraphs"))
    return base.join(found, "_row", "left").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_licence_paragraphs", F.lit(0)).alias("n_licence_paragraphs"),
        "least_probability",
    )
