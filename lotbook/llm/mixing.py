"""Mix sources to target weights by hash-threshold histograms.

Every document has a hash that does not depend on the run. A source takes all documents
whose hash lies below its threshold, so budgets nest: a larger one takes what a smaller
one takes and more. The threshold is found without sorting: word counts are summed by
source and hash bucket, the bucket that crosses the budget is cut into finer buckets, and
so on until it holds one hash. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.llm.common import WORD_PATTERN, free_name, stored
from lotbook.operators.numbering import number_rows

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that is never null: null becomes a value no source has."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def targets_of(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Per source of (``_key``, ``size``): ``source_size`` and ``target``.

    Sources in order of code point, null last, get the weights in turn. Targets share
    ``share`` of all words by weight, none above ``repeats`` times its source; the
    excess goes to the others by weight until none is above. Only sums reach the driver.
    """
    totals = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    null_last = F.when(F.col("_key") == "n", 1).otherwise(0)
    ranged = totals.withColumn("_null", null_last).repartitionByRange("_null", "_key")
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "sources")
    numbered = number_rows(
        ranged.withColumn("_all", F.lit(0)), ["_all"], ["_null", "_key"], F.col("_part"), "_no"
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(turn, (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = stored(
        numbered.select("_key", "source_size", weight.alias("weight")), "weights"
    )
    cap = F.col("source_size") * F.lit(float(repeats))
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped_before = 0.0, -1
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == capped_before or not row["open"]:
            break
        level, capped_before = (budget - row["used"]) / row["open"], row["n"]
    target = F.least(cap, F.lit(level) * F.col("weight"))
    return weighed.select("_key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """Per source, what ``rows`` (``_key``, ``size``, ``h``) must satisfy to be taken.

    Adds ``whole`` (how often every document is taken), ``cut`` and ``closed``: documents
    with a hash below ``cut``, or equal to it where ``closed``, are taken once more. The
    words taken miss the target by at most half of the documents at the cut.
    """
    whole = F.least(
        F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))),
        F.lit(repeats - 1),
    ).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    state = (
        targets.withColumn("whole", whole)
        .withColumn("rest", F.least(rest, F.col("source_size").cast("double")))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("before", F.lit(0).cast("long"))
    )
    # Unsigned order of the bits is the order of the hash as a signed number.
    bits = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    kept = ["_key", "source_size", "target", "whole", "rest"]
    settled, known = None, 0
    while True:
        finer = min(known + BUCKET_BITS, 64)
        inside = rows.join(state.select("_key", "prefix"), "_key")
        if known:
            inside = inside.where(F.shiftrightunsigned(bits, 64 - known) == F.col("prefix"))
        sums = inside.groupBy("_key", F.shiftrightunsigned(bits, 64 - finer).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        earlier = Window.partitionBy("_key").orderBy("bucket")
        summed = sums.withColumn(
            "below", F.sum("words").over(earlier.rowsBetween(Window.unboundedPreceding, 0))
        )
        reached = F.col("before") + F.col("below") >= F.col("rest")
        # The first bucket that reaches the budget; should rounding leave none, the last.
        crossing = (
            summed.join(state.drop("prefix"), "_key")
            .groupBy(*kept, "before")
            .agg(
                F.coalesce(
                    F.min(F.when(reached, F.struct("bucket", "words", "below", "low", "high"))),
                    F.max(F.struct("bucket", "words", "below", "low", "high")),
                ).alias("at")
            )
            .select(
                *kept,
                F.col("at.bucket").alias("prefix"),
                (F.col("before") + F.col("at.below") - F.col("at.words")).alias("before"),
                F.col("at.words").alias("words"),
                F.col("at.low").alias("low"),
                F.col("at.high").alias("high"),
            )
        )
        found = stored(crossing, "crossing")
        known = finer
        single = found.where((F.col("low") == F.col("high")) | F.lit(known == 64))
        settled = single if settled is None else settled.unionByName(single)
        state = found.where((F.col("low") != F.col("high")) & F.lit(known < 64)).select(
            *kept, "prefix", "before"
        )
        if state.isEmpty():
            break
    closed = F.col("words") < 2 * (F.col("rest") - F.col("before"))
    plan = settled.select(
        "_key", "source_size", "target", "whole", F.col("low").alias("cut"), closed.alias("closed")
    )
    return stored(plan, "plan")


def _copies() -> Column:
    below = (F.col("h") < F.col("cut")) | (F.col("closed") & (F.col("h") == F.col("cut")))
    return F.col("whole") + F.when(below, 1).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            _key(F.col("source")).alias("_key"),
            word_count(F.col("text")).alias("size"),
            _hash(docs).alias("h"),
        ),
        "sizes",
    )


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size and source, the target, and the words taken.

    Null texts have size 0; null sources are one source; documents that repeat id and
    text share a hash and are taken together. An empty table gives no rows.
    """
    rows = measured(docs)
    plan = thresholds(rows, targets_of(rows, **options))
    return rows.join(plan, "_key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with their own columns."""
    rows = measured(docs)
    own = free_name(docs, "_mix")
    plan = thresholds(rows, targets_of(rows, **options))
    plan = plan.select(F.struct("_key", "whole", "cut", "closed").alias(own))
    at = lambda name: F.col(own)[name]
    h = _hash(docs)
    below = (h < at("cut")) | (at("closed") & (h == at("cut")))
    copies = (at("whole") + F.when(below, 1).otherwise(0)).cast("int")
    taken = docs.join(plan, _key(docs["source"]) == at("_key")).where(copies > 0)
    # One generator gives a document as often as it is taken; its column replaces the plan.
    copy = F.explode(F.sequence(F.lit(1), copies))
    return taken.withColumn(own, copy).select(*[docs[c] for c in docs.columns])
