"""Batch search: many requests against the prepared entries in one job.

A request with counties is a scan of those counties by substring; one without goes
through the postings. Both produce candidate pairs by equi-join, and share scoring,
boosts and the top rows per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions.text import clean_search, normalize_query, truthy, words
from lotbook.operators.search_index import (
    TEXT_FIELDS,
    StoredIndex,
    gram_postings,
    gram_probes,
    key_bucket,
    postings,
    probes,
    pruned,
    rare_gram_probes,
)
from lotbook.operators.skew import salted_join

# Most rows per request, and the weights of the scores and boosts.
MAX_RESULTS = 200
OWNER_PHRASE, OWNER_ALL, OWNER_ANY = 1000, 800, 400
PARCEL_PART = 600
ADDRESS_PHRASE, ADDRESS_ANY = 300, 150
FIELD_SCORES = {
    "owner": 500,
    "pidn": 400,
    "mailing_address": 300,
    "physical_address": 300,
    "county": 200,
}
NEAR_BOOSTS = [(0.01, 1000), (0.1, 500), (0.5, 100)]
PHYSICAL_BOOST, CLERK_BOOST = 50, 25

# Requests of identical text are ranked once; beyond this many they are salted.
HOT_REQUESTS = 10_000
# Candidate keys are split this many ways, so that neither a word in a third of all
# entries nor a request with a third of all candidates lands in one task when requests
# are too many to broadcast.
SHARDS = 64


def signed_requests(requests: DataFrame, clean_query: bool = False) -> DataFrame:
    """Requests with normalized text, words and a signature of what determines the answer.

    Blank requests are dropped. ``clean_query`` cleans the text the way entries are
    cleaned; by default punctuation stays as typed.
    """
    q = clean_search("q") if clean_query else normalize_query("q")
    codes = F.filter(
        F.transform(
            F.coalesce("counties", F.array().cast("array<string>")), lambda c: F.trim(c)
        ),
        truthy,
    )
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")), F.lower)
    named = requests.select(
        "qid",
        "q",
        "max_rows",
        q.alias("q_norm"),
        F.array_sort(F.array_distinct(codes)).alias("county_codes"),
        F.array_sort(F.array_distinct(fields)).alias("fields"),
        "lon",
        "lat",
    ).where(truthy("q_norm"))
    signature = F.sha2(
        F.to_json(F.struct("q_norm", "county_codes", "fields", "lon", "lat")), 256
    )
    return named.withColumns({"q_words": words("q_norm"), "sig": signature})


def _sharded(df: DataFrame) -> DataFrame:
    return df.withColumn("_shard", F.pmod(F.xxhash64("uid"), F.lit(SHARDS)))


def _every_shard(df: DataFrame) -> DataFrame:
    shards = F.sequence(F.lit(0), F.lit(SHARDS - 1)).cast("array<bigint>")
    return df.withColumn("_shard", F.explode(shards))


def _stored_candidates(indexed: DataFrame, scanned: DataFrame, index: StoredIndex) -> DataFrame:
    """Pairs from the written tables: only folders that a request's keys name are read."""
    keys = probes(indexed).withColumn("bucket", key_bucket("kind", "token"))
    by_index = _sharded(pruned(index.postings, keys)).join(
        _every_shard(keys), ["bucket", "kind", "token", "_shard"]
    )
    keys = rare_gram_probes(scanned, index.gram_counts)
    keys = keys.withColumn("bucket", key_bucket("county_code", "gram"))
    by_gram = _sharded(pruned(index.grams, keys)).join(
        _every_shard(keys), ["bucket", "county_code", "gram", "_shard"]
    )
    return by_index.select("sig", "uid").unionByName(by_gram.select("sig", "uid"))


def candidates(
    distinct: DataFrame, prepared: DataFrame, index: DataFrame | StoredIndex | None = None
) -> DataFrame:
    """``sig, uid`` pairs that can score, each once.

    No early cap: every candidate is scored before the top rows are taken. With a stored
    index nothing is built; else the substring keys are made in the plan, and so are the
    postings where no table of them is given.
    """
    indexed = distinct.where(F.size("county_codes") == 0)
    scanned = distinct.where(F.size("county_codes") > 0)
    if isinstance(index, StoredIndex):
        pairs = _stored_candidates(indexed, scanned, index)
        return pairs.repartition("uid").dropDuplicates(["sig", "uid"])
    by_index = _sharded(postings(prepared) if index is None else index).join(
        _every_shard(probes(indexed)), ["kind", "token", "_shard"]
    )
    by_gram = _sharded(gram_postings(prepared)).join(
        _every_shard(gram_probes(scanned)), ["county_code", "gram", "_shard"]
    )
    pairs = by_index.select("sig", "uid").unionByName(by_gram.select("sig", "uid"))
    # One shuffle by uid serves both the distinct and the join with the entries.
    return pairs.repartition("uid").dropDuplicates(["sig", "uid"])


def _any_word(field: Column) -> Column:
    return F.exists("q_words", lambda w: field.contains(w))


def _all_words(field: Column) -> Column:
    return F.forall("q_words", lambda w: field.contains(w))


def _cleaned(name: str) -> Column:
    return F.col(f"{name}_cleaned")


def score_all_fields() -> Column:
    """Sum over owner, parcel id and both addresses."""
    q, owner = F.col("q_norm"), _cleaned("owner")
    owner_score = (
        F.when(owner.contains(q), OWNER_PHRASE)
        .when(_all_words(owner), OWNER_ALL)
        .when(_any_word(owner), OWNER_ANY)
        .otherwise(0)
    )
    parcel_score = F.when(_cleaned("pidn").contains(q), PARCEL_PART).otherwise(0)
    total = owner_score + parcel_score
    for name in ["mailing_address", "physical_address"]:
        field = _cleaned(name)
        total = total + F.when(field.contains(q), ADDRESS_PHRASE).when(
            _any_word(field), ADDRESS_ANY
        ).otherwise(0)
    return total


def score_chosen_fields() -> Column:
    """Best score among the request's fields."""
    q = F.col("q_norm")
    scores = []
    for name, score in FIELD_SCORES.items():
        whole = name in ("pidn", "county")
        hit = _cleaned(name).contains(q) if whole else _any_word(_cleaned(name))
        scores.append(F.when(F.array_contains("fields", name) & hit, score).otherwise(0))
    return F.greatest(*scores)


def near_boost() -> Column:
    """Boost by distance in degrees from the box centre; zero without point or box."""
    box = F.col("bbox")
    lon = (F.get(box, F.lit(0)) + F.get(box, F.lit(2))) / 2
    lat = (F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2
    distance = G.degree_distance(lon, lat, F.col("lon"), F.col("lat"))
    boost = None
    for limit, value in NEAR_BOOSTS:
        boost = (
            F.when(distance < limit, value) if boost is None else boost.when(distance < limit, value)
        )
    return boost.otherwise(0)


def complete_boost() -> Column:
    """Boost of filled entries; only requests that go through the postings get it."""
    filled = F.when(truthy("physical_address"), PHYSICAL_BOOST).otherwise(0) + F.when(
        truthy("clerk_rec"), CLERK_BOOST
    ).otherwise(0)
    return F.when(F.size("county_codes") == 0, filled).otherwise(0)


def scored(
    requests: DataFrame, prepared: DataFrame, index: DataFrame | StoredIndex | None = None
) -> DataFrame:
    """Candidates of distinct requests with their score; zero scores are still there."""
    distinct = requests.dropDuplicates(["sig"]).select(
        "sig", "q_norm", "q_words", "county_codes", "fields", "lon", "lat"
    )
    fields = [f"{name}_cleaned" for name in TEXT_FIELDS]
    entries = prepared.select("uid", *fields, "bbox", "physical_address", "clerk_rec")
    pairs = candidates(distinct, prepared, index).join(entries, "uid")
    pairs = _sharded(pairs).join(_every_shard(distinct), ["sig", "_shard"])
    base = F.when(F.size("fields") > 0, score_chosen_fields()).otherwise(score_all_fields())
    return pairs.withColumn("base", base).select(
        "sig",
        "uid",
        F.when(F.col("base") > 0, F.col("base") + near_boost() + complete_boost())
        .otherwise(0)
        .alias("score"),
    )


def rank(scores: DataFrame) -> DataFrame:
    """Best rows per request, ties by uid; Spark prunes to the limit before the shuffle."""
    order = Window.partitionBy("sig").orderBy(F.col("score").desc(), F.col("uid"))
    return (
        scores.where(F.col("score") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= MAX_RESULTS)
    )


def search(
    requests: DataFrame,
    prepared: DataFrame,
    index: DataFrame | StoredIndex | None = None,
    clean_query: bool = False,
) -> DataFrame:
    """``qid, rank, uid, score`` of every request, at most 200 and its own limit.

    ``index`` is the stored index, or the postings table; without one it is built in the plan.
    """
    signed = signed_requests(requests, clean_query)
    ranked = rank(scored(signed, prepared, index))
    answered = salted_join(
        signed.select("qid", "sig", "max_rows"), ranked, "sig", "inner", "qid", HOT_REQUESTS
    )
    wanted = F.when(F.col("max_rows") > 0, F.col("max_rows")).otherwise(MAX_RESULTS)
    return answered.where(F.col("rank") <= wanted).select("qid", "rank", "uid", "score")


def response_rows(results: DataFrame, prepared: DataFrame) -> DataFrame:
    """Search results with the display fields; missing texts are empty."""
    texts = [
        "pidn",
        "owner",
        "mailing_address",
        "physical_address",
        "county",
        "state",
        "clerk_rec",
        "property_det",
        "tax_info",
    ]
    shown = prepared.select(
        "uid",
        F.col("global_parcel_uid"),
        *[F.coalesce(F.col(t), F.lit("")).alias(t) for t in texts],
        "bbox",
    )
    return results.join(shown, "uid").drop("uid")


def match_counts(
    requests: DataFrame, prepared: DataFrame, index: DataFrame | StoredIndex | None = None
) -> DataFrame:
    """Candidates and matches per distinct request.

    Without counties the candidates are what the index finds; with counties they are all
    entries of these, as a scan of them looks at each.
    """
    signed = signed_requests(requests)
    distinct = signed.dropDuplicates(["sig"]).select("sig", "county_codes")
    found = scored(signed, prepared, index)
    found = found.groupBy("sig").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("score") > 0).alias("matches")
    )
    entries = prepared.groupBy("county_code").agg(F.count(F.lit(1)).alias("entries"))
    asked = distinct.select("sig", F.explode("county_codes").alias("county_code"))
    scanned = asked.join(entries, "county_code").groupBy("sig")
    scanned = scanned.agg(F.sum("entries").alias("entries"))
    zero = F.lit(0).cast("long")
    by_scan = F.size("county_codes") > 0
    counts = (
        distinct.join(found, "sig", "left")
        .join(scanned, "sig", "left")
        .select(
            "sig",
            F.when(by_scan, F.coalesce("entries", zero)).otherwise(F.col("found")).alias("candidates"),
            "matches",
        )
    )
    return salted_join(signed.select("qid", "sig"), counts, "sig", "left", "qid", HOT_REQUESTS).select(
        "qid",
        F.coalesce("candidates", zero).alias("candidates"),
        F.coalesce("matches", zero).alias("matches"),
    )
