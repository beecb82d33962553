"""Search entries and the inverted index over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions.text import (
    clean_search,
    county_code_of_uid,
    county_display_name,
    state_of_county,
    truthy,
    words,
)
from lotbook.operators.skew import many_tasks

TEXT_FIELDS = ["owner", "pidn", "mailing_address", "physical_address", "county"]

# Shortest indexed word and parcel-id prefix.
MIN_WORD = 3
MIN_PREFIX = 3

# Longest substring key of the scan candidates.
GRAM = 3


# Folders that each stored index table is dealt into by its key.
BUCKETS = 64


@dataclass
class StoredIndex:
    """The written tables of a search index; see ``sinks.features.write_search_index``."""

    entries: DataFrame
    postings: DataFrame
    grams: DataFrame
    gram_counts: DataFrame


def key_bucket(*key: str) -> Column:
    """Folder of a key in a stored index table."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def dealt_by_folder(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``_part``, a share of a key's bucket: a task holds rows of one bucket only.

    The parts divide the buckets evenly and go to a task each, so tables of a bucket per folder
    are written from here, or from groups of ``_part`` and the key, without another shuffle.
    """
    parts = BUCKETS * -(-many_tasks(df.sparkSession) // BUCKETS)
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    return df.withColumn("_part", part).repartitionById(parts, "_part")


def pruned(table: DataFrame, probes: DataFrame) -> DataFrame:
    """The folders of a stored table that the probes' ``bucket`` names; at most BUCKETS values."""
    wanted = [row["bucket"] for row in probes.select("bucket").distinct().collect()]
    return table.where(F.col("bucket").isin(wanted))


def search_entries(standardized: DataFrame) -> DataFrame:
    """Standardized parcels as search entries; missing texts are empty, a box may be null."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return standardized.select(
        text("global_parcel_uid").alias("global_parcel_uid"),
        text("county_parcel_id_num").alias("pidn"),
        text("owner_name").alias("owner"),
        text("mailing_address").alias("mailing_address"),
        text("physical_address").alias("physical_address"),
        county_display_name("county").alias("county"),
        state_of_county("county").alias("state"),
        F.col("bbox"),
        text("clerk_records_link").alias("clerk_rec"),
        text("property_details_link").alias("property_det"),
        text("tax_details_link").alias("tax_info"),
    )


def prepare_entries(entries: DataFrame) -> DataFrame:
    """Entries with ``uid``, ``county_code`` and a cleaned shadow of each text field.

    Write this table once and search it many times; the originals stay for display.
    """
    cleaned = {f"{name}_cleaned": clean_search(name) for name in TEXT_FIELDS}
    return entries.withColumns(
        {
            "uid": F.col("global_parcel_uid"),
            "county_code": county_code_of_uid("global_parcel_uid"),
            **cleaned,
        }
    )


def prefixes(c: Column) -> Column:
    """Prefixes of a text from the shortest indexed length up to the whole."""
    lengths = F.when(
        F.length(c) >= MIN_PREFIX, F.sequence(F.lit(MIN_PREFIX), F.length(c))
    ).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(lengths, lambda i: F.left(c, i))


def _keyed(kind: str, tokens: Column) -> Column:
    return F.transform(
        F.filter(tokens, truthy),
        lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")),
    )


def long_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: F.length(w) >= MIN_WORD)


def postings(prepared: DataFrame) -> DataFrame:
    """``kind, token, uid``: exact owner, parcel and address, parcel prefixes, words.

    Long form: a frequent word is many rows, never one long list. A token repeated
    inside an entry is dropped in the row itself, so building needs no shuffle.
    """
    owner, pidn = F.col("owner_cleaned"), F.col("pidn_cleaned")
    mailing, physical = F.col("mailing_address_cleaned"), F.col("physical_address_cleaned")
    keys = F.concat(
        _keyed("owner", F.array(owner)),
        _keyed("parcel", F.concat(F.array(pidn), prefixes(pidn))),
        _keyed("address", F.array(mailing, physical)),
        _keyed("word", F.concat(long_words(owner), long_words(mailing), long_words(physical))),
    )
    return prepared.select("uid", F.explode(F.array_distinct(keys)).alias("k")).select(
        F.col("k.kind").alias("kind"), F.col("k.token").alias("token"), "uid"
    )


def probes(requests: DataFrame) -> DataFrame:
    """The postings keys each request looks up: ``sig, kind, token``."""
    q = F.col("q_norm")
    keys = F.concat(
        _keyed("owner", F.array(q)),
        _keyed("parcel", F.concat(F.array(q), prefixes(q))),
        _keyed("address", F.array(q)),
        _keyed("word", long_words(q)),
    )
    return requests.select("sig", F.explode(F.array_distinct(keys)).alias("k")).select(
        "sig", F.col("k.kind").alias("kind"), F.col("k.token").alias("token")
    )


def grams(c: Column) -> Column:
    """Distinct substrings of one to three characters.

    At each place the substrings of every size; near the end the longer ones are cut short
    and equal the shorter ones there. ``c`` is read at each place: give a column, no expression.
    """
    places = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(
        F.expr("cast(array() as array<int>)")
    )
    here = F.transform(
        places, lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in range(1, GRAM + 1)])
    )
    return F.array_distinct(F.flatten(here))


def gram_postings(prepared: DataFrame) -> DataFrame:
    """``county_code, gram, uid``: substring keys of every searched field.

    A word lies inside a field only if the word's first three characters do, so
    looking these keys up finds every substring match. The fields are joined in a step of
    their own, once per entry and not once per substring.
    """
    text = F.array_join(F.array(*[F.col(f"{name}_cleaned") for name in TEXT_FIELDS]), "\n")
    joined = prepared.select("county_code", "uid", text.alias("text"))
    return joined.select("county_code", "uid", F.explode(grams(F.col("text"))).alias("gram"))


def gram_probes(requests: DataFrame) -> DataFrame:
    """``sig, county_code, gram``: first characters of each word, per wanted county."""
    keys = F.array_distinct(F.transform(F.col("q_words"), lambda w: F.left(w, F.lit(GRAM))))
    return requests.select(
        "sig", F.explode("county_codes").alias("county_code"), keys.alias("keys")
    ).select("sig", "county_code", F.explode("keys").alias("gram"))


def gram_counts(grams_table: DataFrame) -> DataFrame:
    """``county_code, gram, n``: entries that hold a substring key."""
    return grams_table.groupBy("county_code", "gram").agg(F.count(F.lit(1)).alias("n"))


def rare_gram_probes(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """``sig, county_code, gram``: of each word the key with the fewest entries in a county.

    A word lies inside a field only if all of its keys do, so the rarest one finds every
    match; a word with a key that no entry holds finds none and is left out.
    """
    n = F.length("word")
    starts = F.when(n >= GRAM, F.sequence(F.lit(1), n - (GRAM - 1))).otherwise(F.array(F.lit(1)))
    keys = F.array_distinct(
        F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))
    )
    asked = (
        requests.select("sig", F.explode("county_codes").alias("county_code"), "q_words")
        .select("sig", "county_code", F.explode(F.array_distinct("q_words")).alias("word"))
        .select("sig", "county_code", "word", F.explode(keys).alias("gram"))
        .withColumn("bucket", key_bucket("county_code", "gram"))
    )
    held = pruned(counts, asked).select("bucket", "county_code", "gram", "n")
    rarest = (
        asked.join(held, ["bucket", "county_code", "gram"], "left")
        .groupBy("sig", "county_code", "word")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    )
    found = rarest.where(F.col("rarest.n") > 0)
    return found.select("sig", "county_code", F.col("rarest.gram").alias("gram")).distinct()


def index_sizes(index: DataFrame) -> DataFrame:
    """Distinct tokens per kind, counted after a distinct so no kind meets in one task."""
    return (
        index.select("kind", "token")
        .distinct()
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("tokens"))
    )


def search_stats(entries: DataFrame) -> DataFrame:
    """Entries per county, with the total in the row whose county is null."""
    return (
        entries.groupBy("county")
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("county")
        .agg(F.sum("n").alias("entries"))
    )
