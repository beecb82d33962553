"""Queries of the numbered operators over whole tables, and the SQL of those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotbook.llm import (
    html_text,
    lexical,
    licences,
    mixing,
    multi_index,
    near_dups,
    packing,
    piece_bpe,
    quality_model,
    quality_rules,
    topk,
    toxicity,
    warc,
)
from lotbook.llm.common import table


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dups.duplicate_classes(docs).select("doc_id", "class_id", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_table(docs)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_table(docs)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_pages(pages).select("page_id", "url", "_main.text", "_main.n_chars")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = multi_index.labelled_vectors(table(spark, sf_dir, "embeddings"))
    return multi_index.hard_negatives(multi_index.shifted_labels(vectors))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_table(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licences": op1_licences,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_top_k": op4_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "op11_lexical": op11_lexical,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_piece_bpe": op13_piece_bpe,
}

_WARC_SQL = """
with p as (
    select page_id, coalesce(html, '') as payload from pages
), d as (
    select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
        sha256(payload) as payload_digest
    from p
), r as (
    select *, row_number() over (partition by payload_digest order by page_id) as n,
        min(page_id) over (partition by payload_digest) as first_id
    from d
)
select page_id, payload_bytes, payload_digest,
    case when n > 1 and payload_bytes >= 100 then 'revisit' else 'response' end as record_type,
    case when n > 1 and payload_bytes >= 100 then first_id end as refers_to
from r
"""

_TOP_K_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id
    where q.vec_id % 20 = 0
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEXICAL_SQL = f"""
with d as (
    select row_number() over () as row, doc_id, unnest(regexp_extract_all(
        translate(text, '{_UPPER}', '{_LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from documents
), i as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, '{_UPPER}', '{_LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from benchmark
), lengths as (
    select row, count(*) as n from d group by row
), totals as (
    select count(*) as docs, sum(n)::bigint as terms from lengths
), tf as (
    select row, any_value(doc_id) as doc_id, term, count(*) as tf
    from d where term in (select term from i) group by row, term
), w as (
    select term, cast(floor(1000 * ln(
        cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
    from tf, totals group by term
), s as (
    select item_id, row, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf)
        // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
    from i join tf using (term) join w using (term) join lengths using (row), totals
    group by item_id, row
), r as (
    select *, row_number() over (
        partition by item_id order by score desc, doc_id nulls last) as rank
    from s where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50
"""

_NEGATIVES_SQL = """
with v as (
    select vec_id,
        cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
        cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v c on c.vec_id <> a.vec_id
    where a.vec_id % 50 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score,
        row_number() over (partition by anchor_id order by score desc, vec_id) as n
    from s where same
), n as (
    select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (
            partition by p.anchor_id, positive_id order by s.score desc, s.vec_id
        ) as rank
    from p join s on s.anchor_id = p.anchor_id and not s.same
        and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
    where p.n <= 5
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score,
    negative_score
from n where rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op11_lexical": _LEXICAL_SQL,
    "op12_hard_negatives": _NEGATIVES_SQL,
    "op4_top_k": _TOP_K_SQL,
    "op2_warc": _WARC_SQL,
}
