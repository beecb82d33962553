"""Index building and batch search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import feeds
from checks.parcel_checks import ENTRIES_SQL, standardized
from lotbook.operators import search as S
from lotbook.operators import search_index as X
from lotbook.session import shared_folder
from lotbook.sinks.features import read_search_index, write_search_index

# Requests derived from nations: `{text}` is the engine's text type.
_REQUESTS = {
    "qid": "n_nationkey",
    "q": """case n_nationkey % 8
        when 0 then concat('Household ', n_name)
        when 1 then concat('r 00000', cast(n_nationkey % 10 as {text}))
        when 2 then concat(' ', n_name, ' st ')
        when 3 then concat('po box ', cast(n_nationkey * 7 as {text}))
        when 4 then 'machinery teton'
        when 5 then 'building'
        when 6 then concat(n_name, ', customer')
        else ' ' end""",
    "counties": """case n_nationkey % 8 when 2 then 'teton_county_wy,fremont_county_wy'
        when 3 then 'lincoln_county_wy' when 4 then case when n_nationkey % 3 = 0 then '' else 'teton_county_wy, sublette_county_wy' end
        else '' end""",
    "fields": "case n_nationkey % 8 when 4 then 'Owner,county' when 6 then case when n_nationkey % 3 = 0 then 'mailing_address,pidn,physical_address' else '' end else '' end",
    "lon": "case when n_nationkey % 8 in (5, 2) then -110.9e0 + n_nationkey * 0.01e0 end",
    "lat": "case when n_nationkey % 8 in (5, 2) then 42.5e0 end",
    "max_rows": "case when n_nationkey % 4 = 1 then 20 when n_nationkey % 4 = 2 then 0 else 500 end",
}


def requests(spark, sf):
    def some(c):
        return F.when(F.col(c) != "", F.split(c, ","))

    flat = feeds.table(spark, sf, "nation").select(
        *[F.expr(sql.format(text="string")).alias(name) for name, sql in _REQUESTS.items()]
    )
    return flat.select(
        F.col("qid").cast("bigint").alias("qid"), "q", some("counties").alias("counties"),
        some("fields").alias("fields"), "lon", "lat", F.col("max_rows").cast("int").alias("max_rows"),
    )


def prepared(spark, sf):
    return X.prepare_entries(X.search_entries(standardized(spark, sf)))


_WRITTEN: dict[tuple[str, str], str] = {}


def index(spark, sf):
    """The stored search index of the parcels, written once in a session and then read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/search-index-{uuid.uuid4().hex}"
        write_search_index(X.search_entries(standardized(spark, sf)), path)
        _WRITTEN[key] = path
    return read_search_index(spark, _WRITTEN[key])


def _clean(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


_TEXTS = {"owner": "oc", "pidn": "pc", "mailing_address": "mc", "physical_address": "yc", "county": "cc"}

_PREPARED_SQL = f"""{ENTRIES_SQL}, en as (select *, {', '.join(f'{_clean(n)} as {a}' for n, a in _TEXTS.items())} from e)"""

_REQUESTS_SQL = "rq as (select {} from nation)".format(
    ", ".join(f"{sql.format(text='varchar')} as {n}" for n, sql in _REQUESTS.items())
)


def _any(c: str) -> str:
    return f"len(list_filter(ws, lambda w: contains({c}, w))) > 0"


def _all(c: str) -> str:
    return f"len(list_filter(ws, lambda w: contains({c}, w))) = len(ws)"


def _address_score(c: str) -> str:
    return f"case when contains({c}, qn) then 300 when {_any(c)} then 150 else 0 end"


def _field_score(name: str, hit: str, score: int) -> str:
    return f"case when list_contains(fl, '{name}') and ({hit}) then {score} else 0 end"


# `sc`: every request against every entry, scored by brute force.
_SCORED_SQL = f"""{_PREPARED_SQL}, {_REQUESTS_SQL},
  r1 as (select *, lower(trim(q)) as qn,
      list_filter(list_transform(string_split(counties, ','), lambda x: trim(x)), lambda x: x <> '') as cl,
      list_filter(string_split(lower(fields), ','), lambda x: x <> '') as fl from rq where trim(q) <> ''),
  r2 as (select *, list_filter(regexp_split_to_array(qn, '\\s+'), lambda x: x <> '') as ws from r1),
  pairs as (select r2.*, en.* exclude (county), en.county as county_name,
      (len(cl) > 0 and list_contains(cl, county_code))
      or (len(cl) = 0 and (oc = qn or pc = qn or mc = qn or yc = qn
        or (length(qn) >= 3 and left(qn, 3) = left(pc, 3))
        or len(list_filter(ws, lambda w: length(w) > 2 and (list_contains(string_split(oc, ' '), w)
             or list_contains(string_split(mc, ' '), w) or list_contains(string_split(yc, ' '), w)))) > 0)) as candidate
    from r2, en),
  based as (select *, case when len(fl) > 0 then greatest(
        {_field_score('owner', _any('oc'), 500)}, {_field_score('pidn', 'contains(pc, qn)', 400)},
        {_field_score('mailing_address', _any('mc'), 300)}, {_field_score('physical_address', _any('yc'), 300)},
        {_field_score('county', 'contains(cc, qn)', 200)})
      else case when contains(oc, qn) then 1000 when {_all('oc')} then 800 when {_any('oc')} then 400 else 0 end
        + case when contains(pc, qn) then 600 else 0 end + {_address_score('mc')} + {_address_score('yc')} end as base,
      sqrt(pow((xmin + xmax) / 2 - lon, 2) + pow((ymin + ymax) / 2 - lat, 2)) as dist from pairs where candidate),
  sc as (select *, case when base > 0 then base
      + case when dist < 0.01 then 1000 when dist < 0.1 then 500 when dist < 0.5 then 100 else 0 end
      + case when len(cl) = 0 then case when physical_address <> '' then 50 else 0 end + case when clerk_rec <> '' then 25 else 0 end else 0 end
      else 0 end as score from based),
  top as (select * from (select *, row_number() over (partition by qid order by score desc, global_parcel_uid) as rank from sc where score > 0)
    where rank <= least(200, case when max_rows > 0 then max_rows else 200 end))"""


def _results(spark, sf, keep):
    found = index(spark, sf)
    return S.search(requests(spark, sf).where(keep), found.entries, found)


_NO_COUNTIES = "counties is null or size(counties) = 0"
_COUNTIES = "size(counties) > 0"
_FIELDS = "size(fields) > 0"


def search_indexed(spark, sf):
    return _results(spark, sf, _NO_COUNTIES)


def search_scan(spark, sf):
    return _results(spark, sf, _COUNTIES)


def search_fields(spark, sf):
    return _results(spark, sf, _FIELDS)


def search_near(spark, sf):
    return _results(spark, sf, "lon is not null")


def response_rows(spark, sf):
    found = index(spark, sf)
    answers = S.search(requests(spark, sf), found.entries, found)
    return S.response_rows(answers, found.entries).select(
        "qid", "rank", "global_parcel_uid", "pidn", "owner", "mailing_address", "physical_address",
        "county", "state", "clerk_rec", "property_det", "tax_info",
    )


def match_counts(spark, sf):
    found = index(spark, sf)
    return S.match_counts(requests(spark, sf), found.entries, found)


def postings(spark, sf):
    return X.postings(prepared(spark, sf))


def index_sizes(spark, sf):
    return X.index_sizes(X.postings(prepared(spark, sf)))


def search_stats(spark, sf):
    return X.search_stats(X.search_entries(standardized(spark, sf)))


_POSTINGS_SQL = f"""{_PREPARED_SQL}, po as (
  select distinct * from (
    select 'owner' as kind, oc as token, global_parcel_uid as uid from en where oc <> ''
    union all select 'parcel', pc, global_parcel_uid from en where pc <> ''
    union all select 'parcel', left(pc, i), global_parcel_uid from (select *, unnest(range(3, length(pc) + 1)) as i from en)
    union all select 'address', mc, global_parcel_uid from en where mc <> ''
    union all select 'address', yc, global_parcel_uid from en where yc <> ''
    union all select 'word', w, global_parcel_uid from (
      select global_parcel_uid, unnest(string_split(concat(oc, ' ', mc, ' ', yc), ' ')) as w from en) where length(w) > 2))"""


def _top(where: str) -> str:
    return f"with {_SCORED_SQL} select qid, rank, global_parcel_uid as uid, score from top where {where}"


QUERIES = {
    "postings": (postings, f"with {_POSTINGS_SQL} select * from po"),
    "index_sizes": (index_sizes, f"with {_POSTINGS_SQL} select kind, count(distinct token) as tokens from po group by kind"),
    "search_stats": (
        search_stats,
        f"with {ENTRIES_SQL} select county, count(*) as entries from e group by rollup (county)",
    ),
    "search_indexed": (search_indexed, _top("len(cl) = 0")),
    "search_scan": (search_scan, _top("len(cl) > 0")),
    "search_fields": (search_fields, _top("len(fl) > 0")),
    "search_near": (search_near, _top("lon is not null")),
    "response_rows": (
        response_rows,
        f"""with {_SCORED_SQL} select qid, rank, global_parcel_uid, pidn, owner, mailing_address, physical_address,
          county_name as county, state, clerk_rec, property_det, tax_info from top""",
    ),
    "match_counts": (
        match_counts,
        f"""with {_SCORED_SQL} select r2.qid, count(sc.qid) as candidates, count(sc.qid) filter (score > 0) as matches
          from r2 left join sc on r2.qid = sc.qid group by r2.qid""",
    ),
}
