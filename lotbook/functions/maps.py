"""Property maps: overwrite rules and descriptions parsed into properties.

Spark raises on duplicate map keys by default. These functions never build one, so
they need no session setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.bind import bind
from lotbook.functions.text import col, description_key, strip, truthy

_NO_PROPERTIES = "cast(map() as map<string,string>)"


def no_properties() -> Column:
    return F.expr(_NO_PROPERTIES)


def truthy_only(m: Column | str) -> Column:
    """Entries whose key and value are truthy."""
    return F.map_filter(col(m), lambda k, v: truthy(k) & truthy(v))


def without_key(m: Column | str, key: str) -> Column:
    return F.map_filter(col(m), lambda k, v: k != F.lit(key))


def overwrite(left: Column | str, right: Column | str) -> Column:
    """``left`` with every entry of ``right`` put over it; a null map counts as empty."""

    def put(over: Column) -> Column:
        kept = F.map_filter(
            F.coalesce(col(left), no_properties()), lambda k, v: ~F.map_contains_key(over, k)
        )
        return F.map_concat(kept, over)

    return bind(F.coalesce(col(right), no_properties()), put)


def map_of_pairs(pairs: Column) -> Column:
    """Map from an array of ``(key, value)`` structs, the last of equal keys winning."""

    def build(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(p, lambda e: e["key"] == k), -1)["value"]
        return bind(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, last)))

    return F.coalesce(bind(pairs, build), no_properties())


# The common entities, the ampersand last so that it starts no new one.
_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def markup_text(c: Column) -> Column:
    """Text of a small markup fragment: tags out, common entities decoded."""

    def decoded(text: Column) -> Column:
        out = text
        for entity, char in _ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(text.contains("&"), out).otherwise(text)

    bare = F.when(c.contains("<"), F.regexp_replace(c, r"<[^>]*>", "")).otherwise(c)
    return strip(bind(bare, decoded))


def parse_description(html: Column | str) -> Column:
    """Rows of exactly two cells of an HTML description as a property map.

    Splitting at row starts leaves the innermost rows of nested tables; a later row
    with the same label wins.
    """
    pieces = F.split(F.coalesce(col(html), F.lit("")), r"(?i)<tr\b")
    bodies = bind(
        pieces, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    )
    cells = F.transform(
        bodies,
        lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)),
    )
    pairs = F.transform(
        F.filter(cells, lambda r: F.size(r) == 2),
        lambda r: F.struct(
            description_key(markup_text(r[0])).alias("key"), markup_text(r[1]).alias("value")
        ),
    )
    return map_of_pairs(pairs)
