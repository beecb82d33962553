"""Feature collections in any layout, split anywhere: no document is read by one task.

Text is read in chunks that end at a closing brace, so files split at any of them, whether a
collection stands on one line, is spread over many, or features follow each other. What a
chunk does to the reading state (in a string or not, depth) is known from the chunk alone
for either start; running sums inside file blocks, and over the blocks' totals, give the
state at every chunk. Features are then cut where a closing brace leads back to the list of
features, or to the top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions.maps import no_properties
from lotbook.schemas import FEATURE_JSON
from lotbook.session import checkpointed
from lotbook.sources.features import line_position

# Stands for the key of the list of features once strings are taken out of a chunk.
_LIST = "\x01"
# The list opens, and is not empty.
_OPENS = _LIST + r"\s*:\s*\[(?![^\{\[\]]*\])"
_BLOCK = ["file", "block"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, value``: text up to each closing brace, which is left out.

    Checkpointed: a scan is split by the cores of the moment, and the state of a block
    must belong to the block it was summed over.
    """
    chunks = spark.read.option("lineSep", "}").text(path)
    chunks = chunks.select(line_position().alias("at"), "value")
    return checkpointed(chunks.select("at.file", "at.block", "at.line", "value"))


def _skeleton(escaped_out: Column) -> Column:
    """A chunk that starts outside strings, without them; the list's key stays as a mark."""
    marked = F.replace(escaped_out, F.lit('"features"'), F.lit(_LIST))
    return F.regexp_replace(marked, r'"[^"]*("|$)', "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _depth_change(skeleton: Column) -> Column:
    opened = _count(skeleton, "{") + _count(skeleton, "[")
    return opened - _count(skeleton, "]")


def _effects(chunks: DataFrame) -> DataFrame:
    """Quotes of a chunk, and skeleton and change of depth for a start outside and inside strings."""
    plain = F.regexp_replace(F.replace("value", F.lit(_LIST), F.lit("")), r"(?s)\\.", "")
    plain = F.regexp_replace(plain, r"\\$", "")
    quotes = _count(plain, '"')
    # A start inside a string goes on behind the quote that ends it.
    rest = F.when(quotes > 0, F.regexp_replace(plain, r'^[^"]*"', "")).otherwise(F.lit(""))
    out = chunks.withColumn("quotes", quotes)
    for start, text in enumerate((plain, rest)):
        closes = ((F.col("quotes") + start) % 2 == 0).cast("int")
        out = out.withColumn(f"bare{start}", _skeleton(text))
        out = out.withColumn(f"change{start}", _depth_change(F.col(f"bare{start}")) - closes)
    return out


def _before() -> Window:
    order = Window.partitionBy(*_BLOCK).orderBy("line")
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _earlier_blocks() -> Window:
    order = Window.partitionBy("file").orderBy("block")
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _placed(chunks: DataFrame) -> DataFrame:
    """Chunks with their skeleton and the depth at their start and after their brace."""
    zero = F.lit(0)
    known = _effects(chunks)
    quotes = F.coalesce(F.sum("quotes").over(_before()), zero)
    known = known.withColumn("odd", quotes % 2)
    # The change of depth if the block starts outside a string (0) or inside one (1).
    for start in (0, 1):
        change = F.when((F.col("odd") + start) % 2 == 1, F.col("change1")).otherwise(F.col("change0"))
        known = known.withColumn(f"if{start}", change)
    for start in (0, 1):
        deep = F.coalesce(F.sum(f"if{start}").over(_before()), zero)
        known = known.withColumn(f"deep{start}", deep)
    known = checkpointed(known.drop("change0", "change1"))
    totals = known.groupBy(*_BLOCK).agg(F.sum("quotes").alias("q"), F.sum("if0").alias("t0"), F.sum("if1").alias("t1"))
    totals = totals.withColumn("start", F.coalesce(F.sum("q").over(_earlier_blocks()), zero) % 2)
    total = F.when(F.col("start") == 1, F.col("t1")).otherwise(F.col("t0"))
    totals = totals.withColumn("total", total)
    totals = totals.withColumn("deep", F.coalesce(F.sum("total").over(_earlier_blocks()), zero))
    joined = known.join(totals.select(*_BLOCK, "start", "deep"), _BLOCK)
    chosen = lambda name: F.when(F.col("start") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    inside = (F.col("start") + F.col("odd")) % 2
    depth = F.col("deep") + chosen("deep")
    return joined.select(
        *_BLOCK,
        "line",
        "value",
        F.when(inside == 1, F.col("bare1")).otherwise(F.col("bare0")).alias("bare"),
        depth.alias("depth"),
        (depth + chosen("if")).alias("after"),
        # A brace inside a string closes nothing.
        ((inside + F.col("quotes")) % 2 == 0).alias("closes"),
    )


def _marked(placed: DataFrame) -> DataFrame:
    """Chunks with ``opens`` (the list of features starts here) and ``ends`` (a feature does)."""
    head = F.regexp_extract("bare", f"(?s)^(.*?){_OPENS}", 1)
    opens = F.col("bare").rlike(_OPENS) & (F.col("depth") + _depth_change(head) == 1)
    shut = (F.col("depth") == 2) & F.col("bare").rlike(r"^[^\{\[\]]*\]")
    marked = placed.withColumn("opens", opens)
    # 1 from the opening of a list on, 0 from its end on.
    marked = marked.withColumn("event", F.when(F.col("opens"), 1).when(shut, 0))
    own = Window.partitionBy(*_BLOCK).orderBy("line")
    own = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("inside", F.last("event", ignorenulls=True).over(own))
    ends = marked.groupBy(*_BLOCK).agg(
        F.max_by("event", F.when(F.col("event").isNotNull(), F.col("line"))).alias("left")
    )
    carried = F.last("left", ignorenulls=True).over(_earlier_blocks())
    ends = ends.select(*_BLOCK, carried.alias("carried"))
    listed = F.coalesce("inside", "carried", F.lit(0)) == 1
    last = F.when(listed, F.col("after") == 2).otherwise(F.col("after") == 0)
    # What closes at the top behind a list is the rest of its collection, no feature.
    return (
        marked.join(ends, _BLOCK)
        .withColumn("ends", F.col("closes") & last)
        .drop("event", "inside", "carried")
    )


def cut_features(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features as ``src_ord, text``, and what is left of a file as ``src_ord, text``.

    ``chunks`` as ``read_chunks`` gives them. A feature's text is brought together from its
    chunks alone, wherever blocks cut it. The left part is the text behind the last
    feature that belongs to none: the first chunk of it, with ``chunks``, their number. A
    missing last brace of a file is taken as there.
    """
    marked = _marked(_placed(chunks))
    # Every list that opens and every feature that ends starts a new piece of text.
    cuts = F.col("ends").cast("int") + F.col("opens").cast("int")
    earlier = F.coalesce(F.sum(cuts).over(_before()), F.lit(0))
    numbered = marked.withColumn("piece", earlier + F.col("opens").cast("int"))
    numbered = checkpointed(numbered.drop("bare", "depth", "after", "closes"))
    totals = numbered.groupBy(*_BLOCK).agg(F.sum(cuts).alias("own"))
    whole = Window.partitionBy("file")
    totals = totals.select(
        *_BLOCK,
        F.coalesce(F.sum("own").over(_earlier_blocks()), F.lit(0)).alias("offset"),
        F.sum("own").over(whole).alias("all"),
    )
    pieces = numbered.join(totals, _BLOCK).withColumn("piece", F.col("piece") + F.col("offset"))
    place = F.struct("block", "line")
    # The text of a list's first feature starts behind the list's bracket.
    text = F.when(
        F.col("opens"), F.regexp_replace("value", r'(?s)^.*?"features"\s*:\s*\[', "")
    ).otherwise(F.col("value"))
    held = pieces.where(F.col("piece") < F.col("all")).groupBy("file", "piece").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", text.alias("text")))).alias("parts"),
        F.max(F.when(F.col("ends"), place)).alias("end"),
    )
    joined = F.concat(F.array_join(F.col("parts.text"), "}"), F.lit("}"))
    features = held.where(F.col("end").isNotNull()).select(
        F.struct(
            "file", F.col("end.block").alias("block"), F.col("end.line").alias("line"),
            F.lit(0).alias("pos"),
        ).alias("src_ord"),
        F.regexp_replace(joined, r"^[\s,]+", "").alias("text"),
    )
    # A collection's own end starts with the bracket that closes its list; one with an empty
    # list is whole.
    empty = F.col("text").rlike(r'"features"\s*:\s*\[\s*\]')
    kind = F.when(empty, F.get_json_object("text", "$.type"))
    empty = F.coalesce(kind == "FeatureCollection", F.lit(False))
    features = features.where(~F.col("text").startswith("]") & ~empty)
    left = pieces.where((F.col("piece") >= F.col("all")) & F.col("value").rlike(r"[^\s,\]]"))
    left = left.groupBy("file").agg(
        F.min(F.struct("block", "line", "value")).alias("first"), F.count(F.lit(1)).alias("chunks")
    )
    left = left.select(
        F.struct("file", "first.block", "first.line", F.lit(0).alias("pos")).alias("src_ord"),
        F.col("first.value").alias("text"),
        "chunks",
    )
    return features, left


def parsed_features(
    features: DataFrame,
    left: DataFrame,
    county: Column,
    shape: Callable[[Column, Column], Column] = G.parse_geometry,
) -> DataFrame:
    """``county, src_ord, feature_id, props, geom, corrupt`` of ``cut_features``.

    ``shape`` makes ``geom`` of a geometry's kind and the text of its coordinates. A text that is no feature, and what is left of a file, is a row with its text in
    ``corrupt`` and no other values.
    """
    schema = f"{FEATURE_JSON}, _bad string"
    f = F.from_json("text", schema, {"columnNameOfCorruptRecord": "_bad"})
    read = features.withColumn("f", f)
    no_feature = F.col("f._bad").isNotNull() | ~F.coalesce(F.col("f.type") == "Feature", F.lit(False))
    read = read.withColumn("corrupt", F.when(no_feature, F.col("text")))
    good = F.col("corrupt").isNull()
    geom = shape(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    out = read.select(
        county.alias("county"),
        "src_ord",
        F.when(good, F.col("f.id")).alias("feature_id"),
        F.when(good, F.coalesce("f.properties", no_properties())).alias("props"),
        F.when(good, geom).alias("geom"),
        "corrupt",
    )
    rest = left.select(county.alias("county"), "src_ord", F.col("text").alias("corrupt"))
    return out.unionByName(rest, allowMissingColumns=True)


def read_collections(spark: SparkSession, path: str, county: str) -> DataFrame:
    """Features of all files under ``path``, whatever their layout; see ``parsed_features``.

    A brace that is missing or too many inside a feature shifts what follows in its file: it
    comes out as corrupt rows, not as silence.
    """
    return parsed_features(*cut_features(read_chunks(spark, path)), F.lit(county))
