"""Layers of points, lines and areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import feeds
from lotbook.config import EXTRA_LAYERS
from lotbook.operators import layers
from lotbook.session import shared_folder
from lotbook.sources.layers import read_layers

_NAMES = [name for _, name, _ in EXTRA_LAYERS]
_TYPES = [data_type for _, _, data_type in EXTRA_LAYERS]
# Kind of the feature of a customer, by its key. The last two have nothing to read.
_KINDS = ["Point", "LineString", "MultiLineString", "Polygon", "MultiPoint", "LineString", "MultiPolygon",
          "GeometryCollection", None]


def _landed(spark, sf):
    """A feature per customer as text in the folders of six layers and of an unknown one.

    Vertices are multiples of 1/1024 degree. Vertex i of a path is ``(x0 + i * w, y0 + i * h)``,
    its height less ``3 * h`` where i is odd; the second path of a kind of many lies 1/8 east.
    Documents are collections, spread over lines in half of the layers.
    """
    rows = feeds.parcels(spark, sf).select("ck", "x0", "y0", "w", "h")
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    # Shifting in a CASE of literal cells keeps text exact: doubles print as they are read.
    rows = rows.withColumns(
        {"kind": F.get(kinds, F.col("ck") % 9), "n": (2 + F.col("ck") % 4).cast("int")}
    )

    def path(shift):
        def vertex(i):
            x = F.col("x0") + i * F.col("w") + F.lit(shift)
            y = F.col("y0") + i * F.col("h") - F.when(i % 2 == 1, 3 * F.col("h")).otherwise(0.0)
            return F.format_string("[%s, %s, 7]", x.cast("string"), y.cast("string"))

        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), vertex)

    def listed(items):
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    def ring(shift):
        return listed(F.concat(path(shift), F.slice(path(shift), F.lit(1), F.lit(1))))

    coordinates = (
        F.when(F.col("kind") == "Point", F.get(path(0.0), F.lit(0)))
        .when(F.col("kind").isin("LineString", "MultiPoint"), listed(path(0.0)))
        .when(F.col("kind") == "MultiLineString", listed(F.array(listed(path(0.0)), listed(path(0.125)))))
        .when(F.col("kind") == "Polygon", listed(F.array(ring(0.0))))
        .when(F.col("kind") == "MultiPolygon", listed(F.array(listed(F.array(ring(0.0))), listed(F.array(ring(0.125))))))
        .otherwise("[]")
    )
    geometry = F.when(F.col("kind").isNull(), "null").otherwise(
        F.concat(F.lit('{"type": "'), "kind", F.lit('", "coordinates": '), coordinates, F.lit("}"))
    )
    text = F.concat(
        F.lit('{"type": "Feature", "id": "'), F.col("ck").cast("string"),
        F.lit('", "properties": {"name": "n } '), F.col("ck").cast("string"), F.lit('"}, "geometry": '), geometry, F.lit("}"),
    )
    names = F.array(*[F.lit(n) for n in [*_NAMES, "parks"]])
    layer = F.get(names, F.floor(F.col("ck") / 9).cast("int") % 7)
    grouped = rows.select("ck", layer.alias("layer"), text.alias("t"))
    grouped = grouped.groupBy("layer", F.floor(F.col("ck") / 400).alias("doc"))
    docs = grouped.agg(F.array_sort(F.collect_list(F.struct("ck", "t"))).alias("f"))
    one = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("f.t", ", "), F.lit("]}"))
    spread = F.regexp_replace(one, r'([,{\[]) ?(["{])', "$1\n  $2")
    value = F.when(F.col("layer") < "p", one).otherwise(spread)
    return docs.select(F.lit("teton_county_wy").alias("county"), "layer", value.alias("value"))


def _read(spark, sf):
    path = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    _landed(spark, sf).write.option("lineSep", " ").partitionBy("county", "layer").text(path)
    return read_layers(spark, path)


def layer_features(spark, sf):
    features, _ = _read(spark, sf)
    box = F.col("bbox")
    return layers.layer_features(features).select(
        "feature_id",
        "layer",
        "data_type",
        F.col("props")["name"].alias("name"),
        F.col("shape.type").alias("kind"),
        F.coalesce(F.size(F.flatten("shape.paths")), F.lit(0)).alias("vertices"),
        box["xmin"].alias("xmin"),
        box["ymin"].alias("ymin"),
        box["xmax"].alias("xmax"),
        box["ymax"].alias("ymax"),
    )


def layer_tiles(spark, sf):
    features, _ = _read(spark, sf)
    by_id = layers.layer_features(features).withColumn("uid", F.col("feature_id"))
    return layers.layer_cover(by_id)


def layer_counts(spark, sf):
    features, rejects = _read(spark, sf)
    return layers.layer_counts(layers.layer_features(features), rejects)


def _choice(values, by):
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values) if v is not None)
    return f"case {by} {whens} end"


_LANDED_SQL = f"""{feeds.PARCELS_SQL},
  f as (select ck, cast(ck as varchar) as feature_id, {_choice(_KINDS, 'ck % 9')} as kind, 2 + ck % 4 as n, x0, y0, w, h,
      (ck // 9) % 7 as l, {_choice([*_NAMES, 'parks'], '(ck // 9) % 7')} as layer, {_choice(_TYPES, '(ck // 9) % 7')} as data_type from p),
  ok as (select * from f where l < 6 and (kind is null or kind <> 'GeometryCollection')),
  paths as (select *, unnest(case when kind like 'Multi%' and kind <> 'MultiPoint' then [0, 1] when kind is null then [] else [0] end) as part from ok),
  v as (select *, x0 + i * w + part * 0.125e0 as x, y0 + i * h - case when i % 2 = 1 then 3 * h else 0 end as y
      from (select *, unnest(range(case when kind = 'Point' then 1 else n end)) as i from paths)),
  b as (select ck, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax, count(*) as c, max(part) + 1 as parts from v group by ck)"""

_X = "(({v}) + 180) / 360"
_Y = "(1 - ln(tan(radians({v})) + 1 / cos(radians({v}))) / pi()) / 2"

_TILES_SQL = f"""{_LANDED_SQL},
  zs as (select unnest(range(6, 18)) as z),
  pairs as (select feature_id, x as x1, y as y1, coalesce(lead(x) over o, case when i = 0 then x end) as x2,
      coalesce(lead(y) over o, case when i = 0 then y end) as y2 from v where kind in ('Point', 'LineString', 'MultiLineString')
      window o as (partition by ck, part order by i)
    union all select feature_id, x, y, x, y from v where kind = 'MultiPoint'),
  ends as (select feature_id, case when x1 > x2 then x2 else x1 end as a, case when x1 > x2 then y2 else y1 end as b,
      case when x1 > x2 then x1 else x2 end as c, case when x1 > x2 then y1 else y2 end as d from pairs where x2 is not null),
  sized as (select feature_id, z, {_X.format(v='a')} * pow(2, z) as wx, {_Y.format(v='b')} * pow(2, z) as wy,
      {_X.format(v='c')} * pow(2, z) as ex, {_Y.format(v='d')} * pow(2, z) as ey from ends, zs),
  cols as (select *, unnest(range(cast(floor(wx) as bigint), cast(floor(ex) as bigint) + 1)) as x from sized),
  cut as (select *, case when wx >= x then wy else wy + (x - wx) * ((ey - wy) / (ex - wx)) end as i,
      case when ex <= x + 1 then ey else wy + (x + 1 - wx) * ((ey - wy) / (ex - wx)) end as o from cols),
  lined as (select feature_id, z, x, unnest(range(cast(floor(least(i, o)) as bigint), cast(floor(greatest(i, o)) as bigint) + 1)) as y from cut),
  acols as (select *, unnest(range(cast(floor({_X.format(v='xmin')} * pow(2, z)) as bigint), cast(floor({_X.format(v='xmax')} * pow(2, z)) as bigint) + 1)) as x
      from b join ok using (ck), zs where kind in ('Polygon', 'MultiPolygon')),
  boxed as (select feature_id, z, x, unnest(range(cast(floor({_Y.format(v='ymax')} * pow(2, z)) as bigint),
      cast(floor({_Y.format(v='ymin')} * pow(2, z)) as bigint) + 1)) as y from acols),
  tiles as (select feature_id, z, x, y, count(*) as steps from lined group by all
    union all select feature_id, z, x, y, 0 from boxed)"""

QUERIES = {
    "layer_features": (
        layer_features,
        f"""with {_LANDED_SQL} select feature_id, layer, data_type, concat('n }} ', feature_id) as name, kind,
          cast(coalesce(c, 0) + case when kind in ('Polygon', 'MultiPolygon') then parts else 0 end as int) as vertices,
          xmin, ymin, xmax, ymax from ok left join b using (ck)""",
    ),
    "layer_tiles": (
        layer_tiles,
        f"""with {_TILES_SQL} select case when z <= 12 then 'low' when z <= 16 then 'mid' else 'high' end as band,
          cast(z as int) as z, x, y, feature_id as uid, steps from tiles""",
    ),
    "layer_counts": (
        layer_counts,
        f"""with {_LANDED_SQL} select 'teton_county_wy' as county, layer, count(*) filter (good) as features,
          count(*) filter (good and kind is not null) as placed, count(*) filter (not good) as rejects
          from (select *, l < 6 and (kind is null or kind <> 'GeometryCollection') as good from f) group by layer""",
    ),
}
