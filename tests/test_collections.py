"""Collections in any layout, cut into chunks, against the standard JSON reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lotbook.sources import collections as C

HEAD = {"type": "FeatureCollection", "name": "a \"features\": [ {x", "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}}


def feature(rng, i):
    odd = rng.choice(["plain", "a } b { [ ] \" \\ ,", "\\", "\"features\":[", "}{", "line\nend", "é日", ""])
    ring = [[i, 0.5], [i + 1, 0.5], [i + 1, 1.5], [i, 0.5]]
    props = {"n": f"p{i}", "t": odd, "features": "[{"}
    if rng.random() < 0.3:
        props["deep"] = {"features": [{"a": {}}, {"b": [1, {"c": "}"}]}]}
    geometry = {"type": "Polygon", "coordinates": [ring]} if rng.random() < 0.9 else None
    return {"type": "Feature", "id": str(i), "properties": props, "geometry": geometry}


def layouts(features):
    whole = {**HEAD, "features": features, "tail": [{"z": {}}], "bbox": [1, 2]}
    lines = ",\n".join(json.dumps(f) for f in features)
    return {
        "one line": json.dumps(whole),
        "spread": json.dumps(whole, indent=2),
        "no spaces, line end": json.dumps(whole, separators=(",", ":")) + "\r\n",
        "line by line": json.dumps(HEAD)[:-1] + ',\n"features": [\n' + lines + "\n]\n}\n",
        "bare lines": "\n".join(json.dumps(f) for f in features) + "\n",
        "mixed": json.dumps(features[0]) + "\n" + json.dumps({**HEAD, "features": features[1:9]}) + "\n"
        + json.dumps({"type": "FeatureCollection", "features": []}) + "\n"
        + json.dumps({"features": features[9:], "type": "FeatureCollection"}, indent=1),
    }


@pytest.mark.parametrize("block", [97, 1 << 20])
def test_all_layouts_give_the_same_features(spark, tmp_path, block):
    rng = random.Random(5)
    features = [feature(rng, i) for i in range(40)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        for n, (name, text) in enumerate(layouts(features).items()):
            path = tmp_path / f"f{n}"
            path.mkdir()
            (path / "a.json").write_text(text, newline="")
            cut, left = C.cut_features(C.read_chunks(spark, str(path)))
            got = [json.loads(r.text) for r in cut.orderBy("src_ord").collect()]
            assert got == features, name
            assert left.count() == 0, name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_and_bad_spans(spark, tmp_path):
    rng = random.Random(1)
    good = [feature(rng, i) for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": good}))
    broken = '{"type":"Feature","id":"x","properties":{"n": nonsense},"geometry":null}\n{"type":"Other"}\n'
    (tmp_path / "b.json").write_text(json.dumps(good[0]) + "\n" + broken + '{"type":"Feature","id":"cut","properties":{"n":"u"')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text("[1, 2")
    rows = C.read_collections(spark, str(tmp_path), "teton_county_wy").collect()
    fine = [r for r in rows if r.corrupt is None]
    assert sorted(r.feature_id for r in fine) == sorted(["0", "0", "1", "2", "3", "4"])
    assert all(r.county == "teton_county_wy" and r.props["n"] == f"p{r.feature_id}" for r in fine)
    assert all((r.geom is None) == (good[int(r.feature_id)]["geometry"] is None) for r in fine)
    bad = [r.corrupt for r in rows if r.corrupt is not None]
    assert len(bad) == 4
    assert all(any(sign in b for b in bad) for sign in ("[1, 2", "cut", "Other", "nonsense"))
    assert all(r.props is None and r.geom is None for r in rows if r.corrupt is not None)


def test_blocks_of_a_file_are_read_apart(spark, tmp_path):
    """One line of many features is many tasks, and no task has a document."""
    rng = random.Random(2)
    text = json.dumps({"type": "FeatureCollection", "features": [feature(rng, i) for i in range(400)]})
    (tmp_path / "a.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        chunks = C.read_chunks(spark, str(tmp_path))
        assert chunks.select("block").distinct().count() > 10
        assert chunks.agg(F.max(F.length("value"))).first()[0] < 500
        assert C.cut_features(chunks)[0].count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
