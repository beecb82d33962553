"""Worked cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from lotbook.functions import geometry as G
from lotbook.functions import maps as M
from lotbook.functions import numbers as N
from lotbook.functions import text as T
from lotbook.functions.legal import legal_part
from lotbook.functions.urls import extraction_route, parcel_of_url, record_domain


@pytest.mark.parametrize(
    "raw, want",
    [(" 1,234.5 ", 1234.5), ("", None), ("abc", None), ("0", 0.0), ("1e3d", None), ("-.5e1", -5.0), (None, None)],
)
def test_parse_number(one, raw, want):
    assert one(N.parse_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [("Smith, John & Mary", "smith john mary"), ("É-b_c", "é b_c"), (None, ""), (" a  b ", "a b")],
)
def test_clean_search(one, raw, want):
    assert one(T.clean_search(F.lit(raw).cast("string"))) == want


def test_words_and_query(one):
    assert one(T.words(T.normalize_query(F.lit("  Ab,  CD ")))) == ["ab,", "cd"]


@pytest.mark.parametrize(
    "code, name, state",
    [
        ("teton_county_wy", "Teton County", "WY"),
        ("teton_county_id", "Teton County", "ID"),
        ("some_place", "Some Place", ""),
    ],
)
def test_county_names(one, code, name, state):
    assert one(T.county_display_name(F.lit(code))) == name
    assert one(T.state_of_county(F.lit(code))) == state


@pytest.mark.parametrize(
    "text, part, want",
    [
        ("LOT 12, H-H-R RANCHES", "subdivision", "H-H-R RANCHES"),
        ("BLOCK 7 S25 T41 R116", "block", "7"),
        ("BLOCK 7 S25 T41 R116", "section", "25"),
        ("BLOCK 7 S25 T41 R116", "range", "116"),
        ("LOT12", "township", "12"),
        (None, "block", ""),
    ],
)
def test_legal_parts(one, text, part, want):
    assert one(legal_part(F.lit(text).cast("string"), part)) == want


def test_description_last_duplicate_wins_and_odd_rows_are_skipped(one):
    html = (
        "<table><tr><td>Pid N</td><td> 7 </td></tr><tr><td>single</td></tr>"
        "<TR><th>Owner</th><td>X &amp; <b>Y</b></td></TR><tr><td>owner</td><td>Z</td></tr></table>"
    )
    assert one(M.parse_description(F.lit(html))) == {"pid_n": "7", "owner": "Z"}
    assert one(M.parse_description(F.lit(None).cast("string"))) == {}


def test_nested_description_rows(one):
    html = "<tr><td><table><tr><td>k</td><td>v</td></tr></table></td></tr>"
    assert one(M.parse_description(F.lit(html))) == {"k": "v"}


def test_overwrite_needs_no_session_setting(one):
    left = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    right = F.create_map(F.lit("b"), F.lit("3"))
    assert one(M.overwrite(left, right)) == {"a": "1", "b": "3"}


@pytest.mark.parametrize("value, want", [(250000.0, "250000.0"), (12345678.25, "12345678.25"), (1.5, "1.5"), (None, ""), (0.0, "0.0")])
def test_number_text(one, value, want):
    assert one(N.number_text(F.lit(value).cast("double"))) == want


def test_money(one):
    text = F.lit("$ 1,234 ($ 500 Land + $734 Improvements)")
    assert one(N.money_total(text)) == "$1,234"
    assert one(N.money_before(text, "Land")) == "$500"
    assert one(N.money_before(text, "Improvements")) == "$734"
    assert one(N.money_value(F.lit("$1,234.00"))) == 1234.0


def test_url_rules(one):
    assert one(parcel_of_url(F.lit("x?ParcelID=7&y=1"))) == "7"
    assert one(parcel_of_url(F.lit("x?account-no=8"))) == "8"
    assert one(parcel_of_url(F.lit("x"))) is None
    cases = [
        ("https://maps.greenwoodmap.com/", "lincoln", "greenwood"),
        ("u", "Sublette", "greenwood"),
        ("https://tetonidaho.maps.arcgis.com", None, "teton_idaho"),
        ("https://lincoln/teton", None, "lincoln"),
        ("https://gis.tetoncountywy.gov", None, "teton"),
        ("u", None, "general"),
    ]
    for url, county, want in cases:
        assert one(extraction_route(F.lit(url), F.lit(county).cast("string"))) == want
    assert one(record_domain(F.lit("u"), F.lit("Fremont"))) == "fremont"
    assert one(record_domain(F.lit("http://sublette"), F.lit("park"))) is None
    assert one(record_domain(F.lit("http://Sublette"), F.lit(None).cast("string"))) == "sublette"


def test_crs_rules(one):
    def guess(x, y):
        return one(G.crs_of_point(F.lit(x), F.lit(y)))

    assert guess(-110.8, 43.4) == "EPSG:4326"
    assert guess(2.4e6, 1.4e6) == "EPSG:3739"
    assert guess(500.0, 500.0) == "EPSG:4326"
    assert one(G.declared_crs(F.lit("urn:ogc:def:crs:EPSG::3738"))) == "EPSG:3738"
    assert one(G.declared_crs(F.lit("EPSG:2677"))) == "EPSG:3739"


def forward(lon, lat, zone):
    """Forward Transverse Mercator in feet (Snyder 1987, eqs. 8-9 and 8-10)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon - zone["lon0"])
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, q = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, lam * math.cos(phi)
    x = zone["k0"] * n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * q**5 / 120)
    arc = G.meridian_arc(phi) - G.meridian_arc(math.radians(zone["lat0"]))
    y = zone["k0"] * (
        arc + n * math.tan(phi) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q**4 / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * q**6 / 720)
    )
    foot = 1200 / 3937
    return (x + zone["fe"]) / foot, (y + zone["fn"]) / foot


@pytest.mark.parametrize("crs", ["EPSG:3738", "EPSG:3739"])
@pytest.mark.parametrize("lon, lat", [(-110.8, 43.4), (-109.9, 42.1), (-110.083333, 40.5)])
def test_reprojection_inverts_the_forward_formula(one, crs, lon, lat):
    x, y = forward(lon, lat, G.STATE_PLANE_ZONES[crs])
    p = one(F.expr(G.to_degrees_sql(f"{x!r}D", f"{y!r}D", f"'{crs}'")))
    assert abs(p.x - lon) < 1e-8 and abs(p.y - lat) < 1e-8


SQUARE = "[[[0,0,9],[4,0],[4,4],[0,4],[0,0]]]"
DONUT = "[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]"


def geom(kind, text):
    return G.parse_geometry(F.lit(kind), F.lit(text))


@pytest.mark.parametrize(
    "kind, text, x, y, want",
    [
        ("Polygon", SQUARE, 2.0, 2.0, True),
        ("Polygon", SQUARE, 4.0, 2.0, True),
        ("Polygon", SQUARE, 4.0, 4.0, True),
        ("Polygon", SQUARE, 5.0, 2.0, False),
        ("Polygon", SQUARE, 5.0, 4.0, False),
        ("Polygon", DONUT, 2.0, 2.0, False),
        ("Polygon", DONUT, 1.0, 2.0, True),
        ("Polygon", DONUT, 0.5, 2.0, True),
        ("MultiPolygon", f"[{SQUARE},[[[10,10],[12,10],[11,12],[10,10]]]]", 11.0, 11.0, True),
        ("MultiPolygon", f"[{SQUARE},[[[10,10],[12,10],[11,12],[10,10]]]]", 10.0, 11.9, False),
        ("Polygon", "[[[0,0],[6,0],[6,6],[3,1],[0,6],[0,0]]]", 3.0, 4.0, False),
        ("Polygon", "[[[0,0],[6,0],[6,6],[3,1],[0,6],[0,0]]]", 1.0, 2.0, True),
    ],
)
def test_point_in_polygon(one, kind, text, x, y, want):
    assert one(G.covers_point(G.segments(geom(kind, text)), F.lit(x), F.lit(y))) is want


def test_bbox(one):
    two = geom("MultiPolygon", f"[{SQUARE},[[[10,10],[12,10],[11,12],[10,10]]]]")
    assert list(one(G.bbox_array(G.bbox(two)))) == [0.0, 0.0, 12.0, 12.0]
    assert one(G.bbox(geom("Point", "[1,2]"))) is None
    assert one(G.bbox(geom("Polygon", "[]"))) is None


def test_tiles_of_the_world_corners(one):
    assert one(G.tile_x(F.lit(-180.0), F.lit(3))) == 0
    assert one(G.tile_x(F.lit(180.0), F.lit(3))) == 7
    assert one(G.tile_y(F.lit(90.0), F.lit(3))) == 0
    assert one(G.tile_y(F.lit(-90.0), F.lit(3))) == 7
