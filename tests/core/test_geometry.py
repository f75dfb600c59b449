import math
import random

import pytest

import cellweave.functions as rf
from cellweave.functions import geometry as G
from cellweave.operators.joins import box_in, reproject

SQUARE = "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))"
TEXTS = ["POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", SQUARE, "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT EMPTY", "POLYGON EMPTY"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    g = G.from_text(text)
    assert G.to_text(g) == text and G.to_text(G.read(G.write(g))) == text
    if "EMPTY" not in text:
        assert G.from_json(G.json.loads(G.json.dumps(G.to_json(g)))) == g


@pytest.mark.parametrize(
    ("a", "b", "matrix"),
    [
        (SQUARE, "POLYGON ((1 1, 1 3, 3 3, 3 1, 1 1))", "212101212"),
        (SQUARE, "POLYGON ((2 0, 2 2, 4 2, 4 0, 2 0))", "FF2F11212"),
        (SQUARE, "POINT (1 1)", "0F2FF1FF2"),
        (SQUARE, "POINT (0 1)", "FF20F1FF2"),
        (SQUARE, "LINESTRING (-1 1, 3 1)", "1F20F1102"),
        (SQUARE, SQUARE, "2FFF1FFF2"),
        (SQUARE, "POLYGON ((0.5 0.5, 0.5 1, 1 1, 1 0.5, 0.5 0.5))", "212FF1FF2"),
        ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "0F1FF0102"),
        ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)", "1010F0102"),
        ("POINT (0 0)", "POINT (0 0)", "0FFFFFFF2"),
    ],
)
def test_relations(a, b, matrix):
    a, b = G.from_text(a), G.from_text(b)
    assert G.relate(a, b) == matrix
    assert G.relate(b, a) == "".join(matrix[j * 3 + i] for i in range(3) for j in range(3))


def test_predicates_of_boxes():
    rng = random.Random(0)
    for _ in range(300):
        p, q = (sorted(rng.sample(range(6), 2)) + sorted(rng.sample(range(6), 2)) for _ in range(2))
        a, b = (G.box(x0, y0, x1, y1) for x0, x1, y0, y1 in (p, q))
        meet = p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
        inner = p[0] < q[1] and q[0] < p[1] and p[2] < q[3] and q[2] < p[3]
        holds = p[0] <= q[0] and q[1] <= p[1] and p[2] <= q[2] and q[3] <= p[3]
        assert G.holds("intersects", a, b) == meet and G.holds("disjoint", a, b) != meet
        assert G.holds("touches", a, b) == (meet and not inner)
        assert G.holds("contains", a, b) == holds == G.holds("within", b, a) == G.holds("covers", a, b)
        assert G.holds("overlaps", a, b) == (inner and not holds and not (q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3]))
        assert G.holds("equals", a, b) == (p == q)


def test_measures():
    hole = G.from_text(TEXTS[3])
    assert G.area(hole) == 80 and G.length(hole) == 40 and G.dimension(hole) == 2
    assert G.centroid(G.from_text(SQUARE)) == (1, (1.0, 1.0))
    assert G.nearest(G.from_text(SQUARE), G.from_text("POINT (5 6)"))[:2] == (5.0, (2, 2))
    assert G.is_valid(hole) and not G.is_valid(G.from_text("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"))
    assert not G.is_simple(G.from_text("LINESTRING (0 0, 2 2, 2 0, 0 2)"))
    assert math.isclose(G.sphere_distance((0, 0), (0, 1)), math.radians(1) * G.SPHERE)
    assert G.geohash(-5.6, 42.6, 25) == "ezs42" and G.geohash_box("ezs42")[0] < -5.6 < G.geohash_box("ezs42")[2]
    assert G.within_world(G.box(170, 0, 190, 10))[0] == 6


def test_projections():
    x, y = reproject(15.0, 52.0, "EPSG:4326", "EPSG:32633")
    assert abs(x - 500000) < 1e-6 and abs(y - 5761038.21) < 1  # on the zone's meridian
    for crs in ("EPSG:3857", "EPSG:32631", "EPSG:32733"):
        lng, lat = (3.7, 50.1) if crs != "EPSG:32733" else (14.2, -30.5)
        back = reproject(*reproject(lng, lat, "EPSG:4326", crs), crs, "EPSG:4326")
        assert abs(back[0] - lng) < 1e-8 and abs(back[1] - lat) < 1e-8
    with pytest.raises(ValueError):
        reproject(1, 1, "EPSG:4326", "EPSG:27700")
    assert box_in({"xmin": 0, "ymin": 0, "xmax": 1, "ymax": 1}, "EPSG:4326", "EPSG:4326") == (0, 0, 1, 1)


def test_xz_codes_nest():
    assert G.xz2(-180, -90, 180, 90) == 1
    assert G.xz2(10, 10, 10.001, 10.001) != G.xz2(11, 10, 11.001, 10.001)
    assert G.xz2(-180, -90, -170, -85) < G.xz2(170, 80, 180, 90)


def test_functions_in_sql(spark):
    rf.register(spark)
    row = spark.sql(
        f"""select st_asText(st_centroid(g)) c, st_contains(g, st_point(1D, 1D)) i, st_area(g) a, st_extent(g) e, st_x(st_pointFromText('POINT (3 4)')) x,
        st_asText(st_translate(st_makePoint(1D, 2D), 1D, 1D)) t, st_relate(g, g) m, st_geometryType(st_geometry(st_extent(g))) y, st_intersects(g, null) n,
        rf_data_cells(rf_rasterize(g, st_makeBBox(0D, 0D, 4D, 4D), 7, 4, 4)) r, round(st_distanceSphere(st_point(0D, 0D), st_point(0D, 1D))) d,
        st_asText(st_reproject(st_point(0D, 0D), 'EPSG:4326', 'EPSG:3857')) p, rf_xz2_index(st_extent(g), 'EPSG:4326', 18) z
        from (select st_geomFromWKT('{SQUARE}') g)"""
    ).first()
    assert (row.c, row.i, row.a, row.x, row.t, row.m, row.y, row.n, row.r, row.d) == ("POINT (1 1)", True, 4.0, 3.0, "POINT (2 3)", "2FFF1FFF2", "Polygon", None, 4, 111195.0)
    assert row.e == (0.0, 0.0, 2.0, 2.0) and row.z > 0 and row.p.startswith("POINT (0 ")
