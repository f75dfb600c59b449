"""Functions on groups of geometries against the same functions row by row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cellweave.functions import alike
from cellweave.functions import geometry as G

RNG = random.Random(5)


def _some(kind):
    """Geometries on a coarse grid, so that they touch, nest and cross."""
    n = lambda: float(RNG.randrange(-4, 5))
    if kind == "point":
        return 1, (n(), n())
    if kind == "line":
        return 2, [(n(), n()) for _ in range(RNG.choice((2, 3, 4)))]
    if kind == "ring":
        a = [(n(), n()) for _ in range(3)]
        return 2, [*a, a[0]]
    x0, y0 = n(), n()
    x1, y1 = x0 + RNG.randrange(1, 6), y0 + RNG.randrange(1, 6)
    if kind == "box":
        return G.box(x0, y0, x1, y1)
    if kind == "holed":
        return 3, [[(x0, y0), (x0 + 8, y0), (x0 + 8, y0 + 8), (x0, y0 + 8), (x0, y0)], [(n(), n()), (x0 + 2, y0 + 4), (x0 + 4, y0 + 2)]]
    if kind == "triangle":
        return 3, [[(x0, y0), (x1, y0), (n(), y1), (x0, y0)]]
    if kind == "many":
        return RNG.choice([(4, [(x0, y0), (x1, y1)]), (5, [[(x0, y0), (x1, y1)], [(n(), n()), (x1, y0), (x0, y1)]]), (6, [[[(x0, y0), (x1, y0), (x1, y1), (x0, y0)]]]), (7, [(1, (x0, y0)), (2, [(x0, y0), (x1, y1)])])])
    return RNG.choice([(1, None), (3, []), (2, [])])


def _column(kinds, n=240):
    shapes = [G.write(_some(RNG.choice(kinds))) for _ in range(n)]
    for i in range(0, n, 31):
        shapes[i] = None
    return pa.array(shapes, pa.binary())


ALL = ["point", "line", "ring", "box", "holed", "triangle", "many", "empty"]


def _same(got, told):
    assert got.type == told.type
    for a, b in zip(got.to_pylist(), told.to_pylist(), strict=True):
        if isinstance(a, bytes) and isinstance(b, bytes) and a != b:
            assert a[:1] == b[:1] and len(a) == len(b)
            a, b = (np.array(G.points_of(G.read(v))).ravel().tolist() for v in (a, b))
            assert np.allclose(a, b, rtol=1e-12, atol=1e-9)
        elif isinstance(a, dict) and isinstance(b, dict):
            assert np.allclose(list(a.values()), list(b.values()), rtol=1e-14)
        elif isinstance(a, float) and isinstance(b, float):
            assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
        else:
            assert a == b


def _both(name, *columns):
    try:
        told = alike._row_by_row(name, list(columns))
    except Exception:
        with pytest.raises(Exception):  # noqa: B017
            alike._by_groups(name, list(columns))
        return
    _same(alike._by_groups(name, list(columns)), told)
    _same(alike._by_groups(name, [c.slice(7) for c in columns]), told.slice(7))


@pytest.mark.parametrize("name", sorted(n for n, (takes, _, _) in G.FUNCTIONS.items() if n in alike.FAST and takes == [G.G] or n in alike._WKB))
def test_of_one_geometry(name):
    points = name in ("st_asLatLonText", "st_bufferPoint", "st_pointFromWKB")
    lines = name in ("st_makePolygon", "st_polygon")
    _both(name, _column(["point"] if points else ["line", "ring"] if lines else ALL))
    _both(name, _column(["box", "line"] if not points else ["point"]))


@pytest.mark.parametrize("name", [f"st_{n}" for n in [*G.PREDICATES, "relate", "distance", "closestPoint"]])
@pytest.mark.parametrize("kinds", [(["box"], ["box"]), (["point"], ["box"]), (["box", "triangle"], ["point"]), (["point"], ["point"]), (["line", "ring"], ["line", "box"])])
def test_relations(name, kinds):
    _both(name, *(_column(k, 90 if kinds[0] == ["line", "ring"] else 240) for k in kinds))


def test_lines_that_are_equal():
    a = _column(["line", "ring"], 60)
    _both("st_equals", a, a)


@pytest.mark.parametrize("name", ["st_geomFromWKT", "st_lineFromText", "st_pointFromText", "st_polygonFromText", "st_mLineFromText", "st_mPointFromText", "st_mPolyFromText"])
def test_texts(name):
    kind = {"line": "line", "poin": "point", "poly": "box", "geom": "many"}.get(name[3:7])
    told = {"st_mLineFromText": "MULTILINESTRING ((1 2, 3 -4.5e1), (0 0, 1 {}))", "st_mPointFromText": "MULTIPOINT ((1 2), (3 {}))", "st_mPolyFromText": "MULTIPOLYGON (((0 0, 1 0, 1 {}, 0 0)))"}.get(name)
    texts = [told.format(i / 8) if told else G.to_text(_some(kind)) for i in range(90)]
    if name == "st_pointFromText":
        texts += ["SRID=4326;POINT (1 2)", "POINT Z (1 2 3)", "POINT Z (4 5 6)", "POINT EMPTY"]
    _both(name, pa.array([*texts, None]))


def test_of_places():
    n = 120
    x, y = (pa.array([RNG.uniform(-v, v) for _ in range(n)]) for v in (180, 85))
    p = alike._by_groups("st_point", [x, y])
    _same(p, alike._row_by_row("st_point", [x, y]))
    hashes = alike._row_by_row("st_geoHash", [p, pa.array([28] * n, pa.int32())])
    mixed = pa.array([*hashes.to_pylist()[: n - 2], "ezs42", "EZS42"])
    box = pa.StructArray.from_arrays([x, y, pa.array([v + RNG.choice((0, 0.01, 3, 40)) for v in x.to_pylist()]), pa.array([v + RNG.choice((0, 0.02, 2)) for v in y.to_pylist()])], names=["xmin", "ymin", "xmax", "ymax"])
    line = pa.array([[a, b, a] for a, b in zip(p.to_pylist(), p.to_pylist()[::-1], strict=True)])
    whole = lambda v: pa.array([v] * n, pa.int32())
    said = lambda v: pa.array([v] * n)
    for name, *columns in [
        ("st_geoHash", p, whole(28)), ("st_geoHash", _column(ALL[:7], n), whole(25)), ("st_geomFromGeoHash", mixed), ("st_pointFromGeoHash", mixed), ("rf_xz2_index", box, said("EPSG:4326"), whole(12)), ("rf_reprojected_extent", box, said("EPSG:4326"), said("EPSG:3857")),
        ("st_geometry", box), ("st_makeLine", line), ("st_aggregateDistanceSphere", line), ("st_bufferPoint", p, said(5000.0)), ("st_distanceSphere", p, p.take(pa.array(range(n - 1, -1, -1)))), ("st_translate", _column(ALL[:7], n), x, y), ("st_makePointM", x, y, x),
        ("st_makeBox2D", p, p.take(pa.array(range(n - 1, -1, -1)))), ("st_pointN", _column(["line", "ring", "point"], n), whole(-1)), ("st_pointN", _column(["line"], n), whole(3)), ("st_interiorRingN", _column(["holed", "box"], n), whole(1)), ("st_geometryN", _column(ALL[:7], n), whole(2)),
        ("st_antimeridianSafeGeom", alike._row_by_row("st_geometry", [box])), ("st_relateBool", _column(["box"], n), _column(["box", "point"], n), said("T********")), ("st_lengthSphere", _column(["line", "box"], n)),
    ]:
        _both(name, *columns)


def test_relations_of_boxes_are_not_asked_row_by_row(monkeypatch):
    """Two boxes, points and boxes: all rows at once."""
    monkeypatch.setattr(G, "relate", lambda a, b: pytest.fail("row by row"))
    box, point = (pa.array([G.write(_some(k)) for _ in range(500)], pa.binary()) for k in ("box", "point"))
    for name in G.PREDICATES:
        alike.evaluate(f"st_{name}", box, box.take(pa.array(range(499, -1, -1))))
        alike.evaluate(f"st_{name}", box, point)
