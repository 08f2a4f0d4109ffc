"""The geometry kernel: matrices, overlay, buffer, text forms and coordinate systems with known answers."""

import itertools
import math
import random

import pytest

from geoframe.kernel import crs, shapes
from geoframe.kernel.arrangement import buffer, matches, overlay, predicate, relate
from geoframe.kernel.geometry import Geometry, area2, from_geojson, from_wkt, to_geojson, to_wkt
from geoframe.types import FormatError

BOX = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
HOLED = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"
S32 = 16 * math.sin(math.pi / 16)


def square(x, y, w=10, h=10):
    return from_wkt(f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))")


def area(g):
    return sum((1 if s else -1) * abs(area2(p)) / 2 for m in g.flat() if m.kind == "polygon" for p, s in zip(m.parts, m.shells))


@pytest.mark.parametrize("a, b, matrix", [
    (BOX, BOX, "2FFF1FFF2"), (BOX, "POLYGON((10 0,20 0,20 10,10 10,10 0))", "FF2F11212"), (BOX, "POLYGON((5 5,15 5,15 15,5 15,5 5))", "212101212"), (BOX, "POLYGON((20 20,30 20,30 30,20 30,20 20))", "FF2FF1212"),
    (BOX, "POLYGON((4 4,6 4,6 6,4 6,4 4))", "212FF1FF2"), ("POLYGON((4 4,6 4,6 6,4 6,4 4))", BOX, "2FF1FF212"), ("POINT(5 5)", BOX, "0FFFFF212"), ("POINT(0 5)", BOX, "F0FFFF212"), ("POINT(50 5)", BOX, "FF0FFF212"),
    ("POINT(5 5)", "LINESTRING(0 0,10 10)", "0FFFFF102"), ("POINT(0 0)", "LINESTRING(0 0,10 10)", "F0FFFF102"), ("POINT(0 1)", "LINESTRING(0 0,10 10)", "FF0FFF102"), ("POINT(0 1)", "POINT(1 1)", "FF0FFF0F2"),
    ("LINESTRING(0 0,10 10)", "LINESTRING(0 10,10 0)", "0F1FF0102"), ("LINESTRING(-5 5,15 5)", BOX, "101FF0212"), ("LINESTRING(-0.0000003 0.0000004, 10.0000002 9.9999998)", "LINESTRING(0 10,10 0)", "0F1FF0102"),
    ("LINESTRING(0 0,5 5)", "LINESTRING(0 0,5 5)", "1FFF0FFF2"), (f"GEOMETRYCOLLECTION({BOX},POINT(20 20))", "POINT(20 20)", "0F2FF1FF2"), (f"GEOMETRYCOLLECTION({BOX},POINT(20 20))", BOX, "2F0F1FFF2"),
])
def test_relate(a, b, matrix):
    assert relate(from_wkt(a), from_wkt(b)) == matrix


def test_relate_transposes_and_implies():
    r = random.Random(1)
    shapes_ = [square(r.randint(0, 6), r.randint(0, 6), r.randint(1, 6), r.randint(1, 6)) for _ in range(12)] + [from_wkt(f"LINESTRING({r.randint(0, 9)} {r.randint(0, 9)},{r.randint(0, 9)} 11)") for _ in range(6)]
    for a, b in itertools.product(shapes_, repeat=2):
        m, t = relate(a, b), relate(b, a)
        assert "".join(m[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)) == t
        assert predicate("intersects", a, b) != predicate("disjoint", a, b)
        assert predicate("contains", a, b) == predicate("within", b, a)
        assert not predicate("contains", a, b) or predicate("covers", a, b)
        assert predicate("touches", a, b) == (predicate("intersects", a, b) and matches(m, "F********"))


OPS = ["intersection", "union", "difference", "symmetric_difference"]


@pytest.mark.parametrize("b, areas, kind", [
    (square(5, 5), (25, 175, 75, 150), "polygon"), (square(20, 20), (0, 200, 100, 200), "polygon"), (square(4, 4, 2, 2), (4, 100, 96, 96), "polygon"),
    (square(0, 0), (100, 100, 0, 0), "polygon"), (square(10, 0), (0, 200, 100, 200), "polyline"), (square(10, 10), (0, 200, 100, 200), "point"),
])
def test_overlay_areas(b, areas, kind):
    got = [overlay(from_wkt(BOX), b, op) for op in OPS]
    assert [area(g) for g in got] == list(areas) and got[0].kind == kind


def test_overlay_identities():
    r = random.Random(3)
    for _ in range(60):
        ring = lambda: [(r.randint(0, 40), r.randint(0, 40)) for _ in range(3)]
        try:
            a, b = (from_wkt(f"POLYGON(({', '.join(f'{x} {y}' for x, y in [*t, t[0]])}))") for t in (ring(), ring()))
        except FormatError:
            continue
        if not area(a) or not area(b):
            continue
        i, u, d, s = (area(overlay(a, b, op)) for op in OPS)
        assert u == pytest.approx(area(a) + area(b) - i) and d == pytest.approx(area(a) - i) and s == pytest.approx(u - i)


def test_overlay_lines_points_heights():
    line, box = from_wkt("LINESTRING(-5 5,15 5)"), from_wkt(BOX)
    assert to_wkt(overlay(line, box, "intersection")) == "LINESTRING (0 5, 10 5)"
    assert to_wkt(overlay(line, box, "difference")) == "MULTILINESTRING ((-5 5, 0 5), (10 5, 15 5))"
    cut = overlay(box, line, "difference")
    assert cut.kind == "polygon" and area(cut) == 100
    assert [m.kind for m in overlay(box, line, "union").members] == ["polygon", "polyline", "polyline"]
    assert to_wkt(overlay(from_wkt("LINESTRING(0 0,10 10)"), from_wkt("LINESTRING(0 10,10 0)"), "intersection")) == "POINT (5 5)"
    assert to_wkt(overlay(from_wkt("MULTIPOINT(1 1,50 50)"), box, "intersection")) == "POINT (1 1)"
    assert to_wkt(overlay(from_wkt("POINT(1 1)"), from_wkt("POINT(2 2)"), "union")) == "MULTIPOINT ((1 1), (2 2))"
    z = overlay(from_wkt("POLYGON Z((0 0 5,10 0 5,10 10 5,0 10 5,0 0 5))"), from_wkt("POLYGON Z((5 5 7,15 5 7,15 15 7,5 15 7,5 5 7))"), "intersection")
    assert {(v[0], v[1]): v[2] for v in z.parts[0]} == {(5, 5): 7, (5, 10): 6, (10, 10): 5, (10, 5): 6}
    assert len(overlay(from_wkt(HOLED), square(4, 4, 2, 2), "union").parts) == 1
    assert overlay(box, square(50, 50), "intersection").kind == "polygon"
    with pytest.raises(NotImplementedError):
        overlay(from_wkt(f"GEOMETRYCOLLECTION({BOX},POINT(1 1))"), box, "union")
    with pytest.raises(NotImplementedError):
        overlay(Geometry("multipatch", [[(0, 0, 0, 0)]]), box, "union")


@pytest.mark.parametrize("wkt, style, want", [
    ("POINT(0 0)", {"distance": 1}, S32), ("POINT(0 0)", {"distance": 1, "cap": "square"}, 4), ("POINT(0 0)", {"distance": 1, "cap": "flat"}, 0), ("LINESTRING(0 0,10 0)", {"distance": 1}, 20 + S32),
    ("LINESTRING(0 0,10 0)", {"distance": 1, "cap": 2}, 20), ("LINESTRING(0 0,10 0)", {"distance": 1, "cap": 3}, 24), (BOX, {"distance": 1, "join": "mitre"}, 144), (BOX, {"distance": 1, "join": "bevel"}, 142),
    (BOX, {"distance": 1}, 140 + S32), (BOX, {"distance": -1}, 64), (BOX, {"distance": -6}, 0), (HOLED, {"distance": -1}, 52 - S32), (HOLED, {"distance": 1}, 140 + S32), ("LINESTRING(0 0,10 0)", {"distance": -1, "single_sided": True}, 10), (BOX, {"distance": 0}, 100),
])
def test_buffer(wkt, style, want):
    assert area(buffer(from_wkt(wkt), **style)) == pytest.approx(want, abs=1e-9)


def test_buffer_vertices_and_refusals():
    assert [len(buffer(from_wkt("POINT(0 0)"), 1, q).parts[0]) for q in (1, 2, 4, 8, 16)] == [4, 8, 16, 32, 64]
    assert len(buffer(from_wkt(BOX), -1).parts[0]) == 4 and buffer(from_wkt("LINESTRING(0 0,1 1)"), -1).empty
    with pytest.raises(ValueError):
        buffer(from_wkt(BOX), 1, cap="pointed")


def test_measures_and_shapes():
    assert shapes.distance(square(0, 0), square(20, 0)) == 10 and shapes.distance(from_wkt("POINT(5 5)"), square(0, 0)) == 0 and shapes.distance(from_wkt("POINT EMPTY"), square(0, 0)) is None
    assert to_wkt(shapes.convex_hull(from_wkt("MULTIPOINT(0 0,1 1,2 2)"))) == "LINESTRING (0 0, 2 2)"
    assert len(shapes.simplify(from_wkt("LINESTRING(0 0,1 0.05,2 -0.05,3 0)"), 0.1).parts[0]) == 2
    assert shapes.is_valid(from_wkt(HOLED)) and not shapes.is_valid(from_wkt("POLYGON((0 0,10 10,10 0,0 10,0 0))"))
    assert not shapes.is_simple(from_wkt("LINESTRING(0 0,10 10,10 0,0 10)")) and shapes.is_simple(from_wkt("LINESTRING(0 0,1 1,2 0)")) and not shapes.is_simple(from_wkt("MULTIPOINT(1 1,1 1)"))
    with pytest.raises(NotImplementedError):
        shapes.simplify(from_wkt(BOX), 1, preserve_topology=True)


@pytest.mark.parametrize("wkt", ["POINT ZM (1 2 3 4)", "MULTIPOINT ((1 1), (2 2))", "LINESTRING M (0 0 7, 1 1 8)", "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", "GEOMETRYCOLLECTION (POINT Z (1 2 3), POLYGON ((0 0, 1 1, 1 0, 0 0)))", "LINESTRING (1.5 -2.25, 1e+16 0.1)"])
def test_wkt_round_trip(wkt):
    assert to_wkt(from_wkt(wkt)) == wkt and to_wkt(from_wkt("SRID=4326;" + wkt)) == wkt


@pytest.mark.parametrize("wkt", ["", "CIRCLE (1 2)", "POINT (1)", "POLYGON ((0 0, 1 1))", "GEOMETRYCOLLECTION (POINT (1 2)", "GEOMETRYCOLLECTION (POINT (1 2),)", "GEOMETRYCOLLECTION ()", "GEOMETRYCOLLECTION Z (POINT (1 2))", "POINT (1 2) x"])
def test_bad_wkt(wkt):
    with pytest.raises(FormatError):
        from_wkt(wkt)


def test_geojson():
    for wkt in (BOX, HOLED, "POINT Z (1 2 3)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "GEOMETRYCOLLECTION(POINT(1 1))"):
        assert to_wkt(from_geojson(to_geojson(from_wkt(wkt)))) == to_wkt(from_wkt(wkt))
    assert from_geojson('{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}').kind == "point"
    for bad in ('{"type": "Circle", "coordinates": [1]}', "[]", "nope", '{"type": "Point", "coordinates": [1, 2, 3, 4]}'):
        with pytest.raises(FormatError):
            from_geojson(bad)


def test_crs():
    lon, lat = crs.transform([39394370.79], [3179362.10], 4527, 4326)
    assert lon[0] == pytest.approx(115.91881971302487, abs=1e-9) and lat[0] == pytest.approx(28.725838734163123, abs=1e-9)
    x, y = crs.transform(lon, lat, "EPSG:4326", 4527)
    assert x[0] == pytest.approx(39394370.79, abs=1e-3) and y[0] == pytest.approx(3179362.10, abs=1e-3)
    x, y = crs.transform([500000], [0], 32633, 4326)
    assert (x[0], y[0]) == pytest.approx((15, 0), abs=1e-12)
    for bad in (True, 99999, "nowhere"):
        with pytest.raises(crs.CoordTransformError):
            crs.resolve(bad)


def test_shapes_on_their_corners_and_at_odd_angles():
    """Crossings that are rounded apart: the ladder of precisions closes the rings."""
    for cx, cy, r in itertools.product((0, 5, 7), (0, 3), (1, 2, 3)):
        g = from_wkt(f"POLYGON(({cx - r} {cy},{cx} {cy + r},{cx + r} {cy},{cx} {cy - r},{cx - r} {cy}))")
        assert area(buffer(g, 0.25)) == pytest.approx(2 * r * r + math.sqrt(2) * r + S32 * 0.0625)
        assert area(buffer(g, -0.25)) == pytest.approx(2 * (r - 0.25 * math.sqrt(2)) ** 2)
    rnd = random.Random(3)
    for _ in range(25):
        n = rnd.randint(3, 9)
        ring = [(math.cos(2 * math.pi * i / n + 0.3) * rnd.uniform(2, 6) + 5, math.sin(2 * math.pi * i / n + 0.3) * rnd.uniform(2, 6) + 5) for i in range(n)]
        text = lambda row: from_wkt("POLYGON((" + ",".join(f"{x} {y}" for x, y in [*row, row[0]]) + "))")
        a, b = text(ring), text([(x + 1, y + 0.5) for x, y in ring])
        assert area(buffer(a, 0.5)) > area(a)
        assert area(overlay(a, b, "intersection")) + area(overlay(a, b, "union")) == pytest.approx(area(a) + area(b))


def test_few_and_many_segments_cross_alike():
    import numpy as np

    from geoframe.kernel.arrangement import _few_crossings, crossings

    rnd = np.random.RandomState(1)
    for size in (3, 5, 9):
        p, q = rnd.randint(0, size, (40, 2)).astype(float), rnd.randint(0, size, (40, 2)).astype(float)
        some = (p != q).any(1)
        p, q = p[some], q[some]
        told = lambda rows: {(min(i, j), max(i, j)): sorted(tuple(round(c, 9) for c in v) for v in shared) for i, j, shared in rows}
        assert told(_few_crossings(p.tolist(), q.tolist())) == told(crossings(p, q))
