"""Exact vectors of rectangles, relations, cell codes, geohash and byte codecs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataframe.functions import cells, codec, crs, geometry
from strataframe.functions.rect import Rect
from strataframe.operators.relate import Shape, matches, matrix, relate, transposed

SQUARE = (0.0, 0.0, 100.0, 100.0)
Q = (0.0, 0.0, 32.0, 32.0)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def box(minx, miny, maxx, maxy):
    return Shape(3, [[[(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]]])


def test_rect_points(spark):
    r = Rect.lit(*SQUARE)
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    got = one(
        spark, a=r.contains_point(*p(50, 50)), b=r.contains_point(*p(0, 50)), c=r.covers_point(*p(0, 50)), d=r.touches_point(*p(100, 100)),
        e=r.touches_point(*p(50, 50)), f=r.covers_point(*p(101, 50)),
    )
    assert tuple(got) == (True, False, True, True, False, False)


def test_rect_pairs(spark):
    r = Rect.lit(*SQUARE)
    inner, edge, corner, apart, across = (Rect.lit(*v) for v in ((10, 10, 20, 20), (0, 0, 20, 20), (100, 100, 120, 120), (200, 200, 210, 210), (50, 50, 150, 150)))
    got = one(
        spark, a=r.contains(inner), b=r.contains(edge), c=r.covers(edge), d=r.touches(corner), e=r.disjoint(apart), f=r.overlaps(across), g=r.overlaps(corner),
        h=r.intersection(corner).is_valid(), i=r.offset(1, 2).maxy, j=r.extend(5).maxy, k=r.scale(2).minx,
    )
    assert tuple(got) == (True, False, True, True, True, True, False, False, 102.0, 105.0, -50.0)


@pytest.mark.parametrize(
    ("b", "expected"),
    [
        ((10, 10, 20, 20), "FF2F01212"),
        ((10, 0, 20, 10), "FF2F11212"),
        ((5, 5, 15, 15), "212101212"),
        ((2, 2, 8, 8), "212FF1FF2"),
        ((0, 0, 10, 10), "2FFF1FFF2"),
        ((20, 20, 30, 30), "FF2FF1212"),
    ],
)
def test_polygon_matrices(b, expected):
    a = box(0, 0, 10, 10)
    value = matrix(a, box(*b))
    assert value == expected
    assert matrix(box(*b), a) == transposed(value)


def test_line_and_point_relations():
    square = box(0, 0, 10, 10)
    assert matrix(Shape(5, [[[(0, 0), (5, 0)]]]), square) == "F1FF0F212"
    assert matrix(Shape(5, [[[(0, 0), (10, 0)]]]), square) == "F1FF0F212"
    assert matrix(Shape(5, [[[(5, 0), (5, -5)]]]), square) == "FF1F00212"
    assert relate(Shape(5, [[[(-5, 5), (15, 5)]]]), square, "Crosses")
    assert relate(Shape(5, [[[(0, 0), (10, 10)]]]), Shape(5, [[[(0, 10), (10, 0)]]]), "Crosses")
    assert matches(matrix(Shape(1, [[[(0, 5)]]]), square), "F0F***212", boundary_a=False)
    assert matches(matrix(Shape(1, [[[(5, 5)]]]), square), "0FF***212", boundary_a=False)
    assert matches(matrix(Shape(1, [[[(15, 5)]]]), square), "FF0***212", boundary_a=False)
    line = Shape(5, [[[(0, 0), (10, 0)]]])
    assert matrix(Shape(1, [[[(5, 0)]]]), line).startswith("0FF")
    assert matrix(Shape(1, [[[(0, 0)]]]), line).startswith("F0F")
    assert matrix(Shape(1, [[[(0, 1)]]]), line).startswith("FF0")


def circle(cx, n):
    pts = [(cx + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    return Shape(3, [[[*pts, pts[0]]]])


@pytest.mark.parametrize("n", [200, 400, 800])
def test_short_slanted_edges(n):
    assert matrix(circle(0, n), circle(0.7, n)) == "212101212"
    assert matrix(circle(0, n), circle(5, n)) == "FF2FF1212"
    assert matrix(circle(0, n), circle(0, n)) == "2FFF1FFF2"


def test_slivers_holes_and_seams():
    sliver = Shape(3, [[[(1, 1), (2, 1.0000001), (1, 1.0000002), (1, 1)]]])
    assert matrix(sliver, box(0, 0, 3, 3)) == "2FF1FF212"
    ring = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    holed = Shape(3, [[ring(0, 0, 10, 10), ring(2, 2, 8, 8)]])
    assert matrix(holed, box(3, 3, 7, 7)) == "FF2FF1212"
    assert matrix(holed, box(2, 2, 8, 8)) == "FF2F112F2"
    assert matrix(holed, box(1, 1, 9, 9)) == "2121F12F2"
    assert matrix(box(0, 0, 10, 10), holed) == transposed(matrix(holed, box(0, 0, 10, 10))) == "212F1FFF2"
    assert matrix(Shape(5, [[[(3, 5), (7, 5)]]]), holed) == "FF1FF0212"
    assert matrix(Shape(5, [[[(1, 5), (9, 5)]]]), holed) == "1010FF212"
    two = Shape(3, [[ring(0, 0, 5, 5)], [ring(20, 0, 25, 5)]])
    assert matrix(two, box(1, 1, 2, 2)) == "212FF1FF2"


def test_rectangles_by_columns_and_exactly(spark):
    from strataframe.operators.query import rect_matrix, rect_shape

    rnd = random.Random(4)
    boxes = set()
    while len(boxes) < 60:
        x, y = rnd.randrange(5), rnd.randrange(5)
        boxes.add((x, y, x + rnd.randrange(1, 4), y + rnd.randrange(1, 4)))
    pairs = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate((a, b) for a in boxes for b in list(boxes)[:25])]
    names = [f"{p}_{c}" for p in "ab" for c in ("minx", "miny", "maxx", "maxy")]
    df = spark.createDataFrame(pairs, "i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r.m for r in df.select("i", rect_matrix(Rect.of("a_"), Rect.of("b_")).alias("m")).collect()}
    for i, *v in pairs:
        a, b = rect_shape(tuple(v[:4])), rect_shape(tuple(v[4:]))
        assert matrix(a, b) == got[i], v
        assert matrix(b, a) == transposed(got[i])


def test_matrices_of_a_batch_of_rectangles(monkeypatch):
    import pyarrow as pa

    from strataframe.functions.geometry import POLYGON
    from strataframe.operators import relate as module

    rnd = random.Random(8)
    far = lambda v: v + rnd.choice([0.0, 0.0, 1e-10])
    ring = lambda a, b, c, d: [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]
    some = []
    for _ in range(400):
        x, y = rnd.randrange(5), rnd.randrange(5)
        some.append(ring(*map(far, (x, y, x + rnd.randrange(1, 4), y + rnd.randrange(1, 4)))))
    some += [[[p[0][0][k:] + p[0][0][1 : k + 1]]] for p in some[:50] for k in (1, 2)] + [[[p[0][0][::-1]]] for p in some[:50]]
    odd = [None, [], [[]], ring(1, 1, 1, 3), [ring(0, 0, 4, 4)[0] + ring(1, 1, 2, 2)[0]], ring(0, 0, 2, 2) + ring(2, 2, 4, 4), [[[(0, 0), (3, 0), (3, 3), (1, 2), (0, 0)]]]]
    pairs = [(rnd.choice(some), rnd.choice(some)) for _ in range(3000)] + [(o, rnd.choice(some)) for o in odd for _ in range(3)]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    side = lambda k: pa.array([None if p[k] is None else [[[{"x": x, "y": y} for x, y in r] for r in part] for part in p[k]] for p in pairs], kind)
    gtype = pa.array([POLYGON] * len(pairs), pa.int32())
    calls = []
    monkeypatch.setattr(module, "matrix", lambda a, b: calls.append(1) or matrix(a, b))
    got = module.matrix_of.func(gtype, side(0), gtype, side(1)).to_pylist()
    assert got == [None if p is None else matrix(Shape(POLYGON, p), Shape(POLYGON, q)) for p, q in pairs]
    # Only pairs with sides that are close but not equal, and geometries that are no rectangles, are compared one by one.
    close = lambda p, q: any(0 < abs(v - w) < 1e-8 for k in (0, 1) for v in {t[k] for r in (p, q) for t in r[0][0]} for w in {t[k] for r in (p, q) for t in r[0][0]})
    assert len(calls) <= 18 + sum(close(p, q) for p, q in pairs[:3000]) < 2500


def test_modes():
    from strataframe.operators.relate import may_be_apart

    with pytest.raises(ValueError):
        relate(box(0, 0, 1, 1), box(0, 0, 1, 1), "Inside")
    assert may_be_apart("Disjoint") and may_be_apart("F********") is True and not may_be_apart("T********") and not may_be_apart("Touches")
    assert relate(box(0, 0, 4, 4), box(4, 4, 5, 5), "BBoxIntersects") and relate(box(0, 0, 4, 4), box(2, 2, 6, 6), "T*T***T**")


def test_contains_is_strict():
    assert relate(box(0, 0, 10, 10), box(2, 2, 8, 8), "Contains")
    assert not relate(box(0, 0, 10, 10), box(0, 0, 8, 8), "Contains")
    assert relate(box(0, 0, 10, 10), box(0, 0, 8, 8), "Covers")


def test_xzorder_codes(spark):
    for b, expected in (((15, 15, 17, 17), 8), ((3, 3, 5, 5), 5), ((15, 15, 25, 55), 1)):
        assert one(spark, c=cells.xzorder_code(Rect.lit(*b), Q, 2)).c == expected


def test_code_queries_find_all_hits(spark):
    rnd = random.Random(3)
    boxes = []
    for i in range(300):
        x, y = rnd.uniform(0, 31), rnd.uniform(0, 31)
        boxes.append((i, x, y, min(32.0, x + rnd.uniform(0, 6)), min(32.0, y + rnd.uniform(0, 6))))
    df = spark.createDataFrame(boxes, "fid int, minx double, miny double, maxx double, maxy double")
    coded = df.select("*", cells.zorder_code(Rect.of(), Q, 3).alias("z"), cells.xzorder_code(Rect.of(), Q, 3).alias("xz")).collect()
    for _ in range(20):
        x, y = rnd.uniform(0, 30), rnd.uniform(0, 30)
        q = (x, y, x + 5, y + 5)
        z, xz = set(cells.zorder_query(q, Q, 3)), set(cells.xzorder_query(q, Q, 3))
        for r in coded:
            if r.minx <= q[2] and r.maxx >= q[0] and r.miny <= q[3] and r.maxy >= q[1]:
                assert r.z in z and r.xz in xz


def test_code_ranges_hold_all_codes_of_a_query():
    rnd = random.Random(6)
    for _ in range(60):
        x, y = rnd.uniform(-3, 33), rnd.uniform(-3, 33)
        q = (x, y, x + rnd.uniform(0, 20), y + rnd.uniform(0, 20))
        for listed, ranged in ((cells.zorder_query, cells.zorder_ranges), (cells.xzorder_query, cells.xzorder_ranges)):
            for most in (8, 1000):
                runs = ranged(q, Q, 5, most=most)
                assert len(runs) <= most and all(a <= b for a, b in runs)
                assert all(any(a <= c <= b for a, b in runs) for c in listed(q, Q, 5))
    fine = cells.zorder_ranges((-180.0, -90.0, 0.0, 90.0), (-180.0, -90.0, 180.0, 90.0), 15)
    assert len(fine) <= cells.MAX_RANGES


def test_cells_round_trip():
    for code in range(cells.code_count(4)):
        assert cells.cell_code(*cells.code_cell(code)) == code
    assert cells.zorder_level(1000) == 0 and cells.zorder_level(15000) == 2
    assert cells.ranges([3, 1, 2, 7]) == [(1, 3), (7, 7)]


def test_geohash(spark):
    got = one(spark, c=cells.geohash(F.lit(-124.453125), F.lit(-6.328125), 3), **dict(zip("xywh", cells.geohash_cell(F.lit("3nz"), 3), strict=True)))
    assert tuple(got) == ("3nz", -124.453125, -6.328125, 1.40625, 1.40625)


@pytest.mark.parametrize("order", "<>")
def test_wkb(order):
    shapes = [
        (1, [[[(121.1, 42.4)]]]),
        (5, [[[(1.0, 2.0), (3.0, 4.0)]], [[(5.0, 6.0), (7.0, 8.0)]]]),
        (3, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]]),
    ]
    for g, parts in shapes:
        assert codec.from_wkb(codec.to_wkb(g, parts, order)) == (g, parts)
        assert codec.from_gaia(codec.to_gaia(g, parts, 4326))[:3] == (g, parts, 4326)


def test_vector_tile_commands():
    assert codec.mvt_commands(1, [[[(25, 17)]]]) == [9, 50, 34]
    assert codec.mvt_commands(5, [[[(2, 2), (2, 10), (10, 10)]]]) == [9, 4, 4, 18, 0, 16, 16, 0]


def test_mercator_round_trip(spark):
    x, y = crs.from_mercator(*crs.to_mercator(F.lit(12.5), F.lit(-45.25)))
    got = one(spark, x=x, y=y)
    assert math.isclose(got.x, 12.5) and math.isclose(got.y, -45.25)
    assert crs.from_wkt('GEOGCS["GCS_WGS_1984",DATUM["x"]]') == 4326


def test_transverse_mercator(spark):
    # Published values: the middle meridian at the equator, and a point of zone 33.
    for lon, lat, epsg, x, y in ((15.0, 0.0, 32633, 500000.0, 0.0), (-3.0, 60.0, 32630, 500000.0, 6651411.19), (117.0, 0.0, 4548, 500000.0, 0.0), (117.0, 0.0, 4527, 39500000.0, 0.0)):
        a, b = crs.transform(F.lit(lon), F.lit(lat), 4326, epsg)
        got = one(spark, x=a, y=b)
        assert math.isclose(got.x, x, abs_tol=0.01) and math.isclose(got.y, y, abs_tol=0.01), (epsg, got)
    for lon, lat, epsg in ((12.3, 45.6, 32633), (17.9, -33.0, 32733), (118.2, 31.9, 4548), (115.7, 22.2, 4527)):
        back = crs.transform(*crs.transform(F.lit(lon), F.lit(lat), 4326, epsg), epsg, 4326)
        got = one(spark, x=back[0], y=back[1])
        assert math.isclose(got.x, lon, abs_tol=1e-8) and math.isclose(got.y, lat, abs_tol=1e-8)
    with pytest.raises(ValueError):
        crs.transform(F.lit(1.0), F.lit(1.0), 4326, 99999)


def test_rings_and_points(spark):
    from strataframe.functions import segment

    pts = lambda *v: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in v))
    ring = pts((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    got = one(
        spark, a=segment.points_in_ring(pts((1, 1), (0, 2), (4, 2), (5, 5)), ring), b=segment.points_in_ring(pts((1, 1), (0, 2), (4, 2), (5, 5)), ring, True),
        c=segment.ring_has_all(pts((1, 1), (0, 2)), ring), d=segment.ring_has_all(pts((1, 1), (0, 2)), ring, True), e=segment.ring_has_any(pts((9, 9), (4, 4)), ring),
        f=Rect.empty().union(Rect.lit(1, 2, 3, 4)).maxx, g=Rect.empty().is_valid(),
    )
    assert tuple(got) == ([True, False, False, False], [True, True, True, False], False, True, True, 3.0, False)


def test_thinning():
    line = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 5.0)]
    assert geometry.slim_line(line) == [(0.0, 0.0), (2.0, 0.0), (2.0, 5.0)]
    assert geometry.thin_line(line, 4.0) == [(0.0, 0.0), (2.0, 0.0), (2.0, 5.0)]
    spike = [(0.0, 0.0), (2.0, 0.0), (1.0, 0.0)]
    assert geometry.slim_line(spike) == spike
    assert geometry.thin_line([(0.0, 0.0), (2.0, 0.0), (4.0, 0.0)], 4.0) == [(0.0, 0.0), (4.0, 0.0)]
    assert geometry.thin_ring([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 0.0) == []
