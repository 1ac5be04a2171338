import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fordway.functions import geometry as G, overlay as O, scores as S
from fordway.operators import crop as C

INF = float("inf")


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def wkt(text):
    return G.polygon_of_wkt(F.lit(text))


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"


@pytest.mark.parametrize("x,y,intersects,within", [(2, 2, True, True), (4, 2, True, False), (0, 0, True, False), (5, 2, False, False)])
def test_point_and_square(spark, x, y, intersects, within):
    segs = G.polygon_segments(wkt(SQUARE))
    assert tuple(one(spark, G.point_intersects(F.lit(x), F.lit(y), segs), G.point_within(F.lit(x), F.lit(y), segs))) == (intersects, within)


def test_hole(spark):
    segs = G.polygon_segments(wkt("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))"))
    inside = [G.point_within(F.lit(x), F.lit(5), segs) for x in (1, 5, 3)]
    assert tuple(one(spark, *inside, G.point_intersects(F.lit(3), F.lit(5), segs))) == (True, False, False, True)


def test_lines(spark):
    segs = G.polygon_segments(wkt(SQUARE))
    lines = ["LINESTRING (-1 -1, 5 5)", "LINESTRING (1 1, 2 2)", "LINESTRING (4 5, 4 4)", "LINESTRING (5 0, 5 4)", "LINESTRING (-1 5, 5 5)"]
    got = one(spark, *[G.line_intersects(G.line_of_wkt(F.lit(x)), segs) for x in lines], *[G.line_within(G.line_of_wkt(F.lit(x)), segs) for x in lines[:2]])
    assert tuple(got) == (True, True, True, False, False, False, True)
    inner, outer = "POLYGON ((1 1, 2 1, 2 2, 1 1))", "POLYGON ((3 3, 6 3, 6 6, 3 3))"
    assert tuple(one(spark, *[G.polygon_within(wkt(x), segs) for x in (inner, outer)])) == (True, False)


def test_measures(spark):
    ring = G.polygon_centroid(wkt("POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (0 0, 3 0, 3 6, 0 6, 0 0))"))
    line = G.line_centroid(G.line_of_wkt(F.lit("LINESTRING (0 0, 10 0, 10 2)")))
    got = one(spark, ring, line, G.line_length(G.line_of_wkt(F.lit("LINESTRING (0 0, 3 4)"))), G.bounds(G.line_of_wkt(F.lit("LINESTRING (1 7, -2 3)"))))
    assert got[0] == (4.5, 3.0)
    assert got[1] == pytest.approx((70 / 12, 2 / 12))
    assert got[2] == 5.0
    assert tuple(got[3]) == (-2.0, 3.0, 1.0, 7.0)


def test_haversine_and_zones(spark):
    sides = one(spark, G.haversine(*map(F.lit, (6.55, 49.68, 6.55, 49.85))), G.haversine(*map(F.lit, (6.55, 49.85, 6.775, 49.85))))
    assert tuple(sides) == pytest.approx((18909.072, 16136.991), abs=1e-3)
    assert G.haversine_m(6.55, 49.68, 6.55, 49.85) == pytest.approx(sides[0])
    codes = one(spark, *[G.utm_epsg(F.lit(lon), F.lit(lat)) for lon, lat in ((6.65, 49.75), (-180, 10), (0, -1), (179.999, 0), (180, 10))])
    assert tuple(codes) == (32632, 32601, 32731, 32660, 32660)


def test_grid_steps():
    box = (G.haversine_m(6.55, 49.85, 6.775, 49.85), G.haversine_m(6.55, 49.68, 6.55, 49.85))
    assert G.grid_steps(*box, distance_m=500) == (37, 32)
    assert G.grid_steps(*box, distance_m=50) == (378, 322)
    wide = (6.775 - 6.55) / (49.85 - 49.68)
    assert G.grid_steps(*box, samples=100, aspect=wide) == (8, 10) and G.grid_steps(*box, samples=1000, aspect=wide) == (27, 35)
    with pytest.raises(ValueError):
        G.grid_steps(*box, samples=1, aspect=wide)
    with pytest.raises(RuntimeError):
        G.grid_steps(*box)
    with pytest.raises(RuntimeError):
        G.grid_steps(*box, samples=1, distance_m=1)
    with pytest.raises(ValueError):
        G.grid_steps(*box, distance_m=1e6)


def test_interpolation(spark):
    inner = "LINESTRING (0 0, 1 0, 2 0, 3 0, 4 0, 5 0, 0 0)"
    outer = "LINESTRING (0 2, 1 2, 2 2, 3 2, 4 2, 5 2, 6 2, 7 2, 0 2)"
    got = one(spark, G.interpolate_rings(G.line_of_wkt(F.lit(inner)), G.line_of_wkt(F.lit(outer))))[0]
    assert [int(p.x * 2 - k) for k, p in enumerate(got[:-1])] == [0, 0, 1, 2, 3, 3, 4, 5]
    assert got[0] == got[-1] and {p.y for p in got} == {1.0}
    assert int(22 * (30 / 44)) == 14  # the step is a float: a whole-number division would give 15


def test_clip(spark):
    box = [F.lit(v) for v in (0, 0, 10, 10)]
    got = one(spark, *[G.clip_segment(*map(F.lit, s), *box) for s in ((-5, 5, 15, 5), (-5, 5, -1, 5), (2, 2, 3, 3), (5, -5, 5, 5), (-1, 11, 11, 12))])
    assert [None if g is None else tuple(g) for g in got] == [(0, 5, 10, 5), None, (2, 2, 3, 3), (5, 0, 5, 5), None]


def test_wkt_round_trip(spark):
    text = "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.5, 0.0 0.0))"
    got = one(spark, G.polygon_wkt(wkt(text)), G.point_of_wkt(F.lit("POINT (7.5 -1e-3)")), G.point_of_wkt(F.lit("LINESTRING (0 0, 1 1)")), G.line_wkt(G.line_of_wkt(F.lit("LINESTRING (0 0, 1 1)"))))
    assert got[0] == text and tuple(got[1]) == (7.5, -0.001) and got[2] is None and got[3] == "LINESTRING (0.0 0.0, 1.0 1.0)"


# n, d, score
TRUTH = [(100, 200, 0.5), (100, 100, 1), (100, 80, 1), (0, 0, 1), (100, 0, 1), (0, 50, 0), (100, INF, 0), (INF, INF, 0), (INF, 100, 1), (100, None, 0), (INF, None, 0), (0, INF, 0)]


def test_score_truth_table(spark):
    df = spark.createDataFrame([(None if n is None else float(n), None if d is None else float(d), float(s)) for n, d, s in TRUTH], "n double, d double, s double")
    assert [r.got for r in df.select(S.robustness(F.col("n"), F.col("d")).alias("got")).collect()] == [float(s) for *_, s in TRUTH]


def test_score_looks(spark):
    s = [0.0, 0.25, 0.3, 0.75, 0.99, 1.0]
    got = one(spark, *[S.bucket(F.lit(v)) for v in s], S.color(F.lit(0.1)), S.color(F.lit(1.0)), S.heat_weight(F.lit(0.25)))
    assert tuple(got) == (1, 2, 3, 4, 4, 5, "rgb(255.0,51.0,0)", "rgb(0.0,255.0,0)", 0.75)


def square(x, y, w, h=None):
    h = h or w
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def ring_area(rings):
    return sum(O.area(np.array([(p.x, p.y) for p in r])) for r in rings)


L_SHAPE = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0), (0.0, 0.0)]


def test_clip_polygons(spark):
    """Holes and parts are kept, masks may be bent: areas as by hand."""
    shapes = [("hole", [square(0.0, 0.0, 8.0), square(1.0, 1.0, 2.0)]), ("parts", [square(0.5, 0.5, 1.0), square(4.0, 0.5, 1.0), square(20.0, 20.0, 1.0)]), ("far", [square(50.0, 50.0, 1.0)]), ("bent", [L_SHAPE[::-1]]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(shapes, f"k string, polygon {G.POLYGON}")
    got = {r.k: r for r in C.clip_polygons(df, [(0, 0), (0, 4), (4, 4), (4, 0)], parts="parts").collect()}
    assert set(got) == {"hole", "parts", "bent"}
    assert {k: ring_area(r.polygon) for k, r in got.items()} == {"hole": 12.0, "parts": 1.0, "bent": 12.0}
    assert len(got["hole"].parts) == 1 and len(got["hole"].parts[0]) == 2
    bent = {r.k: r for r in C.clip_polygons(df, L_SHAPE, parts="parts").collect()}
    assert {k: ring_area(r.polygon) for k, r in bent.items()} == {"hole": 17.0, "parts": 2.0, "bent": 20.0}
    assert len(bent["parts"].parts) == 2 and len(bent["hole"].polygon) == 1
    holed = {r.k: ring_area(r.polygon) for r in C.clip_polygons(df, [square(0, 0, 10), square(1, 1, 4)]).collect()}
    assert holed == {"hole": 48.0, "parts": 0.75 + 0.5, "bent": 20.0 - 4 - 3}


def test_dissolve(spark):
    shapes = [("a", [square(0, 0, 4)]), ("a", [square(4, 0, 4)]), ("a", [square(2, 2, 4)]), ("b", [square(0, 0, 9), square(3, 3, 3)]), ("b", [square(3, 3, 3)]), ("b", None)]
    df = spark.createDataFrame([(k, [[tuple(map(float, p)) for p in r] for r in v] if v else None) for k, v in shapes], f"k string, polygon {G.POLYGON}")
    got = {r.k: r.polygon for r in C.dissolve(df, ["k"], size=3.0).collect()}
    assert {k: ring_area(v) for k, v in got.items()} == {"a": 40.0, "b": 81.0} and [len(v) for v in got.values()] == [1, 1]
    whole = C.dissolve(df).collect()
    assert len(whole) == 1 and ring_area(whole[0].polygon) == 81.0 and C.dissolve(df.limit(0), size=1.0).count() == 0


def test_overlay_by_places():
    """What rings hold against counts of places in star-shaped polygons."""
    rng = np.random.default_rng(1)
    for turn in range(30):
        stars = []
        while len(stars) < 2 + turn % 3:
            angles = np.sort(rng.random(8) * 2 * math.pi)
            if np.diff(np.concatenate((angles, angles[:1] + 2 * math.pi))).max() < 2.5:
                stars.append([rng.integers(0, 8, 2) + rng.integers(2, 6, 8)[:, None] * np.stack([np.cos(angles), np.sin(angles)], axis=1)])
        places = rng.random((2000, 2)) * 20 - 5
        held = sum(O.holds(O.closed(p[0]), places).astype(int) for p in stars)
        for least in range(1, len(stars) + 1):
            rings = O.overlay(stars, least)
            inside = sum((O.holds(r, places).astype(int) for r in rings), np.zeros(len(places), int)) % 2
            assert (inside == (held >= least)).mean() > 0.999


def test_buffers():
    corner = 32 * math.sin(2 * math.pi / 64)
    bent = O.widened([np.array(L_SHAPE)], 0.5)
    assert len(bent) == 1 and O.area(bent[0]) == pytest.approx(20 + 24 * 0.5 + 1.25 * corner * 0.25 - 0.25)
    frame = O.widened([np.array(square(0, 0, 10)), np.array(square(4, 4, 2))], 0.5)
    assert len(frame) == 2 and sum(map(O.area, frame)) == pytest.approx(121 - (1 - corner / 4) - 1)
    assert len(O.widened([np.array(square(0, 0, 10)), np.array(square(4, 4, 2))], 2.0)) == 1
    line = O.widened([np.array([(0.0, 0.0), (10.0, 0.0)])], 1.0, filled=False)
    assert sum(map(O.area, line)) == pytest.approx(20 + corner)


def test_to_crs(spark):
    df = spark.createDataFrame([(1, (6.65, 49.75)), (2, None)], f"k int, p {G.POINT}")
    for epsg, east in ((32632, 330_648), (25832, 330_648), (3857, 740_274.6)):
        there = C.to_crs(df, "p", 4326, epsg)
        assert there.where("k = 1").first().p.x == pytest.approx(east, rel=1e-3)
        back = {r.k: r.p for r in C.to_crs(there, "p", epsg, 4326).collect()}
        assert tuple(back[1]) == pytest.approx((6.65, 49.75), abs=1e-8) and back[2] is None
    rings = spark.createDataFrame([([[(500_000.0, 0.0), (500_100.0, 0.0), (500_000.0, 100.0), (500_000.0, 0.0)], []],)], f"polygon {G.POLYGON}")
    got = C.layers_to_degrees({"a": rings}, {"a": 32632})["a"].first().polygon
    assert len(got) == 2 and tuple(got[0][0]) == pytest.approx((9.0, 0.0), abs=1e-9) and got[1] == []
    with pytest.raises(ValueError):
        C.to_crs(df, "p", 4326, 2154)


def test_to_crs_by_a_zone_and_beyond_the_poles(spark):
    """By way of a zone web maps' metres are the same but for rounding; beyond a pole a zone has no place."""
    places = [(k, (6 + k / 100, float(lat))) for k, lat in enumerate((-79.5, -45, 0, 49.75, 79.5))]
    df = spark.createDataFrame(places, f"k int, p {G.POINT}")
    straight = {r.k: r.p for r in C.to_crs(df, "p", 4326, 3857).collect()}
    for k, p in C.to_crs(C.to_crs(df, "p", 4326, 32632), "p", 32632, 3857).collect():
        assert tuple(p) == pytest.approx(tuple(straight[k]), abs=1e-6)
    beyond = spark.createDataFrame([(1, (6.65, 90.5)), (2, (6.65, -100.0)), (3, (6.65, 89.5))], f"k int, p {G.POINT}")
    zone = {r.k: r.p for r in C.to_crs(beyond, "p", 4326, 32632).collect()}
    assert all(math.isnan(v) for k in (1, 2) for v in zone[k]) and all(map(math.isfinite, zone[3]))


def test_utm_and_buffer(spark):
    east, north = C.to_utm(np.array([6.65]), np.array([49.75]), 32)
    lon, lat = C.from_utm(east, north, 32)
    assert (lon[0], lat[0]) == pytest.approx((6.65, 49.75), abs=1e-9)
    assert C.to_utm(np.array([9.0]), np.array([0.0]), 32)[0][0] == pytest.approx(500_000)
    df = spark.createDataFrame([(1, [(6.65, 49.75)])], f"k int, ring {G.LINE}")
    ring = C.buffer_metres(df, 100.0, "ring").first().ring[0]
    far = [G.haversine_m(6.65, 49.75, p.x, p.y) for p in ring]
    assert len(ring) == 65 and min(far) > 99 and max(far) < 101
    south = spark.createDataFrame([(1, [(20.0, -30.0), (20.01, -30.0), (20.01, -30.01), (20.0, -30.0)])], f"k int, ring {G.LINE}")
    assert min(p.y for p in C.buffer_metres(south, 50.0, "ring").first().ring[0]) == pytest.approx(-30.01 - 50 / 110850, abs=2e-5)
    assert math.isfinite(far[0])


def test_project_points(spark):
    df = spark.createDataFrame([(6.65, 49.75), (9.0, 0.0), (20.0, -30.0)], "x double, y double")
    got = C.project_points(df).orderBy("x").collect()
    assert [r.epsg for r in got] == [32632, 32632, 32734]
    for r in got:
        east, north = C.to_utm(np.array([r.x]), np.array([r.y]), r.epsg % 100, r.epsg > 32700)
        assert (r.east, r.north) == pytest.approx((east[0], north[0]))
