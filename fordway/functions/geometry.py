"""Geometry as plain columns.

A point is two numbers or struct<x,y>; a line is array<struct<x,y>>; a ring is a closed line; a polygon is array<ring>
with the shell first; several polygons are several rows, or one array of all their rings where they do not overlap.
All predicates avoid division, so they are exact on integers, and stay inside the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

POINT = "struct<x: double, y: double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"

EARTH_KM = 6373.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_of(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in corners])


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A polygon of one ring."""
    return F.array(ring_of((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)))


def segments(line: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of a line's neighbouring points; empty for fewer than two."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))


def polygon_segments(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, segments))


def turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Over zero if p lies to the left of the way from a to b, under zero to the right, zero on the line."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _on(s: Column, px: Column, py: Column) -> Column:
    inside = px.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)) & py.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2))
    return inside & (turn(s.x1, s.y1, s.x2, s.y2, px, py) == 0)


def on_segments(px: Column, py: Column, segs: Column) -> Column:
    return F.exists(segs, lambda s: _on(s, px, py))


def inside_parity(px: Column, py: Column, segs: Column) -> Column:
    """Whether a ray from the point crosses the rings an odd number of times; undefined on the border."""

    def crosses(s: Column) -> Column:
        side = turn(s.x1, s.y1, s.x2, s.y2, px, py)
        return ((s.y1 > py) != (s.y2 > py)) & ((side > 0) == (s.y2 > s.y1))

    return F.aggregate(segs, F.lit(False), lambda odd, s: odd != crosses(s))


def point_intersects(px: Column, py: Column, segs: Column) -> Column:
    """In the polygon or on its border."""
    return on_segments(px, py, segs) | inside_parity(px, py, segs)


def point_within(px: Column, py: Column, segs: Column) -> Column:
    """In the polygon's interior."""
    return inside_parity(px, py, segs) & ~on_segments(px, py, segs)


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments share a point."""
    a1, a2 = turn(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1), turn(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)
    b1, b2 = turn(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1), turn(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
    proper = (F.signum(a1) * F.signum(a2) < 0) & (F.signum(b1) * F.signum(b2) < 0)
    return proper | _on(b, a.x1, a.y1) | _on(b, a.x2, a.y2) | _on(a, b.x1, b.y1) | _on(a, b.x2, b.y2)


def line_intersects(line: Column, segs: Column) -> Column:
    """Whether a line and a polygon share a point."""
    own = segments(line)
    first = F.element_at(line, 1)
    return F.exists(own, lambda a: F.exists(segs, lambda b: segments_meet(a, b))) | point_intersects(first.x, first.y, segs)


def line_within(line: Column, segs: Column) -> Column:
    """Whether a polygon's interior holds all of a line (that touches no border)."""
    own = segments(line)
    first = F.element_at(line, 1)
    return ~F.exists(own, lambda a: F.exists(segs, lambda b: segments_meet(a, b))) & inside_parity(first.x, first.y, segs)


def polygon_within(inner: Column, outer_segs: Column) -> Column:
    """Whether all corners of a polygon are in or on another and no borders cross properly."""
    def proper(a: Column, b: Column) -> Column:
        a1, a2 = turn(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1), turn(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)
        b1, b2 = turn(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1), turn(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
        return (F.signum(a1) * F.signum(a2) < 0) & (F.signum(b1) * F.signum(b2) < 0)

    corners = F.flatten(inner)
    return F.forall(corners, lambda p: point_intersects(p.x, p.y, outer_segs)) & ~F.exists(polygon_segments(inner), lambda a: F.exists(outer_segs, lambda b: proper(a, b)))


def bounds(points: Column) -> Column:
    """struct<xmin,ymin,xmax,ymax> of array<struct<x,y>>."""
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, s: acc + value(s).cast("double"))


def polygon_centroid(polygon: Column) -> Column:
    """Area-weighted middle; rings' directions are made to differ (shell one way, holes the other) by their area."""
    def ring_sums(r: Column, sign: Column) -> Column:
        segs = segments(r)
        cross = lambda s: s.x1 * s.y2 - s.x2 * s.y1
        area = _total(segs, cross)
        flip = F.when(area < 0, -sign).otherwise(sign)
        return F.struct((area * flip).alias("a"), (_total(segs, lambda s: (s.x1 + s.x2) * cross(s)) * flip).alias("x"), (_total(segs, lambda s: (s.y1 + s.y2) * cross(s)) * flip).alias("y"))

    sums = F.transform(polygon, lambda r, i: ring_sums(r, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))))
    area = _total(sums, lambda s: s.a)
    return F.when(area != 0, point(_total(sums, lambda s: s.x) / (3 * F.nullif(area, F.lit(0.0))), _total(sums, lambda s: s.y) / (3 * F.nullif(area, F.lit(0.0)))))


def line_centroid(line: Column) -> Column:
    """Length-weighted middle; the point itself for a line without length."""
    segs = segments(line)
    size = lambda s: F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))
    length = F.nullif(_total(segs, size), F.lit(0.0))
    middle = point(_total(segs, lambda s: (s.x1 + s.x2) / 2 * size(s)) / length, _total(segs, lambda s: (s.y1 + s.y2) / 2 * size(s)) / length)
    first = F.element_at(line, 1)
    return F.when(length.isNotNull(), middle).otherwise(point(first.x.cast("double"), first.y.cast("double")))


def line_length(line: Column) -> Column:
    return _total(segments(line), lambda s: F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius_km: float = EARTH_KM) -> Column:
    """Great-circle metres."""
    lat1, lat2 = F.radians(lat1), F.radians(lat2)
    dlat, dlon = lat2 - lat1, F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2000 * radius_km) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; longitude 180 counts to the last."""
    return F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column, xmin, ymin, xmax, ymax) -> Column:
    """The part of a segment in a rectangle as struct<x1,y1,x2,y2> (double), null if none (Liang-Barsky)."""
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    sides = [(-dx, x1 - xmin), (dx, xmax - x1), (-dy, y1 - ymin), (dy, ymax - y1)]
    ratio = lambda p, q: q.cast("double") / F.nullif(p, F.lit(0.0))
    out = reduce(lambda a, b: a | b, [(p == 0) & (q < 0) for p, q in sides])
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, ratio(p, q)) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, ratio(p, q)) for p, q in sides])
    part = F.struct((x1 + enter * dx).alias("x1"), (y1 + enter * dy).alias("y1"), (x1 + leave * dx).alias("x2"), (y1 + leave * dy).alias("y2"))
    return F.when(~out & (enter <= leave), part)


def open_ring(ring: Column) -> Column:
    """A ring without its closing point, if it has one."""
    a, b = F.element_at(ring, 1), F.element_at(ring, -1)
    near = (F.abs(a.x - b.x) <= 1e-8 + 1e-5 * F.abs(b.x)) & (F.abs(a.y - b.y) <= 1e-8 + 1e-5 * F.abs(b.y))
    return F.when(near, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def interpolate_rings(inner: Column, outer: Column, t: float = 0.5) -> Column:
    """The closed ring between two: both are resampled to the larger number of corners by index, then mixed."""
    a, b = open_ring(inner), open_ring(outer)
    n = F.greatest(F.size(a), F.size(b))
    # the step is a float and its multiples are cut: a whole-number division would pick other corners
    pick = lambda r, k: F.get(r, (k * (F.size(r).cast("double") / n.cast("double"))).cast("int"))
    mix = lambda p, q: point((1 - t) * p.x + t * q.x, (1 - t) * p.y + t * q.y)
    mixed = F.transform(F.sequence(F.lit(0), n - 1), lambda k: mix(pick(a, k), pick(b, k)))
    return F.concat(mixed, F.slice(mixed, 1, 1))


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def points_of_wkt(text: Column) -> Column:
    """All coordinate pairs of a WKT text, in order."""
    pairs = F.regexp_extract_all(text, F.lit(rf"({_NUMBER})\s+({_NUMBER})"), F.lit(0))
    return F.transform(pairs, lambda p: point(F.split(p, r"\s+")[0].cast("double"), F.split(p, r"\s+")[1].cast("double")))


def point_of_wkt(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).startswith("POINT"), F.get(points_of_wkt(text), F.lit(0)))


def line_of_wkt(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).startswith("LINESTRING"), points_of_wkt(text))


def polygon_of_wkt(text: Column) -> Column:
    """Rings of a POLYGON or of all parts of a MULTIPOLYGON."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(F.upper(F.trim(text)).rlike("^(MULTI)?POLYGON"), F.transform(rings, points_of_wkt))


def _pair(p: Column) -> Column:
    return F.concat_ws(" ", p.x.cast("double"), p.y.cast("double"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), _pair(point(x, y)), F.lit(")"))


def line_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, _pair), ", "), F.lit(")"))


def polygon_wkt(polygon: Column) -> Column:
    rings = F.transform(polygon, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, _pair), ", "), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(rings, ", "), F.lit(")"))


def grid_steps(width_m: float, height_m: float, samples: int | None = None, distance_m: float | None = None, aspect: float | None = None) -> tuple[int, int]:
    """Rows and columns of a sampling grid, by a number of samples or by a distance; one of both is to be given. By
    number cells follow the box's aspect in its own coordinates (`aspect`, wide by high; of the metres without it). A
    side shorter than a cell has 0; one of both is to have a cell."""
    if (samples is None) == (distance_m is None):
        raise RuntimeError("give either a number of samples or a distance")
    if samples is not None:
        aspect = width_m / height_m if aspect is None else aspect
        high = int(math.sqrt(samples / aspect))
        wide = int(high * aspect)
    else:
        high, wide = int(height_m / distance_m), int(width_m / distance_m)
    if high < 1 and wide < 1:
        raise ValueError("the grid has no cell: too few samples, or a distance over the area's side")
    return high, wide


def haversine_m(lon1: float, lat1: float, lon2: float, lat2: float, radius_km: float = EARTH_KM) -> float:
    """The same measure for plain numbers."""
    lat1, lat2, dlon = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(dlon / 2) ** 2
    return 2000 * radius_km * math.atan2(math.sqrt(a), math.sqrt(1 - a))
