"""Spatial joins as equi-joins on grid cells.

A theta join on geometry would compare all rows with all. Here each right polygon is listed under the grid cells that
its bounding box meets, each left point under its cell (a line under the cells of its box), the lists are joined on
the cell, and the predicate refines what met. A pair of boxes that meets in several cells is reported from the first
common one only, so no pass to remove duplicates is needed. Cells with many rows are split by Spark's skew join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as G, overlay as O
from .stored import kept


def cell_size(polygons: DataFrame, polygon_col: str = "polygon") -> float:
    """A cell about as large as the median polygon, and no finer than a 256th of the whole extent."""
    b = G.bounds(F.flatten(polygon_col))
    side = F.greatest(b.xmax - b.xmin, b.ymax - b.ymin)
    found = polygons.select(b.alias("b"), side.alias("side")).agg(F.percentile_approx("side", 0.5), F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
    if found[0] is None:
        return 1.0
    return float(max(found[0], (found[3] - found[1]) / 256, (found[4] - found[2]) / 256, 1e-9))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def _celled(df: DataFrame, box: Column, size: float) -> DataFrame:
    """df once for each cell of its box, with columns _cx, _cy and the box's first cell _x0, _y0."""
    low = lambda c: _cell(box[c], size)
    out = df.withColumns({"_x0": low("xmin"), "_y0": low("ymin"), "_x1": low("xmax"), "_y1": low("ymax")})
    out = out.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
    return out.drop("_x1", "_y1")


PREDICATES: dict[str, dict[str, Callable[..., Column]]] = {
    "point": {"intersects": G.point_intersects, "within": G.point_within},
    "line": {"intersects": G.line_intersects, "within": G.line_within},
}


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    predicate: str = "intersects",
    x: str = "x",
    y: str = "y",
    line: str | None = None,
    polygon: str = "polygon",
    key: list[str] | None = None,
    flag: str = "flooded",
    size: float | None = None,
) -> DataFrame:
    """Join left points (columns x, y) or lines (column line) to right polygons.

    how: inner and left (a row for each match; left keeps rows without), semi, anti, and flag (all left rows with a
    boolean that is never null). `key` names left columns that identify a row; lines need it for all but inner.
    Rows of empty or null geometry match nothing. Column names of both sides should differ.
    """
    if how not in ("inner", "left", "semi", "anti", "flag"):
        raise ValueError(f"unknown join {how}")
    size = size or cell_size(right, polygon)
    kind = "line" if line else "point"
    test = PREDICATES[kind][predicate]
    right = right.withColumn("_segs", G.polygon_segments(F.col(polygon))).withColumn("_box", G.bounds(F.flatten(polygon)))
    right = _celled(right, F.col("_box"), size)
    if not line:
        # a ray to the right from a point in the cell meets no other segments; of a large polygon each cell has few
        top, bottom, side = (F.col("_cy") + 2) * size, (F.col("_cy") - 1) * size, (F.col("_cx") - 1) * size
        right = right.withColumn("_segs", F.filter("_segs", lambda s: (F.greatest(s.y1, s.y2) >= bottom) & (F.least(s.y1, s.y2) <= top) & (F.greatest(s.x1, s.x2) >= side)))
    names = {"_cx": "_rcx", "_cy": "_rcy", "_x0": "_rx0", "_y0": "_ry0", "_box": "_rbox"}
    right = right.withColumnsRenamed(names)
    if kind == "point":
        px, py = F.col(x), F.col(y)
        celled = left.withColumns({"_cx": _cell(px, size), "_cy": _cell(py, size)})
        near = px.between(F.col("_rbox.xmin"), F.col("_rbox.xmax")) & py.between(F.col("_rbox.ymin"), F.col("_rbox.ymax"))
        on = (F.col("_cx") == F.col("_rcx")) & (F.col("_cy") == F.col("_rcy")) & near & test(px, py, F.col("_segs"))
        spark_how = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}.get(how)
        helpers = ["_cx", "_cy", "_segs", "_rbox", "_rcx", "_rcy", "_rx0", "_ry0"]
        if spark_how:
            return celled.join(right, on, spark_how).drop(*helpers)
        if key:
            hit = celled.join(right, on, "left_semi").select(*key).distinct().withColumn(flag, F.lit(True))
            return left.join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        hit = celled.join(right, on, "left_semi").select(*left.columns).withColumn(flag, F.lit(True))
        return hit.unionByName(celled.join(right, on, "left_anti").select(*left.columns).withColumn(flag, F.lit(False)))
    celled = left.withColumn("_box", G.bounds(F.col(line)))
    celled = _celled(celled.where(F.size(line) > 0), F.col("_box"), size)
    first = (F.col("_cx") == F.greatest("_x0", "_rx0")) & (F.col("_cy") == F.greatest("_y0", "_ry0"))
    boxes = (F.col("_box.xmin") <= F.col("_rbox.xmax")) & (F.col("_rbox.xmin") <= F.col("_box.xmax")) & (F.col("_box.ymin") <= F.col("_rbox.ymax")) & (F.col("_rbox.ymin") <= F.col("_box.ymax"))
    on = (F.col("_cx") == F.col("_rcx")) & (F.col("_cy") == F.col("_rcy")) & first & boxes & test(F.col(line), F.col("_segs"))
    helpers = ["_cx", "_cy", "_x0", "_y0", "_box", "_segs", "_rbox", "_rcx", "_rcy", "_rx0", "_ry0"]
    inner = celled.join(right, on).drop(*helpers)
    if how == "inner":
        return inner
    if not key:
        raise ValueError("lines need a key for this join")
    if how == "left":
        added = [c for c in inner.columns if c not in left.columns]
        return left.join(inner.select(*key, *added), key, "left")
    hit = inner.select(*key).distinct()
    if how == "flag":
        return left.join(hit.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return left.join(hit, key, f"left_{how}")


def in_union(points: DataFrame, polygons: DataFrame, key: list[str], x: str = "x", y: str = "y", polygon: str = "polygon") -> DataFrame:
    """Points in the interior of the polygons' union, key naming a row: those within a polygon, and those on borders
    where the polygons that touch there leave no gap around the point."""
    shapes = polygons.select(polygon)
    within = spatial_join(points, shapes, "semi", "within", x, y, polygon=polygon)
    on_border = spatial_join(points.join(within.select(*key), key, "left_anti"), shapes, "inner", "intersects", x, y, polygon=polygon)

    kind = StructType([points.schema[k] for k in key])

    def closed_around(t: pa.Table) -> pa.Table:
        whole = surrounded((float(t[x][0].as_py()), float(t[y][0].as_py())), [[[(p["x"], p["y"]) for p in r] for r in v] for v in t[polygon].to_pylist()])
        return t.select(key).slice(0, int(whole)).cast(to_arrow_schema(kind))

    # by Arrow: a frame of pandas cannot hold rings of different lengths
    found = on_border.select(*key, x, y, polygon).groupBy(*key).applyInArrow(closed_around, kind)
    return points.join(within.select(*key).unionByName(found), key, "left_semi")


def surrounded(point: tuple[float, float], polygons: list[list[list[tuple]]], least: float = 1e-9) -> bool:
    """Whether polygons that have the point on their borders cover all directions around it."""
    px, py = point
    arcs = []
    for rings in polygons:
        for r in O.turned([np.array(r, float) for r in rings]):
            r = r[:-1]
            ways = [(r[k], r[(k + 1) % len(r)]) for k in range(len(r))]
            for k, (a, b) in enumerate(ways):
                angle = lambda q: math.atan2(q[1] - py, q[0] - px)
                if (b[0], b[1]) == point:  # the interior lies to the left of both: from the way on to the way back
                    arcs.append((angle(ways[(k + 1) % len(ways)][1]), angle(a)))
                elif (a[0], a[1]) != point and (b[0] - a[0]) * (py - a[1]) == (b[1] - a[1]) * (px - a[0]) and min(a[0], b[0]) <= px <= max(a[0], b[0]) and min(a[1], b[1]) <= py <= max(a[1], b[1]):
                    arcs.append((angle(b), angle(a)))
    spans = []
    for start, end in arcs:
        start %= 2 * math.pi
        end = start + ((end - start) % (2 * math.pi) or 2 * math.pi)
        spans += [(start, end), (start - 2 * math.pi, end - 2 * math.pi)]
    reach = 0.0
    for start, end in sorted(spans):
        if start > reach + least:
            break
        reach = max(reach, end)
    return reach >= 2 * math.pi - least


def nearest(points: DataFrame, nodes: DataFrame, key: str, x: str = "px", y: str = "py", node: str = "osmid", node_x: str = "x", node_y: str = "y", metric: str = "planar", size: float | None = None) -> DataFrame:
    """The nearest node of each point: points' columns, node id and `distance` (squared for planar, metres for
    haversine). Ties go to the smallest id.

    Candidates come from the 3 x 3 cells about a point. A find counts if it is nearer than anything outside these can
    be; what is left goes on with cells twice as large, until the cells reach over the whole extent. What is left after
    a round is kept by a checkpoint. Points without a place are nobody's neighbours and have no row.
    """
    extent = nodes.agg(F.min(node_x), F.max(node_x), F.min(node_y), F.max(node_y), F.count("*")).first()
    kind = "double" if metric == "haversine" else nodes.select((F.col(node_x) * F.col(node_x)).alias("d")).schema["d"].dataType.simpleString()
    if not extent[4]:
        return points.withColumns({node: F.lit(None).cast(nodes.schema[node].dataType), "distance": F.lit(None).cast(kind)})
    side = max(float(extent[1] - extent[0]), float(extent[3] - extent[2]), 1e-9)
    at = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    reach = max(side, *(abs(float(a) - float(b)) for a in at[:2] for b in extent[:2] if a is not None), *(abs(float(a) - float(b)) for a in at[2:] for b in extent[2:4] if a is not None), 1e-9)
    size = size or 2 * side / max(1.0, extent[4] ** 0.5)
    slim = nodes.select(F.col(node), F.col(node_x).alias("_nx"), F.col(node_y).alias("_ny"))
    left, found = points, None
    while True:
        last = size > reach
        cells = slim.withColumns({"_cx": _cell(F.col("_nx"), size), "_cy": _cell(F.col("_ny"), size)})
        around = left.withColumn("_cx", F.explode(F.array(*[_cell(F.col(x), size) + d for d in (-1, 0, 1)]))).withColumn("_cy", F.explode(F.array(*[_cell(F.col(y), size) + d for d in (-1, 0, 1)])))
        if metric == "haversine":
            distance = G.haversine(F.col(x), F.col(y), F.col("_nx"), F.col("_ny"))
            # one cell's width in metres at the point's latitude and a cell beyond
            bound = F.least(F.lit(1.0), F.cos(F.radians(F.least(F.abs(F.col(y)) + size, F.lit(89.9))))) * (size * 1000 * G.EARTH_KM * 0.0174532925)
        else:
            distance = (F.col("_nx") - F.col(x)) * (F.col("_nx") - F.col(x)) + (F.col("_ny") - F.col(y)) * (F.col("_ny") - F.col(y))
            bound = F.lit(float(size) * float(size))
        best = around.join(cells, ["_cx", "_cy"]).groupBy(key).agg(F.min(F.struct(distance.alias("distance"), F.col(node))).alias("_best"), F.max(bound).alias("_bound"))
        if not last:
            best = best.where(F.col("_best.distance") <= F.col("_bound"))
        best = best.select(key, F.col(f"_best.{node}").alias(node), F.col("_best.distance").alias("distance"))
        here = left.join(best, key)
        found = here if found is None else found.unionByName(here)
        if last:
            return found
        left = kept(left.join(best, key, "left_anti"))
        size *= 2
        if size <= reach and left.isEmpty():
            return found
