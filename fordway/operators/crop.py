"""Crops: by box with whole ways, by box with cut lines, by any polygon; unions; buffers in metres; projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions import geometry as G, overlay as O


def points_in_box(df: DataFrame, xmin, ymin, xmax, ymax, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def complete_ways(edges: DataFrame, nodes: DataFrame, xmin, ymin, xmax, ymax) -> DataFrame:
    """Edges with an end in the box, whole."""
    inside = points_in_box(nodes, xmin, ymin, xmax, ymax)
    ends = inside.select("osmid")
    keys = ["u", "v", "key"]
    hit = edges.join(ends, edges["u"] == ends["osmid"], "left_semi").select(*keys).union(edges.join(ends, edges["v"] == ends["osmid"], "left_semi").select(*keys)).distinct()
    return edges.join(hit, keys, "left_semi")


def clip_lines(df: DataFrame, xmin, ymin, xmax, ymax, line: str = "line") -> DataFrame:
    """Lines cut at a box: `parts`, the pieces of their segments inside; lines without any go."""
    parts = F.filter(F.transform(G.segments(F.col(line)), lambda s: G.clip_segment(s.x1, s.y1, s.x2, s.y2, F.lit(xmin), F.lit(ymin), F.lit(xmax), F.lit(ymax))), lambda p: p.isNotNull())
    return df.withColumn("parts", parts).where(F.size("parts") > 0)


def _rings(polygon) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in polygon if r is not None and len(r)]


def _rows(rings: list[np.ndarray]) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings]


def as_double(polygon: str):
    return F.transform(polygon, lambda r: F.transform(r, lambda p: G.point(p.x.cast("double"), p.y.cast("double"))))


def _map_column(df: DataFrame, column: str, made: list[StructField], f: Callable[[list], list[tuple | None]]) -> DataFrame:
    """df with `column` and further ones as f makes them of a batch's values (a tuple each); rows with None go.

    By Arrow: a frame of pandas cannot hold rings of different lengths."""
    new = {m.name: m for m in made}
    kind = StructType([new.get(x.name, x) for x in df.schema] + [m for m in made if m.name not in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        for b in batches:
            got = f(b.column(column).to_pylist())
            stay = pa.array([k for k, g in enumerate(got) if g is not None], pa.int64())
            values = dict(zip(new, zip(*[g for g in got if g is not None], strict=True), strict=True)) if len(stay) else {n: [] for n in new}
            columns = [pa.array(values[x.name], x.type) if x.name in new else b.column(x.name).take(stay).cast(x.type) for x in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, kind)


def _kind(name: str, ddl: str) -> StructField:
    return StructField(name, _parse_datatype_string(ddl))


def clip_polygons(df: DataFrame, mask: list, polygon: str = "polygon", parts: str | None = None) -> DataFrame:
    """Polygons (arrays of rings, parts and holes among them) cut at a polygon of any shape: `mask` is its corners, or a
    list of its rings. Rows with nothing in it go. `parts` names a column for the polygons one by one, each a shell
    with its holes."""
    rings = [np.array(mask, float)] if np.ndim(mask[0][0]) == 0 else [np.array(r, float) for r in mask]
    rings = O.turned(rings)
    low, high = np.min([r.min(axis=0) for r in rings], axis=0), np.max([r.max(axis=0) for r in rings], axis=0)

    def one(value) -> list[np.ndarray]:
        own = _rings(value) if value is not None else []
        own = [r for r in own if len(r) > 2]
        if not own or (np.min([r.min(axis=0) for r in own], axis=0) > high).any() or (np.max([r.max(axis=0) for r in own], axis=0) < low).any():
            return []
        return O.overlay([own, rings], 2)

    def cut(values: list) -> list[tuple | None]:
        found = [one(v) for v in values]
        return [(_rows(r), [_rows(p) for p in O.nested(r)])[: 1 + bool(parts)] if r else None for r in found]

    return _map_column(df.withColumn(polygon, as_double(polygon)), polygon, [_kind(polygon, G.POLYGON), *([_kind(parts, f"array<{G.POLYGON}>")] if parts else [])], cut)


def dissolve(df: DataFrame, by: list[str] | None = None, polygon: str = "polygon", size: float | None = None) -> DataFrame:
    """by, polygon: the union of the polygons of each group (of all without one), as one array of rings.

    Polygons are united by cells first, in as many tasks, so that only the borders of what a cell holds go on to the
    task that makes the group's one geometry.
    """
    from .spatial_join import cell_size

    by = by or []
    own = df.where(F.size(polygon) > 0).select(*by, as_double(polygon).alias("polygon"))
    size = size or 16 * cell_size(own)
    b = G.bounds(F.flatten("polygon"))
    celled = own.withColumns({"_cx": F.floor(b.xmin / size), "_cy": F.floor(b.ymin / size)})
    kind = StructType([*(own.schema[c] for c in by), StructField("polygon", own.schema["polygon"].dataType)])

    def united(t: pa.Table) -> pa.Table:
        schema = to_arrow_schema(kind)
        rings = O.overlay([_rings(v) for v in t["polygon"].to_pylist()])
        return pa.Table.from_arrays([*(t[c].slice(0, 1).cast(schema.field(c).type) for c in by), pa.array([_rows(rings)], schema.field("polygon").type)], schema=schema)

    by_cell = celled.groupBy(*by, "_cx", "_cy").applyInArrow(united, kind)
    return by_cell.withColumn("_all", F.lit(0)).groupBy("_all", *by).applyInArrow(united, kind)


# The WGS 84 ellipsoid and the scale of transverse Mercator zones.
A_METRES, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A_METRES / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
# Krüger's series to the fourth order, by powers of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def to_utm(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in metres."""
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for k, a in enumerate(_ALPHA, 1):
        y = y + a * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        x = x + a * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    return EAST + SCALE * _RADIUS * x, SCALE * _RADIUS * y + (SOUTH if south else 0)


def from_utm(east: np.ndarray, north: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees."""
    xi, eta = (north - (SOUTH if south else 0)) / (SCALE * _RADIUS), (east - EAST) / (SCALE * _RADIUS)
    x, y = eta.copy(), xi.copy()
    for k, b in enumerate(_BETA, 1):
        y = y - b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        x = x - b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    t = np.sin(y) / np.sqrt(np.sinh(x) ** 2 + np.cos(y) ** 2)
    t0 = t.copy()
    for _ in range(5):  # Newton steps from the conformal to the geodetic latitude
        root = np.sqrt(1 + t * t)
        sigma = np.sinh(_E * np.arctanh(_E * t / root))
        back = t * np.sqrt(1 + sigma * sigma) - sigma * root
        t = t + (t0 - back) / np.sqrt(1 + back * back) * (1 + (1 - _E * _E) * t * t) / ((1 - _E * _E) * root)
    return np.degrees(np.arctan2(np.sinh(x), np.cos(y))) + 6 * zone - 183, np.degrees(np.arctan(t))


def project_points(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """df with `east`, `north` (metres) and `epsg` of its points' UTM zones, from longitude and latitude."""

    @pandas_udf("struct<east: double, north: double>")
    def flat(lon: pd.Series, lat: pd.Series, epsg: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"east": np.nan, "north": np.nan}, index=lon.index)
        for code, at in epsg.groupby(epsg).groups.items():
            east, north = to_utm(lon[at].to_numpy(float), lat[at].to_numpy(float), int(code) % 100, int(code) // 100 == 327)
            out.loc[at, "east"], out.loc[at, "north"] = east, north
        return out

    zoned = df.withColumn("epsg", G.utm_epsg(F.col(x), F.col(y)))
    return zoned.withColumn("_p", flat(F.col(x), F.col(y), F.col("epsg"))).withColumns({"east": F.col("_p.east"), "north": F.col("_p.north")}).drop("_p")


def buffer_metres(df: DataFrame, metres: float, column: str = "polygon") -> DataFrame:
    """Shapes in degrees widened by metres, in the UTM zone of their middle: `column` (a polygon as an array of rings,
    a line or a ring as an array of places, or a place) becomes the polygon of all places within that distance.
    Circles have 64 corners. Holes and inner bends are kept or closed as the distance has it."""
    kind = df.schema[column].dataType.simpleString()
    shape = "polygon" if kind.startswith("array<array") else "line" if kind.startswith("array") else "point"

    def one(value) -> list | None:
        if value is None or not len(value):
            return None
        rings = _rings(value if shape == "polygon" else [value] if shape == "line" else [[value]])
        lon, lat = np.concatenate(rings).mean(axis=0) if rings else (0.0, 0.0)
        zone, south = min(60, int((lon + 180) // 6) + 1), bool(lat < 0)
        flat = [np.stack(to_utm(r[:, 0], r[:, 1], zone, south), axis=1) for r in rings]
        wide = O.widened(flat, metres, filled=shape == "polygon")
        return _rows([np.stack(from_utm(r[:, 0], r[:, 1], zone, south), axis=1) for r in wide])

    return _map_column(df, column, [_kind(column, G.POLYGON)], lambda values: [(one(v),) for v in values])


#: Codes of projections: longitude and latitude, web maps, and the UTM zones of WGS 84 and of Europe's system, which
#: differs by less than a metre.
DEGREES, WEB = (4326, 4258), 3857


def _zone(epsg: int) -> tuple[int, bool] | None:
    for first, last, south in ((32601, 32660, False), (32701, 32760, True), (25828, 25838, False)):
        if first <= epsg <= last:
            return epsg % 100, south
    return None


def project(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from one system to another, by longitude and latitude.

    Latitudes beyond a pole are no places: in a zone both numbers are NaN, and on web maps the northing is what its
    formula gives, which is NaN up to 180 degrees beyond."""
    for epsg in (source, target):
        if epsg not in (*DEGREES, WEB) and _zone(epsg) is None:
            raise ValueError(f"no projection for EPSG:{epsg}")
    if source == WEB:
        x, y = np.degrees(x / A_METRES), np.degrees(2 * np.arctan(np.exp(y / A_METRES)) - math.pi / 2)
    elif source not in DEGREES:
        x, y = from_utm(x, y, *_zone(source))
    if target in DEGREES:
        return x, y
    if target == WEB:
        with np.errstate(divide="ignore", invalid="ignore"):
            return A_METRES * np.radians(x), A_METRES * np.log(np.tan(math.pi / 4 + np.radians(y) / 2))
    real = np.abs(y) <= 90
    return to_utm(np.where(real, x, np.nan), np.where(real, y, np.nan), *_zone(target))


def to_crs(df: DataFrame, column: str, source: int, target: int) -> DataFrame:
    """A geometry column (a place, a line, a polygon or several of them) in another system, by EPSG codes."""
    if source == target or (source in DEGREES and target in DEGREES):
        return df
    project(np.zeros(0), np.zeros(0), source, target)  # unknown codes are refused here
    kind = df.schema[column].dataType
    depth = kind.simpleString().count("array<")
    def places(value, level: int) -> list:
        if value is None:
            return []
        return [value] if level == 0 else [p for v in value for p in places(v, level - 1)]

    def rebuilt(value, level: int, found: Iterator):
        if value is None:
            return None
        return next(found) if level == 0 else [rebuilt(v, level - 1, found) for v in value]

    def moved(values: list) -> list[tuple]:
        every = [p for v in values for p in places(v, depth)]
        x, y = project(np.array([p["x"] for p in every], float), np.array([p["y"] for p in every], float), source, target)
        found = iter([{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)])
        return [(rebuilt(v, depth, found),) for v in values]

    return _map_column(df, column, [_kind(column, "array<" * depth + G.POINT + ">" * depth)], moved)


def layers_to_degrees(layers: dict[str, DataFrame], epsg: dict[str, int], column: str = "polygon") -> dict[str, DataFrame]:
    """Layers by name, each from its own system to longitude and latitude."""
    return {n: to_crs(df, column, epsg[n], 4326) for n, df in layers.items()}
