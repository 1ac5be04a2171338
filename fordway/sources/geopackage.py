"""GeoPackage files: SQLite databases whose layers are tables with a geometry column of well-known binary."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import geometry as G


def _open(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def layer_names(spark: SparkSession, path: str) -> list[str]:
    """The feature layers of a file: a handful of names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with _open(content) as db:
                    yield pd.DataFrame({"name": [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features'")]}, dtype=str)

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string")
    return sorted(r.name for r in found.distinct().collect())


# bytes of the envelope by its kind in the header
_ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def parse(blob: bytes) -> tuple[str, list]:
    """Kind and parts of a geometry: a point is one part of one place; each line or ring is a part."""
    if blob[:2] == b"GP":
        blob = blob[8 + _ENVELOPES[blob[3] >> 1 & 7] :]
    kind, parts, _ = _wkb(blob, 0)
    return kind, parts


def _wkb(data: bytes, at: int) -> tuple[str, list, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    kind = ("", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")[code % 1000 & 7]
    size = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)

    def number(at: int) -> tuple[int, int]:
        return struct.unpack_from(f"{order}I", data, at)[0], at + 4

    def places(n: int, at: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{n * size}d", data, at)
        return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, n * size, size)], at + 8 * n * size

    parts: list = []
    if kind == "Point":
        place, at = places(1, at)
        return kind, [place], at
    if kind == "LineString":
        n, at = number(at)
        line, at = places(n, at)
        return kind, [line], at
    n, at = number(at)
    for _ in range(n):
        if kind == "Polygon":
            m, at = number(at)
            ring, at = places(m, at)
            parts.append(ring)
        else:
            _, inner, at = _wkb(data, at)
            parts += inner
    return kind, parts, at


def layer(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    """A layer's named columns (a DDL schema), `kind`, and `parts` (array of arrays of places): a polygon's rings, a
    line's or a point's places. A task reads a whole file, as SQLite needs."""
    kind = StructType([*_parse_datatype_string(columns).fields, *_parse_datatype_string(f"kind string, parts {G.POLYGON}").fields])
    names = [f.name for f in kind.fields[:-2]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with _open(content) as db:
                    quoted = lambda n: '"' + n.replace('"', '""') + '"'
                    column = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()
                    if column is None:
                        raise ValueError(f"no feature layer {name}")
                    cursor = db.execute(f"select {', '.join(map(quoted, [*names, column[0]]))} from {quoted(name)}")
                    while rows := cursor.fetchmany(1000):
                        shapes = [parse(r[-1]) if r[-1] is not None else (None, None) for r in rows]
                        yield pd.DataFrame([(*r[:-1], *s) for r, s in zip(rows, shapes, strict=True)], columns=[*names, "kind", "parts"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)


def all_layers(spark: SparkSession, path: str, columns: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Layers by name; all feature layers of the file without a list."""
    return {n: layer(spark, path, n, columns) for n in names or layer_names(spark, path)}


def polygons(layer_: DataFrame) -> DataFrame:
    """The polygon rows of a layer, `parts` as `polygon`."""
    return layer_.where(F.col("kind").isin("Polygon", "MultiPolygon")).withColumnRenamed("parts", "polygon")
