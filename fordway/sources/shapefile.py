"""Shapefiles: a file of shapes and beside it one of their attributes, joined by the records' order.

Each file comes as one value, so it may have up to 2 GB, as the format itself allows. Heights and measures are passed
over. Rings are told apart by their direction there; here a polygon is all rings of its record.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import geometry as G, overlay as O

# Names of the format's kinds of shapes; tens stand for those with heights and measures.
KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def shapes(content: bytes) -> Iterator[tuple[str | None, list | None]]:
    """Kind and parts of each record: a point is one part of one place; each line or ring is a part."""
    if struct.unpack_from(">i", content)[0] != 9994:
        raise ValueError("not a file of shapes")
    at = 100
    while at + 8 <= len(content):
        n = 2 * struct.unpack_from(">i", content, at + 4)[0]
        at += 8
        code = struct.unpack_from("<i", content, at)[0]
        if code and code % 10 not in KINDS:
            raise ValueError(f"shapes of kind {code}")
        kind = KINDS[code % 10] if code else None
        if kind is None:
            yield None, None
        elif kind == "Point":
            yield kind, [[dict(zip("xy", struct.unpack_from("<dd", content, at + 4), strict=True))]]
        else:
            first = at + 36
            if kind == "MultiPoint":
                (count,), starts, first = struct.unpack_from("<i", content, first), [0], first + 4
            else:
                parts, count = struct.unpack_from("<ii", content, first)
                starts = list(struct.unpack_from(f"<{parts}i", content, first + 8))
                first += 8 + 4 * parts
            places = np.frombuffer(content, "<f8", 2 * count, first).reshape(-1, 2).tolist()
            yield kind, [[{"x": x, "y": y} for x, y in places[a:b]] for a, b in zip(starts, [*starts[1:], count], strict=True)]
        at += n


def attributes(content: bytes) -> Iterator[dict[str, str | None]]:
    """The fields of each record as text, null where blank."""
    count, start, size = struct.unpack_from("<IHH", content, 4)
    fields, at, k = [], 1, 32
    while content[k] != 0x0D:
        name, width = content[k : k + 11].split(b"\0")[0].decode("latin-1"), content[k + 16]
        fields.append((name, at, at + width))
        at += width
        k += 32
    for n in range(count):
        row = content[start + n * size : start + (n + 1) * size]
        yield {name: _text(row[a:b]) for name, a, b in fields}


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode().strip(" \0") or None
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip(" \0") or None


def read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The named columns (a DDL schema), `kind`, and `parts` (array of arrays of places) of a .shp file, with the
    attributes of the .dbf file beside it."""
    wanted = _parse_datatype_string(columns)
    shape_kind = f"n long, kind string, parts {G.POLYGON}"

    def rows(found: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in found:
            held.append(r)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
                held = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)

    place = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    shape_schema = pa.schema([("n", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(place)))])
    text_schema = pa.schema([("n", pa.int64()), *((f.name, pa.string()) for f in wanted)])

    def of_shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from rows(((n, *s) for n, s in enumerate(shapes(content.as_py()))), shape_schema)

    def of_attributes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from rows(((n, *(r.get(f.name) for f in wanted)) for n, r in enumerate(attributes(content.as_py()))), text_schema)

    one = lambda p: spark.read.format("binaryFile").load(p).select("content")
    drawn = one(path).mapInArrow(of_shapes, shape_kind)
    said = one(path.removesuffix(".shp") + ".dbf").mapInArrow(of_attributes, ", ".join(["n long", *(f"`{f.name}` string" for f in wanted)]))
    return drawn.join(said, "n", "left").select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted], "kind", "parts")


def polygons(shapes_: DataFrame) -> DataFrame:
    return shapes_.where("kind = 'Polygon'").withColumnRenamed("parts", "polygon")


def write(df: DataFrame, path: str, polygon: str = "polygon", width: int = 254) -> None:
    """Polygons and the other columns, as text of up to `width` bytes, as a .shp, .shx and .dbf file. The driver writes
    them record by record; names of columns are cut to ten letters, as the format has it."""
    spark = df.sparkSession
    others = [c for c in df.columns if c != polygon]
    text = df.select(F.col(polygon).alias("p"), *[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(others)])
    records, texts, index, at = [], [], [], 50
    low, high = [float("inf")] * 2, [float("-inf")] * 2
    for n, r in enumerate(text.toLocalIterator()):
        rings = O.turned([np.array([(p.x, p.y) for p in ring], float) for ring in r.p or []])
        if rings:
            flat = np.concatenate([x[::-1] for x in rings])  # shells run clockwise there
            ends = np.cumsum([0, *(len(x) for x in rings)]).tolist()
            a, b = flat.min(axis=0), flat.max(axis=0)
            low, high = [min(x) for x in zip(low, a.tolist(), strict=True)], [max(x) for x in zip(high, b.tolist(), strict=True)]
            body = struct.pack("<i4d", 5, *a, *b) + struct.pack(f"<ii{len(rings)}i", len(rings), len(flat), *ends[:-1]) + flat.astype("<f8").tobytes()
        else:
            body = struct.pack("<i", 0)
        records.append(struct.pack(">ii", n + 1, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += len(records[-1]) // 2
        texts.append(b" " + b"".join((r[f"c{k}"] or "").encode()[:width].decode("utf-8", "ignore").encode().ljust(width) for k in range(len(others))))
    box = [*low, *high] if records and low[0] <= high[0] else [0.0] * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<ii8d", 1000, 5, *box, 0, 0, 0, 0)
    fields = b"".join(c.encode("latin-1", "replace")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for c in others)
    table = struct.pack("<4BIHH20x", 3, 95, 7, 26, len(texts), 33 + len(fields), 1 + width * len(others)) + fields + b"\r" + b"".join(texts) + b"\x1a"
    stem = path.removesuffix(".shp")
    for ending, content in ((".shp", head(at) + b"".join(records)), (".shx", head(50 + 4 * len(index)) + b"".join(index)), (".dbf", table), (".cpg", b"UTF-8")):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stem + ending)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
