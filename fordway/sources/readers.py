"""Readers: feature tables, graphs and layers as DataFrames with plain geometry columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..operators.crop import dissolve
from ..operators.graph import undirected

_GEOMETRY = "type string, coordinates string"


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: str | StructType, wkt: str | None = None) -> DataFrame:
    """A CSV file with a header and a schema; a WKT point column becomes x, y on request."""
    df = spark.read.csv(path, header=True, schema=schema)
    if not wkt:
        return df
    p = G.point_of_wkt(F.col(wkt))
    return df.withColumns({"x": p.x, "y": p.y})


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: the named properties (a DDL schema), `kind`, and the geometry as point, line or
    polygon, the others null. A multi-polygon's rings come in one polygon; multi-lines as a line for each part."""
    nested = f"features array<{_feature(properties)}>"
    return _shapes(spark.read.schema(nested).json(path, multiLine=True).select(F.explode("features").alias("f")))


def geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The same of files with a feature on each line, which any number of tasks read."""
    return _shapes(spark.read.text(path).select(F.from_json("value", _feature(properties)).alias("f")).where("f.type = 'Feature'"))


def _feature(properties: str) -> str:
    return f"struct<type: string, properties: struct<{_ddl(properties)}>, geometry: struct<type: string, coordinates: string>>"


def _shapes(f: DataFrame) -> DataFrame:
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pair = lambda p: G.point(p[0], p[1])
    as_line = lambda s: F.transform(F.from_json(s, "array<array<double>>"), pair)
    as_polygon = lambda s: F.transform(F.from_json(s, "array<array<array<double>>>"), lambda r: F.transform(r, pair))
    as_parts = lambda s: F.transform(F.flatten(F.from_json(s, "array<array<array<array<double>>>>")), lambda r: F.transform(r, pair))
    one = F.from_json(raw, "array<double>")
    polygon = F.when(kind == "Polygon", as_polygon(raw)).when(kind == "MultiPolygon", as_parts(raw))
    out = f.select("f.properties.*", kind.alias("kind"), F.when(kind == "Point", pair(one)).alias("point"), F.when(kind == "LineString", F.array(as_line(raw))).when(kind == "MultiLineString", as_polygon(raw)).alias("lines"), polygon.alias("polygon"))
    return out.withColumn("line", F.explode_outer("lines")).drop("lines")


def _ddl(properties: str) -> str:
    return ", ".join(f"`{n.strip('`')}`: {t}" for n, t in (p.strip().split(None, 1) for p in properties.split(",")))


def _records(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """value: what ends with each closing tag, so that many tasks read a large file and none holds it."""
    end = f"</{tag}>"
    rows = spark.read.option("lineSep", end).text(path)
    return rows.withColumn("value", F.concat("value", F.lit(end)))


def gml(spark: SparkSession, path: str | list[str], row_tag: str, columns: str, file: str | None = None) -> DataFrame:
    """Polygons of GML files: rows by tag, the named columns (a DDL schema, child elements as text), and `polygon`
    from all gml:posList elements below (x y pairs; the first is the shell). `file` names a column for the file's
    name."""
    names = [c.strip().split(None, 1)[0] for c in columns.split(",") if c.strip()]
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    rows = _records(spark, path, row_tag).select(name, F.col("value").alias("r")).where(F.col("r").rlike(rf"(?s)<{row_tag}[\s>].*</{row_tag}>$"))
    rows = rows.select("file", F.regexp_extract("r", rf"(?s)<{row_tag}[\s>].*", 0).alias("r"))
    child = lambda n: F.nullif(F.regexp_extract("r", rf"(?s)<(?:\w+:)?{n}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{n}>", 1), F.lit(""))
    lists = F.regexp_extract_all("r", F.lit(r"(?s)<(?:\w+:)?posList(?:\s[^>]*)?>(.*?)</"), F.lit(1))
    numbers = lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda v: v.cast("double"))
    pairs = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda k: G.point(F.get(v, 2 * k), F.get(v, 2 * k + 1)))
    types = dict(c.strip().split(None, 1) for c in columns.split(",") if c.strip())
    origin = [F.col("file").alias(file)] if file else []
    return rows.select(*origin, *[child(n).cast(types[n]).alias(n) for n in names], F.transform(lists, lambda s: pairs(numbers(s))).alias("polygon"))


def graph(spark: SparkSession, folder: str, name: str, undirected_graph: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a stored graph; edges both ways on request."""
    nodes, edges = (spark.read.parquet(f"{folder}/{name}_{part}") for part in ("nodes", "edges"))
    return nodes, undirected(edges) if undirected_graph else edges


def drive_graphs(spark: SparkSession, folder: str, slug: str, undirected_graph: bool = False):
    """The two stored graphs of a region: for driving, and with private ways."""
    return tuple(graph(spark, folder, f"{slug}_{kind}", undirected_graph) for kind in ("drive", "all_private"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (osmid, x, y) and edges (u, v, key, length, line, bridge) of a GraphML file; `.graphml` is added."""
    path = path if path.endswith(".graphml") else f"{path}.graphml"
    attr = lambda c, n: F.regexp_extract(c, rf"\b{n}=\"([^\"]*)\"", 1)
    # the file's own ids of its attributes, by whom they are for and their name: a handful
    keys = spark.read.option("lineSep", ">").text(path).where(F.col("value").rlike(r"<key\s")).select(attr("value", "for").alias("on"), attr("value", "attr\\.name").alias("name"), attr("value", "id").alias("id"))
    ids = {(r["on"], r["name"]): r["id"] for r in keys.collect()}

    def rows(tag: str, own: str) -> DataFrame:
        kind = f"{own}, data array<struct<_key: string, _VALUE: string>>"
        r = spark.read.format("xml").option("rowTag", tag).schema(kind).load(path)
        pairs = F.coalesce("data", F.expr("cast(array() as array<struct<_key: string, _VALUE: string>>)"))
        return r.withColumn("data", F.map_from_entries(pairs))

    value = lambda tag, n: F.try_element_at("data", F.lit(ids.get((tag, n), "")))
    nodes = rows("node", "_id long").select(F.col("_id").alias("osmid"), value("node", "x").cast("double").alias("x"), value("node", "y").cast("double").alias("y"))
    key = F.coalesce(F.expr("try_cast(_id as int)"), F.lit(0)).alias("key")
    edges = rows("edge", "_source long, _target long, _id string").select(F.col("_source").alias("u"), F.col("_target").alias("v"), key, value("edge", "length").cast("double").alias("length"), G.line_of_wkt(value("edge", "geometry")).alias("line"), value("edge", "bridge").alias("bridge"))
    return nodes, edges


def layers(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The layers of a container as tables of one folder, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def one_region(boundaries: DataFrame, name: str) -> DataFrame:
    """The single boundary of a name; an error if there is none or more than one, or no polygon."""
    found = boundaries.where(F.col("name") == name)
    rows = found.select(F.col("polygon").isNotNull().alias("ok")).take(2)
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} boundary named {name}")
    if not rows[0].ok:
        raise ValueError(f"the boundary {name} is not a polygon")
    return found


def hazard_polygons(features: DataFrame) -> DataFrame:
    """A row for each polygon of a hazard layer, as the joins take it: what meets the union meets one of them."""
    return features.where(F.col("polygon").isNotNull()).select("polygon")


def flooded_area(features: DataFrame) -> DataFrame:
    """A hazard layer as one polygon, the union of its polygons: one row, or none for an empty layer."""
    return dissolve(hazard_polygons(features))
