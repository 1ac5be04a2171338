"""Writers. A target that exists is left alone or overwritten, as asked."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..operators.crop import clip_polygons
from . import readers, regions, shapefile


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "ignore"


def graph(nodes: DataFrame, edges: DataFrame, folder: str, name: str, overwrite: bool = False) -> None:
    for part, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode(_mode(overwrite)).parquet(f"{folder}/{name}_{part}")


def one_file(df: DataFrame, path: str, before: list[str], after: list[str], overwrite: bool = False) -> None:
    """A folder with one text file: some lines, the lines of df (order, value) in order, and some more. The rows pass
    through one task as a stream, as one file asks for."""
    spark = df.sparkSession
    edge = lambda lines, k: spark.createDataFrame([(k, i, x) for i, x in enumerate(lines)], "part int, `order` long, value string")
    rows = edge(before, 0).unionByName(df.select(F.lit(1).alias("part"), F.col("order").cast("long").alias("order"), "value")).unionByName(edge(after, 2))
    rows.coalesce(1).sortWithinPartitions("part", "order").select("value").write.mode(_mode(overwrite)).text(path)


def _escaped(c: Column) -> Column:
    c = c.cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


#: GraphML's names of Spark's types; others are written as text.
_KINDS = {"double": "double", "float": "float", "int": "int", "bigint": "long", "boolean": "boolean"}


def graphml(nodes: DataFrame, edges: DataFrame, path: str, overwrite: bool = False) -> None:
    """A graph as one GraphML file in a folder: nodes (osmid) and edges (u, v, key) with their other columns as data;
    lines as WKT, named geometry. Nulls are left out."""
    flat = edges
    if "line" in edges.columns:
        flat = edges.withColumn("geometry", F.when(F.col("line").isNotNull(), G.line_wkt(F.col("line")))).drop("line")
    keys, parts = [], []
    for tag, df, skip in (("node", nodes, ("osmid",)), ("edge", flat, ("u", "v", "key"))):
        data = []
        for f in df.schema.fields:
            if f.name not in skip:
                kind = _KINDS.get(f.dataType.simpleString(), "string")
                keys.append(f'<key id="d{len(keys)}" for="{tag}" attr.name="{f.name}" attr.type="{kind}"/>')
                data.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.concat(F.lit(f'<data key="d{len(keys) - 1}">'), _escaped(F.col(f"`{f.name}`")), F.lit("</data>"))))
        ends = [F.lit('<node id="'), F.col("osmid").cast("string"), F.lit('">')] if tag == "node" else [F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" id="'), F.col("key").cast("string"), F.lit('">')]
        parts.append(df.select(F.lit(len(parts)).alias("order"), F.concat(*ends, F.concat_ws("", *data), F.lit(f"</{tag}>")).alias("value")))
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    one_file(parts[0].unionByName(parts[1]), path, head, ["</graph>", "</graphml>"], overwrite)


def gml(df: DataFrame, path: str, row_tag: str, polygon: str = "polygon", overwrite: bool = False) -> None:
    """Polygons as one GML file in a folder: a member for each row, the columns as child elements, the rings as
    gml:posList, shells and holes told apart by their direction."""
    columns = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"<{c}>"), _escaped(F.col(f"`{c}`")), F.lit(f"</{c}>"))) for c in df.columns if c != polygon]
    ring = lambda r: F.concat(F.lit("<gml:LinearRing><gml:posList>"), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p.x, p.y)), " "), F.lit("</gml:posList></gml:LinearRing>"))
    rings = F.concat(F.lit("<gml:surfaceMember>"), F.array_join(F.transform(polygon, ring), ""), F.lit("</gml:surfaceMember>"))
    value = F.concat(F.lit(f"<{row_tag}>"), F.concat_ws("", *columns), F.when(F.col(polygon).isNotNull(), rings).otherwise(F.lit("")), F.lit(f"</{row_tag}>"))
    one_file(df.select(F.lit(0).alias("order"), value.alias("value")), path, ['<?xml version="1.0" encoding="utf-8"?>', '<collection xmlns:gml="http://www.opengis.net/gml">'], ["</collection>"], overwrite)


def _coordinates(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p.x.cast("double"), p.y.cast("double")))


def features(df: DataFrame, geometry: str, kind: str, *beside: str) -> DataFrame:
    """A GeoJSON feature as text for each row, with the columns named to stand beside it. kind: Point, LineString,
    Polygon, or MultiPolygon (an array of polygons; one alone is written as a Polygon)."""
    g = F.col(geometry)
    polygon = lambda p: F.transform(p, _coordinates)
    at = {"Point": lambda: F.array(g.x.cast("double"), g.y.cast("double")), "LineString": lambda: _coordinates(g), "Polygon": lambda: polygon(g), "MultiPolygon": lambda: F.transform(g, polygon)}[kind]()
    as_text = lambda k, c: F.to_json(F.struct(F.lit(k).alias("type"), c.alias("coordinates")))
    shape = as_text(kind, at)
    if kind == "MultiPolygon":
        shape = F.when(F.size(g) == 1, as_text("Polygon", polygon(F.get(g, F.lit(0))))).otherwise(shape)
    others = [F.col(f"`{c}`") for c in df.columns if c not in (geometry, *beside)]
    properties = F.to_json(F.struct(*others)) if others else F.lit("{}")
    body = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(F.when(g.isNotNull(), shape), F.lit("null")), F.lit("}"))
    return df.select(*beside, body.alias("value"))


def geojson(df: DataFrame, path: str, geometry: str, kind: str, overwrite: bool = False) -> None:
    """GeoJSON features, one a line, as a folder of text files."""
    features(df, geometry, kind).write.mode(_mode(overwrite)).text(path)


def geojson_collection(df: DataFrame, path: str, geometry: str, kind: str, order: str, overwrite: bool = False) -> None:
    """One GeoJSON file with all features, in a folder; `order` is a column of whole numbers that no two rows share."""
    first = df.agg(F.min(order)).first()[0]
    rows = features(df.withColumn("_order", F.col(order)), geometry, kind, "_order")
    rows = rows.select(F.col("_order").alias("order"), F.concat(F.when(F.col("_order") == first, F.lit("")).otherwise(F.lit(",")), F.col("value")).alias("value"))
    one_file(rows, path, ['{"type":"FeatureCollection","features":['], ["]}"], overwrite)


def stamped(path: str, at: datetime | None = None) -> str:
    """path_YYYYmmdd_HHMMSS, for results of several runs side by side."""
    return f"{path.rstrip('/')}_{at or datetime.now():%Y%m%d_%H%M%S}"


def scores_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV files by service type, points as WKT and routes as text."""
    flat = df
    for f in df.schema.fields:
        if f.dataType.simpleString().startswith("struct<x"):
            flat = flat.withColumn(f.name, G.point_wkt(F.col(f"{f.name}.x"), F.col(f"{f.name}.y")))
        elif f.dataType.typeName() == "array":
            flat = flat.withColumn(f.name, F.to_json(f.name))
    flat.write.mode(_mode(overwrite)).partitionBy("service_type").csv(path, header=True)


def boundary_json(df: DataFrame, path: str, polygon: str = "polygon", overwrite: bool = False) -> None:
    """The geometry alone of each row, as GeoJSON text."""
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(polygon, _coordinates).alias("coordinates")))
    df.select(shape.alias("value")).write.mode(_mode(overwrite)).text(path)


def cropped(df: DataFrame, mask: list, path: str, overwrite: bool = False, polygon: str = "polygon", row_tag: str = "feature") -> bool:
    """Polygons cut at a mask of any shape, all rings and parts, by the path's ending as GeoJSON, GML or a shapefile;
    False for an unknown ending, which is skipped."""
    if not path.endswith((".geojson", ".gml", ".shp")):
        return False
    if path.endswith(".shp"):
        if overwrite or not regions.exists(df.sparkSession, path):
            shapefile.write(clip_polygons(df, mask, polygon), path, polygon)
    elif path.endswith(".gml"):
        gml(clip_polygons(df, mask, polygon), path, row_tag, polygon, overwrite)
    else:
        geojson(clip_polygons(df, mask, polygon, "_parts").drop(polygon), path, "_parts", "MultiPolygon", overwrite)
    return True


def crop_folder(spark: SparkSession, folder: str, row_tag: str, columns: str, mask: list, postfix: str, slug: str | None = None, overwrite: bool = False) -> list[str]:
    """All GML files of a folder that are still to be cropped, cut at a mask of any shape in one job: GeoJSON features
    below <folder>/<postfix>, a part for each file. Gives the files' names; an error in any file fails the job."""
    names = regions.to_crop(regions.list_files(spark, folder, ".gml", relative=True), postfix, slug)
    if names:
        rows = readers.gml(spark, [f"{folder.rstrip('/')}/{n}" for n in names], row_tag, columns, "file")
        cut = clip_polygons(rows.where("size(polygon) > 0"), mask, "polygon", "_parts").drop("polygon")
        body = features(cut, "_parts", "MultiPolygon", "file")
        body.write.mode(_mode(overwrite)).partitionBy("file").text(f"{folder.rstrip('/')}/{postfix}")
    return names


def region_mask(name: str) -> list[tuple[float, float]]:
    """A preset region's corners as a mask."""
    xmin, ymin, xmax, ymax = regions.REGIONS[name]
    return [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)]
