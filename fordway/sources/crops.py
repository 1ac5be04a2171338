"""Files cut to a region: single files by their kind, and the flood files of a preset region."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..functions import geometry as G
from . import osm, pbf, readers, regions, writers

MAPS, SHAPES = (".pbf", ".osm"), (".gml", ".geojson")


def crop_file(spark: SparkSession, source: str, target: str, box: tuple[float, float, float, float], overwrite: bool = False, row_tag: str = "feature", columns: str = "id string") -> bool:
    """The part of a file in a box (xmin, ymin, xmax, ymax): of a map, its ways with a node in the box, whole; of a
    layer of polygons, what lies in the box, with the named columns. False if the target is there and is to stay; other
    kinds of files raise ValueError."""
    ending = regions.extension(source)
    if ending not in (*MAPS, *SHAPES):
        raise ValueError(f"no crop for files that end in {ending!r}")
    if regions.exists(spark, target) and not overwrite:
        return False
    if ending in MAPS:
        area = spark.range(1).select(G.rectangle(*map(F.lit, map(float, box))).alias("polygon"))
        nodes, ways = osm.in_polygon(osm.nodes(spark, source), osm.ways(spark, source), area)
        if target.endswith(".pbf"):
            pbf.write(nodes, ways, target)
        else:
            osm.write_xml(nodes, ways, target, overwrite)
        return True
    rows = readers.gml(spark, source, row_tag, columns) if ending == ".gml" else readers.geojson(spark, source, columns).drop("kind", "point", "line")
    return writers.cropped(rows.where(F.size("polygon") > 0), corners(box), target, overwrite, row_tag=row_tag)


def corners(box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    xmin, ymin, xmax, ymax = box
    return [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)]


def crop_to_region(spark: SparkSession, source: str, target: str, region: str, overwrite: bool = False, **more) -> bool:
    """A file cut to a preset region."""
    return crop_file(spark, source, target, regions.REGIONS[region], overwrite, **more)


def crop_flooding(spark: SparkSession, config: regions.Config, region: str, row_tag: str, columns: str, overwrite: bool = False) -> dict[str, list[str]]:
    """Risk zones and hazard areas of a whole country cut to a preset region: the names of the files cut, by folder."""
    return {name: writers.crop_folder(spark, config.folder(name), row_tag, columns, writers.region_mask(region), region, overwrite=overwrite) for name in ("risk_zones", "hazard_areas")}
