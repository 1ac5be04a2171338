"""Preset regions, hazard scenarios and file names."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G

# Xmin, ymin, xmax, ymax in degrees.
REGIONS = {
    "weser_bergland": (7.2, 50.89, 10.329, 53.079),
    "porta_westfalica": (8.7, 52.15, 9.3, 52.4),
    "trier_city": (6.558, 49.709, 6.725, 49.835),
    "trier_region": (6.55, 49.68, 6.775, 49.85),
}
# Letters of the flood scenarios in file names.
SCENARIOS = {"HQ100": "M", "HQ200": "L", "HQ50": "H"}


@dataclass(frozen=True)
class Config:
    """Folders and default settings; `root` holds the rest unless they are set."""

    root: str = "data"
    srid: int = 4326
    folders: dict = field(default_factory=lambda: {"elevation": "elevation", "flooding": "flooding", "risk_zones": "flooding/risk_zones", "hazard_areas": "flooding/hazard_areas", "osm": "osm", "inputs": "roa/inputs", "outputs": "roa/outputs", "cache": "roa/cache", "story": "story"})

    def folder(self, name: str) -> str:
        return f"{self.root}/{self.folders[name]}"

    @classmethod
    def of_environment(cls, prefix: str = "FORDWAY_") -> Config:
        """Settings from the environment: <prefix>ROOT, <prefix>SRID, and <prefix>FOLDER_<NAME> for each folder."""
        own = cls()
        folders = {k: os.environ.get(f"{prefix}FOLDER_{k.upper()}", v) for k, v in own.folders.items()}
        return cls(os.environ.get(f"{prefix}ROOT", own.root), int(os.environ.get(f"{prefix}SRID", own.srid)), folders)


def logger(name: str = "fordway", level: int = logging.INFO) -> logging.Logger:
    """A logger that writes lines with time and level, once however often it is asked for."""
    found = logging.getLogger(name)
    found.setLevel(level)
    if not found.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        found.addHandler(handler)
    return found


def region(spark: SparkSession, name: str) -> DataFrame:
    """One row: name, polygon."""
    return spark.range(1).select(F.lit(name).alias("name"), G.rectangle(*[F.lit(v) for v in REGIONS[name]]).alias("polygon"))


def hazard_path(config: Config, scenario: str, region_name: str | None = None, stem: str = "hazard_areas") -> str:
    """The file of a flood scenario: a whole country's is GML, a region's GeoJSON."""
    letter = SCENARIOS[scenario]
    name = f"{stem}_{letter}.gml" if not region_name else f"{stem}_{letter}_{region_name}.geojson"
    return f"{config.folder('hazard_areas')}/{name}"


def extension(path: str) -> str:
    return PurePosixPath(path).suffix


def with_postfix(path: str, postfix: str) -> str:
    """name_postfix.ext; only the ending is touched."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_{postfix}{p.suffix}"))


def with_subfolder(path: str, folder: str) -> str:
    p = PurePosixPath(path)
    return str(p.parent / folder / p.name)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def list_files(spark: SparkSession, folder: str, ending: str = "", slug: str = "", relative: bool = False) -> list[str]:
    """Files of a folder by ending and a part of the name, in order, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isFile())
    return [n if relative else f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(ending) and slug in n]


def to_crop(names: list[str], postfix: str, slug: str | None = None) -> list[str]:
    """Names of a folder that are still to be cropped: with a slug those that have it, without none cropped before."""
    return [n for n in names if postfix not in n and (slug in n if slug else "cropped" not in n)]
