"""Samples of nodes on a grid, and their filter by districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from .spatial_join import in_union


def grid_cells(nodes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, rows: int, columns: int) -> DataFrame:
    """nodes within the box with their cell (row, column), by arithmetic alone. Along a side of no steps all nodes share
    the one strip before the first, -1."""
    # no step's size is rounded, so cells are exact on whole numbers
    row = F.least(F.floor((F.col("y") - ymin) * rows / (ymax - ymin)).cast("int"), F.lit(rows - 1))
    column = F.least(F.floor((F.col("x") - xmin) * columns / (xmax - xmin)).cast("int"), F.lit(columns - 1))
    inside = (F.col("x") >= xmin) & (F.col("x") <= xmax) & (F.col("y") >= ymin) & (F.col("y") <= ymax)
    return nodes.where(inside).withColumns({"row": row, "column": column})


def one_per_cell(celled: DataFrame, seed: int | None = 42) -> DataFrame:
    """One node of each cell, drawn by a hash of its id and the seed; without a seed the smallest id. Also n, the
    cell's nodes."""
    draw = F.lit(0) if seed is None else F.xxhash64("osmid", F.lit(seed))
    first = F.min(F.struct(draw.alias("d"), "osmid", "x", "y")).alias("_f")
    return celled.groupBy("row", "column").agg(F.count("*").alias("n"), first).select("row", "column", "n", "_f.osmid", "_f.x", "_f.y")


def draw_sample(nodes: DataFrame, polygon: DataFrame, samples: int | None = None, distance_m: float | None = None, seed: int | None = 42, lonlat: bool = True) -> DataFrame:
    """One random node of each grid cell over a polygon's box, of the nodes within the polygon.

    Exactly one of samples and distance_m is to be given. The box's height is measured along its left side, its width
    along the top. A box narrower or lower than a cell is cut along its other side only.
    """
    b = polygon.select(G.bounds(F.flatten("polygon")).alias("b")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
    xmin, ymin, xmax, ymax = map(float, b)
    if lonlat:
        high, wide = G.haversine_m(xmin, ymin, xmin, ymax), G.haversine_m(xmin, ymax, xmax, ymax)
    else:
        high, wide = ymax - ymin, xmax - xmin
    rows, columns = G.grid_steps(wide, high, samples, distance_m, (xmax - xmin) / (ymax - ymin))
    within = in_union(nodes, polygon.select("polygon"), ["osmid"])
    return one_per_cell(grid_cells(within, xmin, ymin, xmax, ymax, rows, columns), seed)


def in_named_districts(samples: DataFrame, districts: DataFrame, key: str = "osmid") -> DataFrame:
    """Samples in the union of the districts that have a name: within one, or on a border between some of them."""
    return in_union(samples, districts.where("name is not null").select("polygon"), [key])


def fraction(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A random share of the rows, the same for the same seed and partitions."""
    return df.sample(fraction=share, seed=seed)
