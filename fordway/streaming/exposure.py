"""Positions as they come, with hazard flags counted by time window. An extension: the batch operators have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.spatial_join import spatial_join


def flagged_positions(positions: DataFrame, hazard: DataFrame, size: float) -> DataFrame:
    """A stream of points joined to static polygons: points inside come once for each polygon; the cell size is given
    since a stream is not measured."""
    return spatial_join(positions, hazard, "inner", size=size).drop("polygon")


def windowed_counts(flagged: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, n: points in hazard areas by window, rows later than the watermark left out."""
    return flagged.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")
