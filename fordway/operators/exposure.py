"""Buildings, persons and households in hazard areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spatial_join import spatial_join


def flooded_share(buildings: DataFrame, hazard: DataFrame, key: list[str]) -> DataFrame:
    """percentage of buildings (points) in or on a hazard polygon."""
    flagged = spatial_join(buildings, hazard.select("polygon"), "flag", key=key)
    return flagged.agg((F.avg(F.col("flooded").cast("int")) * 100).alias("percentage"))


def affected_locations(population: DataFrame, hazard: DataFrame, predicate: str = "within") -> DataFrame:
    """Distinct places (x, y) of the population in a hazard polygon: places are few, persons many."""
    return spatial_join(population.select("x", "y").distinct(), hazard.select("polygon"), "semi", predicate)


def affected_persons(population: DataFrame, hazard: DataFrame, predicate: str = "within") -> DataFrame:
    return population.join(affected_locations(population, hazard, predicate), ["x", "y"], "left_semi")


def affected_households(population: DataFrame, hazard: DataFrame, predicate: str = "within") -> DataFrame:
    """household_id, persons (all of its affected members)."""
    return affected_persons(population, hazard, predicate).groupBy("household_id").agg(F.count("*").alias("persons"))
