"""Road graphs as two tables: nodes (osmid, x, y) and edges (u, v, key, length, line, bridge)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spatial_join import spatial_join

EDGE = ["u", "v", "key"]


def with_lines(edges: DataFrame, nodes: DataFrame, line: str = "line") -> DataFrame:
    """A straight line between its ends for each edge without one."""
    ends = nodes.select("osmid", F.struct(F.col("x").alias("x"), F.col("y").alias("y")).alias("_p"))
    out = edges.join(ends.select(F.col("osmid").alias("u"), F.col("_p").alias("_a")), "u", "left").join(ends.select(F.col("osmid").alias("v"), F.col("_p").alias("_b")), "v", "left")
    straight = F.array("_a", "_b")
    value = F.coalesce(F.col(line), straight) if line in edges.columns else straight
    return out.withColumn(line, value).drop("_a", "_b")


def affected_edges(edges: DataFrame, hazard: DataFrame, exclude_bridges: bool = True, line: str = "line") -> DataFrame:
    """Edges that meet a hazard polygon; bridges (any value that is not null) do not count on request."""
    hit = spatial_join(edges, hazard.select("polygon"), "semi", "intersects", line=line, key=EDGE)
    return hit.where(F.col("bridge").isNull()) if exclude_bridges else hit


def split_edges(edges: DataFrame, hazard: DataFrame, exclude_bridges: bool = True, line: str = "line") -> DataFrame:
    """All edges with a boolean `affected`."""
    hit = affected_edges(edges, hazard, exclude_bridges, line).select(*EDGE).withColumn("affected", F.lit(True))
    return edges.join(hit, EDGE, "left").withColumn("affected", F.coalesce("affected", F.lit(False)))


def disrupted_edges(edges: DataFrame, hazard: DataFrame, exclude_bridges: bool = True, line: str = "line") -> DataFrame:
    return edges.join(affected_edges(edges, hazard, exclude_bridges, line).select(*EDGE), EDGE, "left_anti")


def disrupted_nodes(nodes: DataFrame, affected: DataFrame, hazard: DataFrame) -> DataFrame:
    """Nodes but for those in a hazard polygon that also end an affected edge."""
    ends = affected.select(F.col("u").alias("osmid")).union(affected.select(F.col("v").alias("osmid"))).distinct()
    gone = spatial_join(nodes.join(ends, "osmid", "left_semi"), hazard.select("polygon"), "semi")
    return nodes.join(gone.select("osmid"), "osmid", "left_anti")


def disrupted_by_edges(edges: DataFrame, nodes: DataFrame, hazard: DataFrame, keep_bridges: bool = True, filter_nodes: bool = False, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """The older rule: an edge stays if it has a line that meets no hazard, or if it is a bridge (a text that is not
    empty); an edge without a line goes unless it is a bridge. Nodes that edges still name stay."""
    bridge = F.coalesce("bridge", F.lit("")) != ""
    drawn = edges.where(F.col(line).isNotNull())
    hit = spatial_join(drawn, hazard.select("polygon"), "semi", "intersects", line=line, key=EDGE).select(*EDGE)
    dry = drawn.join(hit, EDGE, "left_anti")
    if keep_bridges:
        kept = edges.join(dry.select(*EDGE).withColumn("_dry", F.lit(True)), EDGE, "left").where(F.col("_dry").isNotNull() | bridge).drop("_dry")
    else:
        kept = dry
    if not filter_nodes:
        return nodes, kept
    named = kept.select(F.col("u").alias("osmid")).union(kept.select(F.col("v").alias("osmid"))).distinct()
    dry_nodes = spatial_join(nodes, hazard.select("polygon"), "anti").select("osmid").union(named).distinct()
    return nodes.join(dry_nodes, "osmid", "left_semi"), kept


def undirected(edges: DataFrame, line: str | None = None) -> DataFrame:
    """Each edge both ways; `reversed` tells the added ones, whose lines run the other way."""
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    if line:
        back = back.withColumn(line, F.reverse(line))
    return edges.withColumn("reversed", F.lit(False)).unionByName(back.withColumn("reversed", F.lit(True)))


def lightest(edges: DataFrame, by: list[str] | None = None, weight: str = "length") -> DataFrame:
    """Of parallel edges the shortest, with its key."""
    keys = [*(by or []), "u", "v"]
    best = edges.groupBy(*keys).agg(F.min(F.struct(weight, "key")).alias("_b"))
    return best.select(*keys, F.col("_b.key").alias("key"), F.col(f"_b.{weight}").alias(weight))


def travel_times(edges: DataFrame, speed: str = "speed_kph", group: str = "highway", length: str = "length") -> DataFrame:
    """speed_kph filled by its road class's mean, or else the mean of all; travel_time in seconds."""
    means = edges.groupBy(group).agg(F.avg(speed).alias("_m"))
    overall = edges.agg(F.avg(speed)).first()[0]
    value = F.coalesce(F.col(speed).cast("double"), "_m", F.lit(overall))
    out = edges.join(means.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn("speed_kph", value).withColumn("travel_time", F.col(length) / (F.col("speed_kph") / 3.6)).drop("_m", "_g")
