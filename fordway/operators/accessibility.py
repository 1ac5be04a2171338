"""Robustness of accessibility: how much worse the way to the nearest service gets when flooded edges are gone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as S
from .graph import disrupted_edges, undirected, with_lines
from .routing import LOCAL_EDGES, shortest_paths, single_source
from .sampling import draw_sample, in_named_districts
from .spatial_join import nearest, spatial_join

NORMAL, DISRUPTED = "normal", "disrupted"


def prepare_services(services: DataFrame, nodes: DataFrame, metric: str = "planar") -> DataFrame:
    """Services (osm_id, x, y, perhaps position) snapped to their nearest node: adds node_id, node_x, node_y.

    A set position (struct x, y) wins over the feature's own middle. The undisturbed graph's nodes are to be given.
    """
    has = "position" in services.columns
    at = lambda c: F.coalesce(F.col(f"position.{c}"), F.col(c)) if has else F.col(c)
    placed = services.withColumns({"_px": at("x"), "_py": at("y")})
    found = nearest(placed, nodes, "osm_id", "_px", "_py", metric=metric).drop("distance").withColumnRenamed("osmid", "node_id")
    points = nodes.select(F.col("osmid").alias("node_id"), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
    return found.join(points, "node_id").drop("_px", "_py")


def named(services: DataFrame) -> Column:
    """A service's name, or amenity and id where it has none."""
    return F.coalesce("name", F.concat_ws("_", "amenity", "osm_id")) if "name" in services.columns else F.concat_ws("_", "amenity", "osm_id")


def service_types(services: DataFrame) -> list[str]:
    """The names of the service types: a handful."""
    return sorted(r[0] for r in services.select("service_type").distinct().collect())


def of_each(names: list[str]) -> Column:
    return F.explode(F.array(*map(F.lit, names)))


def distances(
    edges: DataFrame,
    disrupted: DataFrame | None,
    services: DataFrame,
    strategy: str = "auto",
    with_path: bool = False,
    states: tuple[str, ...] = (NORMAL, DISRUPTED),
    types: list[str] | None = None,
) -> DataFrame:
    """state, service_type, node, distance, source, predecessor (, path), for the states asked for. services:
    service_type, node_id. types: their service types, if known. A state's edges are held once for all types."""
    if strategy == "auto":  # no state has more edges than the whole graph both ways, which is cheaper to count
        strategy = "local" if 2 * edges.count() <= LOCAL_EDGES else "frontier"
    graphs = {NORMAL: edges, DISRUPTED: disrupted}
    sides = [undirected(graphs[s].select("u", "v", "key", "length")).withColumn("state", F.lit(s)) for s in states]
    sources = services.select(of_each(list(states)).alias("state"), "service_type", F.col("node_id").alias("node"))
    n = len(types) if types is not None else None
    return shortest_paths(reduce(DataFrame.unionByName, sides), sources, ["state"], strategy, with_path=with_path, searches=["service_type"], n_searches=n)


def calculate_routes(
    samples: DataFrame, services: DataFrame, nodes: DataFrame, edges: DataFrame, state: str = NORMAL, multi_source: bool = True, a_star: bool = False, strategy: str = "auto", with_path: bool = True, metric: str = "haversine"
) -> DataFrame:
    """The rows of distance_rows() for one state, by one search a service type or, without multi_source, by a search
    for each service that may be the nearest (with A* on request); both at once raise ValueError. Of the latter each
    service tried has a row."""
    if multi_source:
        if a_star:
            raise ValueError("A* searches from one service to one sample")
        types = service_types(services)
        found = distances(edges, edges, services, strategy, with_path, (state,), types)
        return distance_rows(samples, found, services, types, (state,))
    asked = services.select("service_type", F.col("osm_id").alias("service"), F.col("node_id").alias("node"))
    found = single_source(samples.select(F.col("osmid").alias("node")), asked, nodes, undirected(edges.select("u", "v", "key", "length")), a_star, metric=metric)
    own = services.select("service_type", F.col("osm_id").alias("service"), named(services).alias("name"), "node_id", F.struct("x", "y").alias("position"))
    places = samples.select(F.col("osmid").alias("node"), F.struct("x", "y").alias("centroid"))
    return found.join(own, ["service_type", "service"]).join(places, "node").select(
        F.lit(state).alias("state"),
        F.col("name").alias("from_name"),
        F.col("node_id").alias("from_node_id"),
        F.col("position").alias("from_position"),
        F.col("service").alias("from_osm_id"),
        F.col("node").alias("to_node_id"),
        F.col("centroid").alias("to_centroid"),
        "service_type",
        F.col("distance").alias("route_length"),
        F.col("path").alias("route"),
        F.lit(None).cast("double").alias("travel_time"),
    )


def distance_rows(samples: DataFrame, found: DataFrame, services: DataFrame, types: list[str] | None = None, states: tuple[str, ...] = (NORMAL, DISRUPTED)) -> DataFrame:
    """The flat record of each sample, service type and state: an infinite length and no service where none is in
    reach. Of services that share a node the first by id is named."""
    firsts = services.groupBy("service_type", "node_id").agg(F.min(F.struct("osm_id", named(services).alias("name"), "x", "y")).alias("s"))
    wanted = samples.select(F.col("osmid").alias("to_node_id"), F.struct("x", "y").alias("to_centroid"), of_each(types if types is not None else service_types(services)).alias("service_type"))
    wanted = wanted.withColumn("state", of_each(list(states)))
    path = F.col("path") if "path" in found.columns else F.lit(None).cast("array<long>")
    hit = found.select("state", "service_type", F.col("node").alias("to_node_id"), "distance", "source", path.alias("route"))
    out = wanted.join(hit, ["state", "service_type", "to_node_id"], "left").join(firsts.withColumnRenamed("node_id", "source"), ["service_type", "source"], "left")
    return out.select(
        "state",
        F.col("s.name").alias("from_name"),
        F.col("source").alias("from_node_id"),
        F.when(F.col("s").isNotNull(), F.struct("s.x", "s.y")).alias("from_position"),
        F.col("s.osm_id").alias("from_osm_id"),
        "to_node_id",
        "to_centroid",
        "service_type",
        F.coalesce("distance", F.lit(S.INFINITY)).alias("route_length"),
        "route",
        F.lit(None).cast("double").alias("travel_time"),
    )


def scores(rows: DataFrame) -> DataFrame:
    """Of each state the shortest way by sample and service type, normal with disrupted beside it, and the score."""
    keys = ["service_type", "to_node_id"]
    own = [c for c in rows.columns if c not in ("state", *keys, "route_length", "from_osm_id")]
    least = lambda state, *columns: F.min(F.when(F.col("state") == state, F.struct("route_length", "from_osm_id", *columns)))
    # one pass for both states: a join of the two would route twice
    low = rows.groupBy(*keys).agg(least(NORMAL, *own).alias("n"), least(DISRUPTED, "route").alias("d")).where("n is not null")
    side = [F.col(f"n.{c}").alias(c if c != "route" else "route_normal") for c in own]
    joined = low.select(*keys, "n.from_osm_id", *side, F.col("n.route_length").alias("route_length_normal"), F.col("d.route_length").alias("route_length_disrupted"), F.col("d.route").alias("route_disrupted"))
    joined = joined.withColumn("score", S.robustness(F.col("route_length_normal"), F.col("route_length_disrupted")))
    return joined.withColumn("route_length_disrupted", F.coalesce("route_length_disrupted", F.lit(S.INFINITY)))


def robustness_of_networks(
    nodes: DataFrame,
    edges: DataFrame,
    hazard: DataFrame,
    services: DataFrame,
    area: DataFrame | None = None,
    districts: DataFrame | None = None,
    samples: int | None = None,
    distance_m: float | None = None,
    strategy: str = "auto",
    lonlat: bool = True,
    exclude_bridges: bool = True,
    with_path: bool = False,
) -> DataFrame:
    """The whole calculation: split the graph, draw samples, keep those in named districts, snap services, route in
    both states. Without an area all nodes are samples. Gives the rows of distance_rows(), with routes on request."""
    wet = disrupted_edges(with_lines(edges, nodes), hazard, exclude_bridges)
    chosen = nodes if area is None else draw_sample(nodes, area, samples, distance_m, lonlat=lonlat)
    if districts is not None:
        chosen = in_named_districts(chosen, districts)
    snapped = services if "node_id" in services.columns else prepare_services(services, nodes, "haversine" if lonlat else "planar")
    types = service_types(snapped)
    return distance_rows(chosen, distances(edges, wet, snapped, strategy, with_path, types=types), snapped, types)


def overall(scored: DataFrame) -> DataFrame:
    return scored.groupBy("service_type").agg(F.round(F.avg("score"), 6).alias("mean_score"))


def with_districts(scored: DataFrame, districts: DataFrame, dedupe: bool = False) -> DataFrame:
    """Scores (x, y) with the name of the district that holds them: a row for each, a null name without one. Samples
    of nested districts count in each; `dedupe` keeps one district by name."""
    out = spatial_join(scored, districts.select(F.col("name").alias("district_name"), "polygon"), "left", "within").drop("polygon")
    if not dedupe:
        return out
    kept = [c for c in out.columns if c != "district_name"]
    return out.groupBy(*kept).agg(F.min("district_name").alias("district_name"))


def district_means(joined: DataFrame) -> DataFrame:
    return joined.where("district_name is not null").groupBy("district_name", "service_type").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


def district_summary(joined: DataFrame) -> DataFrame:
    """One row a district: for each service type the share of samples cut off, the mean score, and over samples with a
    score above 0 the mean score and distances; null where there is none."""
    out = []
    for kind in ("fire_station", "hospital"):
        mine = F.col("service_type") == kind
        linked = mine & (F.col("score") > 0)
        mean = lambda c, when: F.round(F.avg(F.when(when, F.col(c))), 6)
        out += [
            F.round(F.avg(F.when(mine, (F.col("score") == 0).cast("int"))), 6).alias(f"{kind}_cut_off"),
            mean("score", mine).alias(f"{kind}_score"),
            mean("score", linked).alias(f"{kind}_linked_score"),
            mean("route_length_normal", linked).alias(f"{kind}_normal"),
            mean("route_length_disrupted", linked).alias(f"{kind}_disrupted"),
        ]
    return joined.where("district_name is not null").groupBy("district_name").agg(*out)


def pairwise_scores(normal: DataFrame, disrupted: DataFrame, clip: bool = False) -> DataFrame:
    """Scores by (from, to), one row each on either side; the normal length is cut to a whole number."""
    for side in (normal, disrupted):
        if not side.groupBy("from", "to_node_id").count().where("count > 1").isEmpty():
            raise ValueError("more than one row for a pair")
    n = normal.select("from", "to_node_id", F.col("route_length").cast("long").alias("normal_distance"))
    d = disrupted.select("from", "to_node_id", F.col("route_length").alias("disrupted_distance"))
    return _compared(n.join(d, ["from", "to_node_id"]), clip)


def min_distance_scores(normal: DataFrame, disrupted: DataFrame, clip: bool = False) -> DataFrame:
    """Scores by node of the least normal and disrupted lengths."""
    n = normal.groupBy("to_node_id").agg(F.min("route_length").alias("normal_distance"))
    d = disrupted.groupBy("to_node_id").agg(F.min("route_length").alias("disrupted_distance"))
    return _compared(n.join(d, "to_node_id"), clip)


def _compared(joined: DataFrame, clip: bool) -> DataFrame:
    a, b = F.col("normal_distance"), F.col("disrupted_distance")
    return joined.withColumn("difference", b - a).withColumn("score", S.robustness(a.cast("double"), b.cast("double"), clip))
