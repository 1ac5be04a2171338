"""Multi-source shortest paths, for all groups (state, ...) and searches (service type, ...) in one job.

Strategy "local" runs Dijkstra's algorithm on each group's edges in one task, for all searches over one copy of them;
"frontier" relaxes a frontier of improved nodes by joins, round by round, for graphs that no task holds; "auto" counts
the edges first. Both break ties alike: by distance, then source, then predecessor. Both give paths: the local one by
walking back, the frontier by joining predecessors' paths, which double in length each round.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import geometry as G
from .graph import lightest
from .stored import kept

#: Edges of a group that one task may hold: about a gigabyte of Python objects.
LOCAL_EDGES = 5_000_000
#: Searches that one task runs over its copy of a group's edges.
SEARCHES = 64
#: Steps that the frontier takes between two checkpoints.
STEPS = 4


def shortest_paths(
    edges: DataFrame,
    sources: DataFrame,
    groups: list[str],
    strategy: str = "auto",
    weight: str = "length",
    with_path: bool = False,
    searches: list[str] | None = None,
    n_searches: int | None = None,
) -> DataFrame:
    """groups, searches, node, distance (double), source, predecessor and on request path, for all reachable nodes.

    edges: groups, u, v, key, weight, each way a row of its own. sources: groups, searches, node; each group's nodes of
    one search are its sources. n_searches: at least how many a group has, if that is known. Nodes that cannot be
    reached have no row.
    """
    if strategy not in ("auto", "local", "frontier"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "auto":
        most = edges.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
        strategy = "local" if most <= LOCAL_EDGES else "frontier"
    searches = searches or []
    light = lightest(edges, groups, weight)
    starts = sources.select(*groups, *searches, F.col("node").cast("long").alias("node")).distinct()
    if strategy == "frontier":
        found = _frontier(light, starts, groups, searches, weight)
        return with_paths(found, [*groups, *searches]) if with_path else found
    if searches and n_searches is None:
        n_searches = starts.groupBy(*groups).agg(F.countDistinct(*searches).alias("n")).agg(F.max("n")).first()[0] or 0
    return _local(light, starts, groups, searches, weight, with_path, -(-(n_searches or 1) // SEARCHES) if searches else 1)


def adjacency(u: list, v: list, length: list) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(u, v, length, strict=True):
        out.setdefault(a, []).append((b, w))
    return out


def dijkstra(out: dict[int, list[tuple[int, float]]], sources: list) -> Iterator[tuple[int, float, int, int | None]]:
    """node, distance, source, predecessor of each reachable node."""
    heap = [(0.0, s, -1, s) for s in sorted(sources)]
    heapq.heapify(heap)
    done: set[int] = set()
    while heap:
        d, source, before, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        yield node, d, source, None if before < 0 else before
        for to, w in out.get(node, ()):
            if to not in done:
                heapq.heappush(heap, (d + w, source, node, to))


def _local(edges: DataFrame, sources: DataFrame, groups: list[str], searches: list[str], weight: str, with_path: bool, portions: int) -> DataFrame:
    keys = [*groups, *searches]
    fields = [sources.schema[g] for g in keys] + [StructField("node", LongType()), StructField("distance", DoubleType()), StructField("source", LongType()), StructField("predecessor", LongType())]
    kind = StructType(fields)
    if with_path:
        kind = kind.add("path", ArrayType(LongType()))

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = adjacency(e["u"].tolist(), e["v"].tolist(), e[weight].tolist())
        parts = [kind_of_none()] if s.empty else []
        own = [f"_{k}" for k in keys]
        for values, starts in s.groupby(own, dropna=False, sort=False) if len(s) else ():
            found = list(dijkstra(out, starts["node"].tolist()))
            part = pd.DataFrame(found, columns=["node", "distance", "source", "predecessor"]).astype({"node": "int64", "distance": "float64", "source": "int64"})
            part["predecessor"] = part["predecessor"].astype("Int64")
            for k, (name, value) in enumerate(zip(keys, values, strict=True)):
                part.insert(k, name, value)
            if with_path:
                before = {n: p for n, _, _, p in found}
                part["path"] = [_way(n, before) for n in part["node"].tolist()]
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    def kind_of_none() -> pd.DataFrame:
        return pd.DataFrame({f.name: [] for f in kind.fields})

    # other names on one side: both may come from one table
    own = sources.select(*[F.col(g).alias(f"_{g}") for g in keys], "node")
    on, names = [*groups], [f"_{g}" for g in groups]
    if portions > 1:  # many searches: some tasks share a group's, each with a copy of its edges
        edges = edges.withColumn("_portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
        own = own.withColumn("_p", F.pmod(F.xxhash64(*[f"_{k}" for k in searches]), F.lit(portions)).cast("int"))
        on, names = [*on, "_portion"], [*names, "_p"]
    return edges.groupBy(*on).cogroup(own.groupBy(*names)).applyInPandas(run, kind)


def _way(node: int | None, before: dict[int, int | None]) -> list[int]:
    way = []
    while node is not None:
        way.append(node)
        node = before[node]
    return way[::-1]


def _frontier(edges: DataFrame, sources: DataFrame, groups: list[str], searches: list[str], weight: str) -> DataFrame:
    key = [*groups, *searches, "node"]
    none = F.lit(None).cast("long")
    state = kept(sources.select(*key, F.struct(F.lit(0.0).alias("distance"), F.col("node").alias("source"), none.alias("predecessor")).alias("best"), F.lit(True).alias("fresh")))
    edges = kept(edges)

    def step(front: DataFrame) -> DataFrame:
        reached = front.withColumnRenamed("node", "u").join(edges, [*groups, "u"])
        offer = F.struct((F.col("best.distance") + F.col(weight)).alias("distance"), F.col("best.source").alias("source"), F.col("u").alias("predecessor"))
        return reached.select(*groups, *searches, F.col("v").alias("node"), offer.alias("best")).groupBy(*key).agg(F.min("best").alias("best"))

    while True:
        front, offers = state.where("fresh").select(*key, "best"), None
        for _ in range(STEPS):
            front = step(front)
            offers = front if offers is None else offers.unionByName(front)
        both = state.select(*key, "best", F.col("best").alias("old")).unionByName(offers.withColumn("old", F.lit(None).cast(state.schema["best"].dataType)))
        merged = both.groupBy(*key).agg(F.min("best").alias("best"), F.max("old").alias("old"))
        state = kept(merged.select(*key, "best", (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("fresh")))
        if state.where("fresh").isEmpty():
            return state.select(*key, "best.distance", "best.source", "best.predecessor")


def with_paths(found: DataFrame, groups: list[str]) -> DataFrame:
    """found (groups, node, predecessor and more) with `path`, the nodes from the source on, by pointer jumping: each
    round puts before a path the one that its first node's predecessor has, so rounds grow with the logarithm of hops."""
    found = kept(found)
    way = kept(found.select(*groups, "node", F.col("predecessor").alias("up"), F.array("node").alias("path")))
    while not way.where("up is not null").isEmpty():
        above = way.select(*groups, F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        open_ = way.where("up is not null").join(above, [*groups, "up"]).select(*groups, "node", F.col("next").alias("up"), F.concat("before", "path").alias("path"))
        way = kept(way.where("up is null").unionByName(open_))
    return found.join(way.select(*groups, "node", "path"), [*groups, "node"])


def to_goal(out: dict, source: int, goal: int, bound) -> tuple[float, list[int]] | None:
    """Length and nodes of the shortest way by A*: `bound` gives, for a node, at most what is left to the goal."""
    heap = [(bound(source), 0.0, -1, source)]
    before: dict[int, int] = {}
    while heap:
        _, d, by, node = heapq.heappop(heap)
        if node in before:
            continue
        before[node] = by
        if node == goal:
            return d, _way(node, {n: None if b < 0 else b for n, b in before.items()})
        for to, w in out.get(node, ()):
            if to not in before:
                heapq.heappush(heap, (d + w + bound(to), d + w, node, to))
    return None


def single_source(samples: DataFrame, services: DataFrame, nodes: DataFrame, edges: DataFrame, a_star: bool = False, weight: str = "length", metric: str = "haversine", group: str = "service_type") -> DataFrame:
    """Ways from the services to each sample, one at a time: group, service, node, crow_flies, distance, path.

    samples: node. services: group, service, node. Of each group services are tried by their distance as the crow
    flies, ties by id, until that is over the shortest way found; each one tried has a row, with an infinite distance
    where there is no way. A search ends at its goal; with a_star it also heads for it, by straight distances, which
    lengths must not fall below. Samples are dealt over tasks; each holds the graph and the services, so both are
    counted and more than LOCAL_EDGES of either raise ValueError. It is for comparison: shortest_paths gives the
    shortest ways of all samples in one search.
    """
    if metric not in ("haversine", "planar"):
        raise ValueError(f"unknown metric {metric}")
    spark = edges.sparkSession
    light = lightest(edges.select("u", "v", "key", weight), None, weight)
    points = nodes.select(F.col("osmid").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = services.select(group, "service", "node").distinct().join(points, "node")
    if max(light.count(), ends.count(), points.count() if a_star else 0) > LOCAL_EDGES:
        raise ValueError("a graph of this size is for shortest_paths")
    graph = spark.sparkContext.broadcast(light.select("u", "v", F.col(weight).cast("double").alias("w")).toPandas())
    goals = spark.sparkContext.broadcast(ends.toPandas().sort_values([group, "service"]))
    places = spark.sparkContext.broadcast(points.toPandas() if a_star else None)
    kind = StructType([services.schema[group], services.schema["service"], StructField("node", LongType()), StructField("crow_flies", DoubleType()), StructField("distance", DoubleType()), StructField("path", ArrayType(LongType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge, at = graph.value, places.value
        out = adjacency(edge["u"].tolist(), edge["v"].tolist(), edge["w"].tolist())
        of = {n: (x, y) for n, x, y in at.itertuples(index=False)} if a_star else {}
        by_group = [(g, rows["service"].tolist(), rows["node"].tolist(), rows["x"].to_numpy(), rows["y"].to_numpy()) for g, rows in goals.value.groupby(group, sort=True)]
        for f in frames:
            found = []
            for node, x, y in f.itertuples(index=False):
                to_here = lambda n, x=x, y=y: float(_straight(*of[n], x, y, metric, 0.998)) if n in of else 0.0
                for name, ids, starts, xs, ys in by_group:
                    flies, shortest = _straight(xs, ys, x, y, metric), math.inf
                    for k in np.argsort(flies, kind="stable").tolist():
                        if flies[k] > shortest:
                            break
                        way = to_goal(out, starts[k], node, to_here if a_star else lambda _: 0.0)
                        distance, path = way or (math.inf, None)
                        shortest = min(shortest, distance)
                        found.append((name, ids[k], node, float(flies[k]), distance, path))
            yield pd.DataFrame(found, columns=kind.names)

    return samples.select("node").distinct().join(points, "node").select("node", "x", "y").mapInPandas(run, kind)


def _straight(x1, y1, x2, y2, metric: str, share: float = 1.0):
    """Straight distance; a share of it leaves room for rounding and for the sphere that lengths were taken on."""
    if metric == "planar":
        return share * np.hypot(x1 - x2, y1 - y2)
    x1, y1, x2, y2 = map(np.radians, (x1, y1, x2, y2))
    half = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return share * 2000 * G.EARTH_KM * np.arctan2(np.sqrt(half), np.sqrt(1 - half))


def _hops(path: str) -> Column:
    """array<struct<a, b>> of a path's neighbouring nodes."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def route_length_truncated(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The older length of a path: the sum of its key-0 edges, either way round, cut to a whole number.

    paths: key columns and `path` (nodes). A path of one node has length 0; a hop without a key-0 edge gives null.
    """
    hops = paths.select(*key, F.size("path").alias("n"), F.explode_outer(_hops("path")).alias("hop"))
    hops = hops.select(*key, "n", "hop.a", "hop.b")
    zero = edges.where("key = 0").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "length").groupBy("lo", "hi").agg(F.min("length").alias("length"))
    joined = hops.join(zero, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left")
    total = joined.groupBy(*key).agg(F.sum("length").alias("total"), F.count("length").alias("met"), F.max("n").alias("n"))
    return total.select(*key, F.when(F.col("met") == F.col("n") - 1, F.coalesce("total", F.lit(0))).cast("long").alias("route_length"))


def route_lines(paths: DataFrame, edges: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """key, lines: a path's edge lines in order (key 0), turned round where the edge runs the other way."""
    hops = paths.select(*key, F.posexplode(_hops("path")).alias("k", "hop"))
    zero = edges.where("key = 0")
    both = zero.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col(line).alias("l"), F.lit(0).alias("turned")).unionByName(zero.select(F.col("v").alias("a"), F.col("u").alias("b"), F.reverse(line).alias("l"), F.lit(1).alias("turned")))
    best = both.groupBy("a", "b").agg(F.min_by("l", "turned").alias("l"))
    joined = hops.select(*key, "k", "hop.a", "hop.b").join(best, ["a", "b"])
    return joined.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda s: s.l).alias("lines"))


def per_service_paths(edges: DataFrame, sources: DataFrame, groups: list[str], weight: str = "length", strategy: str = "auto") -> DataFrame:
    """Distances from every service by itself, not only the nearest: a search for each, as `service` beside the
    groups."""
    services = sources.select(*groups, F.col("node").alias("service"), "node").distinct()
    return shortest_paths(edges, services, groups, strategy, weight, searches=["service"])


def path_between(trips: DataFrame, nodes: DataFrame, edges: DataFrame, weight: str = "travel_time", metric: str = "planar", strategy: str = "auto") -> DataFrame:
    """trip, distance, path for each trip (trip, x1, y1, x2, y2): both ends snapped to nodes, one search for each
    starting node, however many trips begin there.

    edges: u, v, key, weight, each way a row. A trip without a way has no row."""
    from .spatial_join import nearest

    side = lambda k: nearest(trips.select("trip", F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py")), nodes, "trip", metric=metric)
    ends = side(1).select("trip", F.col("osmid").alias("start")).join(side(2).select("trip", F.col("osmid").alias("node")), "trip")
    starts = ends.select(F.lit(0).alias("graph"), "start", F.col("start").alias("node")).distinct()
    found = shortest_paths(edges.withColumn("graph", F.lit(0)), starts, ["graph"], strategy, weight, with_path=True, searches=["start"])
    return ends.join(found.select("start", "node", "distance", "path"), ["start", "node"]).select("trip", "distance", "path")


def route_totals(paths: DataFrame, edges: DataFrame, key: list[str], columns: list[str], weight: str = "length") -> DataFrame:
    """key and the sums of the named edge columns along a path, over the lightest of parallel edges either way."""
    hops = paths.select(*key, F.explode(_hops("path")).alias("hop")).select(*key, "hop.a", "hop.b")
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), *dict.fromkeys([weight, *columns])).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), *dict.fromkeys([weight, *columns])))
    best = both.groupBy("a", "b").agg(*[F.min_by(c, weight).alias(c) for c in columns])
    return hops.join(best, ["a", "b"]).groupBy(*key).agg(*[F.sum(c).alias(c) for c in columns])
