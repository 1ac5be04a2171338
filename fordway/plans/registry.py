"""All registered queries of the library and their SQL.

Each query is a function of (spark, sf_dir); its SQL gives the same rows by another formulation where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G, scores as S
from ..operators import accessibility as A, crop as C, exposure as E, graph as R, sampling, spatial_join as J, tables as T
from ..sources import tags
from .fixtures import districts, edges, hazard, nodes, off_grid_points, population, services, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name, with its SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


# Filters, projections, sets


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' OR event_type = 'purchase'")
def tag_filter_in(spark, d):
    return T.in_list(table(spark, d, "events"), "event_type", ["click", "purchase"], ()).select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, p_type FROM part JOIN (VALUES ('SMALL'), ('PROMO'), ('ECONOMY')) t(p) ON p = p_type")
def tag_filter_default_list(spark, d):
    return T.in_list(table(spark, d, "part"), "p_type", None, ("SMALL", "PROMO", "ECONOMY")).select("p_partkey", "p_type")


@query("SELECT u, v, key FROM edges WHERE bridge IS DISTINCT FROM 'yes'", "edges")
def null_safe_exclude(spark, d):
    return edges(spark, d).where(T.not_equal("bridge", "yes")).select("u", "v", "key")


@query(
    """SELECT osm_id, coalesce((SELECT n_nationkey::BIGINT * 100 FROM nation WHERE n_nationkey * 5 = osm_id),
      CASE WHEN osm_id % 3 <> 0 THEN node_id END) AS position
    FROM services WHERE position IS NOT NULL""",
    "services",
)
def override_positions(spark, d):
    own = services(spark, d).select("osm_id", F.when(F.col("osm_id") % 3 != 0, F.col("node_id")).alias("position"))
    k = F.col("n_nationkey").cast("long")
    new = table(spark, d, "nation").select((k * 5).alias("osm_id"), (k * 100).alias("position"))
    return T.override(own, new, "osm_id", "position", drop_null=True)


@query("SELECT s_suppkey AS osm_id, s_name AS name FROM supplier")
def rename_project(spark, d):
    return T.rename_id(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(
    """SELECT p_partkey AS osm_id, p_type AS amenity FROM part WHERE p_type IN ('SMALL', 'LARGE')
    UNION ALL SELECT p_partkey, 'hospital' FROM part WHERE p_size = 7"""
)
def points_of_interest(spark, d):
    p = table(spark, d, "part")
    asked = tags.points_of_interest(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("amenity")), ["SMALL", "LARGE"])
    default = tags.points_of_interest(p.select(F.col("p_partkey").alias("osmid"), F.when(F.col("p_size") == 7, F.lit("hospital")).alias("amenity")))
    return asked.unionByName(default)


@query("SELECT x, y FROM population GROUP BY x, y", "population")
def dedupe_locations(spark, d):
    return population(spark, d).select("x", "y").distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join_isin(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_URGENT, _HIGH = (f"(SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '{p}')" for p in ("1-URGENT", "2-HIGH"))


@query(f"SELECT 'urgent' AS side, id FROM (SELECT id FROM {_URGENT} EXCEPT SELECT id FROM {_HIGH}) UNION ALL SELECT 'high', id FROM (SELECT id FROM {_HIGH} EXCEPT SELECT id FROM {_URGENT})")
def anti_join_both(spark, d):
    of = lambda p: table(spark, d, "orders").where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("id"))
    urgent, high = of("1-URGENT"), of("2-HIGH")
    only = lambda a, b, side: a.join(b, "id", "left_anti").distinct().select(F.lit(side).alias("side"), "id")
    return only(urgent, high, "urgent").unionByName(only(high, urgent, "high"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def head_per_group(spark, d):
    return T.head_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query(
    """SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min,
      round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50,
      round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS max FROM customer"""
)
def summary_stats(spark, d):
    return T.summary(table(spark, d, "customer"), "c_acctbal").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query(
    """SELECT l_partkey, l_extendedprice, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey) = 1"""
)
def argmin_per_group(spark, d):
    return T.least_rows(table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_suppkey"), ["l_partkey"], "l_extendedprice", ["l_suppkey"])


# Measures and predicates


@query(
    """SELECT osmid, round(2 * 6373000 * asin(sqrt(pow(sin(radians(0.0005 * (y / 1000)) / 2), 2)
      + cos(radians(49.68)) * cos(radians(49.68 + 0.0005 * (y / 1000))) * pow(sin(radians(0.0005 * (x / 1000)) / 2), 2))), 3) AS metres FROM nodes""",
    "nodes",
)
def haversine(spark, d):
    lon, lat = 6.55 + 0.0005 * (F.col("x") / 1000), 49.68 + 0.0005 * (F.col("y") / 1000)
    return nodes(spark, d).select("osmid", F.round(G.haversine(F.lit(6.55), F.lit(49.68), lon, lat), 3).alias("metres"))


@query(
    """SELECT osmid, CASE WHEN lon >= 180 THEN 60 ELSE ((lon + 180) // 6)::INTEGER + 1 END AS zone,
      (CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + CASE WHEN lon >= 180 THEN 60 ELSE ((lon + 180) // 6)::INTEGER + 1 END)::INTEGER AS epsg
    FROM (SELECT osmid, osmid * 37 % 361 - 180 AS lon, osmid * 53 % 181 - 90 AS lat FROM nodes)""",
    "nodes",
)
def utm_zone(spark, d):
    lon, lat = F.col("osmid") * 37 % 361 - 180, F.col("osmid") * 53 % 181 - 90
    return nodes(spark, d).select("osmid", G.utm_zone(lon).alias("zone"), G.utm_epsg(lon, lat).alias("epsg"))


@query("SELECT k, ox AS xmin, oy AS ymin, ox + 5000 AS xmax, oy + 5000 AS ymax FROM haz", "hazard")
def bounds(spark, d):
    return hazard(spark, d).select("k", G.bounds(F.flatten("polygon")).alias("b")).select("k", "b.*")


@query(
    """SELECT osmid, k FROM nodes, haz WHERE (x > ox AND x < ox + 5000 AND y > oy AND y < oy + 1600)
      OR (x > ox AND x < ox + 1700 AND y > oy AND y < oy + 5000)""",
    "hazard",
)
def point_in_polygon(spark, d):
    return J.spatial_join(nodes(spark, d), hazard(spark, d), "inner", "within").select("osmid", "k")


_CORNERS = "(SELECT k AS ck, ox + dx AS x, oy + dy AS y FROM haz, (VALUES (0, 0), (5000, 1600), (1700, 1600), (2500, 0), (1700, 3000), (1701, 3000), (-1, 0), (800, 1600)) t(dx, dy))"


@query(f"SELECT DISTINCT ck, x, y, k FROM {_CORNERS}, boxes WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1", "hazard")
def boundary_inclusive(spark, d):
    h = hazard(spark, d)
    first = F.element_at(F.element_at("polygon", 1), 1)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (5000, 1600), (1700, 1600), (2500, 0), (1700, 3000), (1701, 3000), (-1, 0), (800, 1600))]))
    at = h.select(F.col("k").alias("ck"), first.alias("o"), offsets.alias("d")).select("ck", (F.col("o.x") + F.col("d.dx")).alias("x"), (F.col("o.y") + F.col("d.dy")).alias("y"))
    return J.spatial_join(at, h).select("ck", "x", "y", "k")


@query(
    """SELECT k, round((5000.0 * 1600 * (ox + 2500) + 1700.0 * 3400 * (ox + 850)) / (5000.0 * 1600 + 1700.0 * 3400), 6)::DOUBLE AS x,
      round((5000.0 * 1600 * (oy + 800) + 1700.0 * 3400 * (oy + 3300)) / (5000.0 * 1600 + 1700.0 * 3400), 6)::DOUBLE AS y FROM haz""",
    "hazard",
)
def centroid_polygon(spark, d):
    c = G.polygon_centroid(F.col("polygon"))
    return hazard(spark, d).select("k", F.round(c.x, 6).alias("x"), F.round(c.y, 6).alias("y"))


@query(
    """SELECT k, i::INTEGER AS corner, (ox + dx) * 0.5::DOUBLE + (ox + sx) * 0.5::DOUBLE AS x, (oy + dy) * 0.5::DOUBLE + (oy + sy) * 0.5::DOUBLE AS y FROM haz,
      (VALUES (0, 0, 0, -1000, -1000), (1, 5000, 0, -1000, -1000), (2, 5000, 1600, 6000, -1000), (3, 1700, 1600, 6000, 6000),
        (4, 1700, 5000, 6000, 6000), (5, 0, 5000, -1000, 6000), (6, 0, 0, -1000, -1000)) t(i, dx, dy, sx, sy)""",
    "hazard",
)
def interpolate_polygon(spark, d):
    ring = F.element_at("polygon", 1)
    o = F.element_at(ring, 1)
    outer = F.array(*[G.point(o.x + a, o.y + b) for a, b in ((-1000, -1000), (6000, -1000), (6000, 6000), (-1000, 6000), (-1000, -1000))])
    return hazard(spark, d).select("k", F.posexplode(G.interpolate_rings(ring, outer, 0.5)).alias("corner", "p")).select("k", "corner", "p.x", "p.y")


@query("SELECT osmid, x, y FROM nodes WHERE x >= 5000 AND x <= 20500 AND y >= 1000 AND y <= 15500", "nodes")
def clip_points(spark, d):
    return C.points_in_box(nodes(spark, d), 5000, 1000, 20500, 15500)


@query(
    """SELECT u, v, key, round(x1 + t0 * (x2 - x1), 6) AS cx1, round(y1 + t0 * (y2 - y1), 6) AS cy1,
      round(x1 + t1 * (x2 - x1), 6) AS cx2, round(y1 + t1 * (y2 - y1), 6) AS cy2
    FROM (SELECT *, greatest(0.0::DOUBLE,
        CASE WHEN x2 > x1 THEN (5200 - x1) / (x2 - x1)::DOUBLE WHEN x2 < x1 THEN (20700 - x1) / (x2 - x1)::DOUBLE END,
        CASE WHEN y2 > y1 THEN (1200 - y1) / (y2 - y1)::DOUBLE WHEN y2 < y1 THEN (15700 - y1) / (y2 - y1)::DOUBLE END) AS t0,
      least(1.0::DOUBLE,
        CASE WHEN x2 > x1 THEN (20700 - x1) / (x2 - x1)::DOUBLE WHEN x2 < x1 THEN (5200 - x1) / (x2 - x1)::DOUBLE END,
        CASE WHEN y2 > y1 THEN (15700 - y1) / (y2 - y1)::DOUBLE WHEN y2 < y1 THEN (1200 - y1) / (y2 - y1)::DOUBLE END) AS t1 FROM edges)
    WHERE t0 <= t1 AND (x1 <> x2 OR x1 BETWEEN 5200 AND 20700) AND (y1 <> y2 OR y1 BETWEEN 1200 AND 15700)""",
    "edges",
)
def clip_lines_rect(spark, d):
    cut = C.clip_lines(edges(spark, d), 5200, 1200, 20700, 15700)
    return cut.select("u", "v", "key", F.explode("parts").alias("p")).select("u", "v", "key", *[F.round(f"p.{c}", 6).alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")])


# Spatial joins

_IN_DISTRICT = "x > dx0 AND x < dx1 AND y > dy0 AND y < dy1"
_IN_HAZARD = "EXISTS (SELECT 1 FROM boxes WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1)"


@query("SELECT osmid, did FROM nodes, districts WHERE x >= dx0 AND x <= dx1 AND y >= dy0 AND y <= dy1 AND name IS NOT NULL", "districts")
def spatial_inner_join(spark, d):
    return J.spatial_join(nodes(spark, d), districts(spark, d).where("name is not null")).select("osmid", "did")


@query(f"SELECT osmid, name FROM nodes LEFT JOIN (SELECT * FROM districts WHERE level = 4) ON {_IN_DISTRICT}", "districts")
def spatial_left_join(spark, d):
    return J.spatial_join(nodes(spark, d), districts(spark, d).where("level = 4"), "left", "within").select("osmid", "name")


@query(
    """SELECT u, v, key, did FROM edges, districts WHERE level = 4 AND least(x1, x2) > dx0 AND greatest(x1, x2) < dx1
      AND least(y1, y2) > dy0 AND greatest(y1, y2) < dy1""",
    "edges",
    "districts",
)
def lines_within(spark, d):
    return J.spatial_join(edges(spark, d), districts(spark, d).where("level = 4"), "inner", "within", line="line").select("u", "v", "key", "did")


@query(f"SELECT osmid FROM nodes WHERE {_IN_HAZARD}", "hazard")
def spatial_semi(spark, d):
    return J.spatial_join(nodes(spark, d), hazard(spark, d), "semi").select("osmid")


@query(f"SELECT osmid FROM nodes WHERE NOT {_IN_HAZARD}", "hazard")
def spatial_anti(spark, d):
    return J.spatial_join(nodes(spark, d), hazard(spark, d), "anti").select("osmid")


@query(f"SELECT osmid, {_IN_HAZARD} AS flooded FROM nodes", "hazard")
def spatial_flag(spark, d):
    return J.spatial_join(nodes(spark, d), hazard(spark, d), "flag", key=["osmid"]).select("osmid", "flooded")


@query(f"SELECT round(100.0 * sum(CASE WHEN {_IN_HAZARD} THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS percentage FROM nodes", "hazard")
def flooded_share(spark, d):
    return E.flooded_share(nodes(spark, d), hazard(spark, d), ["osmid"]).select(F.round("percentage", 6).alias("percentage"))


@query(
    """SELECT pid, (arg_min(osmid, {'d': d2, 'o': osmid})) AS osmid, min(d2) AS d2
    FROM (SELECT pid, osmid, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM points, nodes) GROUP BY pid""",
    "points",
)
def nearest_node(spark, d):
    return J.nearest(off_grid_points(spark, d), nodes(spark, d), "pid").select("pid", "osmid", F.col("distance").alias("d2"))


# Disrupted graphs


@query("SELECT u, v, key FROM affected", "affected")
def affected_edges(spark, d):
    return R.affected_edges(edges(spark, d), hazard(spark, d)).select("u", "v", "key")


@query("SELECT u, v, key, length FROM dry", "affected")
def disrupted_edges_bridges(spark, d):
    return R.disrupted_edges(edges(spark, d), hazard(spark, d)).select("u", "v", "key", "length")


@query(f"SELECT osmid FROM nodes WHERE NOT ({_IN_HAZARD} AND EXISTS (SELECT 1 FROM affected WHERE u = osmid OR v = osmid))", "affected")
def disrupted_nodes(spark, d):
    h = hazard(spark, d)
    return R.disrupted_nodes(nodes(spark, d), R.affected_edges(edges(spark, d), h), h).select("osmid")


@query("SELECT u, v, key FROM edges WHERE bridge IS NOT NULL OR (has_geom AND (u, v, key) NOT IN (SELECT (u, v, key) FROM meets))", "affected")
def disrupted_by_edges(spark, d):
    drawn = edges(spark, d).withColumn("line", F.when(F.col("has_geom"), F.col("line")))
    return R.disrupted_by_edges(drawn, nodes(spark, d), hazard(spark, d))[1].select("u", "v", "key")


@query(
    """SELECT (SELECT count(*) FROM edges) AS n_all, (SELECT count(*) FROM affected) AS n_affected,
      (SELECT count(*) FROM dry) AS n_unaffected, (SELECT count(*) FROM edges) = (SELECT count(*) FROM affected) + (SELECT count(*) FROM dry) AS whole""",
    "affected",
)
def split_invariant(spark, d):
    split = R.split_edges(edges(spark, d), hazard(spark, d)).agg(F.count("*").alias("n_all"), F.count_if(F.col("affected")).alias("n_affected"), F.count_if(~F.col("affected")).alias("n_unaffected"))
    return split.withColumn("whole", F.col("n_all") == F.col("n_affected") + F.col("n_unaffected"))


@query("SELECT u, v, key, length, false AS reversed FROM edges UNION ALL SELECT v, u, key, length, true FROM edges", "edges")
def to_undirected(spark, d):
    return R.undirected(edges(spark, d)).select("u", "v", "key", "length", "reversed")


@query(
    """SELECT u, v, key, round(length / (coalesce(speed, avg(speed) OVER (PARTITION BY highway), avg(speed) OVER ()) / 3.6::DOUBLE), 6) AS travel_time
    FROM (SELECT *, 'class' || (u % 3)::VARCHAR AS highway, CASE WHEN v % 4 = 0 AND u % 3 <> 2 THEN (30 + u % 5 * 10)::DOUBLE END AS speed FROM edges)""",
    "edges",
)
def travel_time(spark, d):
    e = edges(spark, d).withColumn("highway", F.concat(F.lit("class"), (F.col("u") % 3).cast("string")))
    e = e.withColumn("speed_kph", F.when((F.col("v") % 4 == 0) & (F.col("u") % 3 != 2), (30 + F.col("u") % 5 * 10).cast("double")))
    return R.travel_times(e).select("u", "v", "key", F.round("travel_time", 6).alias("travel_time"))


# Samples


@query(
    """SELECT least((y + 500) * 20 // (nrows * 1000 + 500), 19)::INTEGER AS row, least((x + 500) * 25 // 40500, 24)::INTEGER AS column, count(*) AS n, min(osmid) AS osmid
    FROM nodes, dims GROUP BY 1, 2""",
    "nodes",
)
def grid_sample_cells(spark, d):
    from .fixtures import rows_and_count

    n = nodes(spark, d)
    rows, _ = rows_and_count(n)
    return sampling.one_per_cell(sampling.grid_cells(n, -500, -500, 40000, rows * 1000, 20, 25), None).select("row", "column", "n", "osmid")


@query(f"SELECT osmid FROM nodes WHERE EXISTS (SELECT 1 FROM districts WHERE name IS NOT NULL AND {_IN_DISTRICT})", "districts")
def boundary_filter(spark, d):
    return sampling.in_named_districts(nodes(spark, d), districts(spark, d)).select("osmid")


# Routing and scores


#: The service types of the fixture.
TYPES = ["fire_station", "hospital"]


def _distances(spark, d, with_path: bool = False, states: tuple[str, ...] = (A.NORMAL, A.DISRUPTED), strategy: str = "auto") -> DataFrame:
    e = edges(spark, d)
    dry = R.disrupted_edges(e, hazard(spark, d)) if A.DISRUPTED in states else None
    return A.distances(e, dry, services(spark, d), strategy, with_path, states, TYPES)


def _scored(spark, d) -> DataFrame:
    """service_type, osmid, x, y, route_length_normal, route_length_disrupted, score for all nodes."""
    rows = A.distance_rows(nodes(spark, d), _distances(spark, d), services(spark, d), TYPES)
    return A.scores(rows).select("service_type", F.col("to_node_id").alias("osmid"), "to_centroid.x", "to_centroid.y", "route_length_normal", "route_length_disrupted", "score")


@query("SELECT service_type, node, d AS distance FROM dist WHERE state = 'normal'", "scored")
def multi_source_normal(spark, d):
    return _distances(spark, d, states=(A.NORMAL,)).select("service_type", "node", "distance")


@query("SELECT service_type, node, d AS distance FROM dist WHERE state = 'disrupted'", "scored")
def multi_source_disrupted(spark, d):
    return _distances(spark, d, states=(A.DISRUPTED,)).select("service_type", "node", "distance")


@query(
    """SELECT osmid AS node, CASE WHEN count(length) = 4 THEN sum(length)::BIGINT END AS truncated
    FROM nodes LEFT JOIN edges ON key = 0 AND v = u + 1 AND u BETWEEN osmid AND osmid + 3 GROUP BY 1""",
    "edges",
)
def route_length_truncated(spark, d):
    """Five nodes in a row, every second time the other way round; at a row's end hops are missing."""
    from ..operators.routing import route_length_truncated as truncated

    n = F.col("osmid")
    row = F.array(*[n + k for k in range(5)])
    paths = nodes(spark, d).select(n.alias("node"), F.when(n % 2 == 0, row).otherwise(F.reverse(row)).alias("path"))
    return truncated(paths, edges(spark, d), ["node"]).select("node", F.col("route_length").alias("truncated"))


@query("SELECT service_type, osmid, n AS route_length_normal, d AS route_length_disrupted, score FROM scored", "scored")
def roa_scores(spark, d):
    return _scored(spark, d).select("service_type", "osmid", "route_length_normal", "route_length_disrupted", "score")


@query("SELECT service_type, round(avg(score), 6) AS mean_score FROM scored GROUP BY service_type", "scored")
def roa_overall(spark, d):
    return A.overall(_scored(spark, d))


@query(
    """SELECT least(floor(score * 10)::INTEGER, 9) AS bin, count(*) AS n FROM (SELECT score FROM scored) GROUP BY 1""",
    "scored",
)
def score_histogram(spark, d):
    return T.histogram(_scored(spark, d), "score", 0.0, 1.0)


@query("SELECT district_name, service_type, round(avg(score), 6) AS mean_score, count(*) AS n FROM joined WHERE district_name IS NOT NULL GROUP BY 1, 2", "joined")
def district_mean(spark, d):
    return A.district_means(A.with_districts(_scored(spark, d), districts(spark, d)))


def _summary_columns(kind: str) -> str:
    linked = f"WHERE service_type = '{kind}' AND score > 0"
    return f"""round(avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE service_type = '{kind}'), 6)::DOUBLE AS {kind}_cut_off,
      round(avg(score) FILTER (WHERE service_type = '{kind}'), 6) AS {kind}_score, round(avg(score) FILTER ({linked}), 6) AS {kind}_linked_score,
      round(avg(n) FILTER ({linked}), 6) AS {kind}_normal, round(avg(d) FILTER ({linked}), 6) AS {kind}_disrupted"""


@query(f"SELECT district_name, {_summary_columns('fire_station')}, {_summary_columns('hospital')} FROM joined WHERE district_name IS NOT NULL GROUP BY 1", "joined")
def district_summary(spark, d):
    return A.district_summary(A.with_districts(_scored(spark, d), districts(spark, d)))


@query(
    """SELECT 'any' AS "from", osmid AS to_node_id, n::BIGINT AS normal_distance, d AS disrupted_distance, d - n::BIGINT AS difference,
      CASE WHEN d = 'infinity'::DOUBLE THEN 0 WHEN d = 0 THEN 1 ELSE n::BIGINT / d END::DOUBLE AS score FROM scored WHERE service_type = 'hospital' AND n < 'infinity'::DOUBLE""",
    "scored",
)
def pairwise_scores(spark, d):
    own = _scored(spark, d).where("service_type = 'hospital' and route_length_normal < double('infinity')")
    side = lambda c: own.select(F.lit("any").alias("from"), F.col("osmid").alias("to_node_id"), F.col(c).alias("route_length"))
    return A.pairwise_scores(side("route_length_normal"), side("route_length_disrupted"))


@query("SELECT osmid, service_type, CASE WHEN score = 0 THEN 1 WHEN score <= 0.25 THEN 2 WHEN score < 0.75 THEN 3 WHEN score < 1 THEN 4 ELSE 5 END AS bucket FROM scored", "scored")
def score_bucket(spark, d):
    return _scored(spark, d).select("osmid", "service_type", S.bucket(F.col("score")).alias("bucket"))


@query("SELECT b, 'rgb(' || least(255.0::DOUBLE, (1 - s) * 510)::VARCHAR || ',' || least(255.0::DOUBLE, s * 510)::VARCHAR || ',0)' AS color FROM (SELECT b, b / 8.0::DOUBLE AS s FROM range(9) t(b))")
def score_color(spark, d):
    return spark.range(9).select(F.col("id").alias("b"), S.color(F.col("id") / 8.0).alias("color"))


@query("SELECT osmid, service_type, round(1 - score, 6) AS weight FROM scored", "scored")
def heat_weight(spark, d):
    return _scored(spark, d).select("osmid", "service_type", F.round(S.heat_weight(F.col("score")), 6).alias("weight"))


# Exposure and crops


@query(f"SELECT person_id FROM population WHERE {_IN_HAZARD}", "hazard", "population")
def affected_persons(spark, d):
    return E.affected_persons(population(spark, d), hazard(spark, d), "intersects").select("person_id")


@query(f"SELECT household_id, count(*) AS persons FROM population WHERE {_IN_HAZARD} GROUP BY 1", "hazard", "population")
def affected_households(spark, d):
    return E.affected_households(population(spark, d), hazard(spark, d), "intersects")


@query(
    """SELECT u, v, key FROM edges e WHERE EXISTS (SELECT 1 FROM nodes WHERE (osmid = u OR osmid = v) AND x BETWEEN 5000 AND 20500 AND y BETWEEN 1000 AND 15500)""",
    "edges",
)
def complete_ways_crop(spark, d):
    return C.complete_ways(edges(spark, d), nodes(spark, d), 5000, 1000, 20500, 15500).select("u", "v", "key")
