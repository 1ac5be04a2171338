"""Further registered queries: features by tags, presets, snapping, records, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import accessibility as A, graph as R, spatial_join as J, tables as T
from ..sources import regions, tags
from .fixtures import districts, edges, hazard, nodes, off_grid_points, population, services, table
from .registry import _distances, _scored, query

_FEATURES = """(SELECT p_partkey AS id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'administrative' WHEN 1 THEN 'political' END AS boundary,
  CASE p_size % 5 WHEN 0 THEN 'rail' WHEN 1 THEN 'tram' END AS railway, CASE p_size % 6 WHEN 0 THEN 'river' WHEN 1 THEN 'canal' WHEN 2 THEN 'stream' END AS waterway,
  CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'house' END AS building, CASE p_size % 7 WHEN 0 THEN 'pub' WHEN 1 THEN 'hospital' WHEN 2 THEN 'casino' END AS amenity,
  CASE p_partkey % 2 WHEN 0 THEN 'yes' END AS emergency FROM part)"""


def features(spark, d):
    """Parts seen as map features with tags."""
    size = F.col("p_size")
    pick = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), (size % n).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lit("POINT (0 0)").alias("geometry"),
        pick(4, "administrative", "political").alias("boundary"),
        pick(5, "rail", "tram").alias("railway"),
        pick(6, "river", "canal", "stream").alias("waterway"),
        pick(3, "yes", "house").alias("building"),
        pick(7, "pub", "hospital", "casino").alias("amenity"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("yes")).alias("emergency"),
    )


@query(f"SELECT id AS osm_id, name, boundary FROM {_FEATURES} WHERE boundary = 'administrative'")
def extract_boundaries(spark, d):
    return tags.boundaries(features(spark, d)).select("osm_id", "name", "boundary")


@query(f"SELECT id AS osm_id FROM {_FEATURES} WHERE railway = 'rail'")
def extract_railways(spark, d):
    return tags.railways(features(spark, d)).select("osm_id")


@query(f"SELECT id AS osm_id, waterway FROM {_FEATURES} WHERE waterway IN ('river', 'canal')")
def extract_waterways(spark, d):
    return tags.waterways(features(spark, d)).select("osm_id", "waterway")


@query(f"SELECT amenity, count(*) AS n FROM {_FEATURES} WHERE building = 'yes' GROUP BY 1")
def extract_buildings(spark, d):
    return tags.buildings(features(spark, d)).groupBy("amenity").agg(F.count("*").alias("n"))


@query(f"SELECT id AS osm_id, amenity FROM {_FEATURES} WHERE amenity = 'pub' OR amenity = 'casino'")
def extract_leisure(spark, d):
    return tags.leisure(features(spark, d)).select("osm_id", "amenity")


@query(f"SELECT id, (id * 3)::BIGINT AS position FROM {_FEATURES} WHERE emergency = 'yes' AND amenity = 'hospital' AND id % 4 = 0 AND id <> 8")
def prepare_hospitals(spark, d):
    found = features(spark, d).where("amenity = 'hospital'").select("id", "emergency", F.lit(None).cast("long").alias("position"))
    new = table(spark, d, "part").where(F.col("p_partkey") % 4 == 0).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3).cast("long").alias("position"))
    return T.prepare_hospitals(found, new, 8, "id").select("id", "position")


@query(
    """SELECT * FROM (VALUES ('weser_bergland', 7.2::DOUBLE, 50.89::DOUBLE, 10.329::DOUBLE, 53.079::DOUBLE), ('porta_westfalica', 8.7, 52.15, 9.3, 52.4),
    ('trier_city', 6.558, 49.709, 6.725, 49.835), ('trier_region', 6.55, 49.68, 6.775, 49.85)) t(name, xmin, ymin, xmax, ymax)"""
)
def region_presets(spark, d):
    from functools import reduce

    found = reduce(lambda a, b: a.unionByName(b), [regions.region(spark, n) for n in regions.REGIONS])
    return found.select("name", G.bounds(F.flatten("polygon")).alias("b")).select("name", "b.*")


@query("SELECT osmid, x::DOUBLE AS x, y::DOUBLE AS y FROM nodes", "nodes")
def wkt_points(spark, d):
    text = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    return nodes(spark, d).select("osmid", G.point_of_wkt(text).alias("p")).select("osmid", "p.x", "p.y")


@query("SELECT u, v, key, x1 AS first_x, x2 AS last_x, false AS reversed FROM edges UNION ALL SELECT v, u, key, x2, x1, true FROM edges", "edges")
def reversed_lines(spark, d):
    both = R.undirected(edges(spark, d), "line")
    return both.select("u", "v", "key", F.element_at("line", 1).x.alias("first_x"), F.element_at("line", -1).x.alias("last_x"), "reversed")


@query("SELECT k, list_sort([ox, ox + 5000, ox + 5000, ox + 1700, ox + 1700, ox, ox])::VARCHAR AS xs FROM haz", "hazard")
def flatten_nested(spark, d):
    xs = F.array_sort(F.transform(F.flatten("polygon"), lambda p: p.x))
    return hazard(spark, d).select("k", F.concat(F.lit("["), F.array_join(xs, ", "), F.lit("]")).alias("xs"))


@query(
    """SELECT pid AS osm_id, n.osmid AS node_id, n.x AS node_x, n.y AS node_y FROM points
    JOIN LATERAL (SELECT osmid, x, y FROM nodes ORDER BY (x - px) * (x - px) + (y - py) * (y - py), osmid LIMIT 1) n ON true""",
    "points",
)
def prepare_services(spark, d):
    found = off_grid_points(spark, d).select(F.col("pid").alias("osm_id"), F.col("px").alias("x"), F.col("py").alias("y"))
    return A.prepare_services(found, nodes(spark, d)).select("osm_id", "node_id", "node_x", "node_y")


@query("SELECT osmid AS node_id, name AS district_name FROM nodes, districts WHERE x BETWEEN dx0 AND dx1 AND y BETWEEN dy0 AND dy1", "districts")
def nodes_in_districts(spark, d):
    return J.spatial_join(nodes(spark, d), districts(spark, d)).select(F.col("osmid").alias("node_id"), F.col("name").alias("district_name"))


@query(
    """, best(state, service_type, node, b) USING KEY (state, service_type, node) AS (
      SELECT DISTINCT state, service_type, node_id, {'d': 0::DOUBLE, 's': node_id} FROM services, (VALUES ('normal'), ('disrupted')) s(state)
      UNION
      SELECT t.state, t.service_type, e.v, min({'d': t.b.d + e.length, 's': t.b.s})
      FROM best t JOIN ways e ON e.state = t.state AND e.u = t.node
        LEFT JOIN recurring.best r ON r.state = t.state AND r.service_type = t.service_type AND r.node = e.v
      WHERE r.b IS NULL OR t.b.d + e.length < r.b.d OR (t.b.d + e.length = r.b.d AND t.b.s < r.b.s) GROUP BY t.state, t.service_type, e.v)
    SELECT state, service_type, osmid AS to_node_id, b.s AS from_node_id, (SELECT min(osm_id) FROM services x WHERE x.node_id = b.s AND x.service_type = t.service_type) AS from_osm_id,
      coalesce(b.d, 'infinity'::DOUBLE) AS route_length
    FROM nodes CROSS JOIN (SELECT DISTINCT service_type FROM services) t CROSS JOIN (VALUES ('normal'), ('disrupted')) s(state)
      LEFT JOIN best USING (state, service_type) WHERE best.node = osmid
    UNION ALL
    SELECT state, service_type, osmid, NULL, NULL, 'infinity'::DOUBLE
    FROM nodes CROSS JOIN (SELECT DISTINCT service_type FROM services) t CROSS JOIN (VALUES ('normal'), ('disrupted')) s(state)
    WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.node = osmid AND best.state = s.state AND best.service_type = t.service_type)""",
    "scored",
)
def distance_records(spark, d):
    found = A.distance_rows(nodes(spark, d), _distances(spark, d), services(spark, d))
    return found.select("state", "service_type", "to_node_id", "from_node_id", "from_osm_id", "route_length")


@query(
    """SELECT to_node_id, normal_distance, disrupted_distance, difference, CASE WHEN disrupted_distance = 'infinity'::DOUBLE THEN 0::DOUBLE WHEN disrupted_distance = 0 THEN 1::DOUBLE
      ELSE normal_distance / disrupted_distance END AS score
    FROM (SELECT osmid AS to_node_id, min(n) AS normal_distance, min(d) AS disrupted_distance, min(d) - min(n) AS difference FROM scored GROUP BY osmid)""",
    "scored",
)
def min_distance_scores(spark, d):
    own = _scored(spark, d)
    side = lambda c: own.select(F.col("osmid").alias("to_node_id"), F.col(c).alias("route_length"))
    return A.min_distance_scores(side("route_length_normal"), side("route_length_disrupted"))


@query("SELECT household_id, max(cell_id) AS cell_id, count(*) AS persons FROM population WHERE household_id IN (SELECT osmid FROM nodes WHERE x < 3000) GROUP BY 1", "population")
def households_at_places(spark, d):
    near = nodes(spark, d).where("x < 3000").select(F.col("osmid").alias("household_id"))
    return population(spark, d).join(near, "household_id", "left_semi").groupBy("household_id").agg(F.max("cell_id").alias("cell_id"), F.count("*").alias("persons"))


@query("SELECT osmid, x, y FROM nodes ORDER BY y, x, osmid LIMIT 5", "nodes")
def head_sorted(spark, d):
    return nodes(spark, d).orderBy("y", "x", "osmid").limit(5)
