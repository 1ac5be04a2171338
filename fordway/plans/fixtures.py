"""Spatial views over the driver's tables: a road grid, hazard shapes, services, districts, population.

All arithmetic is on whole numbers that are not negative, so every engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G

WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey").cast("long")
    x = (i % WIDTH) * 1000 + (i * 7919) % 400
    y = _div(i, WIDTH) * 1000 + (i * 104729) % 400
    return table(spark, sf_dir, "customer").select(i.alias("osmid"), x.alias("x"), y.alias("y"))


def rows_and_count(found: DataFrame) -> tuple[int, int]:
    """Grid rows and number of nodes."""
    top, n = found.agg(F.max("osmid"), F.count("*")).first()
    return top // WIDTH + 1, n


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, key, length, bridge, has_geom, line; each way once."""
    n = nodes(spark, sf_dir)
    a = n.select(F.col("osmid").alias("u"), F.struct("x", "y").alias("a"))
    right = a.where(F.col("u") % WIDTH < WIDTH - 1).withColumn("v", F.col("u") + 1)
    down = a.withColumn("v", F.col("u") + WIDTH)
    pairs = right.unionByName(down).join(n.select(F.col("osmid").alias("v"), F.struct("x", "y").alias("b")), "v")
    keys = F.when(F.col("u") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    u, v = F.col("u"), F.col("v")
    return pairs.withColumn("key", F.explode(keys)).select(
        "u",
        "v",
        "key",
        (800 + (u * 7919 + v * 104729) % 700 - 50 * F.col("key")).alias("length"),
        F.when((u * 31 + v) % 13 == 0, F.lit("yes")).alias("bridge"),
        (u % 29 != 0).alias("has_geom"),
        F.array("a", "b").alias("line"),
    )


def hazard(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """k, polygon: an L-shaped ring for each nation."""
    rows = rows or rows_and_count(nodes(spark, sf_dir))[0]
    k = F.col("n_nationkey").cast("long")
    ox, oy = (k * 17 % 35) * 1000 + 500, (k * 11 % rows) * 1000 - 500
    shape = ((0, 0), (5000, 0), (5000, 1600), (1700, 1600), (1700, 5000), (0, 5000), (0, 0))
    ring = F.array(*[G.point(ox + dx, oy + dy) for dx, dy in shape])
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.array(ring).alias("polygon"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_id, service_type, amenity, node_id, x, y."""
    n = nodes(spark, sf_dir)
    _, count = rows_and_count(n)
    s = F.col("s_suppkey").cast("long")
    found = table(spark, sf_dir, "supplier").where(s % 5 < 2)
    kind = F.when(s % 2 == 0, F.lit("hospital")).otherwise(F.lit("fire_station"))
    node = (s * 7919 + F.col("s_nationkey").cast("long") * 31) % count
    found = found.select(s.alias("osm_id"), kind.alias("service_type"), kind.alias("amenity"), node.alias("node_id"))
    return found.join(n.withColumnRenamed("osmid", "node_id"), "node_id").select("osm_id", "service_type", "amenity", "node_id", "x", "y")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """did, level, name, polygon: regions, nations' squares, and one area without a name."""
    rows, _ = rows_and_count(nodes(spark, sf_dir))
    r, k = F.col("r_regionkey").cast("long"), F.col("n_nationkey").cast("long")
    low = lambda v: F.lit(v).cast("long")
    box = lambda *v: G.rectangle(*v).alias("polygon")
    x, y = (k * 13 % 36) * 1000 - 500, (k * 7 % rows) * 1000 - 500
    large = table(spark, sf_dir, "region").select(r.alias("did"), F.lit(2).alias("level"), F.col("r_name").alias("name"), box(r * 8000 - 500, low(-500), r * 8000 + 7500, low(rows * 1000)))
    small = table(spark, sf_dir, "nation").select((k + 100).alias("did"), F.lit(4).alias("level"), F.col("n_name").alias("name"), box(x, y, x + 4000, y + 4000))
    rest = spark.range(1).select(low(999).alias("did"), F.lit(9).alias("level"), F.lit(None).cast("string").alias("name"), box(low(-500), low(-500), low(20500), low(rows * 500 + 1)))
    return large.unionByName(small).unionByName(rest)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("person_id"), F.col("o_custkey").cast("long").alias("household_id"))
    n = nodes(spark, sf_dir).withColumnRenamed("osmid", "household_id")
    return o.join(n, "household_id").select("person_id", "household_id", _div(F.col("household_id"), 10).alias("cell_id"), "x", "y")


def off_grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = rows_and_count(nodes(spark, sf_dir))
    s = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(s.alias("pid"), ((s * 7919 + 137) % 39400).alias("px"), ((s * 104729 + 71) % (rows * 1000)).alias("py"))


_NODES = """nodes AS (
  SELECT c_custkey::BIGINT AS osmid, (c_custkey % 40) * 1000 + (c_custkey * 7919) % 400 AS x,
    (c_custkey // 40) * 1000 + (c_custkey * 104729) % 400 AS y FROM customer),
dims AS (SELECT max(osmid) // 40 + 1 AS nrows, count(*) AS n FROM nodes)"""
_EDGES = """pairs AS (
  SELECT a.osmid AS u, b.osmid AS v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM nodes a JOIN nodes b ON b.osmid = a.osmid + 40 OR (b.osmid = a.osmid + 1 AND a.osmid % 40 < 39)),
edges AS (
  SELECT u, v, k::INTEGER AS key, 800 + (u * 7919 + v * 104729) % 700 - 50 * k AS length,
    CASE WHEN (u * 31 + v) % 13 = 0 THEN 'yes' END AS bridge, u % 29 <> 0 AS has_geom, x1, y1, x2, y2
  FROM pairs, (VALUES (0), (1)) t(k) WHERE k = 0 OR u % 11 = 0)"""
# an L is two boxes, so membership is tested by boxes here and by rings on the other side
_HAZARD = """haz AS (
  SELECT n_nationkey::BIGINT AS k, (n_nationkey::BIGINT * 17 % 35) * 1000 + 500 AS ox,
    (n_nationkey::BIGINT * 11 % nrows) * 1000 - 500 AS oy FROM nation, dims),
boxes AS (
  SELECT k, ox AS bx0, oy AS by0, ox + 5000 AS bx1, oy + 1600 AS by1 FROM haz
  UNION ALL SELECT k, ox, oy, ox + 1700, oy + 5000 FROM haz)"""
_SERVICES = """services AS (
  SELECT s_suppkey::BIGINT AS osm_id, CASE WHEN s_suppkey % 2 = 0 THEN 'hospital' ELSE 'fire_station' END AS service_type,
    (s_suppkey * 7919 + s_nationkey::BIGINT * 31) % n AS node_id FROM supplier, dims WHERE s_suppkey % 5 < 2)"""
_DISTRICTS = """districts AS (
  SELECT r_regionkey::BIGINT AS did, 2 AS level, r_name AS name, r_regionkey::BIGINT * 8000 - 500 AS dx0, -500 AS dy0,
    r_regionkey::BIGINT * 8000 + 7500 AS dx1, nrows * 1000 AS dy1 FROM region, dims
  UNION ALL
  SELECT 100 + n_nationkey::BIGINT, 4, n_name, (n_nationkey::BIGINT * 13 % 36) * 1000 - 500,
    (n_nationkey::BIGINT * 7 % nrows) * 1000 - 500, (n_nationkey::BIGINT * 13 % 36) * 1000 + 3500,
    (n_nationkey::BIGINT * 7 % nrows) * 1000 + 3500 FROM nation, dims
  UNION ALL SELECT 999, 9, NULL, -500, -500, 20500, nrows * 500 + 1 FROM dims)"""
_POPULATION = """population AS (
  SELECT o_orderkey::BIGINT AS person_id, o_custkey::BIGINT AS household_id, o_custkey::BIGINT // 10 AS cell_id, x, y
  FROM orders JOIN nodes ON osmid = o_custkey)"""
_POINTS = """points AS (
  SELECT s_suppkey::BIGINT AS pid, (s_suppkey * 7919 + 137) % 39400 AS px, (s_suppkey * 104729 + 71) % (nrows * 1000) AS py
  FROM supplier, dims)"""
# a segment and a box are apart if a side of the box or the segment's own line parts them
_AFFECTED = """meets AS (
  SELECT DISTINCT u, v, key FROM edges, boxes
  WHERE greatest(x1, x2) >= bx0 AND least(x1, x2) <= bx1 AND greatest(y1, y2) >= by0 AND least(y1, y2) <= by1
    AND greatest((x2 - x1) * (by0 - y1) - (y2 - y1) * (bx0 - x1), (x2 - x1) * (by1 - y1) - (y2 - y1) * (bx0 - x1),
                 (x2 - x1) * (by0 - y1) - (y2 - y1) * (bx1 - x1), (x2 - x1) * (by1 - y1) - (y2 - y1) * (bx1 - x1)) >= 0
    AND least((x2 - x1) * (by0 - y1) - (y2 - y1) * (bx0 - x1), (x2 - x1) * (by1 - y1) - (y2 - y1) * (bx0 - x1),
              (x2 - x1) * (by0 - y1) - (y2 - y1) * (bx1 - x1), (x2 - x1) * (by1 - y1) - (y2 - y1) * (bx1 - x1)) <= 0),
affected AS (SELECT e.* FROM edges e JOIN meets USING (u, v, key) WHERE bridge IS NULL),
dry AS (SELECT * FROM edges ANTI JOIN affected USING (u, v, key))"""
_DISTANCES = """ways AS (
  SELECT 'normal' AS state, u, v, length FROM edges UNION ALL SELECT 'normal', v, u, length FROM edges
  UNION ALL SELECT 'disrupted', u, v, length FROM dry UNION ALL SELECT 'disrupted', v, u, length FROM dry),
dist(state, service_type, node, d) USING KEY (state, service_type, node) AS (
  SELECT DISTINCT state, service_type, node_id, 0::DOUBLE FROM services, (VALUES ('normal'), ('disrupted')) s(state)
  UNION
  SELECT t.state, t.service_type, e.v, min(t.d + e.length)
  FROM dist t JOIN ways e ON e.state = t.state AND e.u = t.node
    LEFT JOIN recurring.dist r ON r.state = t.state AND r.service_type = t.service_type AND r.node = e.v
  WHERE t.d + e.length < coalesce(r.d, 1e300) GROUP BY t.state, t.service_type, e.v),
scored AS (
  SELECT t.service_type, osmid, x, y, coalesce(a.d, 'infinity'::DOUBLE) AS n, coalesce(b.d, 'infinity'::DOUBLE) AS d,
    CASE WHEN b.d IS NULL THEN 0::DOUBLE WHEN b.d = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, a.d / b.d) END AS score
  FROM nodes CROSS JOIN (SELECT DISTINCT service_type FROM services) t
    LEFT JOIN dist a ON a.state = 'normal' AND a.service_type = t.service_type AND a.node = osmid
    LEFT JOIN dist b ON b.state = 'disrupted' AND b.service_type = t.service_type AND b.node = osmid)"""
_JOINED = """joined AS (
  SELECT s.*, name AS district_name FROM scored s
    LEFT JOIN districts ON x > dx0 AND x < dx1 AND y > dy0 AND y < dy1)"""


def with_views(select: str, *names: str) -> str:
    """A query after the named views, each with those it needs."""
    parts = {"nodes": _NODES, "edges": _EDGES, "hazard": _HAZARD, "services": _SERVICES, "districts": _DISTRICTS, "population": _POPULATION, "points": _POINTS, "affected": _AFFECTED, "scored": _DISTANCES, "joined": _JOINED}
    needs = {"affected": ("edges", "hazard"), "scored": ("affected", "services"), "joined": ("scored", "districts")}
    chosen: list[str] = ["nodes"]

    def add(name: str) -> None:
        for n in needs.get(name, ()):
            add(n)
        if name not in chosen:
            chosen.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(parts[n] for n in chosen) + "\n" + select
