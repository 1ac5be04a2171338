"""Hand-solved graphs, invariants and strategies against each other."""

import pytest
from pyspark.sql import functions as F

from fordway.functions import geometry as G
from fordway.operators import accessibility as A, graph as R, routing, sampling, spatial_join as J
from fordway.plans import fixtures as X


def polygon(spark, *boxes):
    return spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], "k int, a double, b double, c double, d double").select("k", G.rectangle(*map(F.col, "abcd")).alias("polygon"))


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 8)], "osmid long, x double, y double")
    wet, dry = [(0.0, 5.0), (1.0, 5.0)], [(0.0, 50.0), (1.0, 50.0)]
    rows = [("a", 1, 2, dry, None), ("b", 1, 3, wet, None), ("c", 1, 4, wet, "yes"), ("d", 1, 5, wet, "no"), ("e", 1, 6, None, None), ("f", 1, 7, None, "yes"), ("g", 2, 3, wet, "")]
    edges = spark.createDataFrame([(n, u, v, 0, 1.0, line, b) for n, u, v, line, b in rows], f"name string, u long, v long, key int, length double, line {G.LINE}, bridge string")
    return nodes, edges, polygon(spark, (-1, 4, 2, 6))


def test_both_rules_of_disruption(small):
    nodes, edges, hazard = small
    old = R.disrupted_by_edges(edges, nodes, hazard)[1]
    assert {r.name for r in old.collect()} == set("acdf")
    new = R.disrupted_edges(R.with_lines(edges, nodes), hazard)
    assert {r.name for r in new.collect()} == set("acdefg")
    strict = R.disrupted_edges(R.with_lines(edges, nodes), hazard, exclude_bridges=False)
    assert {r.name for r in strict.collect()} == set("aef")


def test_node_filter(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 1.0, 1.0)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 1.0, None)], "u long, v long, key int, length double, bridge string")
    hazard = polygon(spark, (-1, -1, 2, 2))
    hit = R.affected_edges(R.with_lines(edges, nodes), hazard)
    assert {r.osmid for r in R.disrupted_nodes(nodes, hit, hazard).collect()} == {2, 3}


def test_undirected(small):
    got = R.undirected(small[1], "line").where("name = 'a'").collect()
    assert sorted((r.u, r.v, r.reversed, [p.x for p in r.line]) for r in got) == [(1, 2, False, [0.0, 1.0]), (2, 1, True, [1.0, 0.0])]


def test_parallel_edges(spark):
    edges = spark.createDataFrame([("g", 1, 2, 0, 10.9), ("g", 1, 2, 1, 5.2)], "g string, u long, v long, key int, length double")
    sources = spark.createDataFrame([("g", 1)], "g string, node long")
    got = {r.node: r for r in routing.shortest_paths(edges, sources, ["g"], "local", with_path=True).collect()}
    assert (got[2].distance, got[2].path, got[1].distance, got[1].path) == (5.2, [1, 2], 0.0, [1])
    paths = routing.shortest_paths(edges, sources, ["g"], "local", with_path=True)
    assert {r.node: r.route_length for r in routing.route_length_truncated(paths, edges.drop("g"), ["node"]).collect()} == {1: 0, 2: 10}


def test_route_lines(spark):
    edges = spark.createDataFrame([(1, 2, 0, [(0.0, 0.0), (1.0, 0.0)]), (3, 2, 0, [(2.0, 0.0), (1.0, 0.0)])], f"u long, v long, key int, line {G.LINE}")
    paths = spark.createDataFrame([(9, [1, 2, 3])], "node long, path array<long>")
    got = routing.route_lines(paths, edges, ["node"]).first().lines
    assert [[p.x for p in line] for line in got] == [[0.0, 1.0], [1.0, 2.0]]


def test_strategies_agree(spark, sf):
    edges = X.edges(spark, sf)
    services = X.services(spark, sf)
    dry = R.disrupted_edges(edges, X.hazard(spark, sf))
    both = [sorted((r.state, r.service_type, r.node, r.distance, r.source) for r in A.distances(edges, dry, services, s).collect()) for s in ("local", "frontier")]
    assert both[0] == both[1]
    reach = {}
    for state, kind, node, d, _ in both[0]:
        reach.setdefault((state, kind), {})[node] = d
    assert {k: len(v) for k, v in reach.items()} == {("normal", "hospital"): 150, ("normal", "fire_station"): 150, ("disrupted", "hospital"): 39, ("disrupted", "fire_station"): 2}
    for kind in ("hospital", "fire_station"):
        assert all(d >= reach["normal", kind][n] for n, d in reach["disrupted", kind].items())
    with pytest.raises(ValueError):
        routing.shortest_paths(edges, services, ["state"], "other")


def test_per_service(spark):
    edges = spark.createDataFrame([("g", a, b, 0, 1.0) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2))], "g string, u long, v long, key int, length double")
    got = routing.per_service_paths(edges, spark.createDataFrame([("g", 1), ("g", 3)], "g string, node long"), ["g"]).collect()
    assert sorted((r.service, r.node, r.distance) for r in got) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (3, 1, 2.0), (3, 2, 1.0), (3, 3, 0.0)]


def test_whole_calculation(spark, sf):
    nodes, edges, hazard = X.nodes(spark, sf), X.edges(spark, sf), X.hazard(spark, sf)
    services = X.services(spark, sf)
    rows = A.robustness_of_networks(nodes, edges, hazard, services, lonlat=False)
    scored = A.scores(rows)
    assert {r.service_type: r.mean_score for r in A.overall(scored).collect()} == pytest.approx({"hospital": 0.2567, "fire_station": 0.0133}, abs=1e-4)
    assert scored.where("score < 0 or score > 1").isEmpty()
    record = rows.columns
    assert record == ["state", "from_name", "from_node_id", "from_position", "from_osm_id", "to_node_id", "to_centroid", "service_type", "route_length", "route", "travel_time"]
    far = rows.where("route_length = double('infinity')").first()
    assert far.from_node_id is None and far.from_name is None
    near = rows.where("route_length = 0").first()
    assert near.from_name == f"{near.service_type}_{near.from_osm_id}"
    snapped = A.prepare_services(services.drop("node_id"), nodes)
    assert all(r.a == r.b for r in snapped.select(F.col("node_id").alias("a"), "osm_id").join(services.select("osm_id", F.col("node_id").alias("b")), "osm_id").collect())
    area = polygon(spark, (-500, -500, 40000, 4000))
    sampled = A.robustness_of_networks(nodes, edges, hazard, services, area, X.districts(spark, sf), samples=40, lonlat=False)
    assert 0 < sampled.count() < rows.count()


def test_positions_win(spark, sf):
    nodes = X.nodes(spark, sf)
    s = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0, (2000.0, 3000.0))], "osm_id long, x double, y double, position struct<x: double, y: double>")
    got = {r.osm_id: r.node_id for r in A.prepare_services(s, nodes).collect()}
    assert got[1] == 0 and got[2] != 0


def test_sampling(spark, sf):
    nodes = X.nodes(spark, sf)
    area = polygon(spark, (-500, -500, 40000, 4000))
    draws = [sorted(r.osmid for r in sampling.draw_sample(nodes, area, samples=60, seed=s, lonlat=False).collect()) for s in (42, 42, 7)]
    assert draws[0] == draws[1] != draws[2]
    cells = sampling.grid_cells(nodes, 0, 0, 39400, 3400, 4, 8)
    assert cells.select("row", "column").distinct().count() == sampling.one_per_cell(cells).count()


def test_sampling_of_narrow_areas(spark):
    """An area narrower or lower than a cell is sampled in strips, and none of its nodes is left out."""
    places = lambda x, y: spark.range(1, 1000).select(F.col("id").alias("osmid"), F.expr(x).alias("x"), F.expr(y).alias("y"))
    line, tall, flat = places("2L", "id"), polygon(spark, (0, 0, 4, 1000)), polygon(spark, (0, 0, 1000, 4))
    for nodes, area, side, other in ((line, tall, "row", "column"), (places("id", "2L"), flat, "column", "row")):
        got = sampling.draw_sample(nodes, area, distance_m=100.0, lonlat=False).collect()
        assert sorted(r[side] for r in got) == list(range(10)) and {r[other] for r in got} == {-1}
        assert sorted(r.n for r in got) == [99] + 9 * [100]
    by_number = sampling.draw_sample(line, tall, samples=60, lonlat=False).collect()
    assert len(by_number) == 122 and sum(r.n for r in by_number) == 999
    with pytest.raises(ValueError):
        sampling.draw_sample(line, tall, distance_m=2000.0, lonlat=False)


def test_borders_between_districts(spark):
    """A place on a border is in the union if no gap is left around it."""
    boxes = polygon(spark, (0, 0, 4, 4), (4, 0, 8, 4), (0, 4, 4, 8), (20, 0, 24, 4), (24, 2, 28, 6), (40, 0, 44, 4), (44, 4, 48, 8)).withColumn("name", F.lit("d"))
    bent = spark.createDataFrame([(9, [[(60.0, 0.0), (66.0, 0.0), (66.0, 2.0), (62.0, 2.0), (62.0, 6.0), (60.0, 6.0), (60.0, 0.0)]], "l"), (10, [[(62.0, 2.0), (66.0, 2.0), (66.0, 6.0), (62.0, 6.0), (62.0, 2.0)]], "r"), (11, [[(80.0, 0.0), (89.0, 0.0), (89.0, 9.0), (80.0, 9.0), (80.0, 0.0)], [(83.0, 3.0), (86.0, 3.0), (86.0, 6.0), (84.0, 6.5), (83.0, 6.0), (83.0, 3.0)]], "h"), (12, [[(83.0, 3.0), (86.0, 3.0), (86.0, 6.0), (84.0, 6.5), (83.0, 6.0), (83.0, 3.0)]], "fill")], f"k int, polygon {G.POLYGON}, name string")
    spots = [(4, 2, True), (4, 0, False), (4, 4, False), (2, 4, True), (1, 1, True), (8, 1, False), (24, 3, True), (24, 2, False), (24, 1, False), (24, 4, False), (44, 4, False), (62, 2, True), (64, 2, True), (66, 2, False), (60, 3, False), (83, 3, True), (84, 3, True), (83, 5, True), (89, 5, False), (99, 99, False), (None, 1, False)]
    points = spark.createDataFrame([(k, None if x is None else float(x), float(y)) for k, (x, y, _) in enumerate(spots)], "osmid long, x double, y double")
    whole = sampling.in_named_districts(points, boxes.unionByName(bent).unionByName(boxes.limit(1).withColumn("name", F.lit(None).cast("string"))))
    assert {r.osmid for r in whole.collect()} == {k for k, (_, _, inside) in enumerate(spots) if inside}


def test_sample_fraction(spark):
    df = spark.range(2000)
    half = [r.id for r in sampling.fraction(df, 0.5, 7).collect()]
    assert half == [r.id for r in sampling.fraction(df, 0.5, 7).collect()] and 850 < len(half) < 1150


def test_districts_and_summaries(spark):
    d = polygon(spark, (0, 0, 10, 10), (2, 2, 6, 6)).withColumn("name", F.concat(F.lit("d"), "k"))
    s = spark.createDataFrame([("hospital", 1, 3.0, 3.0, 10.0, 20.0, 0.5), ("hospital", 2, 9.0, 9.0, 10.0, float("inf"), 0.0), ("hospital", 3, 99.0, 9.0, 1.0, 1.0, 1.0)], "service_type string, osmid long, x double, y double, route_length_normal double, route_length_disrupted double, score double")
    joined = A.with_districts(s, d)
    assert sorted((r.osmid, r.district_name) for r in joined.collect() if r.district_name) == [(1, "d0"), (1, "d1"), (2, "d0")]
    assert joined.count() == 4 and A.with_districts(s, d, dedupe=True).count() == 3
    got = {r.district_name: r for r in A.district_summary(joined).collect()}
    assert (got["d0"].hospital_cut_off, got["d0"].hospital_score, got["d0"].hospital_linked_score, got["d0"].hospital_disrupted) == (0.5, 0.25, 0.5, 20.0)
    assert got["d1"].fire_station_score is None


def test_pairs(spark):
    rows = lambda *v: spark.createDataFrame(v, "from string, to_node_id long, route_length double")
    got = A.pairwise_scores(rows(("a", 1, 10.9), ("a", 2, 0.0)), rows(("a", 1, 5.0), ("a", 2, 0.0))).orderBy("to_node_id").collect()
    assert [(r.normal_distance, r.score) for r in got] == [(10, 2.0), (0, 1.0)]
    with pytest.raises(ValueError):
        A.pairwise_scores(rows(("a", 1, 1.0), ("a", 1, 2.0)), rows(("a", 1, 1.0)))
    assert A.min_distance_scores(rows(("a", 1, 5.0), ("b", 1, 4.0)), rows(("a", 1, 8.0), ("b", 1, float("inf")))).first().score == 0.5


def test_nearest(spark):
    nodes = spark.createDataFrame([(k, k % 7 * 10, k // 7 * 10) for k in range(49)] + [(100, 5000, 5000)], "osmid long, x long, y long")
    points = spark.createDataFrame([(1, 14, 1), (2, -900, -900), (3, 5, 0), (4, 4000, 4000), (5, 2400, 2400)], "pid long, px long, py long")
    got = {r.pid: r.osmid for r in J.nearest(points, nodes, "pid").collect()}
    brute = {}
    n = [tuple(r) for r in nodes.collect()]
    for p in points.collect():
        brute[p.pid] = min(((x - p.px) ** 2 + (y - p.py) ** 2, o) for o, x, y in n)[1]
    assert got == brute
    lonlat = nodes.select("osmid", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))
    near = J.nearest(points.select("pid", (F.col("px") / 1000).alias("px"), (F.col("py") / 1000).alias("py")), lonlat, "pid", metric="haversine")
    assert {r.pid: r.osmid for r in near.collect()}[1] == brute[1]
    assert J.nearest(points, nodes.where("osmid < 0"), "pid").where("osmid is null").count() == 5


def test_joins_keep_their_kinds(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0), (3, 5.0, 5.0), (4, None, 1.0)], "k long, x double, y double")
    boxes = polygon(spark, (0, 0, 5, 5), (0, 0, 2, 2)).withColumnRenamed("k", "box")
    count = lambda how, p="intersects": J.spatial_join(points, boxes, how, p, key=["k"]).count()
    assert (count("inner"), count("left"), count("semi"), count("anti"), count("flag")) == (3, 5, 2, 2, 4)
    assert count("inner", "within") == 2
    flags = {r.k: r.flooded for r in J.spatial_join(points, boxes, "flag").collect()}
    assert flags == {1: True, 2: False, 3: True, 4: False}
    with pytest.raises(ValueError):
        J.spatial_join(points, boxes, "cross")
    lines = spark.createDataFrame([(1, [(-1.0, 1.0), (9.0, 1.0)]), (2, [(8.0, 8.0), (9.0, 9.0)])], f"k long, line {G.LINE}")
    assert sorted((r.k, r.box) for r in J.spatial_join(lines, boxes, line="line", size=1.0).collect()) == [(1, 0), (1, 1)]
    assert {r.k: r.flooded for r in J.spatial_join(lines, boxes, "flag", line="line", key=["k"]).collect()} == {1: True, 2: False}
    assert J.spatial_join(lines, boxes, "left", line="line", key=["k"]).count() == 3


def test_trips(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 5)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 1.0, 5.0), (1, 2, 1, 2.0, 1.0), (2, 3, 0, 1.0, 1.0)], "u long, v long, key int, length double, seconds double")
    trips = spark.createDataFrame([("a", 0.9, 0.1, 3.2, 0.0), ("b", 1.0, 0.0, 4.0, 0.0)], "trip string, x1 double, y1 double, x2 double, y2 double")
    both = R.undirected(edges).select("u", "v", "key", "seconds")
    got = routing.path_between(trips, nodes, both, "seconds").collect()
    assert [(r.trip, r.distance, r.path) for r in got] == [("a", 2.0, [1, 2, 3])]
    totals = routing.route_totals(spark.createDataFrame([("a", [3, 2, 1])], "trip string, path array<long>"), edges, ["trip"], ["length", "seconds"])
    assert tuple(totals.first()) == ("a", 2.0, 6.0)


def test_paths_at_every_size(spark, sf, monkeypatch):
    """The frontier's paths are the local search's, ties among them."""
    edges, services = X.edges(spark, sf), X.services(spark, sf)
    dry = R.disrupted_edges(edges, X.hazard(spark, sf))
    rows = lambda: sorted((r.state, r.service_type, r.to_node_id, r.route_length, r.from_node_id, r.route) for r in A.distance_rows(X.nodes(spark, sf), A.distances(edges, dry, services, with_path=True), services).collect())
    by_one = rows()
    monkeypatch.setattr(routing, "LOCAL_EDGES", 1)
    monkeypatch.setattr(A, "LOCAL_EDGES", 1)
    assert rows() == by_one and sum(r[-1] is not None for r in by_one) == 150 * 2 + 39 + 2
    length = {}
    for r in edges.collect():
        for way in ((r.u, r.v), (r.v, r.u)):
            length[way] = min(r.length, length.get(way, r.length))
    for _, _, node, d, source, path in by_one:
        if path:
            assert (path[0], path[-1]) == (source, node) and sum(length[x] for x in zip(path, path[1:], strict=False)) == d
    line = spark.createDataFrame([(0, a, a + 1, 0, 1.0) for a in range(40)] + [(0, 5, 7, 0, 2.0)], "g int, u long, v long, key int, length double")
    start = spark.createDataFrame([(0, 0)], "g int, node long")
    both = [sorted((r.node, r.path) for r in routing.shortest_paths(line, start, ["g"], s, with_path=True).collect()) for s in ("local", "frontier")]
    assert both[0] == both[1] and both[0][40][1] == [0, 1, 2, 3, 4, 5, *([6, 7] if 6 in both[0][7][1] else [7]), *range(8, 41)]


def test_searches_in_portions(spark, monkeypatch):
    edges = spark.createDataFrame([(0, a, b, 0, 1.0 + a) for a in range(9) for b in range(9) if abs(a - b) == 1], "g int, u long, v long, key int, length double")
    sources = spark.createDataFrame([(0, k) for k in range(9)], "g int, node long")
    rows = lambda: sorted(tuple(r) for r in routing.per_service_paths(edges, sources, ["g"]).collect())
    one = rows()
    monkeypatch.setattr(routing, "SEARCHES", 2)
    assert rows() == one and len(one) == 81


def test_single_source(spark, sf):
    """Searches from each service by itself find what the common search does; those tried come in order of distance."""
    nodes, edges, services = X.nodes(spark, sf), X.edges(spark, sf), X.services(spark, sf)
    samples = nodes.where("osmid % 9 = 0")
    least = {}
    for a_star in (False, True):
        rows = A.calculate_routes(samples, services, nodes, edges, multi_source=False, a_star=a_star, metric="planar").collect()
        least[a_star] = {}
        for r in rows:
            key = (r.service_type, r.to_node_id)
            least[a_star][key] = min(r.route_length, least[a_star].get(key, float("inf")))
            assert r.route[0] == r.from_node_id and r.route[-1] == r.to_node_id
    common = {(r.service_type, r.to_node_id): r.route_length for r in A.calculate_routes(samples, services, nodes, edges, metric="planar").collect()}
    assert least[False] == common
    assert all(least[True][k] >= v for k, v in common.items())  # this fixture's lengths are not bounded by its places
    with pytest.raises(ValueError):
        A.calculate_routes(samples, services, nodes, edges, a_star=True)
    places = spark.createDataFrame([(k, 6.5 + 0.01 * k, 49.7) for k in range(6)], "osmid long, x double, y double")
    ways = spark.createDataFrame([(k, k + 1, 0, 800.0 + k) for k in range(5)], "u long, v long, key int, length double")
    posts = spark.createDataFrame([(11, "hospital", "hospital", 0, 6.5, 49.7), (12, "hospital", "hospital", 5, 6.55, 49.7), (13, "hospital", "hospital", 9, 6.9, 49.7)], "osm_id long, service_type string, amenity string, node_id long, x double, y double")
    for a_star in (False, True):
        got = A.calculate_routes(places.where("osmid in (1, 2)"), posts, places, ways, multi_source=False, a_star=a_star).collect()
        assert sorted((r.to_node_id, r.from_osm_id, r.route_length) for r in got) == [(1, 11, 800.0), (2, 11, 1601.0)]
