import datetime
import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from fordway.functions import geometry as G, overlay as O
from fordway.operators import exposure as E, tables as T
from fordway.sources import readers, regions, shapefile, tags, writers
from fordway.streaming import exposure as live


def test_rename_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, name string")
    assert T.rename_id(df).columns == ["osm_id", "name"]
    assert T.rename_id(df.withColumnRenamed("id", "osmid")).columns == ["osm_id", "name"]
    with pytest.warns(UserWarning):
        T.rename_id(df.withColumnRenamed("id", "x"))
    assert [r.id for r in df.where(T.not_equal("name", "a")).collect()] == [2, 3]


def test_hospitals(spark):
    df = spark.createDataFrame([("a", "yes", None), ("b", "yes", 1), ("c", "no", 2), ("d", None, 3), (None, "yes", 4), ("x", "yes", 5)], "name string, emergency string, position int")
    new = spark.createDataFrame([("a", 10), ("b", 20)], "name string, position int")
    got = T.prepare_hospitals(df, new, "x")
    assert sorted((r.name or "", r.position) for r in got.collect()) == [("", 4), ("a", 10), ("b", 20)]


def test_least_rows_and_heads(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", nan, 1, "p"), ("a", inf, 2, "q"), ("b", 1.0, 2, "r"), ("b", 1.0, 1, "s"), ("c", nan, 1, "t")], "g string, v double, t int, w string")
    assert sorted((r.g, r.w) for r in T.least_rows(df, ["g"], "v", ["t"]).collect()) == [("a", "q"), ("b", "s")]
    assert T.head_per_group(df, ["g"], ["t"], 1).count() == 3
    assert T.histogram(df.where("g = 'b'").withColumn("v", F.col("t") / 2), "v", 0.0, 1.0).orderBy("bin").collect() == [(5, 1), (9, 1)]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert T.filtered_with_warning(df, df.where("g = 'a'")) == (5, 2) and len(w) == 1
    assert T.share(df, F.col("g") == "a").first().percentage == 40.0


def test_tags(spark):
    df = spark.createDataFrame([(1, "hospital", None, None), (2, "pub", "yes", None), (3, None, None, "river"), (4, None, "house", "stream")], "id long, amenity string, building string, waterway string")
    ids = lambda found: sorted(r.osm_id for r in found.collect())
    assert ids(tags.points_of_interest(df)) == ids(tags.points_of_interest(df, [])) == [1]
    assert ids(tags.points_of_interest(df, ["pub"])) == ids(tags.leisure(df)) == [2]
    assert ids(tags.waterways(df)) == [3] and ids(tags.railways(df)) == []
    assert tags.buildings(df).count() == 1 and len(tags.buildings(df).columns) == 6 and tags.any_buildings(df).count() == 2
    assert tags.boundaries(df.withColumn("geometry", F.lit("g"))).count() == 0
    assert tags.emergency_only(df).count() == 0
    assert len(tags.LEISURE) == 42 and len(tags.POI) == 7


def test_paths(spark, tmp_path):
    config = regions.Config("/d")
    assert regions.hazard_path(config, "HQ50") == "/d/flooding/hazard_areas/hazard_areas_H.gml"
    assert regions.hazard_path(config, "HQ100", "trier_city").endswith("hazard_areas_M_trier_city.geojson")
    assert regions.with_postfix("/a/b.gml.gml", "x") == "/a/b.gml_x.gml" and regions.extension("a.gml") == ".gml"
    assert regions.with_subfolder("/a/b.gml", "c") == "/a/c/b.gml"
    for n in ("one.gml", "one_cropped.gml", "two.gml", "two.txt"):
        (tmp_path / n).write_text("")
    names = regions.list_files(spark, str(tmp_path), ".gml", relative=True)
    assert names == ["one.gml", "one_cropped.gml", "two.gml"]
    assert regions.to_crop(names, "trier") == ["one.gml", "two.gml"] and regions.to_crop(names, "trier", "one") == ["one.gml", "one_cropped.gml"]
    b = regions.region(spark, "trier_city").select(G.bounds(F.flatten("polygon")).alias("b")).first().b
    assert tuple(b) == regions.REGIONS["trier_city"]


def test_geojson_round_trip(spark, tmp_path):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    geometries = [("Point", [1.0, 2.0]), ("LineString", square[:2]), ("MultiLineString", [square[:2], square[1:3]]), ("Polygon", [square]), ("MultiPolygon", [[square], [square]])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": k, "n": i}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(geometries)]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc, indent=1))
    got = readers.geojson(spark, str(tmp_path / "in.geojson"), "name string, n int").orderBy("n").collect()
    assert [r.kind for r in got] == ["Point", "LineString", "MultiLineString", "MultiLineString", "Polygon", "MultiPolygon"]
    assert tuple(got[0].point) == (1.0, 2.0) and len(got[4].polygon) == 1 and len(got[5].polygon) == 2 and got[4].line is None
    assert readers.hazard_polygons(spark.createDataFrame([(r.polygon,) for r in got], f"polygon {G.POLYGON}")).count() == 2
    points = spark.createDataFrame([("a", (1.0, 2.0))], f"name string, p {G.POINT}")
    writers.geojson(points, str(tmp_path / "out"), "p", "Point")
    writers.geojson(points.limit(0), str(tmp_path / "out"), "p", "Point")  # exists: left alone
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text) == {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    rings = spark.createDataFrame([("a <&>", [square]), ("two", [box(1.0, 1.0, 2.0), box(6.0, 6.0, 2.0)]), ("hole", [box(0.0, 0.0, 8.0), box(2.0, 2.0, 1.0)])], f"name string, polygon {G.POLYGON}")
    for ending in ("geojson", "gml", "shp"):
        assert writers.cropped(rings, [(0, 0), (9, 0), (9, 7), (0, 7)], f"file://{tmp_path}/c.{ending}")
    drawn = {r.name: r for r in shapefile.polygons(shapefile.read(spark, f"file://{tmp_path}/c.shp", "name string")).collect()}
    assert not writers.cropped(rings, [(0, 0), (9, 0), (9, 9)], str(tmp_path / "c.txt"))
    read = {r.name: r for r in readers.geojson_lines(spark, str(tmp_path / "c.geojson"), "name string").collect()}
    assert {k: r.kind for k, r in read.items()} == {"a <&>": "Polygon", "two": "MultiPolygon", "hole": "Polygon"}
    again = {r.name: r for r in readers.gml(spark, str(tmp_path / "c.gml"), "feature", "name string").collect()}
    size = lambda r: sum(O.area(np.array([(p.x, p.y) for p in x])) for x in r.polygon)
    assert {k: -size(r) for k, r in drawn.items()} == {k: size(r) for k, r in read.items()}
    assert {k: size(r) for k, r in read.items()} == {"a <&>": 0.5, "two": 6.0, "hole": 55.0} == {k.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&"): size(r) for k, r in again.items()}
    writers.boundary_json(rings, str(tmp_path / "b"))
    assert json.loads(spark.read.text(str(tmp_path / "b")).first().value)["type"] == "Polygon"
    area = readers.flooded_area(spark.createDataFrame([([box(0.0, 0.0, 4.0)],), ([box(2.0, 0.0, 4.0)],), (None,)], f"polygon {G.POLYGON}")).collect()
    assert len(area) == 1 and size(area[0]) == 24.0


def test_gml_graphml_csv(spark, tmp_path):
    (tmp_path / "a.gml").write_text("<c><m><fid>7</fid><g><gml:exterior><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:exterior></g></m>\n<m><fid>8</fid></m></c>")
    got = readers.gml(spark, str(tmp_path / "a.gml"), "m", "fid int").orderBy("fid").collect()
    assert [(r.fid, len(r.polygon)) for r in got] == [(7, 1), (8, 0)] and len(got[0].polygon[0]) == 4
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d1" for="node" attr.name="x" attr.type="double"/><key id="d2" for="node" attr.name="y" attr.type="double"/>'
        '<key id="d3" for="edge" attr.name="length" attr.type="double"/><key id="d4" for="edge" attr.name="geometry" attr.type="string"/><key id="d5" for="edge" attr.name="bridge" attr.type="string"/>'
        '<graph><node id="1"><data key="d1">6.5</data><data key="d2">49.7</data></node><node id="2"/>'
        '<edge source="1" target="2" id="0"><data key="d3">12.5</data><data key="d4">LINESTRING (0 0, 1 1)</data><data key="d5">yes</data></edge></graph></graphml>'
    )
    nodes, edges = readers.graphml(spark, str(tmp_path / "g"))
    assert sorted((r.osmid, r.x, r.y) for r in nodes.collect())[0] == (1, 6.5, 49.7)
    e = edges.first()
    assert (e.u, e.v, e.key, e.length, e.bridge, len(e.line)) == (1, 2, 0, 12.5, "yes", 2)
    more = edges.unionByName(spark.createDataFrame([(2, 3, 1, 7.0, None, None), (3, 1, 0, None, [(1.0, 2.0), (3.5, 4.0)], "a<b & \"c\"")], edges.schema))
    places = spark.createDataFrame([(1, 6.5, 49.7), (2, None, None), (3, -1.0, 2.5)], "osmid long, x double, y double")
    writers.graphml(places, more, str(tmp_path / "h.graphml"))
    again = readers.graphml(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, places.collect()))
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, more.collect()))
    writers.graph(nodes, edges, str(tmp_path), "r_drive")
    writers.graph(nodes, edges, str(tmp_path), "r_all_private")
    both = readers.drive_graphs(spark, str(tmp_path), "r", undirected_graph=True)
    assert both[0][1].count() == 2 and both[1][0].count() == 2
    (tmp_path / "p.csv").write_text('household_id,cell_id,geometry\n1,2,POINT (7 8)\n')
    r = readers.csv(spark, str(tmp_path / "p.csv"), "household_id long, cell_id long, geometry string", "geometry").first()
    assert (r.x, r.y) == (7.0, 8.0)
    scored = spark.createDataFrame([("hospital", (1.0, 2.0), [1, 2], 0.5)], f"service_type string, to_centroid {G.POINT}, route array<long>, score double")
    assert writers.stamped("a/b/", datetime.datetime(2024, 2, 3, 4, 5, 6)) == "a/b_20240203_040506"
    writers.scores_csv(scored, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().to_centroid == "POINT (1.0 2.0)"


def test_one_region(spark):
    b = spark.createDataFrame([("a", [[(0.0, 0.0)]]), ("b", None), ("c", [[]]), ("c", [[]])], f"name string, polygon {G.POLYGON}")
    assert readers.one_region(b, "a").count() == 1
    for n in "bcd":
        with pytest.raises(ValueError):
            readers.one_region(b, n)


def test_population(spark):
    people = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 2, 4.0, 1.0), (4, 3, 9.0, 9.0)], "person_id long, household_id long, x double, y double")
    hazard = spark.range(1).select(G.rectangle(*map(F.lit, (0.0, 0.0, 4.0, 4.0))).alias("polygon"))
    assert E.affected_persons(people, hazard).count() == 2 and E.affected_persons(people, hazard, "intersects").count() == 3
    assert {r.household_id: r.persons for r in E.affected_households(people, hazard).collect()} == {1: 2}
    assert E.flooded_share(people, hazard, ["person_id"]).first().percentage == 75.0


def test_live_positions(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", x) for h, x in ((1, 1.0), (1, 9.0), (2, 2.0), (2, 3.0))], "ts string, x double").select(F.to_timestamp("ts").alias("ts"), "x", F.lit(1.0).alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    hazard = spark.range(1).select(G.rectangle(*map(F.lit, (0.0, 0.0, 4.0, 4.0))).alias("polygon"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = live.windowed_counts(live.flagged_positions(stream, hazard, 4.0))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("live_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from live_counts").collect()) == [1, 2]
