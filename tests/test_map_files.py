"""Readers of map files: OpenStreetMap XML and GeoPackages."""

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fordway.functions import geometry as G, overlay as O
from fordway.operators.graph import travel_times
from fordway.sources import geopackage, osm, pbf, shapefile, tags

OSM = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="50.0" lon="6.0"/><node id="2" lat="50.0" lon="6.01"/><node id="3" lat="50.0" lon="6.02"><tag k="amenity" v="hospital"/><tag k="name" v="H"/></node>
<node id="4" lat="50.01" lon="6.01"/><node id="5" lat="50.02" lon="6.01"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="maxspeed" v="50"/></way>
<way id="11"><nd ref="2"/><nd ref="4"/><nd ref="5"/><tag k="highway" v="residential"/><tag k="bridge" v="yes"/><tag k="oneway" v="yes"/></way>
<way id="12"><nd ref="1"/><nd ref="5"/><tag k="highway" v="footway"/></way>
<way id="13"><nd ref="1"/><nd ref="2"/><nd ref="4"/><nd ref="1"/><tag k="building" v="yes"/></way>
</osm>"""


@pytest.fixture()
def osm_file(tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    return str(tmp_path / "a.osm")


def test_street_network(spark, osm_file):
    n, e = osm.street_network(osm.nodes(spark, osm_file), osm.ways(spark, osm_file))
    got = {(r.u, r.v): r for r in e.collect()}
    assert set(got) == {(1, 2), (2, 3), (2, 5)}
    assert {r.osmid for r in n.collect()} == {1, 2, 3, 5}
    assert got[2, 5].length == pytest.approx(G.haversine_m(6.01, 50.0, 6.01, 50.02)) and len(got[2, 5].line) == 3
    assert (got[2, 5].bridge, got[2, 5].oneway, got[1, 2].maxspeed, got[2, 5].maxspeed) == ("yes", "yes", 50.0, None)
    times = travel_times(e, "maxspeed", "highway")
    assert {r.speed_kph for r in times.collect()} == {50.0}


def test_binary_file(spark, osm_file, tmp_path):
    """What the XML file holds comes back from the binary one, and the other way round."""
    n, w = osm.nodes(spark, osm_file), osm.ways(spark, osm_file)
    far = spark.createDataFrame([(9_000_000_000, -179.9999999, -89.5, {"name": "Ä <&> \"x\""})], n.schema)
    n = n.unionByName(far)
    pbf.write(n, w, f"file://{tmp_path}/a.osm.pbf", rows=2)
    read = lambda path: (sorted((r.osmid, r.x, r.y, tuple(sorted(r.tags.items()))) for r in osm.nodes(spark, path).collect()), sorted((r.way, r.refs, tuple(sorted(r.tags.items()))) for r in osm.ways(spark, path).collect()))
    want = sorted((r.osmid, r.x, r.y, tuple(sorted(r.tags.items()))) for r in n.collect()), sorted((r.way, r.refs, tuple(sorted(r.tags.items()))) for r in w.collect())
    assert read(str(tmp_path / "a.osm.pbf")) == want
    osm.write_xml(n, w, str(tmp_path / "b.osm"))
    assert read(str(tmp_path / "b.osm")) == want
    edges = osm.street_network(osm.nodes(spark, str(tmp_path / "a.osm.pbf")), osm.ways(spark, str(tmp_path / "a.osm.pbf")))[1]
    assert {(r.u, r.v) for r in edges.collect()} == {(1, 2), (2, 3), (2, 5)}
    osm.buildings_to_xml(spark, str(tmp_path / "a.osm.pbf"), str(tmp_path / "c.osm"))
    assert [x[0] for x in read(str(tmp_path / "c.osm"))[0]] == [1, 2, 4] and [x[0] for x in read(str(tmp_path / "c.osm"))[1]] == [13]
    area = spark.range(1).select(G.rectangle(*map(F.lit, (6.015, 49.0, 7.0, 50.005))).alias("polygon"))
    cut = osm.in_polygon(n, w, area)
    assert {r.osmid for r in cut[0].collect()} == {1, 2, 3} and [r.way for r in cut[1].collect()] == [10]


def test_binary_format():
    """A block put together by hand: granularity, offsets, single nodes, unpacked blobs, numbers of all lengths."""
    data = memoryview(b"".join(pbf._varint(v) for v in (0, 1, 127, 128, 300, 2**35, 2**62)))
    assert pbf.numbers(data).tolist() == [0, 1, 127, 128, 300, 2**35, 2**62] and pbf.numbers(memoryview(b"")).tolist() == []
    assert pbf.numbers(memoryview(b"\x00\x01\x02\x03\xff\xff\x03"), True).tolist() == [0, -1, 1, -2, -32768]
    node = b"\x08\x06" + b"\x12\x01\x01" + b"\x1a\x01\x02" + b"\x40\x14" + b"\x48\x09"  # id 3, 1: 2, lat 10, lon -5
    table = b"\x0a\x09" + b"\x0a\x00" + b"\x0a\x01k" + b"\x0a\x02vv"
    body = table + b"\x12" + bytes([len(node) + 2]) + b"\x0a" + bytes([len(node)]) + node + b"\x88\x01\xe8\x07" + b"\x98\x01\x80\x94\xeb\xdc\x03"
    assert list(pbf.objects(body)) == [("node", 3, -5e-6, 1.00001, None, [("k", "vv")])]
    assert pbf.unpacked(b"\x0a\x02ab") == b"ab" and list(pbf.blobs(pbf.header()))[0][0] == "OSMHeader"
    pbf.check_header(pbf.unpacked(list(pbf.blobs(pbf.header()))[0][1]))
    with pytest.raises(ValueError):
        pbf.check_header(b"\x22\x05Other")
    with pytest.raises(ValueError):
        pbf.unpacked(b"\x22\x02ab")


def test_features(spark, osm_file):
    found = osm.features(spark, osm_file, ["amenity", "name", "building"])
    assert found.count() == 2
    hospital = tags.points_of_interest(found).first()
    assert (hospital.osm_id, hospital.name, tuple(hospital.point)) == (3, "H", (6.02, 50.0))
    house = found.where("building = 'yes'").first()
    assert len(house.polygon[0]) == 4 and house.point is None


def blob(kind, body):
    return b"GP\x00\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<I", kind) + body


def ring(*places):
    return struct.pack("<I", len(places)) + b"".join(struct.pack("<dd", *p) for p in places)


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(str(tmp_path / "a.gpkg"))
    square = ring((0, 0), (4, 0), (4, 4), (0, 0))
    rows = [
        (1, "point", blob(1, struct.pack("<dd", 1.5, 2.5))),
        (2, "line", blob(2, ring((0, 0), (1, 1)))),
        (3, "polygon", blob(3, struct.pack("<I", 1) + square)),
        (4, "two", blob(6, struct.pack("<I", 2) + 2 * (b"\x01" + struct.pack("<II", 3, 1) + square))),
        (5, "none", None),
    ]
    db.execute("create table gpkg_contents (table_name text, data_type text)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("create table a (fid integer, name text, geom blob)")
    db.execute("insert into gpkg_contents values ('a', 'features'), ('t', 'attributes')")
    db.execute("insert into gpkg_geometry_columns values ('a', 'geom')")
    db.executemany("insert into a values (?, ?, ?)", rows)
    db.commit()
    db.close()
    path = str(tmp_path / "a.gpkg")
    assert geopackage.layer_names(spark, path) == ["a"]
    found = geopackage.all_layers(spark, path, "fid long, name string")["a"]
    got = {r.fid: r for r in found.collect()}
    assert [got[k].kind for k in range(1, 6)] == ["Point", "LineString", "Polygon", "MultiPolygon", None]
    assert tuple(got[1].parts[0][0]) == (1.5, 2.5) and len(got[4].parts) == 2 and got[5].parts is None
    areas = geopackage.polygons(found).select("fid", G.point_within(F.lit(3.0), F.lit(1.0), G.polygon_segments(F.col("polygon"))).alias("inside"))
    assert {r.fid: r.inside for r in areas.collect()}[3] is True
    with pytest.raises(Exception, match="no feature layer"):
        geopackage.layer(spark, path, "b", "fid long").collect()


def test_shapefile(spark, tmp_path):
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    rows = [(1, "Übung", [box(0.0, 0.0, 9.0), box(2.0, 2.0, 3.0)]), (2, None, [box(20.0, 0.0, 1.0), box(30.0, 0.0, 2.0)]), (3, "none", None)]
    df = spark.createDataFrame(rows, f"fid long, name_of_the_place string, polygon {G.POLYGON}")
    path = f"file://{tmp_path}/a.shp"
    shapefile.write(df, path)
    got = {r.fid: r for r in shapefile.read(spark, path, "fid long, name_of_th string").collect()}
    assert {k: (r.name_of_th, r.kind) for k, r in got.items()} == {1: ("Übung", "Polygon"), 2: (None, "Polygon"), 3: ("none", None)}
    size = lambda rings: sum(O.area(r) for r in O.turned([np.array([(p.x, p.y) for p in x]) for x in rings]))
    assert (size(got[1].parts), size(got[2].parts)) == (72.0, 5.0) and shapefile.polygons(shapefile.read(spark, path, "fid long")).count() == 2
    raw = (tmp_path / "a.shp").read_bytes()
    assert struct.unpack_from(">i", raw, 24)[0] * 2 == len(raw) and struct.unpack_from("<4d", raw, 36) == (0.0, 0.0, 32.0, 9.0)
    first = np.frombuffer(raw, "<f8", 10, 100 + 8 + 36 + 8 + 8).reshape(-1, 2)
    assert O.area(first) == -81.0  # shells run clockwise in the file
    place, line = struct.pack("<idd", 11, 1.5, 2.5) + bytes(16), struct.pack("<i4dii2i", 3, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 5, 5, 6, 6)
    body = b"".join(struct.pack(">ii", k, len(x) // 2) + x for k, x in enumerate((place, line)))
    found = list(shapefile.shapes(raw[:100] + body))
    assert found[0] == ("Point", [[{"x": 1.5, "y": 2.5}]]) and [len(p) for p in found[1][1]] == [2, 2]
    with pytest.raises(ValueError):
        list(shapefile.shapes(bytes(200)))


def test_crop_files(spark, osm_file, tmp_path, monkeypatch):
    from fordway.sources import crops, regions

    at = lambda n: f"file://{tmp_path}/{n}"
    box = (6.015, 49.0, 7.0, 50.005)
    assert crops.crop_file(spark, at("a.osm"), at("b.osm.pbf"), box) and not crops.crop_file(spark, at("a.osm"), at("b.osm.pbf"), box)
    assert {r.osmid for r in osm.nodes(spark, at("b.osm.pbf")).collect()} == {1, 2, 3}
    assert crops.crop_file(spark, at("b.osm.pbf"), at("c.osm"), box) and osm.ways(spark, at("c.osm")).count() == 1
    with pytest.raises(ValueError):
        crops.crop_file(spark, at("a.shp"), at("d.shp"), box)
    member = "<m><fid>{}</fid><posList>6.6 49.7 {} 49.7 6.6 49.8 6.6 49.7</posList></m>"
    text = f"<c>{member.format(1, 6.7)}{member.format(2, 60.7)}</c>"
    for folder in ("risk", "areas"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "z.gml").write_text(text)
    assert crops.crop_to_region(spark, at("risk/z.gml"), at("z.geojson"), "trier_city", row_tag="m", columns="fid int")
    from fordway.sources import readers

    found = readers.geojson_lines(spark, at("z.geojson"), "fid int").select("fid", G.bounds(F.flatten("polygon")).alias("b")).collect()
    assert {r.fid for r in found} == {1, 2} and max(r.b.xmax for r in found) == pytest.approx(6.725, abs=1e-9)
    monkeypatch.setenv("FORDWAY_ROOT", at("").rstrip("/"))
    monkeypatch.setenv("FORDWAY_FOLDER_RISK_ZONES", "risk")
    monkeypatch.setenv("FORDWAY_FOLDER_HAZARD_AREAS", "areas")
    config = regions.Config.of_environment()
    assert crops.crop_flooding(spark, config, "trier_city", "m", "fid int") == {"risk_zones": ["z.gml"], "hazard_areas": ["z.gml"]}
    assert readers.geojson_lines(spark, at("areas/trier_city"), "fid int").count() == 2
    assert len({id(h) for _ in range(3) for h in regions.logger().handlers}) == 1


def test_crop_folder(spark, tmp_path):
    from fordway.sources import regions, writers

    for name, side in (("risk_a.gml", 1), ("area_b.gml", 9)):
        (tmp_path / name).write_text(f"<c><m><fid>{side}</fid><posList>0 0 {side} 0 {side} {side} 0 {side} 0 0</posList></m><m><fid>0</fid><posList>50 50 51 50 51 51 50 50</posList></m></c>")
    mask = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert writers.crop_folder(spark, str(tmp_path), "m", "fid int", mask, "small", "risk") == ["risk_a.gml"]
    assert writers.crop_folder(spark, str(tmp_path), "m", "fid int", mask, "small", overwrite=True) == ["area_b.gml", "risk_a.gml"]
    got = {r.file: r.value for r in spark.read.text(str(tmp_path / "small")).collect()}
    assert set(got) == {"area_b.gml", "risk_a.gml"} and "[4.0,4.0]" in got["area_b.gml"] and '"fid":9' in got["area_b.gml"]
    assert writers.crop_folder(spark, str(tmp_path), "m", "fid int", mask, "gml") == []
    assert writers.region_mask("trier_city")[0] == regions.REGIONS["trier_city"][:2]
