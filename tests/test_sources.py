"""Settings, adapters and exports."""

import io
import zipfile
import zlib

import numpy as np
import pytest

from meshspan.sources import config, exports, remote


def test_project_documents(spark, tmp_path):
    (tmp_path / "config.yaml").write_text("simulation: {transmitter: {height_m: 3}}\nsites: {a: {name: A, loc: [36.1, -115.2], tags: [Hub, hub, x]}}\n")
    (tmp_path / "sites.yaml").write_text("sites: {b: {loc: [36.2, -115.1], height_m: 0.5, tags: solo}}\n")
    doc = config.load_project(str(tmp_path))
    rows = config.sites(spark, doc).withColumn("h", config.tx_height("height_m", 3.0)).collect()
    assert [(r.slug, r.tags, r.h) for r in rows] == [("a", ["hub", "x"], 3.0), ("b", ["solo"], 1.0)]
    with pytest.raises(ValueError):
        config.validate({"sites": {"z": {"loc": [99, 0]}}})
    cat = {"m": {"sf": 7, "bw": 62.5}}
    assert config.catalogue_entry(cat, {"preset": "m", "bw": 125}) == {"sf": 7, "bw": 125}
    assert config.environment({"c": 1, "d": 2}, {"e": {"d": 3}}, "e") == {"c": 1, "d": 3}
    assert config.boards({"Big": {"radius_km": 40}}) == {"big": 40.0}
    tags = spark.createDataFrame([({"highway": " Track ", "4wd_only": "yes"},), ({"name": "x"},)], "t map<string,string>")
    got = [r.w for r in tags.select(config.way_tags("t").alias("w")).collect()]
    assert got[0].highway == "track" and got[0].fourwd and got[1] is None


def test_pages_halve_on_errors_and_resume():
    asked = []

    def fetch(at, size, where):
        asked.append((at, size))
        if size > 500:
            raise remote.ServerError
        return [{}] * min(size, 1200 - at)

    assert sum(map(len, remote.pages(fetch, size=2000, start=100, pause_s=0))) == 1100
    assert asked[:3] == [(100, 2000), (100, 1000), (100, 500)]


def test_tile_queue_and_retries():
    q = remote.TileQueue(cap=2)
    assert q.submit("a", 0) and q.submit("b", 10) and not q.submit("c", 0) and q.submit("d", 100) and q.submit("a", 25)
    assert [q.take() for _ in range(4)] == ["d", "a", "b", None]
    waits, calls = [], []

    def fetch(name):
        calls.append(name)
        if len(calls) < 3:
            raise OSError
        return b"x"

    got = {}
    remote.fetch_tile(fetch, got.__setitem__, "t", sleep=waits.append)
    assert got == {"t": b"x"} and waits == [1.0, 2.0]
    feats, print_ = remote.run_source(lambda text: [{"a": 1}], {"u": 1}, {}, "k")
    assert feats == [{"a": 1}] and remote.run_source(None, {"u": 1}, {"k": print_}, "k") == (None, print_)


def test_exports(spark):
    rgb = np.full((2, 3, 3), 255, np.uint8)
    rgb[0, 1] = (1, 2, 3)
    png = exports.png_rgba(rgb)
    raw = zlib.decompress(png[41 : png.index(b"IEND") - 8])
    assert raw[0] == 0 and raw[1:9] == bytes([255, 255, 255, 0, 1, 2, 3, 255])
    docs = spark.createDataFrame([("k", "files/a.png", "zz"), ("k", "doc.kml", "<kml/>")], "key string, path string, content string")
    z = zipfile.ZipFile(io.BytesIO(bytes(exports.kmz_archives(docs).first().content)))
    assert z.namelist() == ["doc.kml", "files/a.png"] and z.read("doc.kml") == b"<kml/>"
    line = spark.createDataFrame([(1, i, 36 + i * 0.00018, -115.0) for i in range(20)], "line int, ord int, lat double, lon double")
    assert [r.ord for r in exports.dashes(line).orderBy("ord").collect()] == [0, 1, 2, 3, 6, 7, 8, 9, 12, 13, 14, 15, 18, 19]
    sites = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "slug string, lat double, lon double")
    links = spark.createDataFrame([("a", "b", False), ("a", "gone", True)], "a string, b string, manual boolean")
    assert exports.pruned(links, sites).count() == 1
    s, m = exports.applied(sites, links, spark.createDataFrame([("b", 0.0, 0.0), ("c", 5.0, 6.0)], sites.schema), spark.createDataFrame([("b", "a")], "a string, b string"))
    assert s.count() == 3 and m.filter("manual and a = 'a' and b = 'b'").count() == 1
    assert exports.map_metadata(sites, {"f": 1})["bbox"] == [2.0, 1.0, 4.0, 3.0]
    f = spark.createDataFrame([("l", "x", [[1.23456789, 2.0]])], "layer string, label string, coords array<array<double>>")
    assert exports.baked(f).first().coords == [[1.234568, 2.0]]
