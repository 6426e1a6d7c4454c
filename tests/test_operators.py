"""Operators that SQL does not express, against brute force."""

import gzip
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspan.functions import geo, rf
from meshspan.operators import graph, greedy, grid_join, terrain
from meshspan.sources import files


def metres(a, b, radius=6_371_000.0):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def scatter(n, seed, lat=(60, 60.5), lon=(-1, 1)):
    rnd = random.Random(seed)
    return [(i, rnd.uniform(*lat), rnd.uniform(*lon), round(rnd.uniform(100, 900), 1)) for i in range(n)]


@pytest.mark.parametrize("box", [((60, 60.5), (-1, 1)), ((-1, 1), (5, 6)), ((84, 85), (-10, 10))])
def test_pairs_within_a_radius(spark, box):
    pts = scatter(300, 1, *box)
    df = spark.createDataFrame(pts, "k long, lat double, lon double, z double")
    got = {(r.a_k, r.b_k) for r in grid_join.self_pairs(df, "k", 6000.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a[1:], b[1:], 6_378_137.0) <= 6000}


def test_nearest(spark):
    a, b = scatter(80, 2), scatter(200, 3)
    left = spark.createDataFrame(a, "k long, lat double, lon double, z double")
    right = spark.createDataFrame([x[:3] for x in b], "id long, r_lat double, r_lon double")
    got = {r.k: r.id for r in grid_join.nearest(left, right, 5000.0, "k", "id").collect()}
    for k, la, lo, _ in a:
        d, i = min((metres((la, lo), y[1:], 6_378_137.0), y[0]) for y in b)
        assert got.get(k) == (i if d <= 5000 else None)


def test_greedy_separation_and_deduplication(spark):
    pts = scatter(250, 4)
    df = spark.createDataFrame(pts, "k long, lat double, lon double, elev_m double").withColumn("g", F.lit(1))
    kept = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if len(kept) < 30 and all(metres(p[1:], q[1:]) >= 3000 for q in kept):
            kept.append(p)
    got = greedy.spread_out(df, ["g"], ["elev_m", "k"], [False, True], 3000.0, 30).collect()
    assert {r.k for r in got} == {p[0] for p in kept}
    slots = []
    for p in pts:
        near = next((i for i, q in enumerate(slots) if metres(p[1:], q[1:]) < 3000), None)
        if near is None:
            slots.append(p)
        elif p[3] > slots[near][3]:
            slots[near] = p
    got = greedy.dedup_higher(df, ["g"], ["k"], 3000.0).filter("kept").collect()
    assert {r.k for r in got} == {p[0] for p in slots}


def test_diverse_routes_and_thinning(spark):
    rows = [(1, 1, [1, 2]), (1, 2, [2, 3]), (1, 3, [3, 4]), (1, 4, [5]), (2, 1, [])]
    got = {(r.g, r.o): r.is_unique for r in greedy.diverse_routes(spark.createDataFrame(rows, "g int, o int, peaks array<int>"), ["g"], ["o"]).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): True, (2, 1): True}
    line = spark.createDataFrame([(1, i, 10.0 + i * 0.0004, 20.0) for i in range(20)], "r int, o int, lat double, lon double")
    assert [x.o for x in greedy.thin_along(line, ["r"], "o", 100.0, 40.0).orderBy("o").collect()] == [0, 3, 6, 9, 12, 15, 18, 19]


def test_shortest_paths_and_components(spark):
    import heapq

    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 50)) for _ in range(150)]
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
    best, heap = {}, [(0, 0), (0, 7)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in adj.get(x, ()):
                heapq.heappush(heap, (d + w, y))
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, cost double")
    tree = graph.reach(df, spark.createDataFrame([(0,), (7,)], "node long"))
    assert {r.node: r.cost for r in tree.collect()} == best
    far = max(best, key=lambda x: (best[x], x))
    way = [r.node for r in graph.paths(tree, spark.createDataFrame([(far,)], "node long")).orderBy("step").collect()]
    assert way[0] == far and way[-1] in (0, 7)
    assert sum(min(w for y, w in adj[b] if y == a) for a, b in zip(way, way[1:])) == best[far]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert all(r.component == root(r.node) for r in graph.components(df).collect())


def test_point_in_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0), (0.0, 0.0)]
    hole = [(0.5, 0.2), (1.0, 0.2), (1.0, 0.6), (0.5, 0.6), (0.5, 0.2)]
    as_ring = lambda r: F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in r])
    pts = [(0.2, 1.0, True), (2.0, 2.0, False), (3.5, 2.4, True), (0.7, 0.4, False), (5.0, 1.0, False)]
    df = spark.createDataFrame(pts, "lon double, lat double, want boolean").withColumn("rings", F.array(as_ring(ring), as_ring(hole)))
    got = df.withColumn("got", grid_join.inside_polygon("lat", "lon", "rings")).collect()
    assert all(r.got == r.want for r in got)


def test_spike_is_the_only_summit(spark):
    z = np.full((31, 31), 2000)
    z[15, 16] = 2500
    cells = spark.createDataFrame([(36, -116, 31, y, x, int(z[y, x])) for y in range(31) for x in range(31)], "tile_lat int, tile_lon int, n int, iy int, ix int, z int")
    got = terrain.cell_centre(terrain.local_maxima(cells)).collect()
    assert [(r.iy, r.ix, r.z) for r in got] == [(15, 16, 2500)]
    assert abs(got[0].lat - (37 - 15.5 / 30)) < 1e-12


def test_thresholds():
    assert abs(-128.01029995663981 + 2.0 - -126.01029995663981) < 1e-9
    margin = rf.reliability_margin_db(90, 99.9999)
    assert margin > rf.reliability_margin_db(90, 90) > 0


def test_sensitivity_of_a_narrow_channel(spark):
    v = spark.range(1).select(rf.sensitivity_dbm(F.lit(7), F.lit(62.5), F.lit(5))).first()[0]
    assert abs(v - (-126.01029995663981)) < 1e-9


def test_elevation_tiles_and_archives(spark, tmp_path):
    n = 1201
    z = (np.arange(n * n).reshape(n, n) % 3000).astype(">i2")
    (tmp_path / "hgt").mkdir()
    (tmp_path / "hgt" / "N36W115.hgt.gz").write_bytes(gzip.compress(z.tobytes()))
    dem = files.read_hgt(spark, str(tmp_path / "hgt")).cache()
    assert dem.count() == n and dem.filter("iy = 3").first().elev[:5] == [int(x) for x in z[3, :5]]
    at = spark.createDataFrame([(36.5 + 1e-5, -114.5 + 2e-5), (37.5, -114.5), (36.0, -114.5)], "lat double, lon double")
    got = [r.elev_m for r in terrain.sample(at, dem).orderBy(F.col("lat") == 37.5, F.col("lat") == 36.0).collect()]
    fy, fx = (37 - 36.50001) * 1200, (115 - 114.49998) * 1200
    y, x = int(fy), int(fx)
    want = sum(float(z[y + j, x + i]) * (1 - abs(fx - x - i)) * (1 - abs(fy - y - j)) for i in (0, 1) for j in (0, 1))
    assert abs(got[0] - want) < 1e-6 and got[1:] == [0.0, 0.0]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("doc.kml", "<kml><Placemark><name>A &amp; B</name><Point><coordinates>-115.1,36.2,0</coordinates></Point></Placemark><Placemark><LineString><coordinates>1,2,0\n3,4,0</coordinates></LineString></Placemark></kml>")
    (tmp_path / "a.kmz").write_bytes(buf.getvalue())
    marks = files.read_kmz(spark, str(tmp_path / "a.kmz")).orderBy("place", "ord").collect()
    assert [(m.name, m.kind, m.lat, m.lon) for m in marks] == [("A & B", "point", 36.2, -115.1), ("", "line", 2.0, 1.0), ("", "line", 4.0, 3.0)]


def test_geojson_segments(spark, tmp_path):
    (tmp_path / "r.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3],[4,4]]]},"properties":{"id":"x","kind":"track","surface":null}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0]]},"properties":{}},{"type":"Feature","geometry":null,"properties":{}}]}')
    seg = files.features_to_segments(files.read_geojson(spark, str(tmp_path / "r.geojson"))).collect()
    assert [(s.id, s.kind, s.surface, len(s.coords)) for s in seg] == [("x", "track", "unknown", 3)]


def test_tile_names(spark):
    b = geo.radius_bbox(F.lit(36.99), F.lit(-116.01), F.lit(5000.0))
    got = spark.range(1).select(geo.tiles_of_bbox(b["south"], b["north"], b["west"], b["east"])).first()[0]
    assert got == ["N36W116", "N36W117", "N37W116", "N37W117"]


def test_components_take_logarithmic_rounds(spark, monkeypatch):
    """A path of 10,000 random ids: few rounds of three cuts each, whatever the order of ids."""
    import random

    ids = random.Random(4).sample(range(1 << 40), 10_000)
    df = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5 << 41, 5 << 41)], "src long, dst long")
    cuts, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: (cuts.append(1), real(d))[1])
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {i: min(ids) for i in ids} | {5 << 41: 5 << 41}
    assert (len(cuts) - 2) / 3 < 20
