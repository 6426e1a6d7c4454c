"""Queries by place on tables where many rows share a place: same rows as the SQL, and work by place, not by row."""

import random

import pytest
from pyspark.sql import functions as F

from meshspan.operators import grid_join
from meshspan.plans import catalogue
from tests.compare import differences, duck
from tests.test_network import metres

SHIFT = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey")}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """sf0.01 twice over with keys 840,000 on: places repeat with the keys modulo 40,000, roads with those modulo 7 and 5 too."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for table, keys in SHIFT.items():
        moved = ", ".join(f"{k} + g * 840000 AS {k}" for k in keys)
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM '/root/testdata/sf0.01/{table}.parquet' t, range(2) x(g)) TO '{folder}/{table}.parquet'")
    return str(folder)


def test_nearest_of_places_grows_its_radius(spark):
    rnd = random.Random(4)
    at = lambda n: [(i, 37 + rnd.random() * 0.2, -117 + rnd.random() * 0.2) for i in range(n)]
    left, right = at(40), at(60)
    a = spark.createDataFrame(left * 5, "k long, lat double, lon double")
    b = spark.createDataFrame(right, "id long, r_lat double, r_lon double")
    got = {(r.lat, r.lon): (r.id, r.dist_m) for r in grid_join.nearest_of_places(a, b, (300.0, 1500.0, 4000.0), ["id"]).collect()}
    want = {}
    for _, la, lo in left:
        d, i = min((metres((la, lo), (p, q), 6_378_137.0), i) for i, p, q in right)
        if d <= 4000:
            want[la, lo] = i, round(d, 2)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 0.011 for k in want) and 10 < len(want)


def test_crowded_places_are_packed(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("p"))
    p = grid_join.packs(df, ["p"], ["id"], "rows", 100)
    assert p.filter("size(rows) > 200").isEmpty() and sorted(x.id for r in p.collect() for x in r.rows) == list(range(3000))


@pytest.mark.parametrize("name", ["access_nearest_road", "catalogue_verdicts", "catalogue_report", "park_rings", "park_sectors"])
def test_roads_by_place(spark, copies, name):
    assert differences(spark, duck(copies), copies, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


@pytest.fixture(scope="module")
def crowds(tmp_path_factory):
    """A part of sf0.001 three times over at the same places, suppliers on places of customers."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("crowds"), duckdb.connect()
    for table, keys in SHIFT.items():
        moved = ", ".join(f"{k} + g * 840000 AS {k}" for k in keys)
        few = {"customer": "WHERE c_custkey < 90", "part": "WHERE p_partkey < 120"}.get(table, "")
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM (FROM '/root/testdata/sf0.001/{table}.parquet' {few}) t, range(3) x(g)) TO '{folder}/{table}.parquet'")
    return str(folder)


MESH = ["mesh_links", "mesh_peers", "mesh_manual_override", "mesh_summary", "mesh_of_some", "pair_lookups", "mesh_at_height", "mesh_hop_ranges", "mesh_free_space", "road_reach", "lens_sites", "depth_bounds", "land_denied_peaks"]


@pytest.mark.parametrize("name", MESH)
def test_links_by_place(spark, crowds, name):
    assert differences(spark, duck(crowds), crowds, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


def test_the_mesh_is_kept_by_place(spark, crowds):
    from meshspan.plans import links

    many = links.mesh(spark, crowds).count()
    assert links.spot_mesh(spark, crowds).count() * 3 < many


AREAS = ["fortify_candidates", "alternates_ranked", "eligible_peaks_in_discs", "coverage_raster", "coverage_mosaic", "land_burn_touched", "land_boolean_areas", "corridor_polygons", "routes_alike"]


@pytest.mark.parametrize("name", AREAS)
def test_areas_and_peaks_by_place(spark, crowds, name):
    assert differences(spark, duck(crowds), crowds, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


@pytest.mark.parametrize("name", ["eligible_peaks_in_areas", "land_dissolved"])
def test_land_by_place(spark, copies, name):
    assert differences(spark, duck(copies), copies, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


def test_alternates_are_thinned_in_order_of_rank(spark, crowds):
    from meshspan.plans import planning
    from meshspan.sources.derived import relation

    at = {x.slug: (x.lat, x.lon) for x in relation(spark, crowds, "peaks").collect()}
    want, kept_ = set(), {}
    for x in planning.alternates_ranked(spark, crowds).orderBy("subject", "rank").collect():
        mine = kept_.setdefault(x.subject, [])
        if len(mine) < 10 and all(metres(at[x.peak], at[p]) >= 800 for p in mine):
            mine.append(x.peak)
            want.add((x.subject, x.peak, x.rank))
    assert {tuple(x) for x in planning.alternates_diverse(spark, crowds).select("subject", "peak", "rank").collect()} == want and len(want) > 100
    fits, of_class, _ = planning._fits(spark, crowds)
    assert fits.count() * 6 < planning.alternates_ranked(spark, crowds).count() and of_class.select("class").distinct().count() * 2 < of_class.count()


def test_near_groups_make_no_pairs_at_a_place(spark, monkeypatch):
    from meshspan.operators import greedy

    made = []
    whole = greedy._close_pairs
    monkeypatch.setattr(greedy, "_close_pairs", lambda df, *a: made.append(df.count()) or whole(df, *a))
    rnd = random.Random(9)
    rows = [(i, 37 + (i % 7) * 0.02 + (i % 14 == 8) * 0.004, -117.0, float(rnd.randrange(6))) for i in range(140)]
    df = greedy.near_groups(spark.createDataFrame(rows, "k long, lat double, lon double, elev_m double"), "k", 1000.0)
    got = {x.k: (x.near_group, x.kept, x.winner) for x in greedy.dedup_higher(df, ["near_group"], ["k"], 1000.0).collect()}
    want = {}
    for g in range(7):
        slots, mine = [], [x for x in rows if x[0] % 7 == g]  # all within 1 km of each other
        best = 0
        for i, x in enumerate(mine):
            best = i if x[3] > mine[best][3] else best
        want |= {x[0]: (g, i == best, best) for i, x in enumerate(mine)}
    assert got == want and made == [8]


@pytest.fixture(scope="module")
def pins(tmp_path_factory):
    """Roads of sf0.001, and 40 of its pins three times over: their places repeat with the keys modulo 6,670."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("pins"), duckdb.connect()
    con.execute(f"COPY (FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (SELECT t.* REPLACE (p_partkey + g * 6670 AS p_partkey) FROM (FROM '/root/testdata/sf0.001/part.parquet' WHERE p_partkey < 40) t, range(3) x(g)) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["access_index", "nearest_edges"])
def test_pins_by_place(spark, pins, name):
    assert differences(spark, duck(pins), pins, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


def test_candidates_and_roads_are_worked_out_once(spark, pins, monkeypatch):
    from meshspan.operators import roadnet
    from meshspan.plans import network
    from meshspan.sources.derived import relation

    n, e = network.routing_graph(spark, pins)
    found = network.park_candidates(spark, pins, n, network.trees(spark, pins, e)[0])
    assert 0 < found.select("k").distinct().count() <= 40 and found.filter("k >= 40").isEmpty()
    assert network.access_candidates(spark, pins).count() == 3 * found.count()
    sizes = []
    whole = roadnet.ends
    monkeypatch.setattr(roadnet, "ends", lambda s: sizes.append(s.count()) or whole(s))
    s = relation(spark, pins, "roads").filter("id < 400")
    twice = s.union(s.withColumn("id", F.col("id") + 1_000_000))
    key = lambda e: {(x.src, x.dst): (x.n, x.cost) for x in e.collect()}
    a, b = key(roadnet.build(s)[1]), key(roadnet.build(twice)[1])
    assert b == {k: (2 * v[0], v[1]) for k, v in a.items()} and sizes[0] == sizes[1]


def test_chains_are_worked_out_once_a_place(spark, crowds, monkeypatch):
    from meshspan.operators import wedge
    from meshspan.sources.derived import relation

    started = []
    whole = wedge.grow
    monkeypatch.setattr(wedge, "grow", lambda s, *a, **k: started.append(s.count()) or whole(s, *a, **k))
    at = {x.k: (x.lat, x.lon) for x in relation(spark, crowds, "sites").collect()}
    got = catalogue.QUERIES["peak_chains"](spark, crowds).collect()
    assert sorted(x.route for x in got) == sorted(at)
    ways = {(at[x.route], x.segments, x.path) for x in got}
    assert len(ways) == len(set(at.values())) and len(ways) * 2 < len(got)
    assert 0 < started[0] <= 2 * len(ways)


PAIRS = [("progress_lens", "crowds"), ("terrain_wedge_peaks", "copies"), ("solver_ellipse", "crowds"), ("near_entries", "copies"), ("waypoint_cover", "copies")]


@pytest.mark.parametrize("name, tables", PAIRS)
def test_pairs_meet_by_place(spark, request, monkeypatch, name, tables):
    folder, entered = request.getfixturevalue(tables), []
    whole = grid_join.within

    def counted(left, right, radius_m, left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), *a, **k):
        entered.append(left.count() == left.select(*left_at).distinct().count())
        return whole(left, right, radius_m, left_at, right_at, *a, **k)

    monkeypatch.setattr(grid_join, "within", counted)
    assert differences(spark, duck(folder), folder, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []
    assert entered and all(entered)


@pytest.fixture(scope="module")
def towns(tmp_path_factory):
    """sf0.01 with customers on the suppliers' places, all customers twice over: ways of the SQL end, since the least site of every place is a customer of the first copy."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("towns"), duckdb.connect()
    con.execute(f"COPY (FROM '/root/testdata/sf0.01/supplier.parquet') TO '{folder}/supplier.parquet'")
    customers = "(SELECT * FROM c UNION ALL SELECT * REPLACE (c_custkey + 20009 AS c_custkey) FROM c WHERE c_custkey < 100)"
    con.execute(f"COPY (WITH c AS (FROM '/root/testdata/sf0.01/customer.parquet') SELECT t.* REPLACE (c_custkey + g * 840000 AS c_custkey) FROM {customers} t, range(2) x(g)) TO '{folder}/customer.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["road_paths", "road_components"])
def test_roads_over_towns(spark, towns, monkeypatch, name):
    from meshspan.operators import graph

    sizes = []
    for f in ("reach", "components"):
        whole = getattr(graph, f)
        monkeypatch.setattr(graph, f, lambda e, *a, whole=whole: sizes.append(e.select("src").distinct().count()) or whole(e, *a))
    assert differences(spark, duck(towns), towns, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []
    assert 0 < max(sizes) <= 1600


def test_ways_end_where_many_sites_share_a_place(spark, crowds):
    cost = {x.node: x.cost_m for x in catalogue.QUERIES["road_reach"](spark, crowds).collect()}
    ways = {}
    for x in catalogue.QUERIES["road_paths"](spark, crowds).collect():
        ways.setdefault(x.target, {})[x.step] = x.node
    assert set(ways) == set(cost)
    for target, way in ways.items():
        costs = [cost[way[i]] for i in range(len(way))]
        assert way[0] == target and costs == sorted(costs, reverse=True) and costs[-1] == 0 and len(way) == len(set(way.values()))


def test_routes_between_spots_are_those_of_their_sites(spark):
    from meshspan.operators import solver

    rnd = random.Random(5)
    at = {i: (37 + rnd.random() * 0.5, -117 + rnd.random() * 0.6) for i in range(70)}
    at[70], at[71] = (37.1, -117.0 + 1e-4), (37.1, -117.0 + 2e-4)  # two ways of nearly one length
    names = {i: [f"s{i}_{j}" for j in range(1 + i % 3)] for i in at}
    gap = lambda i, j: metres(at[i], at[j], 6_378_137.0)
    heard = {(i, j): gap(i, j) for i in at for j in at if gap(i, j) <= 12_000 and (i * 7 + j * 7) % 5}
    rows = [(i, *at[i], len(names[i]), names[i], [j for j in at if (i, j) in heard], [heard[i, j] for j in at if (i, j) in heard]) for i in at]
    spots = spark.createDataFrame(rows, "spot long, lat double, lon double, n long, names array<string>, ys array<long>, ws array<double>")
    sites = [(x, y, *at[j], w) for (i, j), w in heard.items() for x in names[i] for y in names[j] if x != y]
    arcs = spark.createDataFrame(sites, "x_slug string, y_slug string, y_lat double, y_lon double, w double")
    pairs = [(i, (i * 11 + 3) % 70) for i in range(70) if i != (i * 11 + 3) % 70]
    want = spark.createDataFrame([(i, *at[i], j, *at[j]) for i, j in pairs], "a_spot long, a_lat double, a_lon double, b_spot long, b_lat double, b_lon double")
    by_site = spark.createDataFrame([(names[i][-1], *at[i], names[j][0], *at[j]) for i, j in pairs], "a_slug string, a_lat double, a_lon double, b_slug string, b_lat double, b_lon double")
    old = {(x.a_slug, x.b_slug): (x.hops, x.routes, x.best_m) for x in solver.fewest_hops(by_site, arcs, 12_000.0).collect() if x.hops}
    new = {(names[x.a_spot][-1], names[x.b_spot][0]): (x.hops, x.routes, x.best_m) for x in solver.spot_routes(want, spots.drop("names"), 12_000.0).collect()}
    assert new == old and len(new) > 40 and len({x[0] for x in new.values()}) > 3
    old = {(x.a_slug, x.b_slug, x.rank): (">".join(x.path), x.d) for x in solver.list_paths(by_site, arcs, 12_000.0, k=6).collect()}
    new = {}
    for x in solver.spot_routes(want, spots, 12_000.0, 6).collect():
        a, b = names[x.a_spot][-1], names[x.b_spot][0]
        new |= {(a, b, i + 1): (">".join([a, p, b] if p else [a, b]), d) for i, (p, d) in enumerate(zip(x.paths, x.ds))}
    assert new == old and max(k[2] for k in new) == 6


def test_routes_over_a_crowded_mesh(spark, copies, monkeypatch):
    from meshspan.operators import solver

    searched = []
    whole = solver.spot_routes
    monkeypatch.setattr(solver, "spot_routes", lambda want, *a: searched.append(want.count()) or whole(want, *a))
    assert differences(spark, duck(copies), copies, "solver_routes", catalogue.QUERIES["solver_routes"], catalogue.ORACLES["solver_routes"]) == []
    assert 0 < searched[0] <= 1600


@pytest.mark.parametrize("name", ["land_point_hits", "land_smallest_hit", "land_eligible_points", "land_clip_to_aoi"])
def test_boxes_meet_by_place(spark, copies, monkeypatch, name):
    from meshspan.operators import rectilinear

    entered, box = [], list(rectilinear.BOX)
    boxes, overlaps = grid_join.boxes, rectilinear.overlaps
    once = lambda df, at: df.count() == df.select(*at).distinct().count()
    monkeypatch.setattr(grid_join, "boxes", lambda p, a, **k: entered.append(once(p, ["lat", "lon"]) and once(a, box)) or boxes(p, a, **k))
    monkeypatch.setattr(rectilinear, "overlaps", lambda a, b, *o, **k: entered.append(once(a, box) and once(b, box)) or overlaps(a, b, *o, **k))
    assert differences(spark, duck(copies), copies, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []
    assert entered and all(entered)


def test_routes_are_thinned_as_a_stream(spark):
    from meshspan.operators import greedy

    rnd, rows = random.Random(3), []
    for route in range(300):
        at = [37.0, -117.0]
        for o in range(rnd.choice((1, 2, 5, 40))):
            at = [at[0] + rnd.random() * 0.004, at[1] + rnd.random() * 0.004]
            rows.append((route, o, *at))
    want = set()
    for route in range(300):
        mine, kept_ = [x for x in rows if x[0] == route], []
        for x in mine:
            if not kept_ or metres(kept_[-1][2:], x[2:]) >= 400 or (x is mine[-1] and metres(kept_[-1][2:], x[2:]) >= 50):
                kept_.append(x)
        want |= {x[:2] for x in kept_}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        df = greedy.thin_along(spark.createDataFrame(rows, "r long, o long, lat double, lon double").repartition(5), ["r"], "o", 400.0, 50.0)
        assert {(x.r, x.o) for x in df.collect()} == want
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set(size, before)


def test_relay_chains_by_tile_are_those_of_the_pairs(spark):
    from meshspan.operators import finder
    from meshspan.plans import planning

    rnd = random.Random(8)
    spots = [(37 + rnd.random() * 0.6, -117 + rnd.random() * 0.7) for _ in range(60)]
    sites = spark.createDataFrame([(f"s{i}", *spots[i % 60]) for i in range(150)], "slug string, lat double, lon double")
    rows = []
    for route in range(200):
        lat, lon, step = 37 + rnd.random() * 0.6, -117 + rnd.random() * 0.7, rnd.choice((0.01, 0.05, 0.12))
        rows += [(route, o, lat + step * o, lon + step * o * rnd.random()) for o in range(1, rnd.randrange(2, 8))]
    way = spark.createDataFrame(rows, "route long, ord long, lat double, lon double")
    key = lambda df: sorted(map(tuple, df.select("route", "ord", "hop", "site", "solved").collect()), key=str)
    want = key(finder.find_chains(planning._chain_facts(way, sites)))
    found, wide = finder.chains_by_tile(way, sites, 8000.0, 12_000.0)
    small, rest = key(found), key(finder.find_chains(planning._chain_facts(wide, sites)))
    assert sorted(small + rest, key=str) == want and small and rest
    assert any(x[2] > 1 for x in small) and any(not x[4] for x in small)
    assert "hears" not in found._jdf.queryExecution().toString()


def test_viewsheds_are_evaluated_once_a_spot(spark, crowds, monkeypatch):
    from meshspan.operators import viewshed
    from meshspan.plans import planning
    from meshspan.sources.derived import relation, tile_blocks

    evaluated = []
    whole = viewshed.coverage
    monkeypatch.setattr(viewshed, "coverage", lambda s, *a: evaluated.append(s.count()) or whole(s, *a))
    s = relation(spark, crowds, "sites")
    spots = s.select("lat", "lon", "height_m").distinct().count()
    cells = {(x.slug, x.x, x.y): x.pr_dbm for x in catalogue.QUERIES["viewshed_cells"](spark, crowds).collect()}
    assert evaluated == [spots] and spots * 2 < s.count()
    cov = whole(s, tile_blocks(spark), planning.LINK | {"rx_height": 2.0}, planning.RADIUS, planning.WIDTH).cache()
    assert cells == {(x.slug, x.x, x.y): x.pr for x in cov.select("slug", "x", "y", planning.r(F.col("pr_dbm"), 2).alias("pr")).collect()} and cells
    masks = viewshed.ground_masks(cov, s, planning.RADIUS, planning.WIDTH, 500.0)
    assert [tuple(x) for x in catalogue.QUERIES["coverage_additions"](spark, crowds).collect()] == [tuple(x) for x in viewshed.best_additions(masks, 12).collect()]
    chains = s.select((F.col("k") % 3).alias("chain"), "slug")
    want = {x.chain: x.cells for x in viewshed.union_cells(masks, chains).collect()}, {x.chain: x.cells for x in viewshed.union_gain(viewshed.raster_masks(cov, planning.WIDTH), chains).collect()}
    got = catalogue.QUERIES["viewshed_union"](spark, crowds).collect()
    assert ({x.chain: x.ground_cells for x in got}, {x.chain: x.cells for x in got}) == want


def test_only_the_first_row_of_a_place_is_compared(spark, monkeypatch):
    from meshspan.operators import greedy

    compared = []
    whole = greedy._close_pairs
    monkeypatch.setattr(greedy, "_close_pairs", lambda df, *a: compared.append(df.count()) or whole(df, *a))
    rnd = random.Random(6)
    at = [(37 + rnd.random() * 0.2, -117 + rnd.random() * 0.2) for _ in range(50)]
    rows = [(f"p{i}", *at[i % 50], float(rnd.randrange(9))) for i in range(400)]
    kept_ = []
    for x in sorted(rows, key=lambda x: (-x[3], x[0])):
        if all(metres(x[1:3], y[1:3]) >= 4000 for y in kept_):
            kept_.append(x)
    lost = [("n1", None, -117.0, 1.0), ("n2", None, -117.0, 2.0)]
    df = spark.createDataFrame(rows + lost, "slug string, lat double, lon double, z double")
    got = greedy.spread_everywhere(df, "slug", [-F.col("z"), F.col("slug")], 4000.0).collect()
    assert {x.slug for x in got} == {x[0] for x in kept_} | {"n1", "n2"} and compared == [50]
