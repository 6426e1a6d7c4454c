"""Road graphs, polygon overlays, greedy selections and solvers against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshspan.operators import graph, greedy, overlay, roadnet, solver, viewshed


def metres(a, b, radius=6_371_000.0):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_weld_is_by_chains_of_steps(spark):
    rnd = random.Random(1)
    pts = [(i, 37 + rnd.random() * 0.002, -117 + rnd.random() * 0.002) for i in range(150)] + [(200, 37.5, -117.0), (201, 37.5, -117.0)]
    got = {r.vertex: r.node for r in roadnet.weld(spark.createDataFrame(pts, "vertex long, lat double, lon double"), 12.0).collect()}
    root = {i: i for i, _, _ in pts}
    for _ in range(len(pts)):
        new = {i: min(root[j] for j, la2, lo2 in pts if metres((la, lo), (la2, lo2)) <= 12.0) for i, la, lo in pts}
        if new == root:
            break
        root = new
    assert got == root and len(set(root.values())) < len(pts) - 10


def test_a_segment_is_split_where_a_node_lies_on_it(spark):
    s = [(1, 37.0, -117.0, 37.01, -117.0, "track"), (2, 37.004, -117.0, 37.004, -116.99, "primary"), (3, 37.00001, -117.0, 37.01, -117.00001, "service")]
    df = spark.createDataFrame([(i, a, b, c, d, h, None, "asphalt", False) for i, a, b, c, d, h in s], "id long, lat_a double, lon_a double, lat_b double, lon_b double, highway string, tracktype string, surface string, fourwd boolean")
    nodes, edges = roadnet.build(df)
    assert {r.node for r in nodes.collect()} == {2, 3, 4, 5}
    got = {(r.src, r.dst): (r.n, r.highway) for r in edges.collect()}
    assert got == {(2, 4): (2, "service"), (3, 4): (2, "service"), (4, 5): (1, "primary")}
    assert {r.node for r in roadnet.anchors(edges).collect()} == {4, 5}
    near = roadnet.nearest_edge(spark.createDataFrame([(9, 37.007, -117.0005), (8, 38.0, -117.0)], "k long, lat double, lon double"), edges, nodes, 100.0, "k").collect()
    assert [(r.k, r.src, r.dst) for r in near] == [(9, 3, 4)] and abs(near[0].off_m - 44.4) < 1


def test_strokes_run_on_straight_and_through_bends(spark):
    at = {1: (37.0, -117.0), 2: (37.0, -116.99), 3: (37.0, -116.98), 4: (37.01, -116.99), 5: (37.0, -116.97), 6: (37.01, -116.97)}
    nodes = spark.createDataFrame([(k, *v) for k, v in at.items()], "node long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (3, 5), (5, 6)], "src long, dst long")
    got = {(r.src, r.dst): r.stroke for r in roadnet.strokes(edges, nodes).collect()}
    assert got[1, 2] == got[2, 3] == got[3, 5] == got[5, 6] == "1-2" and got[2, 4] == "2-4"


def test_reach_by_key_and_long_ways(spark):
    arcs = [(i, i + 1, 1.0) for i in range(30)] + [(0, 10, 5.0), (10, 12, 0.5)]
    e = spark.createDataFrame(arcs, "src long, dst long, cost double")
    s = spark.createDataFrame([("a", 0), ("b", 5)], "k string, node long")
    got = {(r.k, r.node): r.cost for r in graph.reach(e, s, 20.0, ["k"]).collect()}
    want = {}
    for k, n in (("a", 0), ("b", 5)):
        best = {n: 0.0}
        for _ in range(40):
            for x, y, w in arcs:
                if x in best and best[x] + w <= 20.0:
                    best[y] = min(best.get(y, 1e9), best[x] + w)
        want |= {(k, m): c for m, c in best.items()}
    assert got == want


def test_spread_everywhere_is_the_greedy_result(spark):
    rnd = random.Random(4)
    pts = [(f"p{i}", 36.95 + rnd.random() * 0.1, -117.05 + rnd.random() * 0.1, rnd.randrange(50)) for i in range(250)]
    df = spark.createDataFrame(pts, "slug string, lat double, lon double, z int")
    got = {r.slug for r in greedy.spread_everywhere(df, "slug", [-F.col("z"), F.col("slug")], 1500.0).collect()}
    kept = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all(metres(p[1:3], q[1:3]) >= 1500.0 for q in kept):
            kept.append(p)
    assert got == {p[0] for p in kept} and 5 < len(kept) < 100


def test_fold_of_hikes(spark):
    rows = [("a", 1, True, 100.0, 10.0, 5.0, 0.0), ("a", 2, False, 110.0, 3.0, 5.0, 0.0), ("a", 3, False, 300.0, 3.2, 1.0, 0.0), ("b", 1, True, 100.0, 4.0, 5.0, 0.0), ("b", 2, False, 100.0, 3.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "slug string, ord int, paved boolean, len_m double, slope double, gain double, loss double")
    assert {(r.slug, r.ord) for r in greedy.fold_hikes(df, ["slug"], ["ord"]).collect()} == {("a", 3), ("b", 1)}


def test_solver_meets_in_the_middle(spark):
    rnd = random.Random(9)
    at = {i: (37 + rnd.random() * 0.5, -117 + rnd.random() * 0.5) for i in range(40)}
    arcs = [(i, j, metres(at[i], at[j])) for i in at for j in at if i != j and metres(at[i], at[j], 6_378_137.0) <= 12_000]
    a = spark.createDataFrame([(f"{i:02}", f"{j:02}", *at[j], w) for i, j, w in arcs], "x_slug string, y_slug string, y_lat double, y_lon double, w double")
    pairs = [(i, i + 7) for i in range(30)]
    want = spark.createDataFrame([(f"{i:02}", *at[i], f"{j:02}", *at[j]) for i, j in pairs], "a_slug string, a_lat double, a_lon double, b_slug string, b_lat double, b_lon double")
    got = {(r.a_slug, r.b_slug): (r.hops, r.routes, r.best_m and round(r.best_m, 3)) for r in solver.fewest_hops(want, a, 12_000.0, 4).collect()}
    listed = {}
    for r in solver.list_paths(want, a, 12_000.0, 4, k=3).collect():
        listed.setdefault((r.a_slug, r.b_slug), []).append((r.rank, r.path, round(r.d, 3)))
    near, first = {}, {}
    for i, j, w in arcs:
        near.setdefault(i, []).append((j, w))
    expect = {}
    for s, t in pairs:
        walks = [((s,), 0.0)]
        expect[f"{s:02}", f"{t:02}"] = (None, 0, None)
        for hops in range(1, 5):
            walks = [((*p, y), d + w) for p, d in walks for y, w in near.get(p[-1], []) if y not in p]
            ends = [d for p, d in walks if p[-1] == t]
            if ends:
                best = sorted((d, [f"{x:02}" for x in p]) for p, d in walks if p[-1] == t)[:3]
                first[f"{s:02}", f"{t:02}"] = [(i + 1, p, round(d, 3)) for i, (d, p) in enumerate(best)]
                expect[f"{s:02}", f"{t:02}"] = (hops, len(ends), round(min(ends), 3))
                break
            walks = [(p, d) for p, d in walks if p[-1] != t]
    assert got == expect and {h for h, _, _ in expect.values()} >= {1, 2, 3}


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in [*points, points[0]]]


def star(rnd, cx, cy):
    n = rnd.randrange(4, 9)  # no gap of half a turn, so that edges never cross
    turns = [2 * math.pi * (i + rnd.random() * 0.8) / n for i in range(n)]
    return [(cx + math.cos(t) * r, cy + math.sin(t) * r) for t in turns for r in [0.1 + rnd.random() * 0.4]]


def inside(x, y, pts):
    return sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) for (x0, y0), (x1, y1) in zip(pts, [*pts[1:], pts[0]])) % 2 == 1


@pytest.mark.parametrize("rule", ["union", "intersection", "difference"])
def test_overlay_of_any_polygons(spark, rule):
    """Trapezoids against the shapes themselves at many points, and areas that do not depend on the cells."""
    rnd = random.Random(rule)
    shapes = [(rnd.choice("ab"), star(rnd, rnd.random() - 0.5, rnd.random() - 0.5)) for _ in range(9)]
    df = spark.createDataFrame([(role, [ring(p)]) for role, p in shapes], "role string, rings array<array<struct<lon:double,lat:double>>>")
    rows = overlay.overlay(df, rule, cell_deg=0.37).collect()
    one = overlay.overlay(df, rule, cell_deg=5.0).agg(F.sum("area")).first()[0]
    assert abs(sum(r.area for r in rows) - one) < 1e-9
    bad = 0
    for _ in range(3000):
        x, y = rnd.random() * 2 - 1, rnd.random() * 2 - 1
        a, b = (any(inside(x, y, p) for role, p in shapes if role == k) for k in "ab")
        want = {"union": a or b, "intersection": a and b, "difference": a and not b}[rule]
        at = [r for r in rows if r.y0 <= y < r.y1]
        got = sum(r.left0 + (r.left1 - r.left0) * (y - r.y0) / (r.y1 - r.y0) <= x < r.right0 + (r.right1 - r.right0) * (y - r.y0) / (r.y1 - r.y0) for r in at)
        bad += got != int(want)
    assert bad == 0


def test_overlay_of_parcels_and_holes(spark):
    """Include squares, an exclude, an area of interest; a hole stays a hole, an overlap counts once."""
    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rows = [("include", [ring(sq(0, 0, 4)), ring(sq(1, 1, 1))]), ("include", [ring(sq(3, 3, 4))]), ("exclude", [ring(sq(0, 3, 1))]), ("aoi", [ring(sq(-1, -1, 6)[::-1])])]
    df = spark.createDataFrame(rows, "role string, rings array<array<struct<lon:double,lat:double>>>")
    assert abs(overlay.overlay(df, "eligible").agg(F.sum("area")).first()[0] - (16 - 1 - 1 + 4 - 1)) < 1e-9
    assert overlay.overlay(df.limit(0), "eligible").count() == 0


def test_burn_of_all_touched_cells():
    rnd = random.Random(3)
    for _ in range(40):
        pts = star(rnd, rnd.random(), rnd.random())
        got = set(overlay.touched([ring(pts)], 10))
        dense = set()
        for (x0, y0), (x1, y1) in zip(pts, [*pts[1:], pts[0]]):
            dense |= {(math.floor((x0 + (x1 - x0) * i / 2000) * 10), math.floor((y0 + (y1 - y0) * i / 2000) * 10)) for i in range(2001)}
        centres = {(cx, cy) for cx in range(-6, 16) for cy in range(-6, 16) if inside((cx + 0.5) / 10, (cy + 0.5) / 10, pts)}
        assert dense | centres <= got and len(got - dense - centres) <= 2  # a corner clipped between two samples


def test_climb_ends_on_a_summit(spark):
    from meshspan.operators.terrain import blocks
    from meshspan.sources.derived import dem_rows, duck_height

    import duckdb

    pts = [(f"p{i}", 37.1 + i * 0.013, -117.2 + i * 0.011) for i in range(12)]
    got = viewshed.climb(spark.createDataFrame(pts, "slug string, lat double, lon double"), blocks(dem_rows(spark)), "slug", 2000.0, 60.0).collect()
    z = lambda la, lo: duckdb.sql(f"SELECT {duck_height(f'{la}::DOUBLE', f'({lo})::DOUBLE')}").fetchall()[0][0]
    assert len(got) == 12
    start = {p[0]: p[1:] for p in pts}
    for r in got:
        assert abs(z(r.lat, r.lon) - r.elev_m) < 1e-6 and r.elev_m >= z(*start[r.slug]) and metres((r.lat, r.lon), start[r.slug]) <= 2001
        for k in range(8):
            p, d, t = math.radians(r.lat), 60 / 6_371_000.0, math.radians(45 * k)
            p2 = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(t))
            lo = r.lon + math.degrees(math.atan2(math.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(p2)))
            if metres((math.degrees(p2), lo), start[r.slug]) <= 2000:
                assert z(math.degrees(p2), lo) <= r.elev_m + 1e-3


def test_access_options_by_brute_force(spark):
    from meshspan.plans.network import options

    rnd = random.Random(6)
    rows = [(k, n, 37 + rnd.random() * 0.01, -117 + rnd.random() * 0.01, round(rnd.random() * 500, 2), round(rnd.random() * 900, 2), round(rnd.random() * 3000, 3), n % 2 == 0) for k in range(6) for n in range(40)]
    df = spark.createDataFrame(rows, "k long, node long, r_lat double, r_lon double, hike_m double, jeep_m double, score double, passes boolean")
    got = {(r.k, r.node): (r.option, r.recommended) for r in options(df).collect()}
    want = {}
    for k in range(6):
        thin = []
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[4], x[1])):
            if len(thin) < 20 and all(metres(x[2:4], y[2:4]) >= 250 for y in thin):
                thin.append(x)
        kept = []
        for x in sorted(thin, key=lambda x: (x[6], x[1])):
            if len(kept) < 4 and all(metres(x[2:4], y[2:4]) >= 400 for y in kept):
                kept.append(x)
        best = kept[0]
        least = min(x[4] for x in kept)
        left = [x for x in kept if x[4] <= least + 40]
        pick = best if best in left else left[0]
        want |= {(k, x[1]): (f"{x[2]:.4f}#{x[3]:.4f}#0", x is pick) for x in left}
    assert got == want


def test_listed_routes_are_the_shortest(spark):
    arcs = [("a", "x", 1.0), ("a", "y", 2.0), ("x", "m", 5.0), ("y", "m", 3.0), ("m", "b", 1.0), ("x", "n", 1.0), ("n", "b", 9.0), ("a", "far", 1.0)]
    both = [(x, y, 0.0, 0.0, w) for x, y, w in arcs] + [(y, x, 0.0, 0.0, w) for x, y, w in arcs]
    a = spark.createDataFrame(both, "x_slug string, y_slug string, y_lat double, y_lon double, w double")
    want = spark.createDataFrame([("a", 0.0, 0.0, "b", 0.0, 0.0), ("a", 0.0, 0.0, "zz", 0.0, 0.0)], "a_slug string, a_lat double, a_lon double, b_slug string, b_lat double, b_lon double")
    got = {r.a_slug + r.b_slug: (r.hops, r.routes, r.best_m) for r in solver.fewest_hops(want, a, 1000.0).collect()}
    assert got == {"ab": (3, 3, 6.0), "azz": (None, 0, None)}
    listed = [(r.rank, ">".join(r.path), r.d) for r in solver.list_paths(want, a, 1000.0, k=2).orderBy("rank").collect()]
    assert listed == [(1, "a>y>m>b", 6.0), (2, "a>x>m>b", 7.0)]


def test_budgets_keep_every_way_that_none_beats(spark):
    rnd = random.Random(6)
    edges = [(i, j, rnd.randrange(1, 9) * (1 + 2 * c), rnd.randrange(1, 9), c) for i in range(14) for j in range(i + 1, 14) if rnd.random() < 0.3 for c in [rnd.randrange(3)]]
    arcs = edges + [(j, i, c, n, k) for i, j, c, n, k in edges]
    caps, overall = [12, 9, 7], 18
    ways = {(0, 0, (0, 0, 0))}
    front = set(ways)
    while front:
        new = set()
        for node, cost, used in front:
            for i, j, c, n, k in arcs:
                if i == node:
                    u = tuple(v + n * (x == k) for x, v in enumerate(used))
                    if u[k] <= caps[k] and sum(u) <= overall:
                        new.add((j, cost + c, u))
        front = new - ways
        ways |= front
    beats = lambda y, x: y[0] == x[0] and y[1] <= x[1] and all(a <= b for a, b in zip(y[2], x[2])) and y != x
    want = {w for w in ways if not any(beats(o, w) for o in ways)}
    e = spark.createDataFrame(arcs, "src long, dst long, cost long, length long, cls int")
    got = graph.budget_reach(e, spark.createDataFrame([(0,)], "node long"), caps, overall).cache()
    assert {(r.node, r.cost, tuple(r.used)) for r in got.collect()} == want
    # the way back of each node's cheapest adds up to it
    back = {}
    for r in graph.budget_paths(got, got.select("node").distinct()).collect():
        back.setdefault(r.target, {})[r.step] = r.node
    least = {n: min(c for m, c, _ in want if m == n) for n in {w[0] for w in want}}
    for n, steps in back.items():
        way = [steps[i] for i in sorted(steps)]
        assert way[0] == n and way[-1] == 0
        price = {(i, j): [] for i, j, *_ in arcs}
        for i, j, c, *_ in arcs:
            price[i, j].append(c)
        assert sum(min(price[b, a]) for a, b in zip(way, way[1:])) <= least[n]


def test_diverse_routes_are_those_of_one_pass(spark):
    rnd = random.Random(8)
    rows = [(i % 2, i, [rnd.randrange(60) for _ in range(rnd.choice([0, 1, 3, 5]))]) for i in range(300)]
    rnd.shuffle(rows)
    want, seen = {}, {0: set(), 1: set()}
    for g, o, p in sorted(rows, key=lambda x: x[1]):
        want[g, o] = not (set(p) & seen[g])
        if want[g, o]:
            seen[g] |= set(p)
    df = spark.createDataFrame(rows, "g int, o int, peaks array<int>")
    assert {(r.g, r.o): r.is_unique for r in greedy.diverse_routes(df, ["g"], ["o"]).collect()} == want


def test_masks_count_and_additions_are_greedy(spark):
    rnd = random.Random(2)
    cells = {f"s{i:02}": {(rnd.randrange(32), rnd.randrange(32)) for _ in range(rnd.randrange(1, 260))} for i in range(40)}
    covered = spark.createDataFrame([(s, x, y) for s, v in cells.items() for x, y in v], "slug string, x int, y int")
    chains = spark.createDataFrame([(i % 4, f"s{i:02}") for i in range(40)], "chain int, slug string")
    got = {r.chain: r.cells for r in viewshed.union_gain(viewshed.raster_masks(covered, 32), chains).collect()}
    assert got == {k: len(set().union(*[cells[f"s{i:02}"] for i in range(k, 40, 4)])) for k in range(4)}
    # on the ground: sites around two places, cells by the pixels' centres
    at = {s: (37.0 + (int(s[1:]) % 3) * 0.01, -117.0 + (int(s[1:]) // 20) * 2.0) for s in cells}
    sites = spark.createDataFrame([(s, *v) for s, v in at.items()], "slug string, lat double, lon double")
    masks = viewshed.ground_masks(covered, sites, 6000.0, 32, 500.0)

    def ground(s):
        half = 6000.0 / 6_378_137.0 * 180 / math.pi
        wide = half / math.cos(math.radians(at[s][0]))
        out = set()
        for x, y in cells[s]:
            la, lo = at[s][0] + half - (y + 0.5) / 32 * 2 * half, at[s][1] - wide + (x + 0.5) / 32 * 2 * wide
            mx, my = lo * 20037508.342789244 / 180, math.log(math.tan((90 + la) * math.pi / 360)) * 6_378_137.0
            out.add((math.floor(mx / 500), math.floor(my / 500)))
        return out

    land = {s: ground(s) for s in cells}
    assert {r.chain: r.cells for r in viewshed.union_cells(masks, chains).collect()} == {k: len(set().union(*[land[f"s{i:02}"] for i in range(k, 40, 4)])) for k in range(4)}
    have, want = set(), []
    for rank in range(1, 7):
        s = min(land, key=lambda s: (-len(land[s] - have), s))
        want.append((rank, s, len(land[s] - have)))
        have |= land.pop(s)
    assert [(r.rank, r.slug, r.gain) for r in viewshed.best_additions(masks, 6, batch=5).orderBy("rank").collect()] == want
