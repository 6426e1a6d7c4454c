"""Kernels of the planning queries against brute force."""

import heapq
import math
import random

import numpy as np
from pyspark.sql import functions as F

from meshspan.operators import finder, hike, merge, viewshed
from meshspan.sources.derived import dem_rows


def test_walk_is_the_cheapest():
    rnd = random.Random(2)
    grid = np.array([[rnd.uniform(0, 40) for _ in range(9)] for _ in range(9)])
    grid[4, 3] = np.nan
    at = lambda i, j: (36 + i / 1000, -115 + j / 1000)
    cap = 14.0
    limit = math.tan(math.radians(cap + 0.5))

    def edges(x):
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                y = (x[0] + di, x[1] + dj)
                if y != x and 0 <= y[0] < 9 and 0 <= y[1] < 9 and not np.isnan(grid[y]):
                    h, v = hike._metres(at(*x), at(*y)), grid[y] - grid[x]
                    if abs(v) <= limit * h or y == (8, 8):
                        yield y, hike.edge_cost(h, v)

    best, heap = {}, [(0.0, (0, 0))]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in edges(x):
                heapq.heappush(heap, (d + w, y))
    path = hike.search(grid, at, (0, 0), (8, 8), cap, 1e9)
    cost = sum(hike.edge_cost(hike._metres(at(*a), at(*b)), grid[b] - grid[a]) for a, b in zip(path, path[1:]))
    assert path[0] == (0, 0) and path[-1] == (8, 8) and abs(cost - best[8, 8]) < 1e-6
    assert hike.search(grid, at, (0, 0), (8, 8), cap, 500.0) is None


def test_walk_crosses_tiles(spark):
    req = spark.createDataFrame([(1, 36.99, -117.01, 37.01, -116.99), (2, 60.0, 10.0, 60.001, 10.0)], "id long, lat_a double, lon_a double, lat_b double, lon_b double")
    got = {r.id: r for r in hike.routes(req, dem_rows(spark), max_len=9000.0).collect()}
    assert set(got) == {1} and got[1].found and got[1].length_m >= got[1].horiz_m > 2000
    first, last = got[1].path[0], got[1].path[-1]
    assert abs(first.lat - 36.99) < 0.01 and abs(last.lon + 116.99) < 0.01


LINK = {"freq_mhz": 900.0, "eirp_chain": 25.0, "threshold_dbm": -110.0, "fresnel": 0.6, "clutter": 0.0, "rx_height": 2.0}


def test_flat_ground_covers_a_disc_and_a_wall_casts_a_shadow():
    flat = np.zeros((720, 41), np.float32)
    pr = viewshed.levels(flat, 36.0, 4000.0, 32, 30.0, LINK)
    assert np.isnan(pr[0, 0]) and not np.isnan(pr[15:17, 15:17]).any()
    wall = flat.copy()
    wall[0:180, 10:12] = 400.0  # north to east
    shadowed = viewshed.levels(wall, 36.0, 4000.0, 32, 30.0, LINK)
    fewer = lambda a, b: np.isnan(b).sum() > np.isnan(a).sum() or np.nanmean(b) < np.nanmean(a) - 5
    assert fewer(pr[:14, 18:], shadowed[:14, 18:])
    assert np.allclose(pr[18:, :14], shadowed[18:, :14], equal_nan=True)


def test_chain_search():
    hears = {"a": [(1, "dead"), (2, "b")], "dead": [], "b": [(1, "a"), (2, "goal")]}
    assert finder.chain("a", {"goal"}, hears) == ["a", "b", "goal"]
    assert finder.chain("a", {"goal"}, {"a": [(1, "dead")]}) is None
    assert finder.chain("a", {"a"}, {}) == ["a"]
    # a site reached too late on one way is met again on a shorter one
    hears = {"s": [(1, "a"), (2, "c")], "a": [(1, "b")], "b": [(1, "c")], "c": [(1, "g")]}
    assert finder.chain("s", {"g"}, hears, depth=3) == ["s", "c", "g"]


def test_merge_cuts_a_parallel_stretch_and_keeps_a_crossing(spark):
    step = 0.0002  # about 22 m
    line = [(1, i, 36 + i * step, -115.0) for i in range(12)]
    later = [(36 + i * step, -115.00001) for i in range(4, 8)] + [(36 + 10 * step, -115.00001)]
    e = spark.createDataFrame(line, "line long, ord long, lat double, lon double")
    got = merge.merge_layer(e, spark.createDataFrame(later, "lat double, lon double"))
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.piece, []).append(r.ord)
    assert sorted(sorted(p) for p in pieces.values()) == [[0, 1, 2, 3, 4], [7, 8, 9, 10, 11]]
    untouched = merge.merge_layer(e, spark.createDataFrame([], "lat double, lon double")).agg(F.count("*"), F.countDistinct("piece")).first()
    assert tuple(untouched) == (12, 1)
