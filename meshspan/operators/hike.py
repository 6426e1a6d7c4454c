"""Walking routes over terrain: A* on elevation cells, one request at a time.

A request brings its own window of scanlines by a join, bounded by the length it
may walk, so tasks hold windows and never the terrain.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

R = 6_371_000.0
LADDER = (21.8, 26.6, 31.0, 45.0)
RESULT = "id long, found boolean, cap_deg double, horiz_m double, length_m double, gain_m double, loss_m double, max_slope_deg double, cost double, path array<struct<lat:double,lon:double>>"


def _metres(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def edge_cost(horiz: float, rise: float) -> float:
    return horiz + 4 * max(rise, 0.0) + 8 * max(-rise, 0.0)


def search(grid: np.ndarray, at, start: tuple[int, int], goal: tuple[int, int], cap_deg: float, max_len: float):
    """Cheapest way over 8-connected cells, or None; ``at(i, j)`` gives a cell's (lat, lon).

    An edge steeper than the cap plus half a degree is barred, unless it reaches
    the goal.  A label's slope length may not pass ``max_len``.
    """
    limit = math.tan(math.radians(cap_deg + 0.5))
    h, w = grid.shape
    best, heap = {start: (0.0, 0.0, None)}, [(_metres(at(*start), at(*goal)), start)]
    done = set()
    while heap:
        _, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x == goal:
            path = [x]
            while best[path[-1]][2] is not None:
                path.append(best[path[-1]][2])
            return path[::-1]
        cost, length, _ = best[x]
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                y = (x[0] + di, x[1] + dj)
                if y == x or not (0 <= y[0] < h and 0 <= y[1] < w) or y in done or np.isnan(grid[y]):
                    continue
                horiz, rise = _metres(at(*x), at(*y)), float(grid[y] - grid[x])
                if abs(rise) > limit * horiz and y != goal:
                    continue
                far = length + math.hypot(horiz, rise)
                new = cost + edge_cost(horiz, rise)
                if far <= max_len and (y not in best or new < best[y][0]):
                    best[y] = (new, far, x)
                    heapq.heappush(heap, (new + _metres(at(*y), at(*goal)), y))
    return None


def _solve(max_len: float, ladder):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(r["n"])
        step = 1 / (n - 1)
        rows = {}
        for gi, gj, e in zip(pdf["gi"], pdf["gj"], pdf["elev"]):
            for k, z in enumerate(e):
                if z > -12000:
                    rows[int(gi), int(gj) + k] = float(z)
        j0, i0 = min(k[1] for k in rows), min(k[0] for k in rows)
        grid = np.full((max(k[0] for k in rows) - i0 + 1, max(k[1] for k in rows) - j0 + 1), np.nan)
        for (i, j), z in rows.items():
            grid[i - i0, j - j0] = z
        at = lambda i, j: ((i + i0) * step - 90, (j + j0) * step - 180)
        cell = lambda la, lo: (round((la + 90) / step) - i0, round((lo + 180) / step) - j0)
        a, b = cell(r["lat_a"], r["lon_a"]), cell(r["lat_b"], r["lon_b"])
        ok = all(0 <= c[0] < grid.shape[0] and 0 <= c[1] < grid.shape[1] and not np.isnan(grid[c]) for c in (a, b))
        path, cap = None, None
        for cap in ladder if ok else ():
            path = search(grid, at, a, b, cap, max_len)
            if path is not None:
                break
        if path is None:
            return pd.DataFrame([{"id": r["id"], "found": False, "cap_deg": None, "horiz_m": _metres((r["lat_a"], r["lon_a"]), (r["lat_b"], r["lon_b"])), "length_m": None, "gain_m": None, "loss_m": None, "max_slope_deg": None, "cost": None, "path": []}])
        legs = [(_metres(at(*x), at(*y)), float(grid[y] - grid[x])) for x, y in zip(path, path[1:])]
        out = {"id": r["id"], "found": True, "cap_deg": cap, "horiz_m": sum(h for h, _ in legs), "length_m": sum(math.hypot(h, v) for h, v in legs), "gain_m": sum(max(v, 0) for _, v in legs), "loss_m": sum(max(-v, 0) for _, v in legs)}
        out |= {"max_slope_deg": max((math.degrees(math.atan2(abs(v), h)) for h, v in legs), default=0.0), "cost": sum(edge_cost(h, v) for h, v in legs), "path": [{"lat": p[0], "lon": p[1]} for p in (at(*c) for c in path)]}
        return pd.DataFrame([out])

    return run


def routes(requests: DataFrame, dem: DataFrame, max_len: float = 1609.0, ladder=LADDER) -> DataFrame:
    """Walks for requests (id, lat_a, lon_a, lat_b, lon_b), with ever steeper caps until one is found.

    Only requests whose ends are at most ``max_len`` apart can have one; the others
    and those without terrain come back with found = false where they have any
    scanline, and not at all otherwise.
    """
    n = dem.agg(F.max("n")).first()[0]
    if n is None:
        return requests.sparkSession.createDataFrame([], RESULT)
    step, pad = 1 / (n - 1), max_len / 2 / 111_000
    lo, hi = F.least("lat_a", "lat_b") - pad, F.greatest("lat_a", "lat_b") + pad
    k = F.greatest(F.cos(F.radians(F.greatest(F.abs("lat_a"), F.abs("lat_b")))), F.lit(0.01))
    west, east = F.least("lon_a", "lon_b") - pad / k, F.greatest("lon_a", "lon_b") + pad / k
    row = lambda c: F.floor((c + 90) / step)
    req = requests.withColumn("gi", F.explode(F.sequence(row(lo), row(hi)))).withColumn("tile_lon", F.explode(F.sequence(F.floor(west).cast("int"), F.floor(east).cast("int"))))
    req = req.withColumn("w", F.floor((west + 180) / step)).withColumn("e", F.floor((east + 180) / step))
    # Rows and columns on a tile's edge belong to two tiles; the northern and eastern edges are left to the neighbour.
    d = dem.filter("iy > 0").select("n", "tile_lon", ((F.col("tile_lat") + 91).cast("long") * (n - 1) - F.col("iy")).alias("gi"), F.col("elev").alias("line"))
    j = req.join(d, ["gi", "tile_lon"])
    first = (F.col("tile_lon") + 180).cast("long") * (n - 1)
    a = F.greatest(F.col("w") - first, F.lit(0))
    z = F.least(F.col("e") - first, F.lit(n - 2))
    j = j.filter(z >= a).withColumn("elev", F.slice("line", (a + 1).cast("int"), (z - a + 1).cast("int"))).withColumn("gj", first + a)
    return j.select("id", "lat_a", "lon_a", "lat_b", "lon_b", "n", "gi", "gj", "elev").groupBy("id").applyInPandas(_solve(max_len, ladder), RESULT)
