"""Routes of the fewest hops between two sites, counted and listed.

All wanted pairs go on together, a layer of sites a round.  A site is entered in
the first layer that reaches it, and only if the other end is still within the
hops left, each at most ``hop_m`` long; so a layer is one grouped join, whose rows
carry the number of ways and the shortest one, never the ways themselves.  A way
of the fewest hops meets no site twice.  Pairs that have met leave; the search of
the others deepens up to their own bound.

Listing walks the layers back from the far end, so that only links on a way of
the fewest hops are left, and then forward with the best ``k`` ways to each site:
the best ways onward are among them, so no others are built.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_RADIO, haversine_m, midpoint
from ..sources.shared import stored
from .graph import cut
from .grid_join import _lon_cell

PAIR = ["a_slug", "b_slug"]


def hop_bounds(dist_m, hop_m: float) -> tuple[Column, Column]:
    """The least hops that a distance takes, and the most that are tried: four more, eight at most."""
    least = F.greatest(F.ceil(F.col(dist_m) / hop_m), F.lit(1)).cast("int")
    return least, F.least(least + 4, F.lit(8)).cast("int")


def _layers(want: DataFrame, arcs: DataFrame, hop_m: float, most: int | None) -> tuple[list[DataFrame], DataFrame]:
    """The links that enter each layer (a_slug, b_slug, x, y, w), and what has met (a_slug, b_slug, hops, routes, best_m)."""
    if most is None:
        dist = want.withColumn("__d", haversine_m("a_lat", "a_lon", "b_lat", "b_lon"))
        least, bound = hop_bounds("__d", hop_m)
        want = dist.withColumn("most", F.when(least <= bound, bound).otherwise(0)).drop("__d")
    else:
        want = want.withColumn("most", F.lit(most))
    keep = [*PAIR, "b_lat", "b_lon", "most"]
    front = cut(want.filter("most > 0").select(*keep, F.col("a_slug").alias("node"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("d")))
    seen, links, met, arcs = front.select(*PAIR, "node"), [], None, cut(arcs)
    while not front.isEmpty():
        depth = len(links) + 1
        step = front.join(arcs, front.node == arcs.x_slug).filter(F.col("most") >= depth)
        step = step.filter(haversine_m("y_lat", "y_lon", "b_lat", "b_lon") <= (F.col("most") - depth) * hop_m + 1)
        step = cut(step.join(seen.withColumnRenamed("node", "y_slug"), [*PAIR, "y_slug"], "left_anti"))
        links.append(step.select(*PAIR, F.col("node").alias("x"), F.col("y_slug").alias("y"), "w"))
        layer = step.groupBy(*keep, F.col("y_slug").alias("node")).agg(F.sum("n").alias("n"), F.min(F.col("d") + F.col("w")).alias("d"))
        hit = cut(layer.filter("node = b_slug").select(*PAIR, F.lit(depth).alias("hops"), F.col("n").alias("routes"), F.col("d").alias("best_m")))
        met = hit if met is None else met.union(hit)
        front = cut(layer.join(hit, PAIR, "left_anti"))
        seen = seen.union(front.select(*PAIR, "node"))
    if met is None:
        met = want.limit(0).select(*PAIR, F.lit(0).alias("hops"), F.lit(0).cast("long").alias("routes"), F.lit(0.0).alias("best_m"))
    return links, met


def fewest_hops(want: DataFrame, arcs: DataFrame, hop_m: float, most: int | None = None) -> DataFrame:
    """For each wanted pair (a_slug, a_lat, a_lon, b_...): hops, routes, best_m; hops and best_m are null and routes 0 where the bound is not enough.

    ``arcs`` hold both directions (x_slug, y_slug, y_lat, y_lon, w).  ``most`` bounds
    the hops of every pair; without it the bound comes from each pair's distance.
    """
    _, met = _layers(want, arcs, hop_m, most)
    out = want.select(*PAIR).distinct().join(met, PAIR, "left")
    return out.select(*PAIR, "hops", F.coalesce("routes", F.lit(0).cast("long")).alias("routes"), "best_m")


def list_paths(want: DataFrame, arcs: DataFrame, hop_m: float, most: int | None = None, k: int = 500) -> DataFrame:
    """The ``k`` shortest routes of the fewest hops for each wanted pair: rank, path (array of slugs), d; ties by path."""
    links, met = _layers(want, arcs, hop_m, most)
    met = cut(met)
    on, ways = None, []
    for depth in range(len(links), 0, -1):
        goal = met.filter(F.col("hops") == depth).select(*PAIR, F.col("b_slug").alias("y"))
        on = goal if on is None else on.union(goal)
        here = cut(links[depth - 1].join(on, [*PAIR, "y"], "left_semi"))
        ways.insert(0, here)
        on = here.select(*PAIR, F.col("x").alias("y")).distinct()
    best, out = want.select(*PAIR, F.col("a_slug").alias("node"), F.lit(0.0).alias("d"), F.array("a_slug").alias("path")).distinct(), None
    for here in ways:
        step = best.join(here.withColumnRenamed("x", "node"), [*PAIR, "node"])
        step = step.select(*PAIR, F.col("y").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.array_append("path", F.col("y")).alias("path"))
        rank = F.row_number().over(Window.partitionBy(*PAIR, "node").orderBy("d", "path"))
        step = cut(step.withColumn("rank", rank).filter(F.col("rank") <= k))
        done = step.filter("node = b_slug").select(*PAIR, "rank", "path", "d")
        out = done if out is None else out.union(done)
        best = step.filter("node <> b_slug").drop("rank")
    if out is None:
        return want.limit(0).select(*PAIR, F.lit(0).alias("rank"), F.array("a_slug").alias("path"), F.lit(0.0).alias("d"))
    return out


#: what the bound of a pair is raised by, a round each
DEEPER = (0, 1, 2, 3, 4)


def _adjacency(pdf):
    """Spots of a tile as arrays: ids, places, sites a spot, and their links as rows of a sparse matrix (first, to, w)."""
    pdf = pdf.sort_values("spot")
    ids, counts = pdf["spot"].to_numpy(), pdf["ys"].map(len).to_numpy(np.int64)
    to, w = (np.concatenate([np.zeros(0, t), *pdf[c]]).astype(t) for c, t in (("ys", np.int64), ("ws", np.float64)))
    at = np.minimum(np.searchsorted(ids, to), max(len(ids) - 1, 0))
    here = ids[at] == to if len(ids) else np.zeros(0, bool)  # links that leave the tile are on no way within the bound
    row = np.repeat(np.arange(len(ids)), counts)[here]
    return ids, np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lon"].to_numpy(float)), pdf["n"].to_numpy(np.int64), np.searchsorted(row, np.arange(len(ids) + 1)), at[here], w[here]


def _links_of(first, nodes):
    """Positions of all links of ``nodes``, and for each the position of its node among them."""
    size = first[nodes + 1] - first[nodes]
    of = np.repeat(np.arange(len(nodes)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[nodes][of], of


def _search(net, a: int, b: int, bound: int, hop_m: float):
    """Layers of the search from a, each as (nodes, ways to one site there, shortest way), up to the one that links to b; None if the bound is not enough."""
    _, la, lo, n, first, to, w = net
    h = np.sin((la - la[b]) / 2) ** 2 + np.cos(la) * np.cos(la[b]) * np.sin((lo - lo[b]) / 2) ** 2
    left = 2 * R_RADIO * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    ends = slice(first[b], first[b + 1])
    level, ways, short = np.full(len(la), -1), np.zeros(len(la), np.int64), np.full(len(la), np.inf)
    level[a], ways[a], short[a] = 0, 1, 0.0
    layers = [np.array([a])]
    for depth in range(1, bound + 1):
        hit = level[to[ends]] == depth - 1
        if hit.any():
            return layers, level, ways, short
        nodes = layers[-1]
        if depth == bound or not len(nodes):
            return None
        link, of = _links_of(first, nodes)
        y = to[link]
        new = (level[y] < 0) & (left[y] <= (bound - depth) * hop_m + 1)
        link, x, y = link[new], nodes[of[new]], y[new]
        if float(ways[nodes].max(initial=0)) * float(n[nodes].max(initial=0)) * len(nodes) > 2.0**62:
            raise OverflowError("more ways than 64 bits count")
        level[y] = depth
        np.add.at(ways, y, ways[x] * np.where(x == a, 1, n[x]))
        np.minimum.at(short, y, short[x] + w[link])
        layers.append(np.unique(y))
    return None


def _ends(net, found, a: int, b: int):
    """Hops, ways and the shortest way of what ``_search`` found."""
    _, _, _, n, first, to, w = net
    layers, level, ways, short = found
    ends = slice(first[b], first[b + 1])
    hit = level[to[ends]] == len(layers) - 1
    x = to[ends][hit]
    return len(layers), int((ways[x] * np.where(x == a, 1, n[x])).sum()), float((short[x] + w[ends][hit]).min())


def _listed(net, found, a: int, b: int, names, k: int):
    """The ``k`` shortest ways as (names between the ends, metres), equal ones by names.

    Ways go by spots first, forward from a; a start of a way is dropped once ``k``
    others have a shorter rest, which is known from the far end, so a layer holds
    little more than ``k``.
    """
    _, la, _, n, first, to, w = net
    layers, level, _, _ = found
    rest = np.full(len(la), np.inf)
    ends = slice(first[b], first[b + 1])
    hit = level[to[ends]] == len(layers) - 1
    np.minimum.at(rest, to[ends][hit], w[ends][hit])
    last = rest.copy()
    for depth in range(len(layers) - 1, 0, -1):
        nodes = layers[depth][np.isfinite(rest[layers[depth]])]
        link, of = _links_of(first, nodes)
        back = level[to[link]] == depth - 1
        np.minimum.at(rest, to[link][back], rest[nodes[of[back]]] + w[link][back])
    path, d, mult = np.array([[a]]), np.zeros(1), np.ones(1)
    for depth in range(1, len(layers)):
        link, of = _links_of(first, path[:, -1])
        on = (level[to[link]] == depth) & np.isfinite(rest[to[link]])
        link, of = link[on], of[on]
        y = to[link]
        reach, many = d[of] + w[link], mult[of] * n[y]
        total = reach + rest[y]
        order = np.argsort(total, kind="stable")
        enough = np.searchsorted(np.cumsum(many[order]), k)
        if enough < len(order):
            order = order[total[order] <= total[order[enough]] + 1e-6]
        path, d, mult = np.column_stack([path[of[order]], y[order]]), reach[order], many[order]
    d = d + last[path[:, -1]]
    order, out, i = np.argsort(d, kind="stable"), [], 0
    while i < len(order) and len(out) < k:
        j = i
        while j < len(order) and d[order[j]] == d[order[i]]:
            j += 1
        alike = [itertools.product(*[names[x] for x in path[o][1:]]) for o in order[i:j]]
        out += [(p, float(d[order[i]])) for p in itertools.islice(heapq.merge(*alike), k - len(out))]
        i = j
    return out


def _tile_kernel(hop_m: float, k: int | None):
    def run(key, want, spots):
        net = _adjacency(spots)
        at = {s: i for i, s in enumerate(net[0])}
        names = spots.sort_values("spot")["names"].tolist() if k else None
        out = []
        for a, b in zip(want["a_spot"], want["b_spot"]):
            i, j = at.get(a), at.get(b)
            if i is None or j is None:
                continue
            found = _search(net, i, j, int(key[0]), hop_m)
            if found is None:
                continue
            if k:
                ways = _listed(net, found, i, j, names, k)
                out.append((a, b, [">".join(p) for p, _ in ways], [d for _, d in ways]))
            else:
                out.append((a, b, *_ends(net, found, i, j)))
        return pd.DataFrame(out, columns=["a_spot", "b_spot", *(("paths", "ds") if k else ("hops", "routes", "best_m"))])

    return run


def _tiles(df: DataFrame, step: float, reach: float) -> DataFrame:
    """``df`` once for each tile of ``step`` degrees that lies within ``reach`` degrees of it: __band, __cell."""
    lo, hi = (F.floor((F.col("lat") + s * reach + 90) / step) for s in (-1, 1))
    df = df.withColumn("__band", F.explode(F.sequence(lo, hi)))
    wide = reach / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + reach)))
    lo, hi = (_lon_cell(F.col("lon") + s * wide, F.col("__band"), step) for s in (-1, 1))
    return df.withColumn("__cell", F.explode(F.sequence(lo, hi)))


def spot_routes(want: DataFrame, spots: DataFrame, hop_m: float, k: int | None = None) -> DataFrame:
    """``fewest_hops`` between spots, where all sites of a spot have the same links; with ``k`` the ways of ``list_paths``.

    ``want`` has a_spot and b_spot (longs) and their places; pairs of sites at the same
    two spots are one search.  ``spots`` has spot, lat, lon, n (how many sites), ys
    and ws (linked spots and distances) and with ``k`` names, its first ``k`` sites in
    order.  A way meets no two sites of a spot, as they hear the same.

    A pair is searched within the least bound first and deeper only if that is not
    enough; what it may pass lies around its middle, so a task gets the pairs of a
    tile and the spots around it.  Gives hops, routes and best_m, or paths (names
    between the ends) and ds.  Pairs without a way within their bound are left out.
    """
    deg = 180 / math.pi / R_RADIO * 1.0001
    dist = haversine_m("a_lat", "a_lon", "b_lat", "b_lon")
    least, bound = hop_bounds("__d", hop_m)
    mid = midpoint("a_lat", "a_lon", "b_lat", "b_lon")
    want = want.withColumn("__d", dist).select("a_spot", "b_spot", mid[0].alias("lat"), mid[1].alias("lon"), least.alias("least"), bound.alias("most"))
    schema = "a_spot long, b_spot long, " + ("paths array<string>, ds array<double>" if k else "hops int, routes long, best_m double")
    left, out, tile = cut(want.filter("least <= most")), None, ["__bound", "__band", "__cell"]
    for more in DEEPER:
        left = left.filter(F.col("least") + more <= F.col("most"))
        some = left.withColumn("__bound", F.col("least") + more)
        pairs = nodes = None
        for hops in sorted(x[0] for x in some.select("__bound").distinct().collect()):  # eight at most
            reach = (hops * hop_m / 2 + 10) * deg
            step = 2 * reach if hops <= 5 else reach
            p = _tiles(some.filter(F.col("__bound") == hops), step, 0.0)
            q = _tiles(spots, step, reach).withColumn("__bound", F.lit(hops)).join(p.select("__band", "__cell").distinct(), ["__band", "__cell"], "left_semi")
            pairs, nodes = (p, q) if pairs is None else (pairs.unionByName(p), nodes.unionByName(q))
        if pairs is None:
            break
        got = pairs.groupBy(*tile).cogroup(nodes.groupBy(*tile)).applyInPandas(_tile_kernel(hop_m, k), schema)
        got = stored(got, "routes")
        out = got if out is None else out.unionByName(got)
        left = cut(left.join(got.select("a_spot", "b_spot").distinct(), ["a_spot", "b_spot"], "left_anti"))
    return out if out is not None else want.sparkSession.createDataFrame([], schema)
