"""Routing graphs from road segments: welding, splitting, anchors, trees, strokes.

A segment has lat_a, lon_a, lat_b, lon_b, a unique ``id`` and its tags.  Ends less
than ``weld_m`` apart, also by steps, are one node, that of the smallest end; a
segment with a node on it is split there.  Both rules look at distances only, so
the graph does not depend on the order of the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions import roads
from . import graph, grid_join

TAGS = ("highway", "tracktype", "surface", "fourwd")


def ends(segments: DataFrame) -> DataFrame:
    """A row for each end: vertex (2 * id, 2 * id + 1), lat, lon."""
    one = lambda k, s: segments.select((F.col("id") * 2 + k).alias("vertex"), F.col(f"lat_{s}").alias("lat"), F.col(f"lon_{s}").alias("lon"))
    return one(0, "a").union(one(1, "b"))


def weld(points: DataFrame, weld_m: float, key: str = "vertex") -> DataFrame:
    """``points`` (key, lat, lon) with ``node``: the smallest key of the points chained by steps of at most ``weld_m``.

    Points of one place are one point first, so that a crossing of many roads
    makes no pairs among its own ends.
    """
    place = points.groupBy("lat", "lon").agg(F.min(key).alias("p"))
    a = place.select(F.col("p").alias("src"), "lat", "lon")
    b = place.select(F.col("p").alias("dst"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = grid_join.within(a, b, weld_m, radius=g.R_GROUND).filter("src <> dst").select("src", "dst")
    group = graph.components(near).withColumnRenamed("node", "p")
    place = place.join(group, "p", "left").select("lat", "lon", F.coalesce("component", "p").alias("node"))
    return points.join(place, ["lat", "lon"]).select(*points.columns, "node")


def build(segments: DataFrame, weld_m: float = 8.0, snap_m: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node, lat, lon; and src < dst with the tags, length_m and n (parallel segments) of the cheapest piece.

    Both ends of a piece are nodes.  A node at most ``snap_m`` from a segment,
    and not at its ends, splits it.  Segments alike in place and tags are looked
    at once, under the smallest id, and counted.
    """
    tags = [t for t in TAGS if t in segments.columns]
    segments = graph.cut(segments.groupBy("lat_a", "lon_a", "lat_b", "lon_b", *tags).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("alike")))
    welded = graph.cut(weld(ends(segments), weld_m))
    nodes = graph.cut(welded.groupBy("node").agg(F.min(F.struct("vertex", "lat", "lon")).alias("m")).select("node", "m.lat", "m.lon"))
    tip = lambda k, s: welded.filter(F.col("vertex") % 2 == k).select(((F.col("vertex") - k) / 2).cast("long").alias("id"), F.col("node").alias(f"node_{s}"))
    s = segments.join(tip(0, "a"), "id").join(tip(1, "b"), "id")
    on = _nodes_on(segments, nodes, snap_m)
    stops = s.select("id", F.col("node_a").alias("node"), F.lit(0.0).alias("t")).union(s.select("id", F.col("node_b"), F.lit(1.0)))
    inner = on.join(s.select("id", "node_a", "node_b"), "id").filter("node <> node_a and node <> node_b").select("id", "node", "t")
    w = Window.partitionBy("id").orderBy("t", "node")
    piece = stops.union(inner).withColumn("next", F.lead("node").over(w)).filter("next is not null and next <> node")
    at = lambda n, x: nodes.select(F.col("node").alias(n), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    e = piece.select("id", F.least("node", "next").alias("src"), F.greatest("node", "next").alias("dst")).join(segments.select("id", "alike", *tags), "id")
    e = e.join(at("src", "a"), "src").join(at("dst", "b"), "dst").withColumn("length_m", g.haversine_m("lat_a", "lon_a", "lat_b", "lon_b", g.R_GROUND))
    e = e.withColumn("cost", F.col("length_m") * roads.cost_multiplier(*[F.col(t) if t in tags else F.lit(None).cast("string") for t in TAGS]))
    best = e.groupBy("src", "dst").agg(F.sum("alike").alias("n"), F.min(F.struct("cost", "id", "length_m", *tags)).alias("m"))
    return nodes, best.select("src", "dst", "n", "m.cost", "m.length_m", *[f"m.{t}" for t in tags])


def _nodes_on(segments: DataFrame, nodes: DataFrame, snap_m: float, sample_m: float = 400.0) -> DataFrame:
    """(id, node, t): nodes at most ``snap_m`` from the inside of a segment, by samples at most ``sample_m`` apart."""
    length = g.haversine_m("lat_a", "lon_a", "lat_b", "lon_b", g.R_GROUND)
    n = F.greatest(F.ceil(length / sample_m), F.lit(1))
    s = segments.select("id", "lat_a", "lon_a", "lat_b", "lon_b").withColumn("f", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: (i.cast("double") - 0.5) / n)))
    s = s.withColumn("lat", F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("f")).withColumn("lon", F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("f"))
    r = nodes.select("node", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = grid_join.within(s, r, sample_m / 2 + snap_m, radius=g.R_GROUND).dropDuplicates(["id", "node"])
    t = g.along_track("r_lat", "r_lon", "lat_a", "lon_a", "lat_b", "lon_b")
    near = near.withColumn("t", t).filter("t > 0 and t < 1")
    foot = [F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("t") for c in ("lat", "lon")]
    return near.filter(g.haversine_m("r_lat", "r_lon", *foot, g.R_GROUND) <= snap_m).select("id", "node", "t")


def nearest_edge(points: DataFrame, edges: DataFrame, nodes: DataFrame, max_m: float, key: str) -> DataFrame:
    """For each point (key, lat, lon) the edge that passes nearest, at most ``max_m`` away: src, dst, foot_lat, foot_lon, off_m."""
    at = lambda n, x: nodes.select(F.col("node").alias(n), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    e = edges.select("src", "dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst")
    sample = 400.0
    n = F.greatest(F.ceil(g.haversine_m("lat_a", "lon_a", "lat_b", "lon_b", g.R_GROUND) / sample), F.lit(1))
    e = e.withColumn("f", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: (i.cast("double") - 0.5) / n)))
    e = e.withColumn("r_lat", F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("f")).withColumn("r_lon", F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("f"))
    near = grid_join.within(points.select(key, "lat", "lon"), e, sample / 2 + max_m, radius=g.R_GROUND)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(g.along_track("lat", "lon", "lat_a", "lon_a", "lat_b", "lon_b"), F.lit(0.0))))
    near = near.withColumn("t", t)
    foot = [F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("t") for c in ("lat", "lon")]
    near = near.withColumn("foot_lat", foot[0]).withColumn("foot_lon", foot[1]).withColumn("off_m", g.haversine_m("lat", "lon", "foot_lat", "foot_lon", g.R_GROUND))
    best = near.filter(F.col("off_m") <= max_m).groupBy(key).agg(F.min(F.struct("off_m", "src", "dst", "foot_lat", "foot_lon")).alias("m"))
    return best.select(key, "m.src", "m.dst", "m.foot_lat", "m.foot_lon", "m.off_m")


def both_ways(edges: DataFrame, cost: Column | str = "cost") -> DataFrame:
    """Directed (src, dst, cost) of undirected edges."""
    c = F.col(cost) if isinstance(cost, str) else cost
    return edges.select("src", "dst", c.alias("cost")).union(edges.select("dst", "src", c))


def anchors(edges: DataFrame, paved_classes=roads.MAJOR) -> DataFrame:
    """Nodes that a paved road touches."""
    paved = edges.filter(roads.is_paved_anchor("highway", "surface", paved_classes))
    return paved.select(F.col("src").alias("node")).union(paved.select("dst")).distinct()


def drive_lines(tree: DataFrame, edges: DataFrame, nodes: DataFrame, targets: DataFrame, paved_classes=roads.MAJOR) -> DataFrame:
    """The drive to each target (column node) in a ``reach`` tree: start, drive_m, rough_m and the lines that leave pavement.

    ``line`` has the vertices (step, lat, lon) of the stretches that are not paved
    anchor roads, from the start on; ``drive_m`` is the whole way, ``rough_m`` theirs.
    """
    at = nodes.select("node", "lat", "lon")
    way = graph.paths(tree, targets.select("node").distinct())
    last = way.groupBy("target").agg(F.max("step").alias("last"), F.max_by("node", "step").alias("start"))
    hop = way.select("target", "step", F.col("node").alias("far")).join(way.select("target", (F.col("step") - 1).alias("step"), F.col("node").alias("near")), ["target", "step"])
    hop = hop.withColumn("src", F.least("near", "far")).withColumn("dst", F.greatest("near", "far"))
    paved = roads.is_paved_anchor("highway", "surface", paved_classes)
    hop = hop.join(edges.select("src", "dst", "length_m", paved.alias("paved")), ["src", "dst"]).join(last.select("target", "last"), "target")
    ends = hop.filter("not paved").select("target", F.explode(F.array(F.struct((F.col("last") - F.col("step") - 1).alias("step"), F.col("near").alias("node")), F.struct((F.col("last") - F.col("step")).alias("step"), F.col("far").alias("node")))).alias("e"))
    ends = ends.select("target", "e.step", "e.node").distinct().join(at, "node")
    line = ends.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("step", "lat", "lon"))).alias("line"))
    sums = hop.groupBy("target").agg(F.sum("length_m").alias("drive_m"), F.sum(F.when(~F.col("paved"), F.col("length_m")).otherwise(0.0)).alias("rough_m"))
    out = last.join(sums, "target", "left").join(line, "target", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(F.col("target").alias("node"), "start", zero("drive_m"), zero("rough_m"), F.coalesce("line", F.array().cast("array<struct<step:int,lat:double,lon:double>>")).alias("line"))


def strokes(edges: DataFrame, nodes: DataFrame, most_deg: float = 50.0) -> DataFrame:
    """(src, dst, stroke): edges that run on into each other share a stroke, named by its smallest edge.

    Two edges run on at a node if no other edge meets there, or if each is the
    other's straightest continuation and they turn by ``most_deg`` at most.
    """
    at = nodes.select("node", "lat", "lon")
    half = edges.select("src", "dst", F.col("src").alias("node"), F.col("dst").alias("far")).union(edges.select("src", "dst", "dst", "src"))
    half = half.join(at, "node").join(at.select(F.col("node").alias("far"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")), "far")
    half = half.withColumn("b", g.bearing_deg("lat", "lon", "f_lat", "f_lon")).withColumn("edge", F.struct("src", "dst"))
    degree = half.groupBy("node").agg(F.count("*").alias("degree"))
    half = half.select("node", "edge", "b").join(degree, "node")
    other = half.select("node", F.col("edge").alias("edge2"), F.col("b").alias("b2"))
    pair = half.join(other, "node").filter("edge <> edge2")
    pair = pair.withColumn("turn", F.abs(180 - g.angle_between_deg("b", "b2")))
    pair = pair.filter((F.col("degree") == 2) | (F.col("turn") <= most_deg))
    best = pair.groupBy("node", "edge").agg(F.min(F.struct("turn", "edge2")).alias("m")).select("node", "edge", "m.edge2")
    back = best.select("node", F.col("edge").alias("edge2"), F.col("edge2").alias("edge"))
    mutual = best.join(back, ["node", "edge", "edge2"]).filter("edge < edge2")
    ids = edges.select("src", "dst").withColumn("i", F.xxhash64("src", "dst"))
    link = mutual.select(F.xxhash64("edge.src", "edge.dst").alias("src"), F.xxhash64("edge2.src", "edge2.dst").alias("dst"))
    group = graph.components(link).withColumnRenamed("node", "i")
    named = ids.join(group, "i", "left").withColumn("c", F.coalesce("component", "i"))
    first = named.groupBy("c").agg(F.min(F.struct("src", "dst")).alias("stroke"))
    return named.join(first, "c").select("src", "dst", F.concat_ws("-", "stroke.src", "stroke.dst").alias("stroke"))
