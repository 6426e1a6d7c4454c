"""Road graphs: welding, components, shortest paths, reconstruction.

Shortest paths run as frontier rounds of joins and grouped minima, so a graph of
any size stays distributed; a round relaxes only nodes whose cost fell in the
round before, and rewrites only what changed lately.  Lineage is cut each round by
a reliable checkpoint.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="meshspan-graph-"))
    return df.checkpoint()


def weld(points: DataFrame, size_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``node``: the smallest point of the grid cell they share.

    Cells of ``size_m`` stand for the first-come rule, whose result depends on
    input order; near points in two cells stay apart.
    """
    step = size_m / 111_000.0
    cy = F.floor(F.col(lat) / step)
    cx = F.floor(F.col(lon) * F.cos(F.radians(cy * step)) / step)
    return points.withColumn("node", F.xxhash64(cy, cx))


def reach(edges: DataFrame, sources: DataFrame, cap: float | None = None, key: list[str] | None = None) -> DataFrame:
    """Least cost from any source: (node, cost, prev) over directed ``edges`` (src, dst, cost), up to ``cap``.

    With ``key``, columns of ``sources``, every key has a tree of its own.  Equal
    costs prefer the smaller predecessor, so results don't depend on
    partitioning.  Sources have cost 0 and no predecessor.  Costs are positive,
    so the rounds end with the longest least way, whatever its length.
    """
    key = key or []
    at = [*key, "node"]
    best = cut(sources.select(*at, F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("prev")).distinct())
    front, late = best, None
    while True:
        step = front.join(edges.withColumnRenamed("cost", "w"), front.node == edges.src).select(*key, F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("prev"))
        if cap is not None:
            step = step.filter(F.col("cost") <= cap)
        step = step.groupBy(*at).agg(F.min(F.struct("cost", "prev")).alias("m")).select(*at, "m.*")
        # What earlier rounds improved is small beside the nodes that stand; both are looked up, only the first is rewritten.
        for have in (best, late):
            if have is not None:
                old = have.select(*at, F.col("cost").alias("old"), F.col("prev").alias("old_prev"))
                better = F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("prev") < F.col("old_prev")))
                step = step.join(old, at, "left").filter(better).drop("old", "old_prev")
        front = cut(step)
        if front.isEmpty():
            break
        late = front if late is None else cut(late.join(front.select(*at), at, "left_anti").union(front))
        if late.count() * 4 > best.count():
            best, late = cut(best.join(late.select(*at), at, "left_anti").union(late)), None
    return best if late is None else cut(best.join(late.select(*at), at, "left_anti").union(late))


def budget_reach(edges: DataFrame, sources: DataFrame, caps: list[int], overall: int) -> DataFrame:
    """The best ways to each node under a cap on the length driven on each class of road, and on all of it.

    ``edges`` are directed (src, dst, cost, length, cls), whole numbers, cls from 0
    to len(caps) - 1.  A way is (node, cost, used array<long>, prev_node, prev_cost,
    prev_used); a node keeps every way that no other beats on cost and on each
    class, since a dearer one may have budget left where it matters.  Rounds carry
    only ways that are new, and look at the nodes they reach.
    """
    none = lambda t: F.lit(None).cast(t)
    zero = F.array(*[F.lit(0).cast("long") for _ in caps])
    prev = ("prev_node", "prev_cost", "prev_used")
    best = cut(sources.select("node", F.lit(0).cast("long").alias("cost"), zero.alias("used"), none("long").alias("prev_node"), none("long").alias("prev_cost"), none("array<long>").alias("prev_used")).distinct())
    front = best
    limit = F.array(*[F.lit(int(c)) for c in caps])
    while True:
        e = edges.select(F.col("src").alias("node"), "dst", F.col("cost").alias("w"), "length", "cls")
        used = F.transform("used", lambda u, i: u + F.when(i == F.col("cls"), F.col("length")).otherwise(0))
        step = front.join(e, "node").select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), used.alias("used"), F.col("node").alias("prev_node"), F.col("cost").alias("prev_cost"), F.col("used").alias("prev_used"), "cls")
        step = step.filter((F.element_at("used", F.col("cls") + 1) <= F.element_at(limit, F.col("cls") + 1)) & (F.aggregate("used", F.lit(0).cast("long"), lambda s, u: s + u) <= overall))
        step = step.groupBy("node", "used").agg(F.min(F.struct("cost", *prev)).alias("m")).select("node", "m.cost", "used", *[f"m.{c}" for c in prev], F.lit(1).alias("new"))
        met = best.join(step.select("node").distinct(), "node", "left_semi").withColumn("new", F.lit(0))
        both = met.unionByName(step).groupBy("node", "used").agg(F.min(F.struct("cost", "new", *prev)).alias("m")).select("node", F.struct("m.cost", "used", "m.new", *[f"m.{c}" for c in prev]).alias("way"))
        beats = lambda y, x: (y["cost"] <= x["cost"]) & (y["used"] != x["used"]) & F.forall(F.zip_with(y["used"], x["used"], lambda a, b: a <= b), lambda ok: ok)
        kept = both.groupBy("node").agg(F.collect_list("way").alias("ways"))
        kept = cut(kept.select("node", F.explode(F.filter("ways", lambda x: ~F.exists("ways", lambda y: beats(y, x)))).alias("x")).select("node", "x.cost", "x.used", *[f"x.{c}" for c in prev], "x.new"))
        front = kept.filter("new = 1").drop("new")
        if front.isEmpty():
            return best
        best = cut(best.join(kept.select("node").distinct(), "node", "left_anti").unionByName(kept.drop("new")))


def budget_paths(ways: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, node): for each target (column node) its cheapest way, from the target back to its source."""
    cheap = ways.join(targets.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("cost", "used")).alias("m"))
    tip = cut(cheap.select(F.col("node").alias("target"), F.lit(0).alias("step"), "node", "m.cost", "m.used"))
    out = tip
    while True:
        up = tip.join(ways, ["node", "cost", "used"]).filter("prev_node is not null")
        tip = cut(up.select("target", (F.col("step") + 1).alias("step"), F.col("prev_node").alias("node"), F.col("prev_cost").alias("cost"), F.col("prev_used").alias("used")))
        if tip.isEmpty():
            return out.select("target", "step", "node")
        out = out.union(tip)


def paths(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, node): the way from each target (column node) back to its source in a ``reach`` tree."""
    walk = targets.select(F.col("node").alias("target"), F.lit(0).alias("step"), "node").join(tree.select("node"), "node", "left_semi").select("target", "step", "node")
    out, parents = cut(walk), tree.filter("prev is not null").select("node", "prev")
    tip = out
    while True:
        tip = cut(tip.join(parents, "node").select("target", (F.col("step") + 1).alias("step"), F.col("prev").alias("node")))
        if tip.isEmpty():
            return out
        out = out.union(tip)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches, edges taken both ways.

    Each round every node looks up its parent's parent, and offers the smallest of
    those among its neighbours to itself and to its parent; trees hang under each
    other at their roots and halve their depth at once, so rounds grow with the
    logarithm of a component's width, whatever the order of ids (Zhang, Azad and
    Hu, "FastSV", 2020).  Minima meet in the tasks before they shuffle.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    alone = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("component"))
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    v = cut(least.union(alone).groupBy("node").agg(F.min(F.least("node", "m")).alias("p")))
    while True:
        up = v.select(F.col("node").alias("p"), F.col("p").alias("g"))
        g = cut(v.join(up, "p").select("node", "p", "g"))
        near = both.join(g.select(F.col("node").alias("dst"), F.col("g").alias("o")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("o").alias("o"))
        near = cut(near.join(g.select("node", "p"), "node"))
        offers = near.select(F.col("p").alias("node"), "o").union(near.select("node", "o")).union(g.select("node", "g")).groupBy("node").agg(F.min("o").alias("o"))
        new = cut(g.join(offers, "node").select("node", F.least("p", "g", "o").alias("p"), F.col("p").alias("old")))
        if new.filter("p <> old").isEmpty():
            return new.select("node", F.col("p").alias("component"))
        v = new.select("node", "p")
