"""Connected components of an edge table by parent hooking and pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _contract(batches):
    """Each task replaces its own edges by stars of the trees they form."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars():
        mine = list(parent)
        out = [(x, r) for x in mine if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounds a task's memory; the forest so far is a full answer for its edges
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (id, root): root is the smallest id that id reaches.

    Ids without an edge are absent.  Every round hooks each tree onto the
    smallest tree it touches, then halves all paths, so rounds grow with the
    logarithm of the longest path.  Minima are taken map-side; the one join on a
    possibly hot key (a large component's root) has two stored inputs, which
    adaptive execution may split.
    """
    e = stored(edges.select("a", "b").mapInArrow(_contract, "a long, b long"), "edges")
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    first = both.groupBy("a").agg(F.min("b").alias("m"))
    v = stored(first.select(F.col("a").alias("id"), F.least("a", "m").alias("p")), "parents")
    while True:
        up = v.select(F.col("id").alias("p"), F.col("p").alias("g"))
        g = stored(v.join(up, "p").select("id", "p", "g"), "grand")
        near = both.join(g.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("m"))
        near = stored(near.select(F.col("a").alias("id"), "m"), "near")
        hook = g.join(near, "id").filter("m < g").groupBy(F.col("g").alias("id")).agg(F.min("m").alias("h"))
        new = g.join(near, "id", "left").join(hook, "id", "left")
        new = stored(new.select("id", F.least("g", "m", "h").alias("p"), F.col("p").alias("old")), "parents")
        if new.filter("p <> old").isEmpty():
            return new.select("id", F.col("p").alias("root"))
        v = new.select("id", "p")
