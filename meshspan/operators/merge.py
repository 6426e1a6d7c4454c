"""Ordered merging of road layers.

A later layer replaces the stretches of an earlier one that run along it: vertices
within ``near_m`` of a later vertex are covered, and covered runs of two vertices
or more and at least ``run_m`` are cut out.  Shorter runs are crossings and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_GROUND, haversine_m
from . import grid_join


def covered(earlier: DataFrame, later: DataFrame, near_m: float = 18.0) -> DataFrame:
    """``earlier`` (line, ord, lat, lon) with ``covered``: a later vertex (lat, lon) is within ``near_m``."""
    pts = later.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    hit = grid_join.within(earlier.select("line", "ord", "lat", "lon"), pts, near_m, radius=R_GROUND).select("line", "ord").distinct().withColumn("covered", F.lit(True))
    return earlier.join(hit, ["line", "ord"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def runs(flagged: DataFrame, run_m: float = 36.0) -> DataFrame:
    """Adds ``cut``: the vertex lies in a covered run long enough to be replaced."""
    w = Window.partitionBy("line").orderBy("ord")
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon", R_GROUND), F.lit(0.0))
    f = flagged.withColumn("step", step).withColumn("brk", F.when(F.lag("covered").over(w) == F.col("covered"), 0).otherwise(1)).withColumn("run", F.sum("brk").over(w))
    inside = F.when(F.col("brk") == 0, F.col("step")).otherwise(0.0)
    g = Window.partitionBy("line", "run")
    return f.withColumn("cut", F.col("covered") & (F.count("*").over(g) >= 2) & (F.sum(inside).over(g) >= run_m)).drop("step", "brk", "run")


def keep_outside(cut: DataFrame) -> DataFrame:
    """Pieces (line, piece, ord, lat, lon) of what is left; a piece keeps the vertex where it meets a cut."""
    w = Window.partitionBy("line").orderBy("ord")
    c = cut.withColumn("before", F.coalesce(F.lag("cut").over(w), F.lit(True))).withColumn("after", F.coalesce(F.lead("cut").over(w), F.lit(True)))
    # A cut vertex next to a kept one ends (or starts) the kept one's piece.
    c = c.withColumn("ends", F.col("cut") & ~F.col("before")).withColumn("starts", F.col("cut") & ~F.col("after"))
    c = c.withColumn("first", ((~F.col("cut")) & F.col("before")).cast("int"))
    opens = F.when(F.col("starts"), 1).when((F.col("first") == 1) & ~F.coalesce(F.lag("starts").over(w), F.lit(False)), 1).otherwise(0)
    c = c.withColumn("piece", F.sum(opens).over(w))
    both = F.when(F.col("ends") & F.col("starts"), F.array(F.col("piece") - 1, F.col("piece"))).when(F.col("ends") | F.col("starts") | ~F.col("cut"), F.array("piece"))
    p = c.withColumn("p", F.explode(both)).select("line", F.col("p").alias("piece"), "ord", "lat", "lon")
    return p.withColumn("n", F.count("*").over(Window.partitionBy("line", "piece"))).filter("n >= 2").drop("n")


def merge_layer(earlier: DataFrame, later: DataFrame, near_m: float = 18.0, run_m: float = 36.0) -> DataFrame:
    return keep_outside(runs(covered(earlier, later, near_m), run_m))
