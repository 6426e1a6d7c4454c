"""Joins by distance: cells as equi-keys, exact distance afterwards.

Cells are at least ``radius`` wide in both axes.  Longitude cells are counted per
latitude band, so they widen towards the poles; a point's neighbours are the
cells of its own band and the two next to it that its radius box touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import R_RADIO, haversine_m, lit, rounded
from . import graph


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step)


def _lon_cell(lon: Column, band: Column, step: float) -> Column:
    # The band's edge nearest a pole has the shortest degree of longitude.
    edge = F.least(F.lit(89.0), F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)))
    return F.floor((lon + 180) / (step / F.cos(F.radians(edge))))


def cell_columns(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """``df`` with its own cell: __band, __cell."""
    step = radius_m / R_RADIO * 180 / math.pi * 1.0001
    df = df.withColumn("__band", _band(F.col(lat), step))
    return df.withColumn("__cell", _lon_cell(F.col(lon), F.col("__band"), step))


def neighbour_cells(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """``df`` once for each cell that may hold a point within the radius."""
    step = radius_m / R_RADIO * 180 / math.pi * 1.0001
    bands = df.withColumn("__band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: _band(F.col(lat), step) + i)))
    reach = step / F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col(lat)) + step)))
    lo, hi = (_lon_cell(F.col(lon) + s * reach, F.col("__band"), step) for s in (-1, 1))
    return bands.withColumn("__cell", F.explode(F.sequence(lo, hi)))


def within(left: DataFrame, right: DataFrame, radius_m: float, left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), distance: str = "dist_m", radius: float = R_RADIO, slack_m: float = 0.0, spread: bool = False) -> DataFrame:
    """Pairs of rows at most ``radius_m`` + ``slack_m`` apart, with their distance; column names must differ between sides.

    ``spread`` keeps the cells in several tasks a core, for tables whose few bytes become very many pairs.
    """
    reach = (radius_m + slack_m) * max(1.0, R_RADIO / radius) + 1
    a = cell_columns(left, *left_at, reach)
    b = neighbour_cells(right, *right_at, reach)
    if spread:
        tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
        a, b = (x.repartition(tasks, "__band", "__cell") for x in (a, b))
    out = a.join(b, ["__band", "__cell"]).withColumn(distance, haversine_m(*left_at, *right_at, radius))
    return out.filter(F.col(distance) <= radius_m + slack_m).drop("__band", "__cell")


def self_pairs(df: DataFrame, key: str, radius_m: float, lat: str = "lat", lon: str = "lon", slack_m: float = 0.0) -> DataFrame:
    """Unordered pairs (a_*, b_*), a's key before b's, within the radius."""
    a = df.select([F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select([F.col(c).alias(f"b_{c}") for c in df.columns])
    return within(a, b, radius_m, (f"a_{lat}", f"a_{lon}"), (f"b_{lat}", f"b_{lon}"), slack_m=slack_m).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))


def packs(df: DataFrame, at: list[str], carry: list[str], name: str, size: int = 256) -> DataFrame:
    """``df`` by place: columns ``at`` and ``name``, an array of structs of ``carry`` for some ``size`` rows there; a crowded place has many packs."""
    n = df.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / size).alias("__packs"))
    dealt = df.select(*at, F.struct(*carry).alias("__row")).join(n, at).withColumn("__pack", F.pmod(F.xxhash64("__row"), F.col("__packs")))
    return dealt.groupBy(*at, "__pack").agg(F.collect_list("__row").alias(name)).drop("__pack")


def within_packs(left: DataFrame, right: DataFrame, radius_m: float, left_rows: tuple[str, list[str], list[str]], right_rows: tuple[str, list[str], list[str]], left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), slack_m: float = 0.0) -> DataFrame:
    """Pairs of places within the radius, each with the rows at both: names, columns of the place and columns of the rows are (name, at, carry).

    Distances are of places, whatever the number of rows there; the caller filters
    pairs of places and explodes both arrays last, in the task that met them.
    """
    (ln, la, lc), (rn, ra, rc) = left_rows, right_rows
    return within(packs(left, la, lc, ln), packs(right, ra, rc, rn), radius_m, left_at, right_at, slack_m=slack_m, spread=True)


def unpacked(pairs: DataFrame, left: DataFrame, right: DataFrame, left_at: list[str], right_at: list[str], left_rows: str, right_rows: str) -> DataFrame:
    """Pairs of places as pairs of their rows: ``left_rows`` and ``right_rows`` of two ``packs`` tables become one struct each.

    Rows of pairs are only made here, in the tasks that hand them on; what is
    joined and shuffled are pairs of places.
    """
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism  # few bytes of pairs become very many rows
    out = pairs.repartition(tasks).join(left, left_at).join(right, right_at)
    return out.withColumn(left_rows, F.explode(left_rows)).withColumn(right_rows, F.explode(right_rows))


def nearest_of_places(left: DataFrame, right: DataFrame, radii: tuple[float, ...], order: list[str], left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), digits: int = 2) -> DataFrame:
    """For each distinct place of ``left`` the nearest right row, by distance rounded to ``digits`` and then ``order``: left_at, dist_m, order.

    Radii grow; a place whose nearest lies within one is settled and leaves, since
    every row as near lies within it too.  The rows of ``right`` are read where they
    lie, and only the places are spread over cells.
    """
    at, left, out = list(left_at), graph.cut(left.select(*left_at).distinct()), None
    right = right.select(*right_at, *order)
    for radius in radii:
        pairs = within(right, left, radius, right_at, left_at, slack_m=1.0).withColumn("dist_m", rounded(F.col("dist_m"), digits)).filter(F.col("dist_m") <= radius)
        best = pairs.groupBy(*at).agg(F.min(F.struct("dist_m", *order)).alias("m")).select(*at, "m.*")
        if radius != radii[-1]:
            best = graph.cut(best)
            left = graph.cut(left.join(best.select(*at), at, "left_anti"))
        out = best if out is None else out.union(best)
    return out


def nearest(left: DataFrame, right: DataFrame, radius_m: float, key: str, order: str, left_at=("lat", "lon"), right_at=("r_lat", "r_lon")) -> DataFrame:
    """For each left ``key`` the closest right row within the radius, ties by ``order``; a min, so nothing is sorted."""
    pairs = within(left, right, radius_m, left_at, right_at)
    cols = [c for c in pairs.columns if c not in (key, "dist_m", order)]
    best = F.min(F.struct("dist_m", order, *cols)).alias("m")
    return pairs.groupBy(key).agg(best).select(key, "m.*")


def boxes(points: DataFrame, areas: DataFrame, cell_deg: float = 0.25, lat: str = "lat", lon: str = "lon", spread: bool = False) -> DataFrame:
    """Points joined to areas (west, south, east, north) whose box holds them, through shared cells; ``spread`` as in ``within``."""
    f = lambda c: F.floor(F.col(c) / cell_deg)
    p = points.withColumn("__cy", f(lat)).withColumn("__cx", f(lon))
    a = areas.withColumn("__cy", F.explode(F.sequence(f("south"), f("north")))).withColumn("__cx", F.explode(F.sequence(f("west"), f("east"))))
    if spread:
        tasks = 8 * points.sparkSession.sparkContext.defaultParallelism
        p, a = (x.repartition(tasks, "__cy", "__cx") for x in (p, a))
    return p.join(a, ["__cy", "__cx"]).filter(F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))).drop("__cy", "__cx")


def inside_ring(lat, lon, ring) -> Column:
    """Even-odd test of a point against a closed ring of (lon, lat) structs."""
    la, lo, r = lit(lat), lit(lon), lit(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(r, i), F.element_at(r, i + 1)
        spans = (a["lat"] > la) != (b["lat"] > la)
        at = (b["lon"] - a["lon"]) * (la - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.when(spans & (lo < at), 1).otherwise(0)

    count = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0), lambda n, i: n + crosses(i))
    return F.when(F.size(r) < 4, F.lit(False)).otherwise(count % 2 == 1)


def inside_polygon(lat, lon, rings) -> Column:
    """Even-odd over all rings, so holes count as outside."""
    n = F.aggregate(lit(rings), F.lit(0), lambda n, ring: n + F.when(inside_ring(lat, lon, ring), 1).otherwise(0))
    return n % 2 == 1


def ring_area(ring) -> Column:
    """Unsigned area of a closed ring in square degrees."""
    r = lit(ring)
    twice = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + F.element_at(r, i)["lon"] * F.element_at(r, i + 1)["lat"] - F.element_at(r, i + 1)["lon"] * F.element_at(r, i)["lat"])
    return F.abs(twice) / 2
