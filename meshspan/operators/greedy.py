"""Order-dependent selections.

The order is total: callers give a sort key and ties are broken by it.  Selections
per group (a subject, a route) run in the group's task.  Selections over the whole
plane are cut to what can influence each other: rounds of joins on the pairs that
are too close (``spread_everywhere``), or the connected groups of such pairs
(``near_groups``); no band or cell edge changes their results.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, grid_join

R_GROUND = 6_371_000.0


def _metres(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R_GROUND * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def _near(kept: dict, lat: float, lon: float, min_m: float):
    """Kept points within min_m, through a hash of cells at least that wide."""
    step = min_m / 110_000
    cy, cx = math.floor(lat / step), math.floor(lon * max(0.01, math.cos(math.radians(lat))) / step)
    for dy in (-1, 0, 1):
        for dx in (-2, -1, 0, 1, 2):
            for i, p in kept.get((cy + dy, cx + dx), ()):
                if _metres(p, (lat, lon)) < min_m:
                    yield i
    return


def _cell(lat: float, lon: float, min_m: float):
    step = min_m / 110_000
    return math.floor(lat / step), math.floor(lon * max(0.01, math.cos(math.radians(lat))) / step)


def spread_out(df: DataFrame, group: list[str], order: list[str], ascending: list[bool], min_m: float, cap: int | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per group, in order, the rows at least ``min_m`` from all rows kept before, ``cap`` at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=ascending, kind="stable")
        kept, out = {}, []
        for i, (la, lo) in enumerate(zip(pdf[lat], pdf[lon])):
            if cap is not None and len(out) >= cap:
                break
            if next(_near(kept, la, lo, min_m), None) is None:
                kept.setdefault(_cell(la, lo, min_m), []).append((i, (la, lo)))
                out.append(i)
        return pdf.iloc[out]

    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # few bytes, but much to do a group
    return df.repartition(tasks, *group).groupBy(*group).applyInPandas(run, df.schema)


def _close_pairs(df: DataFrame, key: str, min_m: float, lat: str, lon: str) -> DataFrame:
    """(a, b): keys of different rows less than ``min_m`` apart, both ways."""
    a = df.select(F.col(key).alias("a"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    b = df.select(F.col(key).alias("b"), F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"))
    return grid_join.within(a, b, min_m, radius=R_GROUND).filter((F.col("dist_m") < min_m) & (F.col("a") != F.col("b"))).select("a", "b")


def spread_everywhere(df: DataFrame, key: str, order: list[Column], min_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """In order, the rows at least ``min_m`` from all rows kept before, over the whole plane.

    ``key`` is unique and ``order`` total.  Each round keeps every open row that
    comes before all open rows near it and drops the rows near those; that is
    what going through the rows one by one gives.  Of the rows at one place only
    the first can be kept: what drops it drops the others too.
    """
    whole, somewhere = df, F.col(lat).isNotNull() & F.col(lon).isNotNull()
    heads = graph.cut(df.filter(somewhere).groupBy(lat, lon).agg(F.min(F.struct(F.struct(*order).alias("o"), F.col(key).alias("k"))).alias("m")).select(F.col("m.k").alias(key)))
    df = df.filter(somewhere).join(heads, key, "left_semi")
    place = df.select(F.col(key).alias("a"), F.struct(*order).alias("o"))
    pairs = _close_pairs(df, key, min_m, lat, lon)
    ahead = pairs.join(place, "a").join(place.select(F.col("a").alias("b"), F.col("o").alias("ob")), "b").filter(F.col("ob") < F.col("o")).select("a", "b")
    ahead = graph.cut(ahead)  # b is near a and comes before it
    open_ = graph.cut(ahead.select("a").distinct())
    gone = None
    while not open_.isEmpty():
        # A row is out once a kept one is before it, and kept once all before it are out.
        live = ahead.join(open_, "a", "left_semi")
        if gone is not None:
            live = live.join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        waits = live.join(open_.select(F.col("a").alias("b"), F.lit(True).alias("w")), "b", "left")
        state = graph.cut(waits.groupBy("a").agg(F.max(F.col("w").isNull()).alias("hit")))
        out = graph.cut(state.filter("hit").select("a"))
        kept = open_.join(state, "a", "left_anti")
        gone = out if gone is None else graph.cut(gone.union(out))
        open_ = graph.cut(open_.join(out, "a", "left_anti").join(kept, "a", "left_anti"))
    kept = heads if gone is None else heads.join(gone.withColumnRenamed("a", key), key, "left_anti")
    return whole.filter(somewhere).join(kept, key, "left_semi").unionByName(whole.filter(~somewhere))


def near_groups(df: DataFrame, key: str, min_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with ``near_group``: the smallest key of the rows chained by steps of less than ``min_m``.

    Rows of one place are one group; pairs are of places.
    """
    places = graph.cut(df.groupBy(lat, lon).agg(F.min(key).alias("__k")))
    pairs = _close_pairs(places, "__k", min_m, lat, lon)
    groups = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "__k")
    near = places.join(groups, "__k", "left").select(lat, lon, F.coalesce("component", "__k").alias("near_group"))
    return df.join(near, [lat, lon], "left").select(*df.columns, F.coalesce("near_group", key).alias("near_group"))


def dedup_higher(df: DataFrame, group: list[str], order: list[str], min_m: float, height: str = "elev_m") -> DataFrame:
    """Per group, first-fit within ``min_m``: a higher newcomer takes the place of the kept row it is near.

    Adds ``kept`` (boolean) and ``winner`` (position in order of the row that won).
    A group that is all at one place keeps the first of its highest rows, which
    aggregates find; the others go through their rows in order, a task a group.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("winner", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        slots, at, loser = [], {}, {}
        for i, (la, lo, z) in enumerate(zip(pdf["lat"], pdf["lon"], pdf[height])):
            near = min(_near(at, la, lo, min_m), default=None)
            if near is None:
                at.setdefault(_cell(la, lo, min_m), []).append((len(slots), (la, lo)))
                slots.append(i)
                continue
            old = slots[near]
            if z > pdf[height][old]:
                was = _cell(pdf["lat"][old], pdf["lon"][old], min_m)
                at[was] = [x for x in at[was] if x[0] != near]
                at.setdefault(_cell(la, lo, min_m), []).append((near, (la, lo)))
                slots[near], loser[old] = i, near
            else:
                loser[i] = near
        pdf["kept"] = [i not in loser for i in range(len(pdf))]
        pdf["winner"] = [slots[loser[i]] if i in loser else i for i in range(len(pdf))]
        return pdf

    one = (F.min("lat") == F.max("lat")) & (F.min("lon") == F.max("lon"))
    top = df.groupBy(*group).agg(F.coalesce(one, F.lit(False)).alias("__one"), F.min(F.struct((-F.col(height)).alias("low"), F.struct(*order).alias("at"))).alias("__top"))
    d = df.join(top.select(*group, "__one", F.col("__top.at").alias("__top")), group)
    alone = d.filter("__one").withColumn("__at", F.struct(*order))
    place = alone.groupBy(*group).agg(F.count_if(F.col("__at") < F.col("__top")).alias("winner"))
    alone = alone.join(place, group).select(*df.columns, (F.col("__at") == F.col("__top")).alias("kept"), "winner")
    return alone.union(d.filter("not __one").select(*df.columns).groupBy(*group).applyInPandas(run, schema))


def diverse_routes(df: DataFrame, group: list[str], order: list[str], peaks: str = "peaks") -> DataFrame:
    """Per group, in order: a route is ``is_unique`` unless it shares a peak with an earlier unique one.

    ``order`` tells routes of a group apart.  All groups go on together in rounds:
    a route that is first at every peak it has is unique, and it and all that
    share a peak with it leave.  The result is that of one pass in order, the
    number of rounds about the logarithm of the routes.
    """
    rank = F.struct(*order)
    stops = df.select(*group, rank.alias("rank"), F.explode(F.array_distinct(peaks)).alias("peak"))
    left, out = graph.cut(stops), df.filter(F.coalesce(F.size(peaks), F.lit(0)) < 1).select(*group, rank.alias("rank"))
    while not left.isEmpty():
        first = left.groupBy(*group, "peak").agg(F.min("rank").alias("first"))
        free = left.join(first, [*group, "peak"]).groupBy(*group, "rank").agg(F.bool_and(F.col("rank") == F.col("first")).alias("free"))
        won = graph.cut(free.filter("free").select(*group, "rank"))
        out = out.union(won)
        taken = left.join(won, [*group, "rank"], "left_semi").select(*group, "peak").distinct()
        gone = left.join(taken, [*group, "peak"], "left_semi").select(*group, "rank").distinct()
        left = graph.cut(left.join(gone, [*group, "rank"], "left_anti"))
    won = out.select(*group, "rank", F.lit(True).alias("won"))
    return df.withColumn("rank", rank).join(won, [*group, "rank"], "left").select(*df.columns, F.coalesce("won", F.lit(False)).alias("is_unique"))


def thin_along(df: DataFrame, group: list[str], order: str, min_m: float, keep_last_m: float | None = None) -> DataFrame:
    """Per route, points at least ``min_m`` from the last one kept; the end too if it is ``keep_last_m`` away."""

    # Routes are many and short, so a task streams through its routes in order; a row waits for the next one, which tells whether its route goes on.

    def run(batches):
        wait, key, kept = None, None, None

        def picked(rows: pa.RecordBatch, end: bool) -> pa.RecordBatch:
            nonlocal key, kept
            keys = list(zip(*(rows.column(c).to_pylist() for c in group)))
            lat, lon, out = rows.column("lat").to_pylist(), rows.column("lon").to_pylist(), []
            for i in range(len(keys) if end else len(keys) - 1):
                p, first = (lat[i], lon[i]), kept is None or keys[i] != key
                last = i + 1 == len(keys) or keys[i + 1] != keys[i]
                far = 0.0 if first else _metres(kept, p)
                if first or far >= min_m or (last and keep_last_m is not None and far >= keep_last_m):
                    key, kept = keys[i], p
                    out.append(i)
            return rows.take(pa.array(out, pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if wait is None else pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
            yield picked(rows, False)
            wait = rows.slice(rows.num_rows - 1)
        if wait is not None:
            yield picked(wait, True)

    return df.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, df.schema)


def gentler(a, b) -> bool:
    """Whether walk ``a`` (slope, gain, loss, len_m, paved) is better than ``b``; not transitive."""
    if a.paved != b.paved:
        on, off = (a, b) if a.paved else (b, a)
        if on.slope <= off.slope + 2 and on.len_m <= off.len_m * 1.25 + 80:
            return bool(a.paved)
    for x, y, slack in ((a.slope, b.slope, 0.5), (a.gain, b.gain, 2.0), (a.loss, b.loss, 2.0)):
        if abs(x - y) > slack:
            return x < y
    return a.len_m < b.len_m


def fold_hikes(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Per group, the walk left when each in order replaces the best so far if it is ``gentler``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(order, kind="stable").itertuples())
        best = rows[0]
        for x in rows[1:]:
            if gentler(x, best):
                best = x
        return pdf.loc[[best.Index]]

    return df.groupBy(*group).applyInPandas(run, df.schema)
