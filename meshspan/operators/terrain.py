"""Elevation sampling, profiles and link evaluation over terrain.

Terrain comes as scanlines (tile_lat, tile_lon, n, iy, elev), row 0 north, and is
laid out in square blocks that overlap by one row and column.  A point's sample is
an equi-join on its tile and block.  A link that range and free-space loss let
through is cut into its stretches within one block; a kernel a block evaluates
all that cross it, both directions at once, so profiles never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rf
from ..functions.rf import LIGHT_M_S
from ..sources.shared import stored

VOID = -32768


def clean(e: Column) -> Column:
    """Void counts as sea level when sampling."""
    return F.when((e == VOID) | (e < -12000), 0.0).otherwise(e.cast("double"))


def bilinear(z00, z10, z01, z11, tx, ty) -> Column:
    top, bottom = z00 * (1 - tx) + z10 * tx, z01 * (1 - tx) + z11 * tx
    return top * (1 - ty) + bottom * ty


BLOCK = 60


def blocks(dem: DataFrame, size: int = BLOCK) -> DataFrame:
    """Square blocks (tile_lat, tile_lon, n, by, bx, w, z) of scanlines: rows and columns of ``size`` steps and one more, row by row in z."""
    last = F.floor((F.col("n") - 2) / size)
    rows = dem.withColumn("by", F.explode(F.filter(F.array(F.floor(F.col("iy") / size), F.floor((F.col("iy") - 1) / size)), lambda b: (b >= 0) & (b <= last))))
    rows = rows.filter(F.col("iy").between(F.col("by") * size, F.col("by") * size + size)).distinct()
    cut = rows.withColumn("bx", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("part", F.slice("elev", F.col("bx") * size + 1, size + 1))
    got = cut.groupBy("tile_lat", "tile_lon", "n", F.col("by").cast("int").alias("by"), "bx").agg(F.array_sort(F.collect_list(F.struct("iy", "part"))).alias("r"))
    return got.select("tile_lat", "tile_lon", "n", "by", "bx", F.size(F.col("r")[0]["part"]).alias("w"), F.flatten(F.transform("r", lambda x: x["part"])).alias("z"))


def sample(points: DataFrame, dem: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "elev_m", size: int = BLOCK) -> DataFrame:
    """``points`` with bilinear elevation from scanlines; 0 where the tile is missing."""
    return sample_blocks(points, blocks(dem, size), lat, lon, out, size)


def sample_blocks(points: DataFrame, terrain: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "elev_m", size: int = BLOCK) -> DataFrame:
    """``points`` with bilinear elevation from ``blocks``; 0 where the tile is missing or the point is on its last row or column."""
    dims = terrain.select("tile_lat", "tile_lon", F.col("n").alias("__n")).distinct()
    p = points.withColumn("tile_lat", F.floor(lat).cast("int")).withColumn("tile_lon", F.floor(lon).cast("int"))
    p = p.join(dims, ["tile_lat", "tile_lon"], "left")
    fx, fy = (F.col(lon) - F.col("tile_lon")) * (F.col("__n") - 1), (F.col("tile_lat") + 1 - F.col(lat)) * (F.col("__n") - 1)
    p = p.withColumn("__fx", fx).withColumn("__fy", fy)
    p = p.withColumn("__x", F.floor("__fx").cast("int")).withColumn("__y", F.floor("__fy").cast("int"))
    p = p.withColumn("by", F.floor(F.col("__y") / size).cast("int")).withColumn("bx", F.floor(F.col("__x") / size).cast("int"))
    p = p.join(terrain.select("tile_lat", "tile_lon", "by", "bx", F.col("w").alias("__w"), F.col("z").alias("__z")), ["tile_lat", "tile_lon", "by", "bx"], "left")
    first = (F.col("__y") - F.col("by") * size) * F.col("__w") + F.col("__x") - F.col("bx") * size + 1
    at = lambda dy, dx: clean(F.try_element_at("__z", (first + dy * F.col("__w") + dx).cast("int")))
    tx, ty = F.col("__fx") - F.col("__x"), F.col("__fy") - F.col("__y")
    inside = F.col("__z").isNotNull() & (F.col("__x") + 1 < F.col("__n")) & (F.col("__y") + 1 < F.col("__n"))
    z = F.when(inside, bilinear(at(0, 0), at(0, 1), at(1, 0), at(1, 1), tx, ty)).otherwise(F.lit(0.0))
    return p.withColumn(out, z).select(*points.columns, out)


def line_points(lat, lon, bearing, s):
    """Latitude and longitude (arrays) at distances ``s`` along great circles."""
    p, d = np.radians(lat), s / geo.R_RADIO
    p2 = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(bearing))
    l2 = np.radians(lon) + np.arctan2(np.sin(bearing) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(p2))
    return np.degrees(p2), np.degrees(l2)


def _samples(first: np.ndarray, last: np.ndarray):
    """Rows and numbers of the samples first..last of each row, one after the other, and where each row's begin."""
    n = last - first + 1
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - begin[row], begin


LEG = "tile_lat int, tile_lon int, by int, bx int, first int, last int"
SAMPLES = 1 << 19  # positions worked out at a time


def cut_by_block(lines: DataFrame, dims: dict[tuple[int, int], int], size: int) -> DataFrame:
    """``lines`` (a_lat, a_lon, bearing, dist_m, steps and more), a row for each stretch of samples in one terrain block.

    ``dims`` has the nodes of a side by tile: at most the 64,800 of the globe.  A
    stretch over ground without a tile has by and bx -1.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)

    def run(batches):
        nodes = np.zeros(180 * 360, np.int64)
        for (y, x), side in dims.items():
            nodes[(y + 90) * 360 + x + 180] = side
        for whole in batches:
            steps = np.maximum(whole.column("steps").to_numpy(zero_copy_only=False).astype(np.int64), 2)
            for part in np.split(np.arange(whole.num_rows), np.flatnonzero(np.diff(np.cumsum(steps) // SAMPLES)) + 1):
                if not len(part):
                    continue
                batch = whole.slice(int(part[0]), len(part))
                at = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                row, i, _ = _samples(np.ones(len(part), np.int64), steps[part] - 1)
                la, lo = line_points(at("a_lat")[row], at("a_lon")[row], at("bearing")[row], i / steps[part][row] * at("dist_m")[row])
                ty, tx = np.floor(la).astype(np.int32), np.floor(lo).astype(np.int32)
                known = (ty >= -90) & (ty < 90) & (tx >= -180) & (tx < 180)
                n = np.where(known, nodes[np.where(known, (ty + 90) * 360 + tx + 180, 0)], 0)
                by = np.where(n > 0, np.floor((ty + 1 - la) * (n - 1)) // size, -1).astype(np.int32)
                bx = np.where(n > 0, np.floor((lo - tx) * (n - 1)) // size, -1).astype(np.int32)
                same = np.ones(len(row) - 1, bool)
                for v in (row, ty, tx, by, bx):
                    same &= v[1:] == v[:-1]
                start = np.flatnonzero(np.append(True, ~same))
                stop = np.append(start[1:], len(row)) - 1
                legs = [pa.array(v[start].astype(np.int32)) for v in (ty, tx, by, bx, i)] + [pa.array(i[stop].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[start])).columns, *legs], names=[*batch.schema.names, "tile_lat", "tile_lon", "by", "bx", "first", "last"])

    return lines.mapInArrow(run, f"{schema}, {LEG}")


def obstructions(keep: list[str], link: dict, size: int):
    """A kernel (stretches, block): the largest obstruction of each stretch both ways, sampled from the one block."""
    wl = LIGHT_M_S / (link["freq_mhz"] * 1e6)

    def nu(s, d, ground, z_tx, z_rx):
        line = z_tx * (1 - s / d) + z_rx * (s / d) - s * (d - s) / (2 * rf.EFFECTIVE_EARTH_M)
        over = ground - (line - link["fresnel"] * np.sqrt(wl * s * (d - s) / d))
        counts = (s >= 2) & (d - s >= 2) & (over > 0)
        return np.where(counts, over * np.sqrt(2 * d / (wl * s * np.where(counts, d - s, 1.0))), -np.inf)

    def run(key, legs: pa.Table, block: pa.Table) -> pa.Table:
        z = n = w = None
        if block.num_rows:
            n, w = block.column("n")[0].as_py(), block.column("w")[0].as_py()
            z = block.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            z = np.where((z == VOID) | (z < -12000), 0.0, z)
        tile_lat, tile_lon, by, bx = (k.as_py() for k in key[:4])
        col = lambda c: legs.column(c).to_numpy()
        first, last = col("first").astype(np.int64), col("last").astype(np.int64)
        best = [np.full(len(first), -np.inf), np.full(len(first), -np.inf)]
        for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(last - first + 1) // SAMPLES)) + 1):
            if not len(part):
                continue
            row, i, begin = _samples(first[part], last[part])
            of = lambda c: col(c)[part][row]
            d = of("dist_m")
            s = i / of("steps") * d
            ground = np.zeros(len(row))
            if z is not None:
                la, lo = line_points(of("a_lat"), of("a_lon"), of("bearing"), s)
                fx, fy = (lo - tile_lon) * (n - 1), (tile_lat + 1 - la) * (n - 1)
                x, y = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
                on = (x + 1 < n) & (y + 1 < n)
                at = np.where(on, (y - by * size) * w + x - bx * size, 0)
                tx, ty = fx - x, fy - y
                top = z[at] * (1 - tx) + z[at + 1] * tx
                ground = np.where(on, top * (1 - ty) + (z[at + w] * (1 - tx) + z[at + w + 1] * tx) * ty, 0.0)
            ground = ground + link["clutter"]
            best[0][part] = np.maximum.reduceat(nu(s, d, ground, of("z_a_tx"), of("z_b_rx")), begin)
            best[1][part] = np.maximum.reduceat(nu(d - s, d, ground, of("z_b_tx"), of("z_a_rx")), begin)
        found = [pa.array(v, mask=~np.isfinite(v)) for v in best]
        return pa.Table.from_arrays([*[legs.column(c) for c in keep], *found], names=[*keep, "nu_out", "nu_back"])

    return run


def evaluate_pairs(pairs: DataFrame, terrain: DataFrame, link: dict, step_m: Column, keep: list[str], heights=("a_height_m", "b_height_m"), receivers=None, size: int = BLOCK, crowd: int = 20_000) -> DataFrame:
    """Both directions of every pair (a_lat, a_lon, b_lat, b_lon, dist_m, heights): ``keep``, dist_m, fspl, forward, reverse.

    ``terrain`` are ``blocks``; ``link`` has eirp_chain, threshold_dbm, freq_mhz,
    fresnel, clutter, max_range_m; ``receivers`` are the height columns of the
    receiving ends where they differ; ``keep`` names a pair.  A margin is null
    where its direction does not decode.

    No sample is a row.  A line is cut into its stretches within one terrain block,
    stretches meet their block, and a kernel gives the worst of each; the worst of
    a pair is a grouped maximum.  A block that more than ``crowd`` stretches cross
    is dealt out in as many copies as they need.  Ends are sampled once a place.
    """
    d, f = F.col("dist_m"), float(link["freq_mhz"])
    up = lambda c: F.greatest(F.col(c), F.lit(1.0))
    rx = receivers or heights
    base = pairs.withColumn("fspl", F.when(d < 2, 0.0).otherwise(rf.fspl_db(d, f)))
    base = base.withColumn("__open", (d <= link["max_range_m"]) & (link["eirp_chain"] - F.col("fspl") >= link["threshold_dbm"]))
    base = base.withColumn("steps", rf.profile_steps(d, step_m)).withColumn("bearing", geo.bearing_rad("a_lat", "a_lon", "b_lat", "b_lon"))
    rough = base.filter(F.col("__open") & (F.col("steps") >= 2))
    ends = rough.select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).union(rough.select("b_lat", "b_lon")).distinct()
    ends = sample_blocks(ends, terrain, "lat", "lon", "z", size)
    of = lambda e: ends.select(F.col("lat").alias(f"{e}_lat"), F.col("lon").alias(f"{e}_lon"), F.col("z").alias(f"{e}_z"))
    lines = rough.join(of("a"), ["a_lat", "a_lon"]).join(of("b"), ["b_lat", "b_lon"])
    z = {"z_a_tx": F.col("a_z") + up(heights[0]), "z_b_rx": F.col("b_z") + up(rx[1]), "z_b_tx": F.col("b_z") + up(heights[1]), "z_a_rx": F.col("a_z") + up(rx[0])}
    lines = lines.select(*keep, "a_lat", "a_lon", "bearing", "dist_m", "steps", *[v.alias(k) for k, v in z.items()])
    dims = {(r.tile_lat, r.tile_lon): r.n for r in terrain.select("tile_lat", "tile_lon", "n").distinct().collect()}
    where = ["tile_lat", "tile_lon", "by", "bx"]
    legs = stored(cut_by_block(lines, dims, size), "stretches")
    copies = legs.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("copies"))
    legs = legs.join(copies, where).withColumn("copy", F.pmod(F.xxhash64(*keep), F.col("copies")).cast("int")).drop("copies")
    ground = terrain.select(*where, "n", "w", "z").join(copies, where).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    by = [*where, "copy"]
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep] + ["nu_out double", "nu_back double"])
    found = legs.groupBy(*by).cogroup(ground.groupBy(*by)).applyInArrow(obstructions(keep, link, size), schema)
    none = F.lit(None).cast("double")
    every = base.select(*keep, "dist_m", "fspl", "__open", none.alias("nu_out"), none.alias("nu_back")).unionByName(found, allowMissingColumns=True)
    got = every.groupBy(*keep).agg(*[F.max(c).alias(c) for c in ("dist_m", "fspl", "__open", "nu_out", "nu_back")])

    def margin(nu: str) -> Column:
        pr = link["eirp_chain"] - F.col("fspl") - F.coalesce(rf.knife_edge_db(nu), F.lit(0.0))
        return F.when(F.col("__open") & (pr >= link["threshold_dbm"]), pr - link["threshold_dbm"])

    return got.withColumn("forward", margin("nu_out")).withColumn("reverse", margin("nu_back")).drop("nu_out", "nu_back", "__open")


def ring_snap(points: DataFrame, sampler, key: str, radius_m: float, step_m: float) -> DataFrame:
    """(key, lat, lon, elev_m): the highest ground above sea level of each point and of rings around it, 8 k samples on the k-th."""
    step = max(step_m, 15.0)
    ways = [(0, 0.0)] + [(ring, 360.0 * i / (8 * ring)) for ring in range(1, int(radius_m // step) + 1) for i in range(8 * ring)]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k * step).alias("d"), F.lit(b).alias("b")) for i, (k, b) in enumerate(ways)]))
    p = points.select(key, "lat", "lon").withColumn("w", at)
    la, lo = geo.destination("lat", "lon", F.radians("w.b"), F.col("w.d"), geo.R_GROUND)
    s = sampler(p.select(key, F.col("w.i").alias("i"), la.alias("lat"), lo.alias("lon")), "lat", "lon", "elev_m").filter("elev_m > 0")
    return s.groupBy(key).agg(F.min(F.struct((-F.col("elev_m")).alias("k"), "i", "lat", "lon")).alias("m")).select(key, "m.lat", "m.lon", (-F.col("m.k")).alias("elev_m"))


def local_maxima(cells: DataFrame, least_drop: float = 20.0) -> DataFrame:
    """Cells (tile_lat, tile_lon, n, iy, ix, z) no neighbour of which is higher and one of which is ``least_drop`` lower.

    Neighbours are those present in ``cells``: filter it first to the usable ones.
    Each cell offers its height to its eight neighbours, and one aggregation
    answers all; nothing crosses tiles.
    """
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = cells.withColumn("o", F.explode(offsets)).select("tile_lat", "tile_lon", (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix"), F.when((F.col("o.dy") == 0) & (F.col("o.dx") == 0), F.col("z")).alias("own"), F.when((F.col("o.dy") != 0) | (F.col("o.dx") != 0), F.col("z")).alias("near"), "n")
    agg = spread.groupBy("tile_lat", "tile_lon", "n", "iy", "ix").agg(F.max("own").alias("z"), F.max("near").alias("top"), F.min("near").alias("low"))
    return agg.filter(F.col("z").isNotNull() & (F.col("top") <= F.col("z")) & (F.col("z") - F.col("low") >= least_drop)).select("tile_lat", "tile_lon", "n", "iy", "ix", "z")


def cell_centre(df: DataFrame) -> DataFrame:
    """``df`` with lat, lon of cells taken as pixels (half a spacing in from their corner)."""
    s = 1 / (F.col("n") - 1)
    return df.withColumn("lat", F.col("tile_lat") + 1 - (F.col("iy") + 0.5) * s).withColumn("lon", F.col("tile_lon") + (F.col("ix") + 0.5) * s)


def best_per_bin(peaks: DataFrame, bin_m: float, keep: list[str]) -> DataFrame:
    """The highest of each Mercator bin (at least 500 m wide); ties go to the smaller longitude, then latitude."""
    size = max(bin_m, 500.0)
    x, y = geo.mercator("lat", "lon")
    binned = peaks.withColumn("bx", F.floor(x / size)).withColumn("by", F.floor(y / size))
    best = F.min(F.struct((-F.col("elev_m")).alias("k"), F.col("lon"), F.col("lat"), *[F.col(c) for c in keep]))
    out = binned.groupBy("bx", "by").agg(best.alias("m"))
    return out.select("bx", "by", (-F.col("m.k")).alias("elev_m"), "m.lon", "m.lat", *[F.col(f"m.{c}") for c in keep])


def hillshade(west, here, south) -> Column:
    """Shade 0 to 1 of a cell from forward differences: light from 315 degrees, 50 up, ambient 0.28."""
    import math

    dzdx, dzdy = geo.lit(here) - geo.lit(west), geo.lit(south) - geo.lit(here)
    az, alt = math.radians(315), math.radians(50)
    norm = F.sqrt(dzdx * dzdx + dzdy * dzdy + 1)
    light = (-dzdx * (math.sin(az) * math.cos(alt)) + dzdy * (math.cos(az) * math.cos(alt)) + math.sin(alt)) / norm
    return F.greatest(F.lit(0.28), F.least(F.lit(1.0), light))
