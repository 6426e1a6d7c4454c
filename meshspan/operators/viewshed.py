"""Coverage rasters over terrain.

Each site is joined to the few terrain blocks around it; a numpy kernel a site
samples them along rays and evaluates every pixel against the interpolated ray
profile.  A site's rays are at most max(4 w, 720) x steps floats, whatever the
number of sites.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import R_GROUND, R_RADIO, mercator
from ..functions.rf import EFFECTIVE_EARTH_M, LIGHT_M_S
from .graph import cut
from .terrain import BLOCK, VOID


def ground(blocks: list[dict], size: int):
    """A function of (lat, lon) arrays: bilinear elevation from terrain blocks, 0 beyond them."""

    def at(la: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(la.shape)
        tile_la, tile_lo = np.floor(la), np.floor(lo)
        for b in blocks:
            n, w = b["n"], b["w"]
            fx, fy = (lo - tile_lo) * (n - 1), (tile_la + 1 - la) * (n - 1)
            x, y = np.floor(fx).astype(int), np.floor(fy).astype(int)
            on = (tile_la == b["tile_lat"]) & (tile_lo == b["tile_lon"]) & (x // size == b["bx"]) & (y // size == b["by"]) & (x + 1 < n) & (y + 1 < n)
            if not on.any():
                continue
            z = np.asarray(b["z"], float)
            z = np.where((z == VOID) | (z < -12000), 0.0, z)
            first = (y[on] - b["by"] * size) * w + x[on] - b["bx"] * size
            tx, ty = fx[on] - x[on], fy[on] - y[on]
            top = z[first] * (1 - tx) + z[first + 1] * tx
            out[on] = top * (1 - ty) + (z[first + w] * (1 - tx) + z[first + w + 1] * tx) * ty
        return out

    return at


def meet_blocks(sites: DataFrame, blocks: DataFrame, radius_m: float, size: int = BLOCK) -> DataFrame:
    """``sites`` (with lat, lon) joined to the terrain blocks that the box of their radius touches; sites without any keep a row."""
    half = radius_m / R_RADIO * 180 / math.pi * 1.01
    wide = half / F.greatest(F.cos(F.radians(F.abs("lat") + half)), F.lit(0.01))
    span = lambda c, d: F.explode(F.sequence(F.floor(F.col(c) - d).cast("int"), F.floor(F.col(c) + d).cast("int")))
    s = sites.withColumn("tile_lat", span("lat", F.lit(half))).withColumn("tile_lon", span("lon", wide))
    steps = (F.col("n") - 1) / size
    edge = lambda c, t, d: (F.col(c) + d - F.col(t)) * steps
    touched = (F.floor(edge("lon", "tile_lon", -wide)) <= F.col("bx")) & (F.col("bx") <= F.floor(edge("lon", "tile_lon", wide)))
    touched &= (F.floor(steps - edge("lat", "tile_lat", half)) <= F.col("by")) & (F.col("by") <= F.floor(steps - edge("lat", "tile_lat", -half)))
    met = s.join(blocks, ["tile_lat", "tile_lon"]).filter(touched)
    return met.unionByName(sites, allowMissingColumns=True)


def climb(points: DataFrame, blocks: DataFrame, key: str, radius_m: float, step_m: float, size: int = BLOCK) -> DataFrame:
    """(key, lat, lon, elev_m): where walking uphill from each point ends, in steps to the highest of eight neighbours, inside the radius.

    ``key`` is a unique string.  Points without ground above sea level are absent.
    """
    step = max(step_m, 10.0)
    schema = pa.schema([("key", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("elev_m", pa.float64())])

    def metres(a, b, la, lo):
        p, q = np.radians(a), np.radians(la)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lo - b) / 2) ** 2
        return 2 * R_GROUND * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    def run(table: pa.Table) -> pa.Table:
        first = lambda c: table.column(c)[0].as_py()
        held = [b for b in table.select(["tile_lat", "tile_lon", "n", "by", "bx", "w", "z"]).to_pylist() if b["z"] is not None]
        sample = ground(held, size)
        lat0, lon0 = first("lat"), first("lon")
        lat, lon = lat0, lon0
        e = float(sample(np.array([lat]), np.array([lon]))[0])
        if e <= 0:
            return schema.empty_table()
        t = np.radians(45.0 * np.arange(8))
        d = step / R_GROUND
        for _ in range(max(4 * math.ceil(radius_m / step), 16)):
            p = math.radians(lat)
            p2 = np.arcsin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * np.cos(t))
            lo = lon + np.degrees(np.arctan2(np.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * np.sin(p2)))
            la = np.degrees(p2)
            z = np.where(metres(lat0, lon0, la, lo) <= radius_m + 1, sample(la, lo), -1.0)
            i = int(z.argmax())
            if z[i] <= e + 1e-3:
                break
            lat, lon, e = float(la[i]), float(lo[i]), float(z[i])
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((first("key"), lat, lon, e), schema)], schema=schema)

    met = meet_blocks(points.select(F.col(key).alias("key"), "lat", "lon"), blocks, radius_m, size)
    return met.groupBy("key").applyInArrow(run, "key string, lat double, lon double, elev_m double").withColumnRenamed("key", key)


def ray_profiles(lat: float, lon: float, sample, radius_m: float, width: int) -> np.ndarray:
    """Elevations along evenly spread rays, a row a ray, from the site outwards."""
    n, steps = max(4 * width, 720), max(width, 40)
    b = (np.arange(n) * (2 * math.pi / n))[:, None]
    s = (np.arange(steps + 1) * (radius_m / steps) / R_RADIO)[None, :]
    p1 = math.radians(lat)
    p2 = np.arcsin(math.sin(p1) * np.cos(s) + math.cos(p1) * np.sin(s) * np.cos(b))
    lo = math.radians(lon) + np.arctan2(np.sin(b) * np.sin(s) * math.cos(p1), np.cos(s) - math.sin(p1) * np.sin(p2))
    return sample(np.degrees(p2), np.degrees(lo)).astype(np.float32)


def levels(terr: np.ndarray, lat: float, radius_m: float, width: int, height: float, link: dict) -> np.ndarray:
    """Received power of every pixel of a site-centred raster; nan outside the radius or below the threshold."""
    n, steps = terr.shape[0], terr.shape[1] - 1
    step = radius_m / steps
    k = max(math.cos(math.radians(lat)), 0.01)
    half = radius_m / 6_378_137.0 * 180 / math.pi
    out = np.full((width, width), np.nan)
    wl = LIGHT_M_S / (link["freq_mhz"] * 1e6)
    s = np.arange(1, steps) * step
    xs = -half / k + (np.arange(width) + 0.5) / width * 2 * half / k
    for y in range(width):
        dy = half - (y + 0.5) / width * 2 * half
        p1, p2, dl = math.radians(lat), math.radians(lat + dy), np.radians(xs)
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * np.sin(dl / 2) ** 2
        d = 2 * 6_378_137.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
        ok = np.flatnonzero(d <= radius_m)
        if not len(ok):
            continue
        d, dl = d[ok], dl[ok]
        b = np.arctan2(np.sin(dl) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * np.cos(dl)) % (2 * math.pi)
        at = b / (2 * math.pi) * n
        r0, t = np.floor(at).astype(int) % n, (at % 1)[:, None]
        prof = terr[r0] * (1 - t) + terr[(r0 + 1) % n] * t
        end = np.minimum(d / step, steps - 1e-9)
        e0 = np.floor(end).astype(int)
        i = np.arange(len(d))
        z_rx = prof[i, e0] * (1 - (end - e0)) + prof[i, e0 + 1] * (end - e0) + link["rx_height"]
        z_tx = float(terr[0, 0]) + height
        D, S = d[:, None], s[None, :]
        inside = (S >= 2) & (D - S >= 2)
        gap = np.where(inside, D - S, 1.0)
        line = z_tx * (1 - S / D) + z_rx[:, None] * (S / D) - S * gap / (2 * EFFECTIVE_EARTH_M)
        over = prof[:, 1:steps] + link["clutter"] - line + link["fresnel"] * np.sqrt(wl * S * gap / D)
        nu = np.where(inside & (over > 0), over * np.sqrt(2 * D / (wl * S * gap)), -np.inf).max(axis=1)
        v = np.where(np.isfinite(nu), nu, -9.0) - 0.1
        loss = np.where(nu < -0.78, 0.0, np.clip(6.9 + 20 * np.log10(np.sqrt(v * v + 1) + v), 0, 120))
        fspl = np.where(d < 2, 0.0, 20 * np.log10(np.maximum(d, 1) / 1000) + 20 * math.log10(link["freq_mhz"]) + 32.44)
        pr = link["eirp_chain"] - fspl - loss
        out[y, ok] = np.where(pr >= link["threshold_dbm"], pr, np.nan)
    return out


def coverage(sites: DataFrame, blocks: DataFrame, link: dict, radius_m: float, width: int, size: int = BLOCK) -> DataFrame:
    """Covered pixels (slug, x, y, pr_dbm) of each site's raster; sites have slug, lat, lon, height_m.

    A site meets the terrain blocks that its box touches, and its task does the
    rest on arrays; no sample is ever a row.
    """
    schema = pa.schema([("slug", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("pr_dbm", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        first = lambda c: table.column(c)[0].as_py()
        rows = table.select(["tile_lat", "tile_lon", "n", "by", "bx", "w"]).to_pylist()
        held = [{**b, "z": z.values.to_numpy(zero_copy_only=False)} for b, z in zip(rows, table.column("z")) if z.is_valid]
        terr = ray_profiles(first("lat"), first("lon"), ground(held, size), radius_m, width)
        pr = levels(terr, first("lat"), radius_m, width, max(1.0, first("height_m")), link)
        y, x = np.nonzero(~np.isnan(pr))
        return pa.Table.from_arrays([pa.array([first("slug")] * len(x)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(pr[y, x])], schema=schema)

    met = meet_blocks(sites.select("slug", "lat", "lon", "height_m"), blocks, radius_m, size)
    return met.groupBy("slug").applyInArrow(run, "slug string, x int, y int, pr_dbm double")


def raster_masks(covered: DataFrame, width: int) -> DataFrame:
    """Covered pixels packed: (slug, part, mask), a bit a pixel of the site's own raster, row by row."""
    bit = F.col("y").cast("long") * width + F.col("x")
    return covered.groupBy("slug", F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("mask"))


def union_gain(masks: DataFrame, chains: DataFrame) -> DataFrame:
    """Pixels that a chain's sites cover by pixel number: ``raster_masks`` and chains (chain, slug) to (chain, cells).

    Two rasters are laid on each other as they are, though they show different
    ground: the measure breaks ties between chains and is no area.  ``ground_masks``
    unites what lies on the same ground.
    """
    parts = chains.join(masks, "slug").groupBy("chain", "part").agg(F.bitmap_count(F.bitmap_or_agg("mask")).alias("n"))
    return parts.groupBy("chain").agg(F.sum("n").alias("cells"))


GROUND = 181  # cells of a side of one mask: as many as fit its 32,768 bits


def ground_masks(covered: DataFrame, sites: DataFrame, radius_m: float, width: int, cell_m: float) -> DataFrame:
    """(slug, gx, gy, mask): the Mercator cells, ``cell_m`` wide at the equator, in which the centre of a covered pixel lies.

    All sites share the cells, so masks of the same (gx, gy) may be united and counted.
    """
    half = radius_m / R_RADIO * 180 / math.pi
    wide = half / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    c = covered.select("slug", "x", "y").join(sites.select("slug", "lat", "lon"), "slug")
    at_lat = F.col("lat") + half - (F.col("y") + 0.5) / width * 2 * half
    at_lon = F.col("lon") - wide + (F.col("x") + 0.5) / width * 2 * wide
    mx, my = mercator(at_lat, at_lon)
    c = c.select("slug", F.floor(mx / cell_m).alias("cx"), F.floor(my / cell_m).alias("cy"))
    bit = F.pmod(F.col("cy"), F.lit(GROUND)) * GROUND + F.pmod(F.col("cx"), F.lit(GROUND))
    return c.groupBy("slug", F.floor(F.col("cx") / GROUND).alias("gx"), F.floor(F.col("cy") / GROUND).alias("gy")).agg(F.bitmap_construct_agg(bit).alias("mask"))


def union_cells(masks: DataFrame, chains: DataFrame) -> DataFrame:
    """Cells of ground that a chain's sites cover together: ``ground_masks`` and chains (chain, slug) to (chain, cells)."""
    parts = chains.join(masks, "slug").groupBy("chain", "gx", "gy").agg(F.bitmap_count(F.bitmap_or_agg("mask")).alias("n"))
    return parts.groupBy("chain").agg(F.sum("n").alias("cells"))


def best_additions(masks: DataFrame, most: int, batch: int = 64) -> DataFrame:
    """(rank, slug, gain, total): up to ``most`` sites, each the one that adds the most ground to those before it; ties to the smaller slug.

    What a site adds only falls as others are taken, so its last known gain is a
    bound.  A round measures the ``batch`` sites of the highest bounds on their
    packed masks, and takes the best of them once no other site's bound is above
    it; sites that stay behind are not looked at again.
    """
    spark = masks.sparkSession
    masks = cut(masks)
    bounds = cut(masks.groupBy("slug").agg(F.sum(F.bitmap_count("mask")).alias("bound")).withColumn("as_of", F.lit(0)))
    have = cut(masks.limit(0).select("gx", "gy", "mask"))
    picked, total = [], 0
    while len(picked) < most:
        top = bounds.orderBy(F.desc("bound"), "slug").limit(batch).collect()  # a batch of slugs and numbers
        if not top or top[0].bound <= 0:
            break
        stale = [r.slug for r in top if r.as_of < len(picked)]
        if top[0].as_of == len(picked):  # the highest bound is exact: nothing else can beat it
            best = top[0]
            total += best.bound
            picked.append((len(picked) + 1, best.slug, best.bound, total))
            have = cut(have.union(masks.filter(F.col("slug") == best.slug).select("gx", "gy", "mask")).groupBy("gx", "gy").agg(F.bitmap_or_agg("mask").alias("mask")))
            bounds = bounds.filter(F.col("slug") != best.slug)
            continue
        some = masks.filter(F.col("slug").isin(stale))
        there = some.select("slug", "gx", "gy").join(have, ["gx", "gy"])
        both = some.unionByName(there).groupBy("slug", "gx", "gy").agg(F.bitmap_count(F.bitmap_or_agg("mask")).alias("n"))
        before = there.select("slug", F.bitmap_count("mask").alias("was")).groupBy("slug").agg(F.sum("was").alias("was"))
        gain = both.groupBy("slug").agg(F.sum("n").alias("n")).join(before, "slug", "left").select("slug", (F.col("n") - F.coalesce("was", F.lit(0).cast("long"))).alias("gain"))
        new = bounds.join(gain, "slug", "left")
        bounds = cut(new.select("slug", F.coalesce("gain", "bound").alias("bound"), F.when(F.col("gain").isNotNull(), len(picked)).otherwise(F.col("as_of")).alias("as_of")))
    return spark.createDataFrame(picked, "rank int, slug string, gain long, total long")
