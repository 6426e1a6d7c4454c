"""Eligible land on the terrain's own cells, and peak scans that look only there.

A polygon owns the cells that it touches; included cells less excluded ones are
eligible.  Cells are never rows: tasks burn polygons into packed masks, one for
each terrain block they touch, and masks of a block are united by a bitwise
aggregate that also combines within tasks.  Scans meet terrain tiles with their
masks, so tiles and rows without eligible land are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlay import touched
from .terrain import BLOCK, VOID

BYTES = 4096  # of Spark's bitmaps
PENDING = 2000  # masks that a task holds before it hands them on


def burnt(polygons: DataFrame, per_degree: int, size: int = BLOCK) -> DataFrame:
    """(tile_lat, tile_lon, by, bx, role, mask): the cells that the polygons (role, rings) of each role touch, by terrain block.

    Cell (iy, ix) of a tile has bit (iy % size) * size + ix % size of its block's mask.
    """
    width = per_degree

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows():
            keys = list(held)
            masks = [np.packbits(held[k], bitorder="little").tobytes().ljust(BYTES, b"\0") for k in keys]
            held.clear()
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(masks, pa.binary())], names=["tile_lat", "tile_lon", "by", "bx", "role", "mask"])

        for b in batches:
            for role, rings in zip(b.column(0).to_pylist(), b.column(1)):
                at = np.array(touched(rings.as_py(), width), np.int64).reshape(-1, 2)
                tile_lon, tile_lat = at[:, 0] // width, at[:, 1] // width
                ix, iy = at[:, 0] - tile_lon * width, (tile_lat + 1) * width - 1 - at[:, 1]
                keys = np.stack([tile_lat, tile_lon, iy // size, ix // size], axis=1)
                bit = (iy % size) * size + ix % size
                order = np.lexsort(keys.T[::-1])
                keys, bit = keys[order], bit[order]
                for part in np.split(np.arange(len(keys)), np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1):
                    if len(part):
                        key = (*keys[part[0]].tolist(), role)
                        if key not in held:
                            held[key] = np.zeros(size * size, bool)
                        held[key][bit[part]] = True
                if len(held) >= PENDING:
                    yield rows()
        if held:
            yield rows()

    parts = polygons.select("role", "rings").mapInArrow(run, "tile_lat int, tile_lon int, by int, bx int, role string, mask binary")
    return parts.groupBy("tile_lat", "tile_lon", "by", "bx", "role").agg(F.bitmap_or_agg("mask").alias("mask"))


def eligible_masks(polygons: DataFrame, per_degree: int, size: int = BLOCK) -> DataFrame:
    """(tile_lat, tile_lon, by, bx, mask, cells): included cells less excluded ones, of the blocks that have any."""
    m = burnt(polygons.filter(F.col("role").isin("include", "exclude")), per_degree, size).groupBy("tile_lat", "tile_lon", "by", "bx")
    m = m.agg(*[F.max(F.when(F.col("role") == k, F.col("mask"))).alias(k) for k in ("include", "exclude")]).filter("include is not null")

    def run(batches):
        for b in batches:
            masks = []
            for yes, no in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                yes = np.frombuffer(yes, np.uint8)
                masks.append((yes & ~np.frombuffer(no, np.uint8) if no else yes).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(masks, pa.binary())], names=[*b.schema.names[:4], "mask"])

    out = m.mapInArrow(run, "tile_lat int, tile_lon int, by int, bx int, mask binary")
    return out.withColumn("cells", F.bitmap_count("mask")).filter("cells > 0")


def masked_peaks(scanlines: DataFrame, masks: DataFrame, least_drop: float, size: int = BLOCK) -> DataFrame:
    """(tile_lat, tile_lon, n, iy, ix, z): eligible cells no eligible neighbour of which is higher and one of which is ``least_drop`` lower.

    A task has one terrain tile and its masks, and works on the rows between the
    first and the last eligible one.
    """

    def run(key, tile: pa.Table, land: pa.Table) -> pa.Table:
        schema = pa.schema([("tile_lat", pa.int32()), ("tile_lon", pa.int32()), ("n", pa.int32()), ("iy", pa.int32()), ("ix", pa.int32()), ("z", pa.int32())])
        if not tile.num_rows or not land.num_rows:
            return schema.empty_table()
        n = tile.column("n")[0].as_py()
        by, bx = land.column("by").to_numpy(), land.column("bx").to_numpy()
        first, last = int(by.min()) * size, min(n, int(by.max() + 1) * size)
        usable = np.zeros((last - first + 2, n + 2), bool)  # a border all round
        for y, x, m in zip(by.tolist(), bx.tolist(), land.column("mask").to_pylist()):
            bits = np.unpackbits(np.frombuffer(m, np.uint8), count=size * size, bitorder="little").reshape(size, size).astype(bool)
            h, w = min(size, n - y * size), min(size, n - x * size)
            usable[y * size - first + 1 : y * size - first + 1 + h, x * size + 1 : x * size + 1 + w] = bits[:h, :w]
        z = np.zeros(usable.shape, np.int32)
        for i, row in zip(tile.column("iy").to_pylist(), tile.column("elev")):
            if first <= i < last:
                z[i - first + 1, 1 : n + 1] = row.values.to_numpy()
        usable &= (z != VOID) & (z >= -12000)
        lowest, highest = np.iinfo(np.int32).min, np.iinfo(np.int32).max
        up, down = np.where(usable, z, lowest), np.where(usable, z, highest)
        top, low = np.full(z.shape, lowest), np.full(z.shape, highest)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    top = np.maximum(top, np.roll(up, (dy, dx), (0, 1)))
                    low = np.minimum(low, np.roll(down, (dy, dx), (0, 1)))
        ok = usable & (top > lowest) & (top <= z) & (z.astype(np.int64) - low >= least_drop)
        y, x = np.nonzero(ok)
        head = [pa.array(np.full(len(y), v, np.int32)) for v in (key[0].as_py(), key[1].as_py(), n)]
        return pa.Table.from_arrays([*head, pa.array((y + first - 1).astype(np.int32)), pa.array((x - 1).astype(np.int32)), pa.array(z[y, x])], schema=schema)

    tile = ["tile_lat", "tile_lon"]
    lines = scanlines.join(masks.select(*tile).distinct(), tile, "left_semi").select(*tile, "n", "iy", "elev")
    return lines.groupBy(*tile).cogroup(masks.select(*tile, "by", "bx", "mask").groupBy(*tile)).applyInArrow(run, "tile_lat int, tile_lon int, n int, iy int, ix int, z int")
