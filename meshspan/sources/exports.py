"""Exports: archives, images, baked projects."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_GROUND, haversine_m
from .files import compact


def png_rgba(rgb: np.ndarray) -> bytes:
    """An RGBA image in which pure white is transparent."""
    h, w = rgb.shape[:2]
    alpha = np.where((rgb == 255).all(axis=2), 0, 255).astype(np.uint8)
    lines = np.zeros((h, w * 4 + 1), np.uint8)
    lines[:, 1:] = np.dstack([rgb.astype(np.uint8), alpha]).reshape(h, -1)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_images(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, content): a PNG for each key of pixels (key, x, y, r, g, b)."""

    def run(table: pa.Table) -> pa.Table:
        img = np.full((height, width, 3), 255, np.uint8)
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        for i, c in enumerate("rgb"):
            img[y, x, i] = table.column(c).to_numpy()
        return pa.table({"key": pa.array([str(table.column("key")[0].as_py())]), "content": pa.array([png_rgba(img)], pa.binary())})

    return pixels.select(F.col(key).cast("string").alias("key"), "x", "y", "r", "g", "b").groupBy("key").applyInArrow(run, "key string, content binary")


def kmz_archives(docs: DataFrame) -> DataFrame:
    """(key, content) archives from rows (key, path, content): doc.kml and its files."""

    def run(table: pa.Table) -> pa.Table:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for r in sorted(table.to_pylist(), key=lambda r: (r["path"] != "doc.kml", r["path"])):
                z.writestr(zipfile.ZipInfo(r["path"]), r["content"])
        return pa.table({"key": pa.array([table.column("key")[0].as_py()]), "content": pa.array([buf.getvalue()], pa.binary())})

    return docs.select("key", "path", F.col("content").cast("binary").alias("content")).groupBy("key").applyInArrow(run, "key string, content binary")


def dashes(line: DataFrame, on_m: float = 80.0, off_m: float = 40.0) -> DataFrame:
    """Legs of lines (line, ord, lat, lon) that fall on a dash, by the distance run at their start: adds dash number."""
    w = Window.partitionBy("line").orderBy("ord")
    step = F.coalesce(haversine_m("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w), R_GROUND), F.lit(0.0))
    run = F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = line.withColumn("step", step).withColumn("run", run)
    return d.withColumn("dash", F.floor(F.col("run") / (on_m + off_m))).filter(F.col("run") - F.col("dash") * (on_m + off_m) < on_m).drop("step", "run")


def baked(features: DataFrame, layer_key: str = "layer", label: str = "label") -> DataFrame:
    """Features reduced to layer key, label and coordinates of six decimals, for a project without sources."""
    return features.select(F.col(layer_key).alias("layer"), F.col(label).alias("label"), compact(F.col("coords")).alias("coords"))


def map_metadata(sites: DataFrame, settings: dict) -> dict:
    """The header of an exported map: settings, number of sites, extent; it lists no features."""
    e = sites.agg(F.count("*").alias("n"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n2")).first()
    return {"type": "FeatureCollection", "features": [], "properties": settings | {"sites": e.n}, "bbox": [e.w, e.s, e.e, e.n2] if e.n else None}


def applied(sites: DataFrame, links: DataFrame, new_sites: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites and manual links after a plan: new slugs are added, known ones stay; pairs are kept in order of their ends."""
    added = new_sites.join(sites.select("slug"), "slug", "left_anti")
    pair = new_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("manual"))
    old = links.join(pair.select("a", "b"), ["a", "b"], "left_anti")
    return sites.unionByName(added), old.unionByName(pair)


def pruned(links: DataFrame, sites: DataFrame) -> DataFrame:
    """Links both ends of which are still sites."""
    s = sites.select("slug")
    return links.join(s.withColumnRenamed("slug", "a"), "a", "left_semi").join(s.withColumnRenamed("slug", "b"), "b", "left_semi")
