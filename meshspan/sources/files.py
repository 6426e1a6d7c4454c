"""Readers and writers of the formats that planning data comes in.

Each file is one task's work and becomes rows at once; GeoJSON is also written
and read as one feature a line, which splits.
"""

from __future__ import annotations

import gzip
import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import tile_corner

# --- elevation tiles ------------------------------------------------------------------------------------------


def read_hgt(spark: SparkSession, path: str, sizes: tuple[int, ...] = (1201, 3601)) -> DataFrame:
    """Scanlines (tile_lat, tile_lon, n, iy, elev) of gzip tiles named by their corner; other ``sizes`` (squared) are errors."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt.gz").load(path)
    south, west = tile_corner(F.regexp_extract("path", r"([^/]+)\.hgt\.gz$", 1))
    raw = raw.select(south.alias("tile_lat"), west.alias("tile_lon"), "content", "path")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                data = np.frombuffer(gzip.decompress(r["content"]), ">i2")
                n = int(len(data) ** 0.5)
                if n * n != len(data) or n not in sizes or r["tile_lat"] is None:
                    raise ValueError(f"not an elevation tile: {r['path']}")
                rows = data.astype(np.int16).reshape(n, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n + 1, n, dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["tile_lat"]] * n, pa.int32()), pa.array([r["tile_lon"]] * n, pa.int32()), pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), lists], names=["tile_lat", "tile_lon", "n", "iy", "elev"])

    return raw.mapInArrow(run, "tile_lat int, tile_lon int, n int, iy int, elev array<smallint>")


def hgt_files(dem: DataFrame) -> DataFrame:
    """(name, content): a gzip tile for each tile of scanlines."""
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("iy")
        la, lo = (table.column(c)[0].as_py() for c in ("tile_lat", "tile_lon"))
        data = np.concatenate([x.values.to_numpy() for x in table.column("elev")]).astype(">i2").tobytes()
        name = f"{'NS'[la < 0]}{abs(la):02d}{'EW'[lo < 0]}{abs(lo):03d}.hgt.gz"
        return pa.Table.from_arrays([pa.array([name]), pa.array([gzip.compress(data, mtime=0)], pa.binary())], schema=schema)

    return dem.groupBy("tile_lat", "tile_lon").applyInArrow(run, "name string, content binary")


def missing_tiles(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Tile names that are wanted and not there."""
    return wanted.select("name").distinct().join(present.select("name"), "name", "left_anti")


def valid_tile_name(name) -> Column:
    return F.col(name).rlike(r"^[NS]\d{1,2}[EW]\d{3}\.hgt\.gz$")


# --- writing one file a row -------------------------------------------------------------------------------------


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's bytes to ``folder``/``name``, by rename from a temporary name; returns (name, bytes)."""

    def run(batches):
        import uuid

        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = [], []
            for r in b.to_pylist():
                part = f"{root}/.{r['name']}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(r["content"])
                fs.move(part, f"{root}/{r['name']}")
                names.append(r["name"])
                sizes.append(len(r["content"]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")


# --- GeoJSON ----------------------------------------------------------------------------------------------------

FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, coordinates as JSON, props) of features: collections, single features, or a feature a line."""
    text = spark.read.option("wholetext", "true").text(path)
    return parse_geojson(text, "value")


def parse_geojson(df: DataFrame, col: str) -> DataFrame:
    whole = F.from_json(col, f"struct<type:string,features:array<{FEATURE}>,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>")
    one = F.struct(F.col("w.type").alias("type"), F.col("w.geometry").alias("geometry"), F.col("w.properties").alias("properties"))
    lines = F.from_json(F.concat(F.lit("["), F.array_join(F.filter(F.split(col, "\n"), lambda x: F.btrim(x) != ""), ","), F.lit("]")), f"array<{FEATURE}>")
    f = df.withColumn("w", whole).withColumn("f", F.explode(F.when(F.col("w.type") == "FeatureCollection", F.col("w.features")).when((F.col("w.type") == "Feature") & ~F.contains(F.col(col), F.lit("\n{")), F.array(one)).otherwise(lines)))
    return f.select(F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props")).filter("coordinates is not null")


def line_of(geometry, coordinates) -> Column:
    """Vertices of a LineString, or of the part of a MultiLineString with most vertices, first of equals."""
    one = F.from_json(coordinates, "array<array<double>>")
    many = F.from_json(coordinates, "array<array<array<double>>>")
    longest = F.aggregate(many, F.expr("cast(array() as array<array<double>>)"), lambda best, p: F.when(F.size(p) > F.size(best), p).otherwise(best))
    return F.when(F.col(geometry) == "LineString", one).when(F.col(geometry) == "MultiLineString", longest)


def features_to_segments(features: DataFrame) -> DataFrame:
    """Road segments with defaults for what a feature lacks; lines of fewer than two vertices are dropped."""
    p = lambda k, d: F.coalesce(F.nullif(F.btrim(F.try_element_at("props", F.lit(k))), F.lit("")), F.lit(d)).alias(k)
    seg = features.select(p("id", ""), p("kind", "road"), p("surface", "unknown"), p("grade", "unknown"), p("access", "unknown"), line_of("geometry", "coordinates").alias("coords"))
    return seg.filter(F.size("coords") >= 2)


def rings_of(geometry, coordinates) -> Column:
    """Rings of (lon, lat) structs of a Polygon."""
    rings = F.from_json(coordinates, "array<array<array<double>>>")
    as_struct = lambda ring: F.transform(ring, lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat")))
    return F.when(F.col(geometry) == "Polygon", F.transform(rings, as_struct))


def feature_text(geometry: str, coordinates: Column, props: Column) -> Column:
    """A GeoJSON feature as text; ``coordinates`` are nested arrays of numbers."""
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{geometry}","coordinates":'), F.to_json(coordinates), F.lit('},"properties":'), F.to_json(props), F.lit("}"))


def write_geojson(df: DataFrame, path: str, geometry: str, coordinates: Column, props: Column) -> None:
    """A feature a line, in as many part files as there are tasks."""
    df.select(feature_text(geometry, coordinates, props).alias("value")).write.mode("overwrite").text(path)


#: fixed values: field names that summit files use, in order of preference
GNIS_NAME = ("feature_name", "name", "gaz_name", "official_name")
GNIS_ELEV = ("elev_in_m", "elevation", "elev_m")


def gnis_candidates(features: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Named summits (props, name, lat, lon, elev_m) inside a box; places come from decimal fields, else from the point."""
    prop = lambda k: F.nullif(F.btrim(F.try_element_at("props", F.lit(k))), F.lit(""))
    point = F.from_json("coordinates", "array<double>")
    lat = F.coalesce(prop("prim_lat_dec").try_cast("double"), point[1])
    lon = F.coalesce(prop("prim_long_dec").try_cast("double"), point[0])
    f = features.filter("geometry = 'Point'").select("props", F.coalesce(*map(prop, GNIS_NAME)).alias("name"), lat.alias("lat"), lon.alias("lon"), F.coalesce(*[prop(k).try_cast("double") for k in GNIS_ELEV]).alias("elev_m"), prop("k").alias("k"))
    return f.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.col("name").isNotNull())


def way_edges(ways: DataFrame, nodes: DataFrame, way: str, refs: str) -> DataFrame:
    """Edges (way, pos, a, b, lat_a, lon_a, lat_b, lon_b) of ways that list node ids; edges of missing nodes are dropped."""
    r = ways.select(way, F.posexplode(refs).alias("pos", "a"), F.col(refs).alias("all"))
    r = r.withColumn("b", F.try_element_at("all", F.col("pos") + 2)).filter("b is not null").drop("all")
    at = lambda x: nodes.select(F.col("id").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    return r.join(at("a"), "a").join(at("b"), "b")


def compact(coords: Column, places: int = 6) -> Column:
    """Vertices rounded to ``places`` decimals."""
    k = float(10**places)
    return F.transform(coords, lambda v: F.transform(v, lambda x: F.floor(x * k + 0.5) / k))


# --- KML and KMZ ------------------------------------------------------------------------------------------------


def parse_kml(df: DataFrame, col: str) -> DataFrame:
    """Placemarks (place, name, kind, lat, lon, ord): points, and lines vertex by vertex."""
    marks = df.select("*", F.posexplode(F.regexp_extract_all(col, F.lit(r"(?s)<Placemark\b[^>]*>(.*?)</Placemark>"), 1)).alias("place", "__m"))
    kind = F.when(F.contains(F.col("__m"), F.lit("<LineString")), "line").when(F.contains(F.col("__m"), F.lit("<Point")), "point")
    name = F.regexp_extract("__m", r"(?s)<name>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</name>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        name = F.replace(name, F.lit(entity), F.lit(char))
    coords = F.split(F.btrim(F.regexp_replace(F.regexp_extract("__m", r"(?s)<coordinates>(.*?)</coordinates>", 1), r"\s+", " ")), " ")
    v = marks.filter(kind.isNotNull()).select("place", F.btrim(name).alias("name"), kind.alias("kind"), F.posexplode(coords).alias("ord", "__v"))
    at = lambda i: F.try_element_at(F.split("__v", ","), F.lit(i)).try_cast("double")
    return v.select("place", "name", "kind", at(2).alias("lat"), at(1).alias("lon"), "ord").filter("lat is not null and lon is not null")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return parse_kml(spark.read.option("wholetext", "true").text(path), "value")


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """The first KML document of each archive."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            docs = []
            for c in b.column(0):
                z = zipfile.ZipFile(io.BytesIO(c.as_py()))
                docs.append(next((z.read(n).decode() for n in z.namelist() if n.lower().endswith(".kml")), None))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], names=["value"])

    return parse_kml(raw.mapInArrow(run, "value string"), "value")


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def placemark(name, coords: Column, kind: str = "Point") -> Column:
    """KML text of a mark; ``coords`` is an array of (lon, lat) structs."""
    at = F.array_join(F.transform(coords, lambda v: F.concat_ws(",", v["lon"].cast("string"), v["lat"].cast("string"), F.lit("0"))), " ")
    return F.concat(F.lit("<Placemark><name>"), _escaped(F.col(name)), F.lit(f"</name><{kind}><coordinates>"), at, F.lit(f"</coordinates></{kind}></Placemark>"))


def line_placemark(name: Column, coords: Column) -> Column:
    """KML text of a line; ``coords`` is an array of (lon, lat) structs."""
    at = F.array_join(F.transform(coords, lambda v: F.concat_ws(",", v["lon"].cast("string"), v["lat"].cast("string"), F.lit("0"))), " ")
    return F.concat(F.lit("<Placemark><name>"), _escaped(name), F.lit("</name><LineString><coordinates>"), at, F.lit("</coordinates></LineString></Placemark>"))


def kml_document(body: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), body, F.lit("</Document></kml>"))


def ground_overlay(name, image, north, south, east, west) -> Column:
    box = F.concat(*[x for tag, c in (("north", north), ("south", south), ("east", east), ("west", west)) for x in (F.lit(f"<{tag}>"), F.col(c).cast("string"), F.lit(f"</{tag}>"))])
    return F.concat(F.lit("<GroundOverlay><name>"), _escaped(F.col(name)), F.lit("</name><Icon><href>"), F.col(image), F.lit("</href></Icon><LatLonBox>"), box, F.lit("</LatLonBox></GroundOverlay>"))


# --- rasters ----------------------------------------------------------------------------------------------------


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, x, y, r, g, b) of 8-bit P6 images, comments allowed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import re

        for b in batches:
            for r in b.to_pylist():
                m = re.match(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s", r["content"])
                if not m:
                    raise ValueError(f"not an 8-bit PPM: {r['path']}")
                w, h = int(m[1]), int(m[2])
                px = np.frombuffer(r["content"], np.uint8, w * h * 3, m.end()).reshape(h, w, 3).astype(np.int32)
                for y in range(h):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * w), pa.array(range(w), pa.int32()), pa.array([y] * w, pa.int32()), *[pa.array(px[y, :, c]) for c in range(3)]], names=["path", "x", "y", "r", "g", "b"])

    return raw.mapInArrow(run, "path string, x int, y int, r int, g int, b int")


def ppm_bytes(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, content): a P6 image for each key of pixels (key, x, y, r, g, b); absent pixels are white."""

    def run(table: pa.Table) -> pa.Table:
        img = np.full((height, width, 3), 255, np.uint8)
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        for i, c in enumerate("rgb"):
            img[y, x, i] = table.column(c).to_numpy()
        body = f"P6\n{width} {height}\n255\n".encode() + img.tobytes()
        return pa.table({"key": pa.array([str(table.column("key")[0].as_py())]), "content": pa.array([body], pa.binary())})

    src = pixels.select(F.col(key).cast("string").alias("key"), "x", "y", "r", "g", "b")
    return src.groupBy("key").applyInArrow(run, "key string, content binary")
