"""Geographic relations derived from the driver's business tables.

The tables carry no coordinates, so keys give them by integer arithmetic that
every engine evaluates alike.  The text of a relation is the same in both
engines; what is computed from the relations is not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import lit

LAT, LON = "36e0 + (({k} * 7919) % 40000) / 10000e0 + 0.00005e0", "-119e0 + (({k} * 104729) % 40000) / 10000e0 + 0.00005e0"


def _at(k: str) -> str:
    return f"{LAT.format(k=k)} AS lat, {LON.format(k=k)} AS lon"


RELATIONS = {
    "sites": f"""
SELECT c_custkey AS k, concat('c', c_custkey) AS slug, c_name AS name, c_mktsegment AS seg, CAST(c_nationkey AS BIGINT) AS nation, {_at('c_custkey')}, 2e0 + c_custkey % 5 AS height_m
FROM <customer>
UNION ALL
SELECT 1000000000 + s_suppkey AS k, concat('s', s_suppkey) AS slug, s_name AS name, 'SUPPLIER' AS seg, CAST(s_nationkey AS BIGINT) AS nation, {_at('(s_suppkey + 500009)')}, 2e0 + s_suppkey % 5 AS height_m
FROM <supplier>""",
    "peaks": f"""
SELECT p_partkey AS k, concat('p', p_partkey) AS slug, p_name AS name, p_brand AS brand, p_type AS kind, {_at('(p_partkey + 250007)')}, 500e0 + (p_partkey * 37) % 1700 AS elev_m, p_size % 4 <> 0 AS eligible, CAST(p_size AS BIGINT) AS size
FROM <part>""",
    "parcels": f"""
SELECT k, slug, role, grp, lon - w AS west, lat - h AS south, lon + w AS east, lat + h AS north FROM (
SELECT p_partkey AS k, concat('l', p_partkey) AS slug, CASE p_partkey % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'aoi' ELSE 'include' END AS role, p_brand AS grp, {_at('(p_partkey + 750019)')}, 0.05e0 + (p_size % 7) / 100e0 AS w, 0.04e0 + (p_size % 5) / 100e0 AS h
FROM <part>) x""",
    "waypoints": """
SELECT l_orderkey AS route, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord, 36e0 + ((l_orderkey * 7919) % 40000) / 10000e0 + l_linenumber * 0.002e0 + (l_partkey % 7) * 0.0003e0 + 0.00005e0 AS lat,
-119e0 + ((l_orderkey * 104729) % 40000) / 10000e0 + l_linenumber * 0.0015e0 + (l_suppkey % 5) * 0.0004e0 + 0.00005e0 AS lon,
l_returnflag AS flag, l_linestatus AS status, l_quantity AS qty, l_partkey AS part
FROM <lineitem>""",
    "segments": """
SELECT route, ord, lat AS lat_a, lon AS lon_a, lat_b, lon_b,
CASE part % 9 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'unclassified' WHEN 4 THEN 'residential' WHEN 5 THEN 'service' WHEN 6 THEN 'path' WHEN 7 THEN 'river' ELSE 'track' END AS highway,
CASE part % 6 WHEN 0 THEN 'grade1' WHEN 1 THEN 'grade2' WHEN 2 THEN 'grade3' WHEN 3 THEN 'grade4' WHEN 4 THEN 'grade5' END AS tracktype,
CASE part % 5 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'paved' WHEN 3 THEN 'dirt' END AS surface,
CASE WHEN flag = 'A' THEN 'private' ELSE 'public' END AS access, part % 11 = 0 AS fourwd, qty
FROM (SELECT *, lead(lat) OVER (PARTITION BY route ORDER BY ord) AS lat_b, lead(lon) OVER (PARTITION BY route ORDER BY ord) AS lon_b FROM {waypoints}) w
WHERE lat_b IS NOT NULL""",
    # Roads along the lines of a lattice of 120 x 120 crossings; one in four starts half-way between two, on another road.
    "roads": """
SELECT route * 8 + ord AS id, CASE WHEN i % 24 = 0 AND ord % 2 = 1 AND ord % 4 <> 3 THEN 'primary' ELSE CASE (i * 7 + j * 3) % 5 WHEN 0 THEN 'track' WHEN 1 THEN 'unclassified' WHEN 2 THEN 'residential' WHEN 3 THEN 'service' ELSE 'track' END END AS highway,
CASE (i + j) % 6 WHEN 0 THEN 'grade1' WHEN 1 THEN 'grade2' WHEN 2 THEN 'grade3' WHEN 3 THEN 'grade4' WHEN 4 THEN 'grade5' END AS tracktype, CASE WHEN i % 24 = 0 THEN 'asphalt' WHEN j % 3 = 0 THEN 'gravel' END AS surface, route % 13 = 0 AS fourwd,
37.0005e0 + i * 0.002e0 + CASE WHEN ord % 4 = 3 THEN 0.001e0 ELSE 0e0 END + (route % 3) * 0.00001e0 AS lat_a, -116.9995e0 + j * 0.0025e0 + (route % 3) * 0.00001e0 AS lon_a,
37.0005e0 + i * 0.002e0 + CASE WHEN ord % 4 = 3 THEN 0.001e0 ELSE 0e0 END + CASE WHEN ord % 2 = 0 THEN 0.002e0 ELSE 0e0 END + (route % 3) * 0.00001e0 AS lat_b, -116.9995e0 + j * 0.0025e0 + CASE WHEN ord % 2 = 1 THEN 0.0025e0 ELSE 0e0 END + (route % 3) * 0.00001e0 AS lon_b
FROM (SELECT route, ord, part % 120 AS i, (route * 31 + ord * 7) % 120 AS j FROM {waypoints}) x WHERE ord < 8""",
    # Places to reach among those roads.
    "pins": """
SELECT p_partkey AS k, concat('pin', p_partkey) AS slug, p_name AS name, 37.0035e0 + ((p_partkey * 37) % 230) * 0.001e0 AS lat, -116.9985e0 + ((p_partkey * 53) % 290) * 0.001e0 AS lon FROM <part>""",
}


def sql_of(name: str, duck: bool) -> str:
    """A relation's text with its own relations put in, tables as names (duck) or as {table}."""
    text = re.sub(r"\{([a-z]+)\}", lambda m: "(" + sql_of(m[1], duck) + ")", RELATIONS[name])
    return re.sub(r"<(\w+)>", r"\1" if duck else r"{\1}", text)


def with_relations(oracle: str) -> str:
    """Oracle text whose {relation} names become common table expressions."""
    used = list(dict.fromkeys(re.findall(r"\{([a-z]+)\}", oracle)))
    body = re.sub(r"\{([a-z]+)\}", r"rel_\1", oracle)
    if not used:
        return body
    ctes = ", ".join(f"rel_{r} AS ({sql_of(r, True)})" for r in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:].lstrip()}"
    return f"WITH {ctes}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql_of(name, False)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{([a-z]+)\}", text))}
    return spark.sql(text, **tables)


GRID = 120  # terrain nodes a degree


def node_height(i, j) -> Column:
    """Height of the synthetic terrain at global node (i from the south pole, j from the antimeridian)."""
    return F.lit(300) + F.abs((lit(i) * 7) % 240 - 120) * 3 + F.abs((lit(j) * 11) % 300 - 150) * 2


def formula_sampler(df: DataFrame, lat: str, lon: str, out: str) -> DataFrame:
    """Bilinear sample of the synthetic terrain, in closed form."""
    tile = F.floor(lat)
    fx, fy = (F.col(lon) + 180) * GRID, (tile + 1 - F.col(lat)) * GRID
    x, y = F.floor(fx), F.floor(fy)
    tx, ty = fx - x, fy - y
    i = (tile + 91) * GRID - y
    z = lambda di, dj: node_height(i - di, x + dj).cast("double")
    from ..operators.terrain import bilinear

    return df.withColumn(out, bilinear(z(0, 0), z(0, 1), z(1, 0), z(1, 1), tx, ty))


def duck_height(lat: str, lon: str) -> str:
    """DuckDB text of the sample at (lat, lon)."""
    tile, x, y = f"floor({lat})", f"floor(({lon} + 180) * 120)", f"floor((floor({lat}) + 1 - {lat}) * 120)"
    tx, ty = f"(({lon} + 180) * 120 - {x})", f"((floor({lat}) + 1 - {lat}) * 120 - {y})"
    z = lambda di, dj: f"(300 + abs(((({tile} + 91) * 120 - {y} - {di}) * 7) % 240 - 120) * 3 + abs((({x} + {dj}) * 11) % 300 - 150) * 2)"
    return f"(({z(0, 0)} * (1 - {tx}) + {z(0, 1)} * {tx}) * (1 - {ty}) + ({z(1, 0)} * (1 - {tx}) + {z(1, 1)} * {tx}) * {ty})"


def dem_rows(spark: SparkSession, lat_tiles=range(35, 42), lon_tiles=range(-120, -113), n: int = GRID + 1) -> DataFrame:
    """The synthetic terrain as scanlines, row 0 north: the tiles with places and one ring of tiles around them."""
    tiles = spark.createDataFrame([(a, b) for a in lat_tiles for b in lon_tiles], "tile_lat int, tile_lon int")
    rows = tiles.crossJoin(F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("iy"))))  # n rows
    i = (F.col("tile_lat") + 91) * (n - 1) - F.col("iy")
    elev = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: node_height(i, (F.col("tile_lon") + 180) * (n - 1) + x).cast("smallint"))
    return rows.select("tile_lat", "tile_lon", F.lit(n).alias("n"), "iy", elev.alias("elev"))


_tiles: dict[str, str] = {}


def tile_folder(spark: SparkSession) -> str:
    """A folder of elevation tile files of the synthetic terrain, written once a session."""
    from .files import hgt_files, write_files
    from .shared import shared_path

    app = spark.sparkContext.applicationId
    if app not in _tiles:
        folder = shared_path(spark, "tiles")
        write_files(hgt_files(dem_rows(spark)), folder).collect()  # a row a tile
        _tiles[app] = folder
    return _tiles[app]


def tile_rows(spark: SparkSession) -> DataFrame:
    """The terrain as read from the tile files."""
    from .files import read_hgt

    return read_hgt(spark, tile_folder(spark), sizes=(GRID + 1,))


def tile_blocks(spark: SparkSession) -> DataFrame:
    """Blocks of the tile files, written once a session and read as a table."""
    from ..operators.terrain import blocks

    path = tile_folder(spark) + "-blocks"
    if path not in _tiles:
        blocks(tile_rows(spark)).write.mode("overwrite").parquet(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        _tiles[path] = path
    return spark.read.parquet(path)


def tile_sampler(spark: SparkSession):
    """A sampler (df, lat, lon, out) over the tile files' blocks."""
    from ..operators.terrain import sample_blocks

    table = tile_blocks(spark)
    return lambda df, lat, lon, out: sample_blocks(df, table, lat, lon, out)
