"""Queries on scalar geodesy, tiles and raster geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as g
from ..sources.derived import relation
from .registry import query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site and the one of the next key."""
    s = relation(spark, sf_dir, "sites")
    a = s.select("slug", "lat", "lon", "k")
    b = s.select(F.col("slug").alias("slug2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.col("k") - 1).alias("k"))
    return a.join(b, "k")


def r(c, places: int = 3):
    return g.rounded(c, places)


HAV = "2 * {R} * atan2(sqrt(h), sqrt(1 - h))"
H = "(sin(radians(b.lat - a.lat) / 2) * sin(radians(b.lat - a.lat) / 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) * sin(radians(b.lon - a.lon) / 2))"


def rd(x: str, places: int = 3) -> str:
    return f"floor(({x}) * {10**places}.0::DOUBLE + 0.5) / {10**places}.0::DOUBLE"


BEARING = "atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))"
PAIRS = f"p AS (SELECT a.k, a.slug, a.lat, a.lon, b.slug AS slug2, b.lat AS lat2, b.lon AS lon2, {H} AS h FROM {{sites}} a JOIN {{sites}} b ON b.k = a.k + 1)"


@query(f"WITH {PAIRS} SELECT slug, slug2, {rd(HAV.format(R='6378137.0::DOUBLE'))} AS radio_m, {rd(HAV.format(R='6371000.0::DOUBLE'))} AS ground_m, {rd('2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(h)))')} AS asin_m FROM p")
def geo_distance(spark, sf_dir):
    at = ("lat", "lon", "lat2", "lon2")
    return _pairs(spark, sf_dir).select("slug", "slug2", r(g.haversine_m(*at)).alias("radio_m"), r(g.haversine_m(*at, g.R_GROUND)).alias("ground_m"), r(g.haversine_asin_m(*at)).alias("asin_m"))


@query(f"WITH {PAIRS}, b AS (SELECT *, {BEARING} AS t FROM p) SELECT slug, {rd('t', 6)} AS bearing_rad, {rd('CASE WHEN degrees(t) < 0 THEN degrees(t) + 360 ELSE degrees(t) END', 5)} AS bearing_deg, {rd('CASE WHEN abs(lat * 7 % 360 - lon2 % 360 - 360 * floor((lat * 7 % 360 - lon2 % 360) / 360)) > 180 THEN 360 - abs(lat * 7 % 360 - lon2 % 360 - 360 * floor((lat * 7 % 360 - lon2 % 360) / 360)) ELSE abs(lat * 7 % 360 - lon2 % 360 - 360 * floor((lat * 7 % 360 - lon2 % 360) / 360)) END', 5)} AS apart_deg FROM b")
def geo_bearing(spark, sf_dir):
    at = ("lat", "lon", "lat2", "lon2")
    p = _pairs(spark, sf_dir)
    return p.select("slug", r(g.bearing_rad(*at), 6).alias("bearing_rad"), r(g.bearing_deg(*at), 5).alias("bearing_deg"), r(g.angle_between_deg(F.col("lat") * 7, F.col("lon2")), 5).alias("apart_deg"))


def _dest(rad: str) -> str:
    d = f"(1500 + k % 50000) / {rad}"
    p2 = f"asin(sin(radians(lat)) * cos({d}) + cos(radians(lat)) * sin({d}) * cos(radians(k % 360)))"
    return p2, f"radians(lon) + atan2(sin(radians(k % 360)) * sin({d}) * cos(radians(lat)), cos({d}) - sin(radians(lat)) * sin({p2}))"


@query("SELECT slug, " + ", ".join(f"{rd(f'degrees({x})', 7)} AS {n}" for rad, names in (("6378137.0::DOUBLE", ("lat_r", "lon_r")), ("6371000.0::DOUBLE", ("lat_g", "lon_g"))) for x, n in zip(_dest(rad), names)) + " FROM {sites}")
def geo_destination(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    t, d = F.radians(F.col("k") % 360), F.lit(1500.0) + F.col("k") % 50000
    a, b = g.destination("lat", "lon", t, d), g.destination("lat", "lon", t, d, g.R_GROUND)
    return s.select("slug", r(a[0], 7).alias("lat_r"), r(a[1], 7).alias("lon_r"), r(b[0], 7).alias("lat_g"), r(b[1], 7).alias("lon_g"))


LOCAL = "((lon2 - lon) * cos(radians((lat + lat2) / 2)) * 111000)"
ALONG = f"((lat3 - lat) * 111000 * (lat2 - lat) * 111000 + (lon3 - lon) * cos(radians((lat + lat2) / 2)) * 111000 * {LOCAL}) / ({LOCAL} * {LOCAL} + (lat2 - lat) * 111000 * (lat2 - lat) * 111000)"


@query(f"WITH {PAIRS}, t AS (SELECT p.*, c.lat AS lat3, c.lon AS lon3 FROM p JOIN {{sites}} c ON c.k = p.k + 2), u AS (SELECT slug, CASE WHEN {LOCAL} * {LOCAL} + (lat2 - lat) * 111000 * (lat2 - lat) * 111000 >= 1 THEN {ALONG} END AS t FROM t) SELECT slug, {rd('t', 6)} AS t, coalesce({rd('t', 6)} > 0.05 AND {rd('t', 6)} < 0.95, false) AS between_ends, CASE WHEN {rd('t', 6)} > 0.05 AND {rd('t', 6)} < 0.95 THEN {rd('t', 6)} END AS fraction FROM u")
def geo_along_track(spark, sf_dir):
    c = relation(spark, sf_dir, "sites").select((F.col("k") - 2).alias("k"), F.col("lat").alias("lat3"), F.col("lon").alias("lon3"))
    p = _pairs(spark, sf_dir).join(c, "k")
    t = r(g.along_track("lat3", "lon3", "lat", "lon", "lat2", "lon2"), 6)
    return p.select("slug", t.alias("t")).withColumn("between_ends", g.between_ends(F.col("t"))).withColumn("fraction", F.when(F.col("between_ends"), F.col("t")))


@query(f"WITH m AS (SELECT slug, lon * (20037508.342789244::DOUBLE / 180) AS x, ln(tan((90 + lat) * (pi() / 360))) * 6378137 AS y FROM {{sites}}) SELECT slug, {rd('x')} AS x, {rd('y')} AS y, {rd('degrees(2 * atan(exp(y / 6378137)) - pi() / 2)', 6)} AS lat, {rd('degrees(x / 6378137)', 6)} AS lon FROM m")
def geo_mercator(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    x, y = g.mercator("lat", "lon")
    lat, lon = g.mercator_inverse(x, y)
    return s.select("slug", r(x).alias("x"), r(y).alias("y"), r(lat, 6).alias("lat"), r(lon, 6).alias("lon"))


D = "(1000 + k % 60000) / 6378137.0::DOUBLE * (180 / pi())"
K = "greatest(cos(radians(lat)), 0.01::DOUBLE)"
BOX = f"box AS (SELECT slug, lat - {D} AS south, lat + {D} AS north, lon - {D} / {K} AS west, lon + {D} / {K} AS east FROM {{sites}})"


@query(f"WITH {BOX} SELECT slug, {rd('south', 6)} AS south, {rd('north', 6)} AS north, {rd('west', 6)} AS west, {rd('east', 6)} AS east, list_aggregate(list_sort(list_distinct(flatten([[concat(CASE WHEN la >= 0 THEN 'N' ELSE 'S' END, abs(la), CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(lo) AS VARCHAR), 3, '0')) FOR lo IN range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT) + 1)] FOR la IN range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT) + 1)]))), 'string_agg', ',') AS tiles FROM box")
def geo_tiles_of_radius(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    b = g.radius_bbox("lat", "lon", F.lit(1000.0) + F.col("k") % 60000)
    return s.select("slug", *[r(b[c], 6).alias(c) for c in b], F.array_join(g.tiles_of_bbox(b["south"], b["north"], b["west"], b["east"]), ",").alias("tiles"))


@query("SELECT name, CASE WHEN regexp_matches(name, '^[NS]\\d{2}[EW]\\d{3}$') THEN CAST(substr(name, 2, 2) AS INTEGER) * CASE substr(name, 1, 1) WHEN 'S' THEN -1 ELSE 1 END END AS south, CASE WHEN regexp_matches(name, '^[NS]\\d{2}[EW]\\d{3}$') THEN CAST(substr(name, 5, 3) AS INTEGER) * CASE substr(name, 4, 1) WHEN 'W' THEN -1 ELSE 1 END END AS west, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE k % 4 WHEN 0 THEN concat('N', CAST(floor(lat) AS INTEGER), 'W', CAST(-floor(lon) AS INTEGER)) WHEN 1 THEN concat('S0', k % 10, 'E0', 10 + k % 80) WHEN 2 THEN concat('N', k % 10, 'W120') ELSE slug END AS name FROM {sites}) GROUP BY name")
def geo_tile_corner(spark, sf_dir):
    k = F.col("k")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("N"), F.floor("lat").cast("int"), F.lit("W"), (-F.floor("lon")).cast("int")))
        .when(k % 4 == 1, F.concat(F.lit("S0"), k % 10, F.lit("E0"), 10 + k % 80))
        .when(k % 4 == 2, F.concat(F.lit("N"), k % 10, F.lit("W120")))
        .otherwise(F.col("slug"))
    )
    n = relation(spark, sf_dir, "sites").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    south, west = g.tile_corner("name")
    return n.select("name", south.alias("south"), west.alias("west"), "n")


Z = "(6 + k % 9)"
TX = "CAST(floor((lon + 180) / 360 * pow(2.0::DOUBLE, z)) AS BIGINT)"
TY = "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2.0::DOUBLE, z)) AS BIGINT)"


@query(f"WITH t AS (SELECT slug, k, z, {TX} AS x, {TY} AS y, pow(2.0::DOUBLE, z) AS n FROM (SELECT *, {Z} AS z FROM {{sites}})) SELECT slug, z, x, y, {rd('x / n * 360 - 180', 6)} AS west, {rd('(x + 1) / n * 360 - 180', 6)} AS east, {rd('degrees(atan((exp(pi() * (1 - 2 * y / n)) - exp(-pi() * (1 - 2 * y / n))) / 2))', 6)} AS north, {rd('degrees(atan((exp(pi() * (1 - 2 * (y + 1) / n)) - exp(-pi() * (1 - 2 * (y + 1) / n))) / 2))', 6)} AS south, {rd('degrees(atan((exp(pi() * (1 - 2 * (y + (k % 256 + 0.5::DOUBLE) / 256) / n)) - exp(-pi() * (1 - 2 * (y + (k % 256 + 0.5::DOUBLE) / 256) / n))) / 2))', 7)} AS pixel_lat, {rd('(x + (k % 256 + 0.5::DOUBLE) / 256) / n * 360 - 180', 7)} AS pixel_lon FROM t")
def geo_xyz_tiles(spark, sf_dir):
    import math

    s = relation(spark, sf_dir, "sites").withColumn("z", 6 + F.col("k") % 9)
    n = F.pow(F.lit(2.0), F.col("z"))
    phi = F.radians("lat")
    s = s.withColumn("x", F.floor((F.col("lon") + 180) / 360 * n)).withColumn("y", F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n))
    b, p = g.xyz_bounds("z", "x", "y"), g.xyz_pixel("z", "x", "y", F.col("k") % 256, F.col("k") % 256)
    return s.select("slug", "z", "x", "y", *[r(b[c], 6).alias(c) for c in b], r(p[0], 7).alias("pixel_lat"), r(p[1], 7).alias("pixel_lon"))


@query(f"SELECT slug, {rd('degrees(atan(size * 2 / 100.0::DOUBLE))', 6)} AS deg, {rd('tan(radians(size::DOUBLE)) * 100', 6)} AS pct, {rd('156543.0::DOUBLE * greatest(cos(radians(lat)), 0.2::DOUBLE) / pow(2.0::DOUBLE, size % 15)', 6)} AS m_per_px, {rd('greatest(least(111000.0::DOUBLE / 1200, 111000.0::DOUBLE / 1200 * greatest(cos(radians(lat)), 0.01::DOUBLE)), 1.0::DOUBLE)', 6)} AS step_m, CAST(ceil(elev_m * 20 / (111000.0::DOUBLE / 1200 * greatest(cos(radians(lat)), 0.01::DOUBLE))) + 2 AS INTEGER) AS cells, CAST(least(4096, greatest(128, ceil(elev_m * 30 / 30))) AS INTEGER) AS raster_px, CAST((elev_m + 32768)::INTEGER // 256 AS INTEGER) AS r, CAST((elev_m + 32768)::INTEGER % 256 AS INTEGER) AS g, elev_m AS back_m, 1.0::DOUBLE / 1200 AS spacing FROM {{peaks}}")
def geo_raster_scales(spark, sf_dir):
    p, one = relation(spark, sf_dir, "peaks"), F.lit(1.0) / 1200
    t = g.terrarium("elev_m")
    return p.select(
        "slug", r(g.grade_to_degrees(F.col("size") * 2), 6).alias("deg"), r(g.degrees_to_grade("size"), 6).alias("pct"), r(g.metres_per_pixel("lat", F.col("size") % 15), 6).alias("m_per_px"),
        r(g.native_step_m("lat", F.lit(1201)), 6).alias("step_m"), g.disc_cells(F.col("elev_m") * 20, one, "lat").alias("cells"), g.raster_size(F.col("elev_m") * 30).alias("raster_px"),
        t["r"].alias("r"), t["g"].alias("g"), g.terrarium_inverse(t["r"], t["g"], t["b"]).alias("back_m"), one.alias("spacing"),
    )


SEG_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((plon - lon_a) * c * (lon_b - lon_a) * c + (plat - lat_a) * (lat_b - lat_a)) / n))"


def _hav(la1: str, lo1: str, la2: str, lo2: str, rad: str = "6371000.0::DOUBLE") -> str:
    h = f"(sin(radians({la2} - ({la1})) / 2) * sin(radians({la2} - ({la1})) / 2) + cos(radians({la1})) * cos(radians({la2})) * sin(radians({lo2} - ({lo1})) / 2) * sin(radians({lo2} - ({lo1})) / 2))"
    return f"2 * {rad} * atan2(sqrt({h}), sqrt(1 - {h}))"


@query(f"WITH s AS (SELECT *, lat_a + 0.001::DOUBLE AS plat, lon_a + 0.0007::DOUBLE AS plon, cos(radians(lat_a)) AS c FROM {{segments}}), q AS (SELECT *, (lon_b - lon_a) * c * ((lon_b - lon_a) * c) + (lat_b - lat_a) * (lat_b - lat_a) AS n FROM s), t AS (SELECT *, CASE WHEN n > 0 THEN {SEG_T} ELSE 0 END AS t FROM q) SELECT route, ord, {rd('t', 6)} AS t, {rd(_hav('plat', 'plon', 'lat_a + t * (lat_b - lat_a)', 'lon_a + t * (lon_b - lon_a)'))} AS dist_m, {rd('least(' + ', '.join(_hav('plat', 'plon', f'lat_a + (lat_b - lat_a) * {u}', f'lon_a + (lon_b - lon_a) * {u}') for u in ('0.0::DOUBLE', '0.25::DOUBLE', '0.5::DOUBLE', '0.75::DOUBLE', '1.0::DOUBLE')) + ')')} AS sampled_m FROM t")
def geo_segment_distance(spark, sf_dir):
    s = relation(spark, sf_dir, "segments").withColumn("plat", F.col("lat_a") + 0.001).withColumn("plon", F.col("lon_a") + 0.0007)
    at = ("plat", "plon", "lat_a", "lon_a", "lat_b", "lon_b")
    p = g.segment_projection(*at)
    return s.select("route", "ord", r(p["t"], 6).alias("t"), r(p["dist_m"]).alias("dist_m"), r(g.sampled_segment_m(*at)).alias("sampled_m"))


@query("SELECT a.slug AS a, b.slug AS b, a.west <= b.east AND a.east >= b.west AND a.south <= b.north AND a.north >= b.south AS touch, a.west < b.east AND a.east > b.west AND a.south < b.north AND a.north > b.south AS overlap, "
       f"{rd('greatest(a.west, b.west)', 5)} AS west, {rd('least(a.east, b.east)', 5)} AS east, {rd('greatest(a.south, b.south)', 5)} AS south, {rd('least(a.north, b.north)', 5)} AS north, a.west - 0.125::DOUBLE >= -180 AS padded_ok "
       "FROM {parcels} a JOIN {parcels} b ON b.k = a.k + 4")
def geo_boxes(spark, sf_dir):
    p = relation(spark, sf_dir, "parcels")
    b = p.select((F.col("k") - 4).alias("k"), F.col("slug").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("west", "east", "south", "north")])
    j = p.join(b, "k")
    x, y = ({c: F.col(f"{c}{s}") for c in ("west", "east", "south", "north")} for s in ("", "2"))
    i = g.box_intersection(x, y)
    return j.select(F.col("slug").alias("a"), "b", g.boxes_touch(x, y).alias("touch"), g.boxes_touch(x, y, False).alias("overlap"), *[r(i[c], 5).alias(c) for c in i], (F.col("west") - 0.125 >= -180).alias("padded_ok"))


@query(f"WITH v AS (SELECT slug, lat, i, 2 * pi() / 64 * i AS t, (5000 + k % 20000) / 6371000.0::DOUBLE AS d, lon FROM {{sites}}, range(65) x(i)), w AS (SELECT slug, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(t)) AS p, lon, lat, t, d FROM v), u AS (SELECT slug, degrees(p) AS la, lon + degrees(atan2(sin(t) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(p))) AS lo FROM w) SELECT slug, count(*) AS n, {rd('min(la)', 6)} AS south, {rd('max(la)', 6)} AS north, {rd('min(lo)', 6)} AS west, {rd('max(lo)', 6)} AS east FROM u GROUP BY slug")
def geo_hop_disc(spark, sf_dir):
    ring = g.disc_ring("lat", "lon", F.lit(5000.0) + F.col("k") % 20000)
    s = relation(spark, sf_dir, "sites").select("slug", ring.alias("ring"))
    ext = lambda f, c: r(f(F.transform("ring", lambda v: v[c])), 6)
    return s.select("slug", F.size("ring").cast("long").alias("n"), ext(F.array_min, "lat").alias("south"), ext(F.array_max, "lat").alias("north"), ext(F.array_min, "lon").alias("west"), ext(F.array_max, "lon").alias("east"))


@query("SELECT slug, lat * (k % 4) BETWEEN -90 AND 90 AND lon * (1 + k % 2) BETWEEN -180 AND 180 AS ok, TRY_CAST(regexp_extract(txt, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*[, ]\\s*(-?\\d+(?:\\.\\d+)?)\\s*$', 1) AS DOUBLE) AS plat, TRY_CAST(regexp_extract(txt, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*[, ]\\s*(-?\\d+(?:\\.\\d+)?)\\s*$', 2) AS DOUBLE) AS plon FROM (SELECT *, CASE WHEN k % 3 = 0 THEN concat(' ', k % 90, '.5, -', k % 180) WHEN k % 3 = 1 THEN concat('x', k) ELSE concat(k % 60, ' ', k % 7) END AS txt FROM {sites})")
def geo_coordinates(spark, sf_dir):
    k = F.col("k")
    txt = F.when(k % 3 == 0, F.concat(F.lit(" "), k % 90, F.lit(".5, -"), k % 180)).when(k % 3 == 1, F.concat(F.lit("x"), k)).otherwise(F.concat(k % 60, F.lit(" "), k % 7))
    s = relation(spark, sf_dir, "sites").withColumn("txt", txt)
    la, lo = g.parse_lat_lon("txt")
    return s.select("slug", g.valid_coords(F.col("lat") * (k % 4), F.col("lon") * (1 + k % 2)).alias("ok"), la.alias("plat"), lo.alias("plon"))


T = "CASE WHEN hi <= -120 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v + 120) / (hi + 120))) END"


@query(f"WITH x AS (SELECT slug, -(k % 150)::DOUBLE AS v, -((k * 3) % 140)::DOUBLE AS hi FROM {{sites}}), y AS (SELECT slug, {T} AS t FROM x), z AS (SELECT slug, least(3, floor(t * 4)::INTEGER) AS s, t * 4 - least(3, floor(t * 4)::INTEGER) AS f FROM y) SELECT slug, " + ", ".join(f"CAST(floor({a}[s + 1] + ({a}[s + 2] - {a}[s + 1]) * f + 0.5) AS INTEGER) AS {c}" for c, a in (("r", "[13, 126, 204, 248, 240]"), ("g", "[8, 3, 71, 148, 249]"), ("b", "[135, 168, 120, 65, 33]"))) + " FROM z")
def geo_level_colour(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    c = g.plasma_rgb(-(F.col("k") % 150).cast("double"), F.lit(-120.0), -((F.col("k") * 3) % 140).cast("double"))
    return s.select("slug", *[c[x].alias(x) for x in "rgb"])


@query(f"SELECT slug, {rd('north - (k % 100 + 0.5::DOUBLE) / 100 * (north - south)', 6)} AS plat, {rd('west + (k % 70 + 0.5::DOUBLE) / 70 * (east - west)', 6)} AS plon, {rd('(north + south) / 2 + (0.25::DOUBLE * (east - west)) * sin(radians(k % 90)) + (-0.25::DOUBLE * (north - south)) * cos(radians(k % 90))', 6)} AS rot_lat, {rd('(east + west) / 2 + (0.25::DOUBLE * (east - west)) * cos(radians(k % 90)) - (-0.25::DOUBLE * (north - south)) * sin(radians(k % 90))', 6)} AS rot_lon FROM {{parcels}}")
def geo_raster_pixels(spark, sf_dir):
    p, box = relation(spark, sf_dir, "parcels"), ("north", "south", "east", "west")
    a = g.raster_pixel(F.col("k") % 70, F.col("k") % 100, F.lit(70), F.lit(100), *box)
    b = g.rotated_fraction(F.lit(0.75), F.lit(0.75), *box, F.col("k") % 90)
    return p.select("slug", r(a[0], 6).alias("plat"), r(a[1], 6).alias("plon"), r(b[0], 6).alias("rot_lat"), r(b[1], 6).alias("rot_lon"))
