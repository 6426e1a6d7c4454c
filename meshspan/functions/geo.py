"""Geodesy, tiles and raster geometry as Column expressions.

Angles are degrees unless a name says otherwise.  Radio paths use the WGS84
equatorial radius, ground travel the mean radius; the two are kept apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R_RADIO = 6_378_137.0
R_GROUND = 6_371_000.0
M_PER_DEG = 111_000.0
MERCATOR_EDGE = 20037508.342789244


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding that other engines reproduce exactly."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def haversine_m(lat1, lon1, lat2, lon2, radius: float = R_RADIO) -> Column:
    la1, lo1, la2, lo2 = map(lit, (lat1, lon1, lat2, lon2))
    dp, dl = F.radians(la2 - la1) / 2, F.radians(lo2 - lo1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.sin(dl) * F.sin(dl)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin_m(lat1, lon1, lat2, lon2, radius: float = R_GROUND) -> Column:
    la1, lo1, la2, lo2 = map(lit, (lat1, lon1, lat2, lon2))
    dp, dl = F.radians(la2 - la1) / 2, F.radians(lo2 - lo1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.sin(dl) * F.sin(dl)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_rad(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in (-pi, pi]."""
    la1, lo1, la2, lo2 = map(lit, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(la1), F.radians(la2), F.radians(lo2 - lo1)
    return F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    d = F.degrees(bearing_rad(lat1, lon1, lat2, lon2))
    return F.when(d < 0, d + 360).otherwise(d)


def angle_between_deg(a, b) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    d = F.pmod(lit(a) - lit(b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def destination(lat, lon, bearing, distance, radius: float = R_RADIO) -> tuple[Column, Column]:
    """Latitude and longitude reached along a great circle; ``bearing`` in radians."""
    p, t, d = F.radians(lit(lat)), lit(bearing), lit(distance) / radius
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    l2 = F.radians(lit(lon)) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.degrees(l2)


def midpoint(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """The middle of the great circle's shorter arc."""
    p1, p2, o1, d = F.radians(lit(lat1)), F.radians(lit(lat2)), F.radians(lit(lon1)), F.radians(lit(lon2) - lit(lon1))
    bx, by = F.cos(p2) * F.cos(d), F.cos(p2) * F.sin(d)
    lat = F.atan2(F.sin(p1) + F.sin(p2), F.sqrt((F.cos(p1) + bx) * (F.cos(p1) + bx) + by * by))
    return F.degrees(lat), F.degrees(o1 + F.atan2(by, F.cos(p1) + bx))


def along_track(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """Projection of a point on A-B as a share of A-B, in local metres; null if A and B are within a metre."""
    la, lo, a1, o1, a2, o2 = map(lit, (lat, lon, lat_a, lon_a, lat_b, lon_b))
    k = F.cos(F.radians((a1 + a2) / 2))
    bx, by = (o2 - o1) * k * M_PER_DEG, (a2 - a1) * M_PER_DEG
    px, py = (lo - o1) * k * M_PER_DEG, (la - a1) * M_PER_DEG
    n = bx * bx + by * by
    return F.when(n >= 1, (px * bx + py * by) / n)


def between_ends(t: Column) -> Column:
    return F.coalesce((t > 0.05) & (t < 0.95), F.lit(False))


def mercator(lat, lon) -> tuple[Column, Column]:
    x = lit(lon) * (MERCATOR_EDGE / 180)
    y = F.ln(F.tan((90 + lit(lat)) * (math.pi / 360))) * (R_RADIO)
    return x, y


def mercator_inverse(x, y) -> tuple[Column, Column]:
    lat = F.degrees(2 * F.atan(F.exp(lit(y) / R_RADIO)) - math.pi / 2)
    return lat, F.degrees(lit(x) / R_RADIO)


def radius_bbox(lat, lon, radius_m) -> dict[str, Column]:
    d = lit(radius_m) / R_RADIO * (180 / math.pi)
    k = F.greatest(F.cos(F.radians(lit(lat))), F.lit(0.01))
    return {"south": lit(lat) - d, "north": lit(lat) + d, "west": lit(lon) - d / k, "east": lit(lon) + d / k}


def tile_name(lat_tile, lon_tile) -> Column:
    la, lo = lit(lat_tile).cast("int"), lit(lon_tile).cast("int")
    ns, ew = F.when(la >= 0, "N").otherwise("S"), F.when(lo >= 0, "E").otherwise("W")
    return F.concat(ns, F.abs(la).cast("string"), ew, F.lpad(F.abs(lo).cast("string"), 3, "0"))


def tiles_of_bbox(south, north, west, east) -> Column:
    """Names of the one-degree tiles that a box touches, sorted."""
    f = lambda c: F.floor(lit(c)).cast("int")
    names = F.flatten(F.transform(F.sequence(f(south), f(north)), lambda la: F.transform(F.sequence(f(west), f(east)), lambda lo: tile_name(la, lo))))
    return F.array_sort(F.array_distinct(names))


def tile_corner(name) -> tuple[Column, Column]:
    """South-west corner of a tile name; null if the name is malformed."""
    n = lit(name)
    la = F.regexp_extract(n, r"^([NS])(\d{2})([EW])(\d{3})$", 2)
    lo = F.regexp_extract(n, r"^([NS])(\d{2})([EW])(\d{3})$", 4)
    ok = la != ""
    sign = lambda c, neg: F.when(c == neg, -1).otherwise(1)
    return (
        F.when(ok, la.try_cast("int") * sign(F.substring(n, 1, 1), "S")),
        F.when(ok, lo.try_cast("int") * sign(F.substring(n, 4, 1), "W")),
    )


def xyz_bounds(z, x, y) -> dict[str, Column]:
    n = F.pow(F.lit(2.0), lit(z))
    lat = lambda r: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * r / n))))
    lon = lambda c: c / n * 360 - 180
    return {"west": lon(lit(x)), "east": lon(lit(x) + 1), "north": lat(lit(y)), "south": lat(lit(y) + 1)}


def xyz_pixel(z, x, y, px, py, size: int = 256) -> tuple[Column, Column]:
    """Latitude and longitude of a tile pixel's centre."""
    n = F.pow(F.lit(2.0), lit(z))
    fx, fy = lit(x) + (lit(px) + 0.5) / size, lit(y) + (lit(py) + 0.5) / size
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * fy / n)))), fx / n * 360 - 180


def raster_pixel(px, py, w, h, north, south, east, west) -> tuple[Column, Column]:
    u, v = (lit(px) + 0.5) / lit(w), (lit(py) + 0.5) / lit(h)
    return lit(north) - v * (lit(north) - lit(south)), lit(west) + u * (lit(east) - lit(west))


def rotated_fraction(u, v, north, south, east, west, rotation_deg) -> tuple[Column, Column]:
    """A point at fractions (u, v) of a box turned about its centre, counter-clockwise."""
    cx, cy = (lit(east) + lit(west)) / 2, (lit(north) + lit(south)) / 2
    dx, dy = (lit(u) - 0.5) * (lit(east) - lit(west)), (0.5 - lit(v)) * (lit(north) - lit(south))
    c, s = F.cos(F.radians(lit(rotation_deg))), F.sin(F.radians(lit(rotation_deg)))
    return cy + dx * s + dy * c, cx + dx * c - dy * s


def grade_to_degrees(pct) -> Column:
    return F.degrees(F.atan(lit(pct) / 100))


def degrees_to_grade(deg) -> Column:
    return F.tan(F.radians(lit(deg))) * 100


def metres_per_pixel(lat, zoom) -> Column:
    return 156543.0 * F.greatest(F.cos(F.radians(lit(lat))), F.lit(0.2)) / F.pow(F.lit(2.0), lit(zoom))


def native_step_m(lat, n) -> Column:
    """Terrain spacing in metres: the smaller of both axes, at least one; 30 where n is null."""
    d = M_PER_DEG / (lit(n) - 1)
    step = F.greatest(F.least(d, d * F.greatest(F.cos(F.radians(lit(lat))), F.lit(0.01))), F.lit(1.0))
    return F.coalesce(step, F.lit(30.0))


def disc_cells(radius_m, spacing_deg, lat) -> Column:
    k = F.greatest(F.cos(F.radians(lit(lat))), F.lit(0.01))
    return (F.ceil(lit(radius_m) / (lit(spacing_deg) * M_PER_DEG * k)) + 2).cast("int")


def raster_size(radius_m) -> Column:
    return F.least(F.lit(4096), F.greatest(F.lit(128), F.ceil(lit(radius_m) / 30).cast("int")))


def terrarium(elev) -> dict[str, Column]:
    v = (lit(elev) + 32768).cast("int")
    return {"r": F.shiftrightunsigned(v, 8).bitwiseAND(255), "g": v.bitwiseAND(255), "b": F.lit(0)}


def terrarium_inverse(r, g, b) -> Column:
    return lit(r) * 256 + lit(g) + lit(b) / 256 - 32768


def disc_ring(lat, lon, radius_m, steps: int = 64) -> Column:
    """A closed ring of ``steps`` + 1 vertices (lat, lon) on the ground sphere, first vertex north."""

    def vertex(i):
        la, lo = destination(lat, lon, i.cast("double") * (2 * math.pi / steps), radius_m, R_GROUND)
        return F.struct(la.alias("lat"), lo.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)


def segment_projection(lat, lon, lat_a, lon_a, lat_b, lon_b) -> dict[str, Column]:
    """The nearest point of a short segment and its distance, in a plane scaled at A's latitude."""
    la, lo, a1, o1, a2, o2 = map(lit, (lat, lon, lat_a, lon_a, lat_b, lon_b))
    k = F.cos(F.radians(a1))
    bx, by = (o2 - o1) * k, a2 - a1
    n = bx * bx + by * by
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lo - o1) * k * bx + (la - a1) * by) / n))).otherwise(F.lit(0.0))
    pla, plo = a1 + t * (a2 - a1), o1 + t * (o2 - o1)
    return {"t": t, "lat": pla, "lon": plo, "dist_m": haversine_m(la, lo, pla, plo, R_GROUND)}


def sampled_segment_m(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """The least distance to five points of a segment: an upper bound of the true one."""
    a1, o1, a2, o2 = map(lit, (lat_a, lon_a, lat_b, lon_b))
    return F.least(*[haversine_m(lat, lon, a1 + (a2 - a1) * t, o1 + (o2 - o1) * t, R_GROUND) for t in (0.0, 0.25, 0.5, 0.75, 1.0)])


def boxes_touch(a: dict[str, Column], b: dict[str, Column], inclusive: bool = True) -> Column:
    """Overlap of boxes; land counts touching edges, raster merging does not."""
    if inclusive:
        return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])
    return (a["west"] < b["east"]) & (a["east"] > b["west"]) & (a["south"] < b["north"]) & (a["north"] > b["south"])


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """May be inverted where boxes are apart."""
    return {"west": F.greatest(a["west"], b["west"]), "south": F.greatest(a["south"], b["south"]), "east": F.least(a["east"], b["east"]), "north": F.least(a["north"], b["north"])}


def valid_coords(lat, lon) -> Column:
    return F.coalesce(lit(lat).between(-90, 90) & lit(lon).between(-180, 180), F.lit(False))


def parse_lat_lon(text) -> tuple[Column, Column]:
    """"lat, lon" text to two doubles, null if it is anything else."""
    p = r"^\s*(-?\d+(?:\.\d+)?)\s*[, ]\s*(-?\d+(?:\.\d+)?)\s*$"
    return F.regexp_extract(lit(text), p, 1).try_cast("double"), F.regexp_extract(lit(text), p, 2).try_cast("double")


#: fixed values: the five stops of the plasma ramp
PLASMA = ((13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 148, 65), (240, 249, 33))


def plasma_rgb(value, low, high) -> dict[str, Column]:
    """Colour of a level in dBm; a range that is empty or inverted gives the middle."""
    t = F.when(lit(high) <= lit(low), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lit(value) - lit(low)) / (lit(high) - lit(low)))))
    seg = F.least(F.lit(3), F.floor(t * 4).cast("int"))
    f = t * 4 - seg
    out = {}
    for i, name in enumerate("rgb"):
        lo = F.element_at(F.array(*[F.lit(float(c[i])) for c in PLASMA]), seg + 1)
        hi = F.element_at(F.array(*[F.lit(float(c[i])) for c in PLASMA]), seg + 2)
        out[name] = F.floor(lo + (hi - lo) * f + 0.5).cast("int")
    return out


def corridor_ring(lat1, lon1, lat2, lon2, half_m: float) -> Column:
    """The closed ring of a strip ``half_m`` to each side of the way between two points: left side forth, right side back."""
    named = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  evaluated once, however often used
    d = haversine_m(lat1, lon1, lat2, lon2, R_GROUND)
    way = F.struct(d.alias("d"), bearing_rad(lat1, lon1, lat2, lon2).alias("t"), F.greatest(F.ceil(d / max(half_m, 5000.0)), F.lit(1)).alias("n"))

    def points(w: Column) -> Column:
        def mid(i: Column) -> Column:
            la, lo = destination(lat1, lon1, w["t"], i.cast("double") / w["n"] * w["d"], R_GROUND)
            return F.struct(la.alias("lat"), lo.alias("lon"))

        def side(m: Column, turn: float) -> Column:
            la, lo = destination(m["lat"], m["lon"], w["t"] + turn * math.pi / 2, half_m, R_GROUND)
            return F.struct(lo.alias("lon"), la.alias("lat"))

        both = F.transform(F.transform(F.sequence(F.lit(0).cast("long"), w["n"]), mid), lambda m: F.struct(side(m, -1).alias("left"), side(m, 1).alias("right")))
        return named(both, lambda b: F.concat(b["left"], F.reverse(b["right"]), F.slice(b["left"], 1, 1)))

    return named(way, points)


def sector_bbox(lat, lon, goal_lat, goal_lon, min_m: float, max_m: float, half_deg: float, steps: int = 24) -> dict[str, Column]:
    """The box of a ring sector towards a goal, by points on its two arcs, and of its centre."""
    t = bearing_rad(lat, lon, goal_lat, goal_lon)
    points = [destination(lat, lon, t + math.radians(-half_deg + i * 2 * half_deg / steps), m) for i in range(steps + 1) for m in (max(min_m, 1.0), max_m)]
    las, los = [lit(lat), *[p[0] for p in points]], [lit(lon), *[p[1] for p in points]]
    return {"west": F.least(*los), "south": F.least(*las), "east": F.greatest(*los), "north": F.greatest(*las)}


def view_bin_m(south, north, west, east, across: int, least_m: float, most_m: float) -> Column:
    """Whole metres of a bin such that ``across`` of them span a view, within bounds."""
    wide = F.abs(lit(east) - lit(west)) * 111_320 * F.cos(F.radians((lit(south) + lit(north)) / 2))
    return F.floor(F.greatest(F.lit(least_m), F.least(F.lit(most_m), wide / across)) + 0.5)


def resampled(segments, step_m: float, both_ends: bool):
    """Segments (lat_a, lon_a, lat_b, lon_b) as samples i of n, at most ``step_m`` apart: lat, lon; the first end only with ``both_ends``."""
    n = F.greatest(F.ceil(rounded(haversine_m("lat_a", "lon_a", "lat_b", "lon_b", R_GROUND), 3) / step_m), F.lit(1))
    first = F.lit(0 if both_ends else 1).cast("long")
    s = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(first, F.col("n"))))
    at = lambda c: F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("i") / F.col("n")
    return s.withColumn("lat", at("lat")).withColumn("lon", at("lon"))
