"""Queries on what is kept: indexes, caches, options chosen, sites promoted, tiles and documents written."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions import rf
from ..functions import text as t
from ..operators import greedy, grid_join, terrain, viewshed
from ..sources import files
from ..sources.derived import duck_height, relation, tile_blocks, tile_rows, tile_sampler
from ..sources.shared import shared_path
from .access import road_starts
from .geodesy import _hav, r, rd
from .links import LINK, STEP_M
from .registry import query

# --- choosing among options ---------------------------------------------------------------------------------------

OPTIONS = "SELECT l_orderkey AS site, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS i, l_quantity AS bushwhack, l_discount * 100 AS trail, l_extendedprice AS jeep, l_returnflag = 'N' AS recommended FROM lineitem"


def _options(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("site"), F.row_number().over(w).cast("long").alias("i"), F.col("l_quantity").alias("bushwhack"), (F.col("l_discount") * 100).alias("trail"), F.col("l_extendedprice").alias("jeep"), (F.col("l_returnflag") == "N").alias("recommended"))


@query(f"WITH o AS ({OPTIONS}) SELECT site, i, bushwhack FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY bushwhack, trail + bushwhack, jeep, i) AS n FROM o) WHERE n = 1")
def best_candidates(spark, sf_dir):
    """The candidate with the least bushwhacking, then the least walking, then the least driving."""
    key = F.struct("bushwhack", (F.col("trail") + F.col("bushwhack")).alias("walk"), "jeep", "i")
    m = _options(spark, sf_dir).groupBy("site").agg(F.min(key).alias("m"))
    return m.select("site", "m.i", "m.bushwhack")


@query(f"WITH o AS ({OPTIONS}), k AS (SELECT *, min(bushwhack) OVER (PARTITION BY site) AS least FROM o), f AS (SELECT * FROM k WHERE bushwhack <= least + 4), h AS (SELECT *, bool_or(recommended) OVER (PARTITION BY site) AS has, row_number() OVER (PARTITION BY site ORDER BY i) AS n FROM f) SELECT site, i, CASE WHEN has THEN recommended ELSE n = 1 END AS recommended FROM h")
def late_stops(spark, sf_dir):
    """Options without early stops: walks at most a little longer than the least, one of them recommended."""
    w = Window.partitionBy("site")
    f = _options(spark, sf_dir).withColumn("least", F.min("bushwhack").over(w)).filter("bushwhack <= least + 4")
    first = F.row_number().over(w.orderBy("i")) == 1
    return f.select("site", "i", F.when(F.max("recommended").over(w), F.col("recommended")).otherwise(first).alias("recommended"))


@query(f"WITH o AS ({OPTIONS}), c AS (SELECT site, site % 9 AS choice, arg_min(i, i) FILTER (WHERE recommended) AS rec, min(i) AS first, list(i) AS ids FROM o GROUP BY site) SELECT site, CASE WHEN list_contains(ids, choice) THEN choice ELSE coalesce(rec, first) END AS shown FROM c")
def display_routes(spark, sf_dir):
    """The option shown: the one chosen if it is still there, else the recommended one, else the first."""
    o = _options(spark, sf_dir)
    c = o.groupBy("site").agg(F.min(F.when(F.col("recommended"), F.col("i"))).alias("rec"), F.min("i").alias("first"), F.collect_list("i").alias("ids"))
    choice = F.col("site") % 9
    return c.select("site", F.when(F.array_contains("ids", choice), choice).otherwise(F.coalesce("rec", "first")).alias("shown"))


def gentlest_hikes(spark, sf_dir):
    """For each peak the gentlest of the walks from roads near it, paved parking preferred where it is not much worse.

    The comparison is not transitive, so walks are folded in order of their
    distance, as they are found.
    """
    p = relation(spark, sf_dir, "peaks").filter("eligible").select("slug", "lat", "lon")
    s = road_starts(spark, sf_dir).select("route", "ord", "r_lat", "r_lon", F.col("asphalt").alias("paved"))
    # Walks are those of a place; heights are read once a place or start, not once a pair.
    at, z = ["lat", "lon"], tile_sampler(spark)
    places = z(p.select(*at).distinct(), "lat", "lon", "zp")
    n = grid_join.within(z(s, "r_lat", "r_lon", "zr"), places, 2500.0, ("r_lat", "r_lon"), ("lat", "lon"), spread=True)
    rise = F.col("zp") - F.col("zr")
    n = n.select(*at, "route", "ord", "paved", r(F.col("dist_m"), 2).alias("len_m"), r(F.degrees(F.atan2(F.abs(rise), "dist_m")), 3).alias("slope"), r(F.greatest(rise, F.lit(0.0)), 2).alias("gain"), r(F.greatest(-rise, F.lit(0.0)), 2).alias("loss"))
    return p.join(greedy.fold_hikes(n, at, ["len_m", "route", "ord"]), at).select("slug", "route", "ord", "paved", "slope")


# --- indexes and caches -------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT p_partkey AS k, p_brand AS prefs, p_size AS gen, p_name AS name FROM part), newest AS (SELECT arg_max(prefs, (gen, prefs)) AS prefs FROM p) SELECT k, name, gen FROM p JOIN newest USING (prefs)")
def latest_peaks_index(spark, sf_dir):
    """Indexes written by preference key, and the newest of them read."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("prefs"), F.col("p_size").alias("gen"), F.col("p_name").alias("name"))
    path = shared_path(spark, "index")
    p.write.partitionBy("prefs").parquet(path)  # a folder for each key; a rewrite replaces it whole
    kept = spark.read.parquet(path)
    newest = kept.agg(F.max(F.struct("gen", F.col("prefs").cast("string").alias("prefs"))).alias("m")).select(F.col("m.prefs").alias("prefs"))
    return kept.withColumn("prefs", F.col("prefs").cast("string")).join(F.broadcast(newest), "prefs").select("k", "name", "gen")  # one row


@query("WITH c AS (SELECT o_orderkey AS k, sha256(concat(o_orderstatus, '|', o_orderpriority)) AS digest FROM orders), built AS (SELECT digest, min(k) AS built_by FROM c GROUP BY digest) SELECT c.k, c.k = built_by AS miss, built_by FROM c JOIN built USING (digest)")
def memo_table(spark, sf_dir):
    """Values built once for each digest of their inputs: the first asker builds, the others find."""
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), t.digest(["o_orderstatus", "o_orderpriority"], None).alias("digest"))
    built = c.groupBy("digest").agg(F.min("k").alias("built_by"))
    return c.join(built, "digest").select("k", (F.col("k") == F.col("built_by")).alias("miss"), "built_by")


@query(f"WITH have AS (SELECT k, slug, lat, lon, height_m FROM {{sites}} WHERE seg <> 'BUILDING'), want AS (SELECT k, slug, lat + ((k % 3) - 1) * 0.000001 AS lat, lon, height_m FROM {{sites}}) SELECT w.slug, min(h.slug) AS reused FROM want w LEFT JOIN have h ON abs(w.lat - h.lat) <= 0.0000015 AND abs(w.lon - h.lon) <= 0.0000015 AND w.height_m = h.height_m GROUP BY w.slug")
def coordinate_noise(spark, sf_dir):
    """Rasters that serve a request whose place differs by rounding only."""
    s = relation(spark, sf_dir, "sites")
    have = s.filter("seg <> 'BUILDING'").select(F.col("slug").alias("h_slug"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), "height_m")
    want = s.select("slug", (F.col("lat") + ((F.col("k") % 3) - 1) * 0.000001).alias("lat"), "lon", "height_m")
    step = 0.0001
    cell = lambda c: F.floor(F.col(c) / step)
    h = have.withColumn("cy", cell("h_lat")).withColumn("cx", cell("h_lon"))
    w = want.withColumn("cy", F.explode(F.array_distinct(F.array(*[F.floor((F.col("lat") + d) / step) for d in (-0.0000015, 0.0000015)])))).withColumn("cx", F.explode(F.array_distinct(F.array(*[F.floor((F.col("lon") + d) / step) for d in (-0.0000015, 0.0000015)]))))
    near = (F.abs(F.col("lat") - F.col("h_lat")) <= 0.0000015) & (F.abs(F.col("lon") - F.col("h_lon")) <= 0.0000015)
    hit = w.join(h, ["cy", "cx", "height_m"]).filter(near).groupBy("slug").agg(F.min("h_slug").alias("reused"))
    return want.select("slug").join(hit, "slug", "left")


@query("WITH j AS (SELECT event_id AS id, user_id AS slug, event_type AS phase, ts FROM events), last AS (SELECT slug, arg_max(phase, (ts, id)) AS phase, count(*) AS updates FROM j GROUP BY slug), ask AS (SELECT DISTINCT c_custkey AS slug FROM customer) SELECT ask.slug, CASE WHEN l.slug IS NULL THEN 'idle' WHEN phase = 'purchase' THEN 'done' ELSE 'pending' END AS state, coalesce(updates, 0) AS updates FROM ask LEFT JOIN last l ON l.slug = ask.slug")
def scan_states(spark, sf_dir):
    """What a poll answers for each asker: nothing running, still running, or an outcome."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.groupBy(F.col("user_id").alias("slug")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"), F.count("*").alias("updates"))
    ask = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("slug")).distinct()
    state = F.when(F.col("phase").isNull(), "idle").when(F.col("phase") == "purchase", "done").otherwise("pending")
    return ask.join(last, "slug", "left").select("slug", state.alias("state"), F.coalesce("updates", F.lit(0)).alias("updates"))


@query("SELECT seg, sha256(string_agg(concat('{\"slug\":\"', slug, '\",\"lat\":', CAST(CAST(lat * 1000000 AS BIGINT) AS VARCHAR), ',\"h\":', CAST(CAST(height_m AS BIGINT) AS VARCHAR), '}'), ',' ORDER BY slug)) AS fingerprint, count(*) AS n FROM {sites} GROUP BY seg")
def links_fingerprints(spark, sf_dir):
    """A digest of the settings and sites that stored links depend on."""
    s = relation(spark, sf_dir, "sites").withColumn("lat", F.round(F.col("lat") * 1_000_000).cast("long")).withColumn("h", F.col("height_m").cast("long"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("slug", "lat", "h"))), lambda x: t.canonical_json(x))
    return s.groupBy("seg").agg(F.sha2(F.array_join(rows, ","), 256).alias("fingerprint"), F.count("*").alias("n"))


# --- sites made from peaks and routes -----------------------------------------------------------------------------


@query("WITH have AS (SELECT DISTINCT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS slug FROM nation), new AS (SELECT p_partkey AS k, (SELECT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) FROM nation WHERE n_nationkey = p_partkey % 25) AS base FROM part), n AS (SELECT k, base, row_number() OVER (PARTITION BY base ORDER BY k) AS i, base IN (SELECT slug FROM have) AS taken FROM new) SELECT k, CASE WHEN NOT taken AND i = 1 THEN base ELSE concat(base, '-', i + CASE WHEN taken THEN 1 ELSE 0 END) END AS slug FROM n")
def promoted_peaks(spark, sf_dir):
    """Slugs of peaks that become sites: the name's, numbered on where it is taken already."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    have = n.select(t.slug(F.regexp_replace("n_name", "[^A-Za-z0-9]", "")).alias("base"), F.lit(1).alias("taken")).distinct()
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 25).cast("int").alias("nk"))
    new = p.join(n.select(F.col("n_nationkey").alias("nk"), t.slug(F.regexp_replace("n_name", "[^A-Za-z0-9]", "")).alias("base")), "nk").join(have, "base", "left")
    i = F.row_number().over(Window.partitionBy("base").orderBy("k")) + F.coalesce("taken", F.lit(0))
    return new.select("k", F.when(i == 1, F.col("base")).otherwise(F.concat_ws("-", "base", i)).alias("slug"))


# --- tiles and lines ----------------------------------------------------------------------------------------------


@query(f"WITH p AS (SELECT slug, (lon + 180) / 360 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y FROM {{sites}}) SELECT CAST(z AS INTEGER) AS z, CAST(floor(x * pow(2, z)) AS BIGINT) AS tx, CAST(floor(y * pow(2, z)) AS BIGINT) AS ty, count(*) AS n FROM p, range(4, 13) t(z) GROUP BY ALL")
def tile_pyramid(spark, sf_dir):
    """How many sites each map tile of zooms 4 to 12 holds."""
    s = relation(spark, sf_dir, "sites").withColumn("z", F.explode(F.sequence(F.lit(4), F.lit(12))))
    size = F.pow(F.lit(2.0), F.col("z"))
    y = (1 - F.ln(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / math.pi) / 2
    return s.groupBy("z", F.floor((F.col("lon") + 180) / 360 * size).alias("tx"), F.floor(y * size).alias("ty")).agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT route, ord, {rd('lat', 6)} AS lat, {rd('lon', 6)} AS lon FROM {{waypoints}}), s AS (SELECT *, lag(lat) OVER v AS plat, lag(lon) OVER v AS plon FROM w WINDOW v AS (PARTITION BY route ORDER BY ord)) SELECT concat('r', route) AS name, count(*) AS vertices, {rd('sum(lat)', 3)} AS lat_sum FROM s WHERE plat IS NULL OR {_hav('plat', 'plon', 'lat', 'lon')} >= 50 GROUP BY route HAVING count(*) >= 2")
def routes_from_kml(spark, sf_dir):
    """Routes written as KML lines, read again, and cut to vertices 50 m or more from the one before."""
    w = relation(spark, sf_dir, "waypoints")
    path = shared_path(spark, "routes")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("ord", r(F.col("lon"), 6).alias("lon"), r(F.col("lat"), 6).alias("lat")))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    lines = w.groupBy("route").agg(pts.alias("pts")).select((F.col("route") % 16).alias("part"), files.line_placemark(F.concat(F.lit("r"), "route"), F.col("pts")).alias("mark"))
    lines.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("mark")), "").alias("body")).select(files.kml_document(F.col("body"))).write.text(path)
    k = files.read_kml(spark, path).filter("kind = 'line'")
    v = Window.partitionBy("name").orderBy("ord")
    step = g.haversine_m(F.lag("lat").over(v), F.lag("lon").over(v), "lat", "lon", g.R_GROUND)
    kept = k.withColumn("step", step).filter("step is null or step >= 50")
    return kept.groupBy("name").agg(F.count("*").alias("vertices"), r(F.sum("lat"), 3).alias("lat_sum")).filter("vertices >= 2")


@query(f"WITH way AS (SELECT route AS way, ord AS pos, route * 100 + ord AS ref, part FROM {{waypoints}}), node AS (SELECT route * 100 + ord AS id, lat, lon FROM {{waypoints}}), e AS (SELECT way, pos, ref, lead(ref) OVER (PARTITION BY way ORDER BY pos) AS nxt FROM way) SELECT way, count(*) AS edges, {rd('sum(' + _hav('a.lat', 'a.lon', 'b.lat', 'b.lon') + ')', 1)} AS length_m FROM e JOIN node a ON a.id = ref JOIN node b ON b.id = nxt WHERE b.lat BETWEEN 36.5 AND 39 AND a.lat BETWEEN 36.5 AND 39 GROUP BY way")
def ways_to_edges(spark, sf_dir):
    """Ways as lists of node references become edges; nodes outside the box are not loaded."""
    w = relation(spark, sf_dir, "waypoints")
    node = w.select((F.col("route") * 100 + F.col("ord")).alias("id"), "lat", "lon").filter("lat between 36.5 and 39")
    ways = w.groupBy(F.col("route").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord"))), lambda x: F.col("route") * 100 + x["ord"]).alias("refs"))
    e = files.way_edges(ways, node, "way", "refs")
    return e.groupBy("way").agg(F.count("*").alias("edges"), r(F.sum(g.haversine_m("lat_a", "lon_a", "lat_b", "lon_b", g.R_GROUND)), 1).alias("length_m"))


@query("SELECT k, CASE WHEN k % 4 = 0 THEN concat('Peak ', k) ELSE concat('Alt ', k) END AS name, elev_m, 'gnis' AS source FROM (SELECT *, lat AS la FROM {peaks}) WHERE la BETWEEN 37 AND 39 AND lon BETWEEN -118 AND -116")
def gnis_candidates(spark, sf_dir):
    """Named summits out of feature files whose fields differ in name: place, height and name from the first field that has one."""
    p = relation(spark, sf_dir, "peaks")
    k = F.col("k")
    props = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("k"), k.cast("string")), F.struct(F.when(k % 4 == 0, "feature_name").otherwise("name"), F.when(k % 4 == 0, F.concat(F.lit("Peak "), k)).otherwise(F.concat(F.lit("Alt "), k))),
        F.struct(F.when(k % 3 == 0, "elev_in_m").otherwise("elevation"), F.col("elev_m").cast("string")), F.struct(F.lit("prim_lat_dec"), F.col("lat").cast("string")), F.struct(F.lit("prim_long_dec"), F.col("lon").cast("string")),
    ), lambda x: x["col1"].isNotNull()))
    path = shared_path(spark, "gnis")
    at = F.when(k % 2 == 0, F.array("lon", "lat"))
    files.write_geojson(p, path, "Point", F.coalesce(at, F.array(F.lit(0.0), F.lit(0.0))), props)
    out = files.gnis_candidates(files.read_geojson(spark, path), 37.0, 39.0, -118.0, -116.0)
    return out.select(F.col("k").cast("long").alias("k"), "name", "elev_m", F.lit("gnis").alias("source"))


@query(f"WITH ring AS (SELECT d, i, 360.0::DOUBLE * i / (8 * d) AS b FROM (VALUES (1), (2), (3)) x(d), range(24) y(i) WHERE i < 8 * d), c AS (SELECT slug, d, i, degrees(asin(sin(radians(lat)) * cos(d * 60.0 / 6371000) + cos(radians(lat)) * sin(d * 60.0 / 6371000) * cos(radians(b)))) AS la, b, lat, lon FROM {{peaks}}, ring), q AS (SELECT slug, d, i, la, lon + degrees(atan2(sin(radians(b)) * sin(d * 60.0 / 6371000) * cos(radians(lat)), cos(d * 60.0 / 6371000) - sin(radians(lat)) * sin(radians(la)))) AS lo FROM c UNION ALL SELECT slug, 0, 0, lat, lon FROM {{peaks}}), z AS (SELECT *, {duck_height('la', 'lo')} AS z FROM q) SELECT slug, {rd('max(z)', 3)} AS elev_m FROM z WHERE z > 0 GROUP BY slug")
def summit_snaps(spark, sf_dir):
    """The highest ground of the rings around each peak, 60 m apart up to 180 m."""
    p = relation(spark, sf_dir, "peaks").select("slug", "lat", "lon")
    s = terrain.ring_snap(p, tile_sampler(spark), "slug", 180.0, 60.0)
    return s.select("slug", r(F.col("elev_m"), 3).alias("elev_m"))


def summit_climbs(spark, sf_dir):
    """The local summit that walking uphill from each peak in steps of 60 m ends on, within 600 m."""
    p = relation(spark, sf_dir, "peaks").select("slug", "lat", "lon")
    s = viewshed.climb(p, tile_blocks(spark), "slug", 600.0, 60.0)
    return s.select("slug", r(F.col("elev_m"), 3).alias("elev_m"))


def linkable_peaks(spark, sf_dir):
    """For each site the highest peaks of 5 km bins within 25 km that would hear it both ways, highest first."""
    cells = tile_rows(spark).select("tile_lat", "tile_lon", "n", "iy", F.posexplode("elev").alias("ix", "z"))
    top = terrain.cell_centre(terrain.local_maxima(cells, 20.0)).select(F.col("z").cast("double").alias("elev_m"), "lat", "lon")
    s = relation(spark, sf_dir, "sites").select("slug", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("height_m").alias("a_h"))
    near = grid_join.within(top, s, 25_000.0, ("lat", "lon"), ("a_lat", "a_lon"))
    x, y = g.mercator("lat", "lon")
    near = near.withColumn("bx", F.floor(x / 5000)).withColumn("by", F.floor(y / 5000))
    best = near.groupBy("slug", "bx", "by").agg(F.min(F.struct((-F.col("elev_m")).alias("k"), "lon", "lat", "dist_m", "a_lat", "a_lon", "a_h")).alias("m"))
    p = best.select("slug", (-F.col("m.k")).alias("elev_m"), F.col("m.lat").alias("b_lat"), F.col("m.lon").alias("b_lon"), "m.dist_m", "m.a_lat", "m.a_lon", "m.a_h", F.lit(6.0).alias("b_h"))
    m = terrain.evaluate_pairs(p, tile_blocks(spark), LINK, F.lit(STEP_M), ["slug", "elev_m", "b_lat", "b_lon"], ("a_h", "b_h"))
    ok = m.filter("forward is not null and reverse is not null")
    return ok.select("slug", "elev_m", r(F.col("b_lat"), 6).alias("lat"), r(F.col("b_lon"), 6).alias("lon"), r(F.least("forward", "reverse"), 3).alias("margin_db"))


@query("SELECT k, floor(sqrt(pow(z1, 2) + pow(z2, 2)) * 2.375 * 1000 + 0.5) / 1000 AS margin_db FROM (SELECT k, [1.281551565545, 1.644853626951, 2.326347874041, 0.0, -0.674489750196][CAST(k % 5 AS BIGINT) + 1] AS z1, [1.281551565545, 1.644853626951, 2.326347874041, 0.0, -0.674489750196][CAST(k // 5 % 5 AS BIGINT) + 1] AS z2 FROM {sites})")
def reliability_margins(spark, sf_dir):
    """Fade margins of percentages that rows carry."""
    pct = F.array(*[F.lit(float(x)) for x in (90, 95, 99, 50, 25)])
    k = F.col("k")
    at = lambda i: F.element_at(pct, (i % 5 + 1).cast("int"))
    return relation(spark, sf_dir, "sites").select("k", r(rf.reliability_margin(at(k), at(F.floor(k / 5)))).alias("margin_db"))


for _f in (gentlest_hikes, summit_climbs, linkable_peaks):
    query()(_f)
