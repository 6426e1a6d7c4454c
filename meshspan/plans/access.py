"""Road and access queries: roles, rules, costs, difficulty, budgets, nearest roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions import roads as rd_
from ..operators import grid_join
from ..sources.derived import duck_height, relation, tile_sampler
from ..sources.shared import kept
from .geodesy import _hav, r, rd
from .registry import query

PAVED = "coalesce(surface IN ('paved', 'asphalt', 'concrete', 'chipseal', 'tarmac'), false)"
DRIVE = "highway IN (" + ", ".join(f"'{x}'" for x in rd_.DRIVABLE) + ")"
ROLE = f"CASE WHEN access = 'private' THEN 'private' WHEN {DRIVE} THEN CASE WHEN {PAVED} THEN 'paved' ELSE 'jeep' END WHEN highway IN ('foot', 'path', 'cycleway', 'bridleway') THEN 'hiking' ELSE 'other' END"
MULT = """(CASE WHEN highway IN ('motorway', 'trunk', 'primary') THEN 0.8::DOUBLE WHEN highway IN ('secondary', 'tertiary') THEN 0.9 WHEN highway IN ('unclassified', 'residential') THEN 1.0 WHEN highway = 'service' THEN 1.2
WHEN highway = 'track' THEN CASE WHEN fourwd THEN 8 WHEN tracktype = 'grade5' THEN 10 WHEN tracktype = 'grade4' THEN 8 WHEN tracktype = 'grade3' THEN 4 WHEN tracktype = 'grade2' THEN 2.5 WHEN tracktype = 'grade1' THEN 1.5 ELSE 3 END ELSE 2.0 END * CASE WHEN surface IN ('paved', 'asphalt', 'concrete') THEN 0.85::DOUBLE ELSE 1.0 END)"""
JEEP_RANK = "CASE WHEN tracktype = 'grade5' THEN 3 WHEN tracktype IN ('grade3', 'grade4') THEN 2 WHEN tracktype = 'grade2' THEN 1 WHEN highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') THEN 0 WHEN highway IN ('residential', 'unclassified') AND coalesce(tracktype = 'grade1', false) THEN 0 ELSE 1 END"
LEN = _hav("lat_a", "lon_a", "lat_b", "lon_b")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "segments").withColumn("length_m", g.haversine_m("lat_a", "lon_a", "lat_b", "lon_b", g.R_GROUND))


def road_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where segments begin: route, ord, r_lat, r_lon, role, asphalt."""

    def build():
        s = relation(spark, sf_dir, "segments")
        return s.select("route", "ord", F.col("lat_a").alias("r_lat"), F.col("lon_a").alias("r_lon"), rd_.default_role("highway", "surface", "access").alias("role"), F.coalesce(F.col("surface") == "asphalt", F.lit(False)).alias("asphalt"))

    return kept(spark, f"road starts of {sf_dir}", build)


def road_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where segments begin: r_lat, r_lon and n, how many."""
    return kept(spark, f"road places of {sf_dir}", lambda: road_starts(spark, sf_dir).groupBy("r_lat", "r_lon").agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT route, ord, {ROLE} AS role, {PAVED} AS paved, coalesce(surface IN ('unpaved', 'gravel', 'fine_gravel', 'compacted', 'dirt', 'ground', 'sand', 'mud', 'grass', 'earth'), false) AS unpaved, highway IN ('track', 'unclassified', 'service') AND (highway <> 'track' OR fourwd OR NOT (coalesce(tracktype IN ('grade1', 'grade2'), false) OR coalesce(surface = 'paved', false))) AS jeep_road, CASE WHEN highway IN ('track', 'footway', 'path', 'steps', 'service', 'bridleway') THEN false WHEN coalesce(surface IN ('gravel', 'dirt'), false) THEN false WHEN {PAVED} THEN highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') ELSE highway IN ('motorway', 'trunk', 'primary', 'secondary') END AS anchor, {rd(LEN)} AS length_m, {rd(LEN + ' * ' + MULT)} AS cost FROM {{segments}}")
def road_classes(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select(
        "route", "ord", rd_.default_role("highway", "surface", "access").alias("role"), rd_.is_paved_surface("surface").alias("paved"), rd_.is_unpaved_surface("surface").alias("unpaved"),
        rd_.is_jeep_highway("highway", "tracktype", "surface", "fourwd", ("track", "unclassified", "service")).alias("jeep_road"), rd_.is_paved_anchor("highway", "surface").alias("anchor"),
        r(F.col("length_m")).alias("length_m"), r(F.col("length_m") * rd_.cost_multiplier("highway", "tracktype", "surface", "fourwd")).alias("cost"),
    )


#: ordered rules: (index, kind, surface, access, role)
RULES = ((1, "track", None, None, "jeep"), (2, None, "paved", None, "paved"), (3, "service", None, "private", "other"), (4, None, None, None, "hiking"), (5, "path", "gravel", None, "hiking"))
_q = lambda v: "NULL" if v is None else f"'{v}'"


@query("WITH rules(i, kind, srf, acc, role) AS (VALUES " + ", ".join(f"({i}, {_q(a)}, {_q(b)}, {_q(c)}, '{d}')" for i, a, b, c, d in RULES) + f"), d AS (SELECT route, ord, {ROLE} AS base, highway, surface, access, {PAVED} AS paved FROM {{segments}}), m AS (SELECT d.route, d.ord, arg_max(rules.role, i) AS role FROM d JOIN rules ON (kind IS NULL OR kind = highway) AND (srf IS NULL OR CASE WHEN srf = 'paved' THEN paved ELSE coalesce(srf = surface, false) END) AND (acc IS NULL OR acc = access) AND (kind IS NOT NULL OR srf IS NOT NULL OR acc IS NOT NULL) GROUP BY 1, 2) SELECT route, ord, coalesce(role, base) AS role FROM d LEFT JOIN m USING (route, ord)")
def road_rules(spark, sf_dir):
    rules = spark.createDataFrame(list(RULES), "i int, m_kind string, m_surface string, m_access string, r_role string")
    s = relation(spark, sf_dir, "segments").withColumn("base", rd_.default_role("highway", "surface", "access"))
    hit = rd_.rule_matches({"kind": F.col("m_kind"), "surface": F.col("m_surface"), "access": F.col("m_access")}, {"kind": F.col("highway"), "surface": F.col("surface"), "access": F.col("access")})
    last = s.join(F.broadcast(rules), hit).groupBy("route", "ord").agg(F.max_by("r_role", "i").alias("rule"))  # a handful of rules
    return s.join(last, ["route", "ord"], "left").select("route", "ord", F.coalesce("rule", "base").alias("role"))


RUNS = f"b AS (SELECT *, {LEN} AS len, concat(highway, '/', coalesce(tracktype, '')) AS cls FROM {{segments}}), c AS (SELECT *, CASE WHEN lag(cls) OVER w = cls THEN 0 ELSE 1 END AS brk FROM b WINDOW w AS (PARTITION BY route ORDER BY ord)), d AS (SELECT *, sum(brk) OVER (PARTITION BY route ORDER BY ord) AS run FROM c), e AS (SELECT route, run, any_value(highway) AS highway, any_value(tracktype) AS tracktype, {rd('sum(len)')} AS dist_m FROM d GROUP BY route, run), f AS (SELECT *, sum(dist_m) OVER (PARTITION BY route) AS total FROM e), q AS (SELECT *, {JEEP_RANK} AS rank FROM f WHERE total < 80 OR dist_m >= greatest(total * 0.02, 40))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive segments of one class as one: route, run, highway, tracktype, dist_m."""
    w = Window.partitionBy("route").orderBy("ord")
    cls = F.concat_ws("/", "highway", F.coalesce("tracktype", F.lit("")))
    s = segments(spark, sf_dir).withColumn("cls", cls).withColumn("brk", F.when(F.lag("cls").over(w) == F.col("cls"), 0).otherwise(1)).withColumn("run", F.sum("brk").over(w))
    return s.groupBy("route", "run", "highway", "tracktype").agg(r(F.sum("length_m")).alias("dist_m"))


@query(f"WITH {RUNS} SELECT route, run, highway, tracktype, dist_m FROM e")
def jeep_runs(spark, sf_dir):
    return runs(spark, sf_dir)


def qualifying(df: DataFrame) -> DataFrame:
    total = F.sum("dist_m").over(Window.partitionBy("route"))
    q = df.withColumn("total", total).filter((F.col("total") < 80) | (F.col("dist_m") >= F.greatest(F.col("total") * 0.02, F.lit(40.0))))
    return q.withColumn("rank", rd_.jeep_rank("highway", "tracktype"))


@query(f"WITH {RUNS}, w AS (SELECT route, max(rank) AS rank FROM q GROUP BY route), y AS (SELECT q.route, highway, coalesce(tracktype, '') AS tt, {rd('sum(dist_m)')} AS m FROM q JOIN w ON q.route = w.route AND q.rank = w.rank GROUP BY 1, 2, 3), z AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY m DESC, highway, tt) AS n FROM y) SELECT route, ['easy', 'medium', 'difficult', 'extreme'][rank + 1] AS difficulty, trim(concat(highway, ' ', tt)) AS reason, m AS reason_m FROM z JOIN w USING (route) WHERE n = 1")
def jeep_difficulty(spark, sf_dir):
    q = qualifying(runs(spark, sf_dir))
    q = q.withColumn("worst", F.max("rank").over(Window.partitionBy("route"))).filter("rank = worst").withColumn("tt", F.coalesce("tracktype", F.lit("")))
    y = q.groupBy("route", "worst", "highway", "tt").agg(r(F.sum("dist_m")).alias("m"))
    top = y.groupBy("route", "worst").agg(F.min(F.struct((-F.col("m")).alias("k"), "highway", "tt")).alias("b"))
    return top.select("route", rd_.label_of("worst").alias("difficulty"), F.btrim(F.concat_ws(" ", "b.highway", "b.tt")).alias("reason"), (-F.col("b.k")).alias("reason_m"))


KEY = "coalesce(tracktype, CASE WHEN highway IN ('unclassified', 'track') THEN 'grade5' ELSE highway END)"


@query(f"WITH u AS (SELECT route, {KEY} AS cls, {rd(f'sum({LEN})')} AS used FROM {{segments}} GROUP BY 1, 2), o AS (SELECT *, 300 + 100 * length(cls) AS cap FROM u), p AS (SELECT *, greatest(used - cap, 0.0::DOUBLE) AS over_by, row_number() OVER (PARTITION BY route ORDER BY used / cap DESC, cls) AS n FROM o), t AS (SELECT route, sum(used) AS total FROM u GROUP BY route) SELECT route, cls, {rd('used')} AS used_m, CAST(cap AS BIGINT) AS cap_m, {rd('over_by')} AS over_m, CASE WHEN {rd('total')} > 1200 OR over_by > 0.000000001 THEN 'jeep' ELSE 'pass' END AS verdict FROM p JOIN t USING (route) WHERE n = 1")
def jeep_budget(spark, sf_dir):
    u = segments(spark, sf_dir).groupBy("route", rd_.budget_class("highway", "tracktype").alias("cls")).agg(r(F.sum("length_m")).alias("used"))
    u = u.withColumn("cap", 300 + 100 * F.length("cls")).withColumn("total", F.sum("used").over(Window.partitionBy("route")))
    w = Window.partitionBy("route").orderBy((F.col("used") / F.col("cap")).desc(), "cls")
    p = u.withColumn("n", F.row_number().over(w)).filter("n = 1").withColumn("over_by", F.greatest(F.col("used") - F.col("cap"), F.lit(0.0)))
    verdict = F.when((r(F.col("total")) > 1200) | (F.col("over_by") > 1e-9), rd_.drop_reason(F.col("over_by"), F.col("total") - 1200, F.lit(0.0), F.lit(0.0))).otherwise("pass")
    return p.select("route", "cls", r(F.col("used")).alias("used_m"), F.col("cap").cast("long").alias("cap_m"), r(F.col("over_by")).alias("over_m"), verdict.alias("verdict"))


HIKE = f"WITH w AS (SELECT route, ord, lat, lon, {duck_height('lat', 'lon')} AS z FROM {{waypoints}}), s AS (SELECT *, lead(lat) OVER x AS lat2, lead(lon) OVER x AS lon2, lead(z) OVER x AS z2 FROM w WINDOW x AS (PARTITION BY route ORDER BY ord)), e AS (SELECT route, ord, {_hav('lat', 'lon', 'lat2', 'lon2')} AS h, z2 - z AS v FROM s WHERE lat2 IS NOT NULL), f AS (SELECT *, abs(v) / h * 100 AS grade, sqrt(h * h + v * v) AS d FROM e WHERE h > 0.5), a AS (SELECT route, sum(d) AS len3, sum(h) AS horiz, sum(greatest(v, 0)) AS gain, sum(greatest(-v, 0)) AS loss, max(grade) AS top, sum(grade * h) / sum(h) AS avg_grade, sum(h + 4 * greatest(v, 0) + 8 * greatest(-v, 0)) AS cost FROM f GROUP BY route)"


def hike_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between waypoints over terrain: horizontal and vertical metres, grade in percent, slope length; half-metre legs left out."""
    w = Window.partitionBy("route").orderBy("ord")
    p = tile_sampler(spark)(relation(spark, sf_dir, "waypoints"), "lat", "lon", "z")
    for c in ("lat", "lon", "z"):
        p = p.withColumn(f"{c}2", F.lead(c).over(w))
    p = p.filter("lat2 is not null").withColumn("h", g.haversine_m("lat", "lon", "lat2", "lon2", g.R_GROUND)).withColumn("v", F.col("z2") - F.col("z")).filter("h > 0.5")
    return p.withColumn("grade", F.abs("v") / F.col("h") * 100).withColumn("d", F.sqrt(F.col("h") * F.col("h") + F.col("v") * F.col("v")))


@query(HIKE + f", b AS (SELECT route, {rd('len3', 2)} AS length_m, {rd('gain', 2)} AS gain_m, {rd('loss', 2)} AS loss_m, {rd('top', 3)} AS max_grade, {rd('avg_grade', 3)} AS avg_grade, {rd('cost', 2)} AS cost FROM a) SELECT *, {rd('degrees(atan(max_grade / 100))', 4)} AS max_slope_deg, CASE WHEN gain_m >= 250 AND avg_grade >= 18 THEN 'extreme' WHEN gain_m >= 80 AND avg_grade >= 15 THEN 'difficult' WHEN max_grade >= 15 OR avg_grade >= 8 OR gain_m >= 40 THEN 'medium' ELSE 'easy' END AS difficulty, degrees(atan(max_grade / 100)) <= 26.6 + 0.5 AS passes FROM b")
def hike_profiles(spark, sf_dir):
    v = F.col("v")
    a = hike_edges(spark, sf_dir).groupBy("route").agg(
        r(F.sum("d"), 2).alias("length_m"), r(F.sum(F.greatest(v, F.lit(0.0))), 2).alias("gain_m"), r(F.sum(F.greatest(-v, F.lit(0.0))), 2).alias("loss_m"),
        r(F.max("grade")).alias("max_grade"), r(F.sum(F.col("grade") * F.col("h")) / F.sum("h")).alias("avg_grade"), r(F.sum(rd_.hike_edge_cost("h", "v")), 2).alias("cost"),
    )
    deg = g.grade_to_degrees("max_grade")
    return a.withColumn("max_slope_deg", r(deg, 4)).withColumn("difficulty", rd_.hike_difficulty("max_grade", "avg_grade", "gain_m")).withColumn("passes", deg <= 27.1)


EDGES = (0, 5, 10, 15, 20, 30, 45)


@query(HIKE + ", g AS (SELECT route, d, CASE WHEN grade < 5 THEN 0 WHEN grade < 10 THEN 5 WHEN grade < 15 THEN 10 WHEN grade < 20 THEN 15 WHEN grade < 30 THEN 20 WHEN grade < 45 THEN 30 ELSE 45 END AS low FROM f) SELECT route, CAST(low AS INTEGER) AS low_pct, " + rd("sum(d)", 2) + " AS dist_m, " + rd("sum(d) / any_value(t.total) * 100", 2) + " AS share_pct FROM g JOIN (SELECT route, sum(d) AS total FROM g GROUP BY route) t USING (route) GROUP BY route, low HAVING " + rd("sum(d)", 2) + " > 0.5")
def grade_histogram(spark, sf_dir):
    e = hike_edges(spark, sf_dir).withColumn("low_pct", F.greatest(*[F.when(F.col("grade") >= x, x).otherwise(0) for x in EDGES]).cast("int"))
    e = e.groupBy("route", "low_pct").agg(F.sum("d").alias("d")).withColumn("total", F.sum("d").over(Window.partitionBy("route")))
    return e.select("route", "low_pct", r(F.col("d"), 2).alias("dist_m"), r(F.col("d") / F.col("total") * 100, 2).alias("share_pct")).filter("dist_m > 0.5")


@query(f"WITH n AS (SELECT p.slug, s.route, s.ord, {rd(_hav('p.lat', 'p.lon', 's.lat_a', 's.lon_a', '6378137.0::DOUBLE'), 2)} AS d, {ROLE} AS role FROM {{peaks}} p JOIN {{segments}} s ON abs(p.lat - s.lat_a) < 0.05 AND abs(p.lon - s.lon_a) < 0.06 WHERE p.eligible), m AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY d, route, ord) AS i FROM n WHERE d <= 2500) SELECT slug, route, ord, d AS dist_m, role, CASE WHEN role = 'paved' THEN CASE WHEN d > 5 THEN 'hike_only' ELSE 'neither' END WHEN d > 5 THEN 'both' ELSE 'jeep_only' END AS mode FROM m WHERE i = 1")
def access_nearest_road(spark, sf_dir):
    p = relation(spark, sf_dir, "peaks").filter("eligible").select("slug", "lat", "lon")
    best = grid_join.nearest_of_places(p, road_starts(spark, sf_dir), (300.0, 900.0, 2500.0), ["route", "ord", "role"])
    return p.join(best, ["lat", "lon"]).select("slug", "route", "ord", "dist_m", "role").withColumn("mode", rd_.access_mode(F.col("role") == "paved", "dist_m"))


@query(f"WITH l AS (SELECT p_partkey AS k, ['easy', 'medium', 'difficult', 'extreme', '', NULL][p_size % 6 + 1] AS hike, ['easy', 'medium', 'difficult', 'extreme', '', NULL][p_partkey % 6 + 1] AS jeep, p_retailprice AS price, p_size AS size FROM part), m AS (SELECT *, nullif(hike, '') AS h, nullif(jeep, '') AS j FROM l) SELECT k, CASE WHEN h IS NOT NULL AND j IS NOT NULL THEN ['easy', 'medium', 'difficult', 'extreme'][greatest(CASE h WHEN 'extreme' THEN 3 WHEN 'difficult' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, CASE j WHEN 'extreme' THEN 3 WHEN 'difficult' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) + 1] ELSE coalesce(h, j) END AS difficulty, {rd('price * 1.0 + size * 0.5 + 100 * 0.1 + CASE h WHEN ' + repr('extreme') + ' THEN 3 WHEN ' + repr('difficult') + ' THEN 2 WHEN ' + repr('medium') + ' THEN 1 ELSE 0 END * 500.0', 3)} AS score, CASE WHEN size > 40 THEN 'jeep' WHEN size > 20 THEN 'hike' WHEN size > 10 THEN 'slope' ELSE 'jeep' END AS reason, CASE WHEN regexp_extract(jeep || size::VARCHAR, '(\\d+)', 1) <> '' THEN concat('grade', regexp_extract(jeep || size::VARCHAR, '(\\d+)', 1)) END AS tracktype FROM m")
def access_scores(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in ("easy", "medium", "difficult", "extreme", "", None)])
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice", F.element_at(labels, F.col("p_size") % 6 + 1).alias("hike"), F.element_at(labels, (F.col("p_partkey") % 6 + 1).cast("int")).alias("jeep"))
    size = F.col("p_size")
    over = lambda n: (size - n).cast("double")
    return p.select(
        "k", rd_.access_difficulty("hike", "jeep").alias("difficulty"), r(rd_.preference_score("p_retailprice", F.col("p_size"), F.lit(100.0), rd_.rank_of("hike"))).alias("score"),
        rd_.drop_reason(over(40), F.lit(0.0), over(20), over(10)).alias("reason"), rd_.tracktype_of_grade(F.concat("jeep", size)).alias("tracktype"),
    )
