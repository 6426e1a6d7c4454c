"""Queries on names, tags, digests, dates, caches and their upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.derived import relation
from .geodesy import r
from .registry import query

NAME = "CASE k % 5 WHEN 0 THEN concat(' Site ', name) WHEN 1 THEN concat('_', seg, '__x ', k) WHEN 2 THEN concat('Relay ', k) WHEN 3 THEN '   ' ELSE concat(slug, '-', seg, '_') END"


def _named(spark, sf_dir):
    k = F.col("k")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit(" Site "), "name")).when(k % 5 == 1, F.concat(F.lit("_"), "seg", F.lit("__x "), k))
        .when(k % 5 == 2, F.concat(F.lit("Relay "), k)).when(k % 5 == 3, F.lit("   ")).otherwise(F.concat("slug", F.lit("-"), "seg", F.lit("_")))
    )
    return relation(spark, sf_dir, "sites").withColumn("nm", name)


def _rx(c, p, to):
    return f"regexp_replace({c}, '{p}', '{to}', 'g')"


SLUG = _rx(_rx("lower(" + _rx("trim(nm)", "[^A-Za-z0-9_-]", "") + ")", "^_+", ""), "_+", "_")
SLUG = _rx(_rx(_rx(SLUG, "-_", "-"), "_", "-"), "-+$", "")


@query(f"WITH n AS (SELECT *, {NAME} AS nm FROM {{sites}}), s AS (SELECT *, {SLUG} AS sl FROM n), u AS (SELECT *, CASE WHEN sl = '' THEN 'site' ELSE sl END AS base FROM s) SELECT k, base, CASE WHEN row_number() OVER w = 1 THEN base ELSE concat(base, '-', row_number() OVER w) END AS place, TRY_CAST(nullif(regexp_extract(nm, '^Relay (\\d+)$', 1), '') AS INTEGER) AS number FROM u WINDOW w AS (PARTITION BY base ORDER BY k)")
def names_to_slugs(spark, sf_dir):
    n = _named(spark, sf_dir).withColumn("base", t.slug("nm"))
    i = F.row_number().over(Window.partitionBy("base").orderBy("k"))
    return n.select("k", "base", F.when(i == 1, F.col("base")).otherwise(F.concat_ws("-", "base", i)).alias("place"), t.name_number("nm", "Relay").alias("number"))


@query("SELECT k, sha256(concat('v8|', slug, '|', seg, '|', nation)) AS versioned, sha256(concat(slug, '|', seg)) AS stable, concat('event: ', seg, chr(10), 'data: ', slug, chr(10), chr(10)) AS event FROM {sites}")
def digests(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    return s.select("k", t.digest(["slug", "seg", "nation"]).alias("versioned"), t.digest(["slug", "seg"], None).alias("stable"), t.sse_event("seg", "slug").alias("event"))


@query("WITH a AS (SELECT k, slug, lower(trim(seg)) AS t1, concat('n', nation) AS t2, CASE WHEN k % 3 = 0 THEN 'hub' ELSE 'node' END AS t3 FROM {sites}) SELECT k, concat_ws(',', t1, t2, t3) AS tags, t3 = 'hub' AND t2 NOT IN ('n3', 'n4') AS passes, t3 = 'hub' AND t1 = 'building' AS all_of FROM a")
def tag_filters(spark, sf_dir):
    k = F.col("k")
    raw = F.array(F.concat(F.lit(" "), "seg", F.lit(" ")), F.concat(F.lit("N"), "nation"), F.when(k % 3 == 0, "hub").otherwise("node"), F.lit("Hub").substr(1, 0), F.lower("seg"))
    s = relation(spark, sf_dir, "sites").select("k", t.normal_tags(raw).alias("tags"))
    every = F.size(F.array_intersect("tags", F.array(F.lit("hub"), F.lit("building")))) == 2
    return s.select("k", F.array_join("tags", ",").alias("tags"), t.tags_pass(F.col("tags"), ["hub"], ["n3", "n4"]).alias("passes"), every.alias("all_of"))


@query("WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS tags FROM orders GROUP BY 1), p AS (SELECT a.k, a.tags AS x, b.tags AS y FROM a JOIN a b ON b.k = a.k + 1) SELECT k, array_to_string(CASE WHEN len(list_intersect(x, y)) > 0 THEN list_sort(list_intersect(x, y)) ELSE list_append(list_sort(list_distinct(list_concat(x, y))), 'union-fallback') END, ',') AS tags FROM p")
def relay_tags(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("x"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("x").alias("y"))
    both = t.relay_tags(F.array_sort("x"), F.array_sort("y"))
    # The mark sorts after all priorities, which begin with a digit.
    return a.join(b, "k").select("k", F.array_join(F.array_sort(both), ",").alias("tags"))


AUDIT = "CASE WHEN NOT ex THEN 'missing' WHEN NOT valid THEN 'invalid' WHEN last IS NULL THEN 'unknown' WHEN DATE '1998-01-01' > last + iv THEN 'stale' WHEN coalesce(fd > last, false) THEN 'file_newer' ELSE 'ok' END"


@query(f"WITH s AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS ex, o_orderkey % 7 <> 0 AS valid, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS last, CAST(30 + o_orderkey % 400 AS INTEGER) AS iv, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INTEGER) AS fd FROM orders) SELECT k, {AUDIT} AS status, CAST(last + iv AS DATE) AS next_due, strftime(last, '%Y-%m-%d') AS last_text, date_diff('day', DATE '1970-01-01', last) AS last_days FROM s")
def source_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("k"), (k % 11 != 0).alias("ex"), (k % 7 != 0).alias("valid"), F.when(k % 5 != 0, day).alias("last"), (30 + k % 400).cast("int").alias("iv"), F.date_add(day, (k % 3 - 1).cast("int")).alias("fd")
    )
    return s.select("k", t.audit_status("ex", "valid", "last", "iv", "fd", F.lit("1998-01-01").cast("date")).alias("status"), F.date_add("last", F.col("iv")).alias("next_due"), F.date_format("last", "yyyy-MM-dd").alias("last_text"), F.unix_date("last").cast("long").alias("last_days"))


@query("WITH c AS (SELECT user_id AS prefs, event_id AS dir, ts AS mtime, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) SELECT prefs, dir, rank, rank > 2 AS stale, rank = 1 AS latest FROM c")
def cache_ranks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    rank = F.row_number().over(w).cast("long")
    return e.select(F.col("user_id").alias("prefs"), F.col("event_id").alias("dir"), rank.alias("rank"), (rank > 2).alias("stale"), (rank == 1).alias("latest"))


@query("WITH old AS (SELECT o_orderkey AS pair, o_orderstatus AS fp, o_totalprice AS margin, o_orderkey % 9 = 0 AS manual FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS pair, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS fp, o_totalprice + 1 AS margin FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(n.pair, o.pair) AS pair, coalesce(n.fp, o.fp) AS fp, floor(CASE WHEN n.pair IS NULL OR n.fp = o.fp THEN o.margin ELSE n.margin END * 100 + 0.5) / 100 AS margin, coalesce(o.manual, false) AS manual, CASE WHEN n.pair IS NULL THEN 'gone' WHEN n.fp = o.fp THEN 'hit' ELSE 'miss' END AS state FROM new n FULL JOIN old o ON n.pair = o.pair")
def pair_cache(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    old = o.filter(k % 3 != 0).select(k.alias("pair"), F.col("o_orderstatus").alias("ofp"), F.col("o_totalprice").alias("om"), (k % 9 == 0).alias("manual"))
    new = o.filter(k % 5 != 0).select(k.alias("pair"), F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("nfp"), (F.col("o_totalprice") + 1).alias("nm"))
    j = new.join(old, "pair", "full")
    state = F.when(F.col("nfp").isNull(), "gone").when(F.col("nfp") == F.col("ofp"), "hit").otherwise("miss")
    return j.select("pair", F.coalesce("nfp", "ofp").alias("fp"), r(F.when(state == "miss", F.col("nm")).otherwise(F.col("om")), 2).alias("margin"), F.coalesce("manual", F.lit(False)).alias("manual"), state.alias("state"))


@query("SELECT op, count(*) AS n, count(CASE WHEN kind = 'hit' THEN 1 END) AS hits, floor(avg(value) * 1000 + 0.5) / 1000 AS mean FROM (SELECT event_type AS op, CASE WHEN event_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS kind, value FROM events) GROUP BY op")
def hit_ledger(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("hits"), r(F.avg("value")).alias("mean"))


@query("SELECT name, array_to_string(list_transform(regexp_extract_all(lower(name), '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 12, '0') ELSE x END), '') AS sort_key, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(name), '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 12, '0') ELSE x END), ''), k) AS position FROM (SELECT k, concat('Ridge ', k % 120, 'b') AS name FROM {sites})")
def names_in_order(spark, sf_dir):
    s = relation(spark, sf_dir, "sites").select("k", F.concat(F.lit("Ridge "), F.col("k") % 120, F.lit("b")).alias("name")).withColumn("sort_key", t.natural_key("name"))
    return s.select("name", "sort_key", F.row_number().over(Window.orderBy("sort_key", "k")).cast("long").alias("position"))


@query("WITH b AS (SELECT n_nationkey AS node, 5 + n_nationkey % 20 AS radius_km, n_nationkey % 6 = 0 AS gone FROM nation) SELECT slug, CAST(least(100, greatest(1, coalesce(radius_km, 15))) AS BIGINT) AS radius_km, floor(greatest(coalesce(height_m, 2.0), 1.0) * 10 + 0.5) / 10 AS height_m FROM {sites} s LEFT JOIN b ON b.node = s.nation WHERE NOT coalesce(gone, false)")
def fleet_sites(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("nation"), (5 + F.col("n_nationkey") % 20).alias("radius_km"), (F.col("n_nationkey") % 6 == 0).alias("gone"))
    s = relation(spark, sf_dir, "sites").join(n, "nation", "left").filter(~F.coalesce("gone", F.lit(False)))
    return s.select("slug", F.least(F.lit(100), F.greatest(F.lit(1), F.coalesce("radius_km", F.lit(15)))).cast("long").alias("radius_km"), r(F.greatest(F.coalesce("height_m", F.lit(2.0)), F.lit(1.0)), 1).alias("height_m"))


@query("SELECT s.slug, CASE WHEN k % 17 = 0 THEN 'manual_hidden' WHEN k % 13 = 0 THEN 'manual_shown' WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'shown' ELSE 'hidden' END AS visibility FROM {sites} s")
def site_visibility(spark, sf_dir):
    s = relation(spark, sf_dir, "sites")
    k = F.col("k")
    hidden, shown = s.filter(k % 17 == 0).select("slug", F.lit(True).alias("h")), s.filter(k % 13 == 0).select("slug", F.lit(True).alias("v"))
    j = s.join(hidden, "slug", "left").join(shown, "slug", "left")
    tag = F.arrays_overlap(F.array("seg"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    return j.select("slug", F.when(F.col("h"), "manual_hidden").when(F.col("v"), "manual_shown").when(tag, "shown").otherwise("hidden").alias("visibility"))
