"""Streams of requests and progress: throttling, boxes that cover what is asked for, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import progress
from .registry import query

GAP_MS = 3_600_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, event_type, CAST(event_id * 7919 % 400 AS BIGINT) AS x, CAST(event_id * 104729 % 400 AS BIGINT) AS y, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events)"


def _events(spark, sf_dir):
    e = progress.event_stream(spark, sf_dir)
    return e.select("event_id", "user_id", F.unix_millis("ts").alias("ms"), "event_type", (F.col("event_id") * 7919 % 400).alias("x"), (F.col("event_id") * 104729 % 400).alias("y"))


@query(f"WITH RECURSIVE {EV}, pass AS (SELECT user_id, event_id, ms, i, true AS first FROM ev WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.ms, n.i, false FROM (SELECT ev.*, row_number() OVER (PARTITION BY ev.user_id ORDER BY ev.i) AS turn FROM pass p JOIN ev ON ev.user_id = p.user_id AND ev.i > p.i AND ev.ms >= p.ms + {GAP_MS}) n WHERE turn = 1) SELECT event_id, user_id, ms, first FROM pass")
def stream_throttle(spark, sf_dir):
    """Progress of each user that is passed on, an hour apart at least."""
    out = progress.drain(progress.throttled(_events(spark, sf_dir), "user_id", "ms", GAP_MS, ["ms", "event_id"]))
    return out.select("event_id", "user_id", "ms", "first")


@query(f"WITH RECURSIVE {EV}, run AS (SELECT user_id, event_id, i, true AS built, x - 50 AS west, y - 50 AS south, x + 50 AS east, y + 50 AS north FROM ev WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, NOT (x BETWEEN west AND east AND y BETWEEN south AND north), CASE WHEN x BETWEEN west AND east AND y BETWEEN south AND north THEN west ELSE least(west, x - 50) END, CASE WHEN x BETWEEN west AND east AND y BETWEEN south AND north THEN south ELSE least(south, y - 50) END, CASE WHEN x BETWEEN west AND east AND y BETWEEN south AND north THEN east ELSE greatest(east, x + 50) END, CASE WHEN x BETWEEN west AND east AND y BETWEEN south AND north THEN north ELSE greatest(north, y + 50) END FROM run r JOIN ev e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT event_id, user_id, built, west, south, east, north FROM run")
def stream_covering_builds(spark, sf_dir):
    """Requests of each user against the box that was built for those before."""
    out = progress.drain(progress.covering_builds(_events(spark, sf_dir), "user_id", "x", "y", 50, ["ms", "event_id"]))
    return out.select("event_id", "user_id", "built", "west", "south", "east", "north")


@query(f"WITH {EV} SELECT event_id, user_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY i) = event_type, false) AS warm FROM ev")
def stream_recomputes(spark, sf_dir):
    """Whether each user's fingerprint is the one before."""
    out = progress.drain(progress.recomputes(_events(spark, sf_dir), "user_id", "event_type", ["ms", "event_id"]))
    return out.select("event_id", "user_id", "warm")
