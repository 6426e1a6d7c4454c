"""Link profiles a block at a time against one sample after the other."""

import math
import random

from pyspark.sql import functions as F

from meshspan.operators import terrain
from meshspan.sources.derived import dem_rows

R, N = 6_378_137.0, 121
LINK = {"freq_mhz": 911.525, "eirp_chain": 27.0, "fresnel": 0.6, "clutter": 1.0, "max_range_m": 14_000.0, "threshold_dbm": -124.0}


def node(i, j):
    return 300 + abs((i * 7) % 240 - 120) * 3 + abs((j * 11) % 300 - 150) * 2


def ground(la, lo):
    """Bilinear height on the one tile there is; 0 elsewhere."""
    if math.floor(la) != 37 or math.floor(lo) != -117:
        return 0.0
    fx, fy = (lo + 117) * (N - 1), (38 - la) * (N - 1)
    x, y = math.floor(fx), math.floor(fy)
    z = lambda dy, dx: node((37 + 91) * (N - 1) - y - dy, (-117 + 180) * (N - 1) + x + dx)
    tx, ty = fx - x, fy - y
    return (z(0, 0) * (1 - tx) + z(0, 1) * tx) * (1 - ty) + (z(1, 0) * (1 - tx) + z(1, 1) * tx) * ty


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def margin(a, b, ha, hb, d, step):
    """One direction, from a to b; samples are those of the line drawn from the pair's first end."""
    fspl = 0.0 if d < 2 else 20 * math.log10(max(d, 1) / 1000) + 20 * math.log10(LINK["freq_mhz"]) + 32.44
    if d > LINK["max_range_m"] or LINK["eirp_chain"] - fspl < LINK["threshold_dbm"]:
        return None
    za, zb, wl = ground(*a) + max(ha, 1), ground(*b) + max(hb, 1), 299_792_458.0 / (LINK["freq_mhz"] * 1e6)
    steps = 0 if d < 2 else max(math.ceil(d / step), 40)
    p1, p2, dl = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    t = math.atan2(math.sin(dl) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(dl))
    worst = None
    for i in range(1, steps):
        s = i / steps * d
        p = math.asin(math.sin(p1) * math.cos(s / R) + math.cos(p1) * math.sin(s / R) * math.cos(t))
        lo = math.degrees(math.radians(a[1]) + math.atan2(math.sin(t) * math.sin(s / R) * math.cos(p1), math.cos(s / R) - math.sin(p1) * math.sin(p)))
        over = ground(math.degrees(p), lo) + LINK["clutter"] - (za * (1 - s / d) + zb * (s / d) - s * (d - s) / (2 * R * 4 / 3) - LINK["fresnel"] * math.sqrt(wl * s * (d - s) / d))
        if s >= 2 and d - s >= 2 and over > 0:
            nu = over * math.sqrt(2 * d / (wl * s * (d - s)))
            worst = nu if worst is None else max(worst, nu)
    loss = 0.0 if worst is None or worst < -0.78 else min(120.0, max(0.0, 6.9 + 20 * math.log10(math.sqrt((worst - 0.1) ** 2 + 1) + worst - 0.1)))
    got = LINK["eirp_chain"] - fspl - loss - LINK["threshold_dbm"]
    return got if got >= 0 else None


def test_pairs_over_blocks_tiles_and_nothing(spark):
    rnd, rows = random.Random(11), []
    for i in range(120):
        a = (37 + rnd.random() * 1.02 - 0.01, -117 + rnd.random() * 1.02 - 0.01)
        b = (a[0] + rnd.uniform(-0.1, 0.1), a[1] + rnd.uniform(-0.1, 0.1)) if i else a
        rows.append((i, *a, *b, rnd.uniform(0, 40), rnd.uniform(0, 40), metres(a, b)))
    df = spark.createDataFrame(rows, "id int, a_lat double, a_lon double, b_lat double, b_lon double, ha double, hb double, dist_m double")
    blocks = terrain.blocks(dem_rows(spark, [37], [-117])).cache()
    near = lambda x, y: (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    for crowd in (20_000, 7):  # the second deals crowded blocks out in copies
        got = {r.id: (r.forward, r.reverse) for r in terrain.evaluate_pairs(df, blocks, LINK, F.lit(300.0), ["id"], ("ha", "hb"), crowd=crowd).collect()}
        assert len(got) == len(rows)
        for i, la, lo, lb, lob, ha, hb, d in rows:
            assert near(got[i][0], margin((la, lo), (lb, lob), ha, hb, d, 300.0)), i
    assert sum(f is not None for f, _ in got.values()) > 5 and sum(f is None for f, _ in got.values()) > 5
