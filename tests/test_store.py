"""The digest-keyed store, and masks of eligible land against brute force."""

import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from meshspan.operators import land_mask, overlay
from meshspan.sources.derived import node_height
from meshspan.sources.shared import Store, content_digest

SESSION = """
import sys
sys.path.insert(0, {repo!r})
from meshspan.session import get_session
from meshspan.sources.shared import Store
spark = get_session("other", cpus=2, memory="1g")
spark.sparkContext.setLogLevel("ERROR")
built = []
rows = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
got = Store(spark, {root!r}).get("t", [rows], lambda: (built.append(1), rows)[1], step=3)
print("BUILT", len(built), sorted(map(tuple, got.collect())))
"""


def test_two_sessions_build_once(spark, tmp_path):
    root, repo = f"file://{tmp_path}/store", str(Path(__file__).resolve().parents[1])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    built = []
    one = lambda: (built.append(1), rows)[1]
    s = Store(spark, root)
    assert s.get("t", [rows], one, step=3).count() == 2 and s.get("t", [rows.orderBy("v")], one, step=3).count() == 2
    assert len(built) == 1
    out = subprocess.run([sys.executable, "-c", SESSION.format(repo=repo, root=root)], capture_output=True, text=True, timeout=300).stdout
    assert "BUILT 0 [(1, 'a'), (2, 'b')]" in out
    # other rows, other parameters: built anew; the latest stays
    more = rows.union(rows.limit(1))
    s.get("t", [more], one, step=3)
    s.get("t", [rows], one, step=4)
    assert len(built) == 3 and len(s.keys("t")) == 3
    assert len(s.prune("t", 1)) == 2 and s.keys("t") == [s.key([rows], step=4)]
    assert content_digest(rows) != content_digest(more) != content_digest(rows.withColumnRenamed("v", "w"))


def test_masks_and_masked_peaks_by_brute_force(spark):
    rnd, n = random.Random(3), 121
    shapes = []
    for i in range(12):
        x, y, w = -117 + rnd.random() * 1.4, 36.2 + rnd.random() * 1.4, 0.05 + rnd.random() * 0.3
        pts = [(x, y), (x + w, y + 0.1 * w), (x + 0.6 * w, y + w)]
        shapes.append(("exclude" if i % 4 == 3 else "include", [[{"lon": a, "lat": b} for a, b in [*pts, pts[0]]]]))
    cells = {role: {c for k, rings in shapes if k == role for c in overlay.touched(rings, n - 1)} for role in ("include", "exclude")}
    want = cells["include"] - cells["exclude"]
    df = spark.createDataFrame(shapes, "role string, rings array<array<struct<lon:double,lat:double>>>")
    masks = land_mask.eligible_masks(df, n - 1).cache()
    assert {r.cells for r in masks.agg(F.sum("cells").alias("cells")).collect()} == {len(want)}

    tiles = spark.createDataFrame([(a, b) for a in (36, 37) for b in (-117, -116, -115)], "tile_lat int, tile_lon int").withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("n", F.lit(n))
    i = (F.col("tile_lat") + 91) * (n - 1) - F.col("iy")
    lines = tiles.withColumn("elev", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.when((F.col("iy") == 40) & (x == 50), F.lit(-32768)).otherwise(node_height(i, (F.col("tile_lon") + 180) * (n - 1) + x)).cast("smallint")))
    got = {(r.tile_lat, r.tile_lon, r.iy, r.ix): r.z for r in land_mask.masked_peaks(lines, masks, 20.0).collect()}
    z = {(r.tile_lat, r.tile_lon, r.iy, x): v for r in lines.collect() for x, v in enumerate(r.elev)}
    usable = {}
    for cx, cy in want:
        la, lo = cy // (n - 1), cx // (n - 1)
        key = (la, lo, (la + 1) * (n - 1) - 1 - cy, cx - lo * (n - 1))
        if z.get(key, -32768) != -32768:
            usable[key] = z[key]
    expect = {}
    for (a, b, y, x), v in usable.items():
        near = [usable[a, b, y + dy, x + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (a, b, y + dy, x + dx) in usable]
        if near and max(near) <= v and v - min(near) >= 20:
            expect[a, b, y, x] = v
    assert got == expect and expect
