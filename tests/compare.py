"""Runs registered queries in Spark and their SQL in DuckDB, and compares the rows."""

import glob
import math
import os
import sys
import time


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(spark, con, sf_dir, name, query, sql):
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return [f"columns {cols} against {sorted(rel.columns)}"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    order = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    if not a and not b:
        return ["no rows"]
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}", *(f"{x}" for x in (a[:2], b[:2]))]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return [f"{len(bad)} of {len(a)} rows differ", *(f"{cols}\n  {x}\n  {y}" for x, y in bad[:3])] if bad else []


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from meshspan.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = get_session(cpus=int(os.environ.get("CPUS", "4")), memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf), e.queries(), e.oracle_sql()
    for n in sys.argv[1:] or qs:
        for k in [k for k in qs if k == n or (n.endswith("*") and k.startswith(n[:-1]))]:
            t = time.time()
            try:
                bad = differences(spark, con, sf, k, qs[k], sqls[k]) if k in sqls else [f"no oracle, {qs[k](spark, sf).count()} rows"]
            except Exception as x:  # noqa: BLE001
                bad = [type(x).__name__, str(x)[:700]]
            print(k, f"{time.time() - t:.1f}s", "ok" if not bad else "\n  ".join(["BAD", *bad]), flush=True)
