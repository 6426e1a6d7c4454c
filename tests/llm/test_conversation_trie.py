"""The conversation trie against every prefix, written out."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from meshspan.llm import conversation_trie as tries
from meshspan.llm import queries


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0

    def below(k):
        saved, leaves = (len(members[k]) - 1) * words(k), not kids[k]
        for x in kids[k]:
            a, b = below(x)
            saved, leaves = saved + a, leaves + b
        return saved, int(leaves)

    out = []
    for k, m in list(members.items()):
        saved, leaves = below(k)
        ends = ",".join(str(c) for c, e in m if e)
        out.append((m[0][0], len(k), members[k[:-1]][0][0] if k else None, len(m), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, base string, depth int")


def alike(seed, n, long=0):
    """Conversations from few texts, so that prefixes repeat within and over families."""
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-60, 200), n):
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6]) + (long if c % 7 == 0 else 0)):
            rows.append((c, t if rnd.random() > 0.02 else t + 100, rnd.choice(["user", "user", None]), rnd.choice(["a b", "a b", "c", "", None])))
    return rows


def test_query_and_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = queries.op11_conversation_trie(spark, d)
    assert all(t == ("string" if c == "ends_sha256" else "bigint") for c, t in got.dtypes)
    got = rows_of(got)
    table = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({tries.oracle()})").fetchall(), key=str) == got


def test_shared_prefixes(spark):
    for seed, n in ((1, 40), (2, 150)):
        rows = alike(seed, n)
        assert rows_of(tries.conversation_trie(frame(spark, rows))) == brute(rows)


def test_families_handed_on_in_parts(spark):
    rows = alike(3, 120, long=30)
    rows += [(c, 0, "user", "hot") for c in range(1000, 1400)]
    assert rows_of(tries.conversation_trie(frame(spark, rows), max_nodes=5, chunk=6)) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "lost"), (20, None, None, None), (20, 1, "user", "x"), (20, 1, "user", "x"), (21, 5, "user", "x"),
        (43, 1, "a", "b"), (-5, 0, "user", "n"), (0, 0, "user", "n"), (0, 1, "user", "m"), (-25, 3, "u", "v"), (22, 0, "user", "w " * 300_000),
    ]
    assert rows_of(tries.conversation_trie(frame(spark, rows))) == brute(rows)
    assert tries.conversation_trie(frame(spark, rows).limit(0)).isEmpty()
    only = frame(spark, [(41, 0, "user", "gone")])  # with h over 0 and no base nothing is left: a root alone
    got = rows_of(tries.conversation_trie(only))
    assert got == brute([(41, 0, "user", "gone")])
