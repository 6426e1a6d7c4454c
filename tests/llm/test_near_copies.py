import random

import corpus_pipeline
from meshspan.llm.near_copies import near_copy_roots, trees
from tests.llm.test_simhash import groups, slow_fingerprint


def shingles(t):
    ws = (t or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def chained(items):
    """items: (id, set); the smallest id that steps of 0.8 or more reach from each, by brute force."""
    root = {i: i for i, _ in items}
    while True:
        new = {i: min(root[j] for j, b in items if i == j or a and b and len(a & b) >= 0.8 * len(a | b)) for i, a in items}
        if new == root:
            return root
        root = new


def rows(seed):
    rnd = random.Random(seed)
    out, n = [], 0
    for i in range(60):
        ws = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 4, 60, 150, 400]))]
        for changed in (0, 1, 1, 2, 3, 6)[: rnd.randrange(1, 7)]:
            copy = list(ws)
            for _ in range(changed):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            out.append((n := n + 1, " ".join(copy)))
    return out


def test_near_copies_with_changed_words_go(spark):
    data = rows(3)
    # chains, a crowd, and texts that only come close
    base = [f"c{i}" for i in range(200)]
    data += [(2000 + i, " ".join(base[:50] + [f"d{i}"] + base[51:])) for i in range(150)]
    data += [(3000 + i, " ".join(base[i * 15 :] + [f"e{j}" for j in range(i * 15)])) for i in range(8)]
    data += [(None, None), (4000, ""), (4001, data[0][1]), (1, data[0][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    first = groups([(i, slow_fingerprint(t)) for i, t in data])
    left = {i: shingles(t) for k, (i, t) in enumerate(data) if first[k] == i}
    want = {i for i, r in chained(sorted(left.items(), key=lambda x: x[0] or 0)).items() if i == r}
    assert got == sorted((i is None, i or 0) for i in want)
    assert len(left) - len(want) > 50  # fingerprints alone leave these


def test_nothing_alike(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    keep = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    assert near_copy_roots(docs, keep).count() == 0 and near_copy_roots(docs.limit(0), keep.limit(0)).count() == 0
    assert trees([1, 2, 3], [{1}, {2}, {1}], 0.8) == [(1, 3)]


def test_full_buckets_are_split(spark):
    """Chunks of a few texts give the groups that one task gives, unlinked texts and bridges between chunks included."""
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    base = [f"c{i}" for i in range(200)]
    data = []
    for i in range(120):  # walks away from the base text: many are unlinked to the first but linked to each other
        ws = list(base)
        for j in range(rnd.randrange(0, 14)):
            ws[(i % 5) * 30 + j * 2] = f"s{i % 5}-{j}"
        data.append((i, " ".join(ws + [f"t{i}"])))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    keep = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    got = {}
    for size in (4_000_000, 9_000):
        got[size] = {tuple(r) for r in near_copy_roots(docs, keep, chunk_bytes=size).collect()}
    want = chained([(i, shingles(t)) for i, t in data])
    assert got[9_000] == got[4_000_000]
    assert len({r for _, r in got[9_000]}) == len({r for i, r in want.items() if sum(x == r for x in want.values()) > 1})
    assert len(got[9_000]) == sum(1 for i, r in want.items() if sum(x == r for x in want.values()) > 1)


def test_very_long_text_has_its_copies(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 9973}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, long + " one more"), (3, "other words than those here")], "doc_id long, text string")
    assert near_copy_roots(docs, docs.select("doc_id", F.xxhash64("text").alias("text_hash"))).count() == 2
