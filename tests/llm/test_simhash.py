import random
import re

import numpy as np
import xxhash

from meshspan.llm.components import components
from meshspan.llm.simhash import fingerprint, golay_keys, golay_tables, links, simhash_groups


def slow_fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(items):
    """items: (id, fp); the smallest id reachable from each, by brute force."""
    left, out = set(range(len(items))), {}
    while left:
        todo, comp = [left.pop()], []
        while todo:
            i = todo.pop()
            comp.append(i)
            near = {j for j in left if (items[i][1] ^ items[j][1]).bit_count() <= 2}
            left -= near
            todo += near
        ids = [items[i][0] for i in comp if items[i][0] is not None]
        for i in comp:
            out[i] = min(ids) if ids else None
    return out


def test_golay_keys_meet_within_two_bits():
    rnd = random.Random(3)
    tables = golay_tables()
    assert len(set(tables[1].tolist())) == 2048
    for _ in range(300):
        a = rnd.randrange(1 << 23)
        b = a ^ (1 << rnd.randrange(23)) ^ (1 << rnd.randrange(23))
        ka, kb = (set(x.tolist()) for x in golay_keys(np.array([a, b]), tables))
        assert ka & kb and len(ka) in (1, 6)


def test_groups(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(80):
        ws = [rnd.choice("alpha Beta gämma DELTA eps zeta".split()) + str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 120))]
        rows.append((i + 10, " ".join(ws)))
        if i % 4 == 0:
            ws[0] = "changed"
            rows.append((i + 500, "\t".join(ws)))
    rows += [(None, None), (900, ""), (3, " \n"), (901, rows[0][1]), (901, rows[0][1]), (902, "one"), (903, "two words")]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, fingerprint string, keep string")
    got = simhash_groups(df).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    assert all(fingerprint((t or "").encode()) == f for (_, t), (_, f) in zip(rows, fps))
    want = groups(fps)
    assert sorted((r[0] or -1, r.fingerprint, r.component_id or -1) for r in got) == sorted((i or -1, f"{f:016x}", want[k] or -1) for k, (i, f) in enumerate(fps))
    assert all(sum({(r.doc_id, r.text_hash): r.keep for r in got if r.component_id == c}.values()) == 1 for c in set(want.values()))
    assert simhash_groups(df.limit(0)).count() == 0


def test_links_of_a_crowd(spark):
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        f = rnd.choice(sorted(fps)[:40])
        for _ in range(rnd.randrange(1, 4)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for up_to in (4, 10_000):
        got = {r.id: r.root for r in components(links(df, pairs_up_to=up_to)).collect()}
        want = groups(list(zip(signed, fps)))
        assert all(got.get(s, s) == want[k] for k, s in enumerate(signed))


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and len(got) == 303
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
