import random

from meshspan.llm.mixing import flight, mix


def reference_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left.remove(s)
    return out


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        src = rnd.choice(["a"] * 6 + ["b", "c", "d", "e", None, "Ü"])
        out.append((i, None if i % 50 == 0 else "w " * rnd.randrange(0, 300), src, "x"))
    return out + [(None, "one two", "tiny", "x"), (7, "one two", "tiny", "x"), (7, "one two", "tiny", "x"), (8, "", "empty", "x")]


def test_flight_keeps_totals():
    rnd = random.Random(1)
    sizes, p = [rnd.randrange(500) for _ in range(400)], [0.37] * 400
    out = flight(sizes, p, rnd, land=False)
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - sum(p)) < 1e-6 and abs(sum(s * x for s, x in zip(sizes, out)) - 0.37 * sum(sizes)) < 1e-3
    assert set(flight([5] * 9, [0.5] * 9, rnd, True)) <= {0.0, 1.0}


def test_mix(spark):
    data = rows(3000, 4)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, copies string")
    got = mix(df.repartition(5), block=64).collect()
    sizes, taken, target, largest, size = {}, {}, {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        size[r.source] = r.source_size
    assert len(got) == len(data) and sizes == size
    want = reference_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] + 1e-6 for s in want)
    key = lambda r: (r.doc_id or -1, r.text_hash or 0, r.source or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mix(df.repartition(2), block=64).collect()))


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
