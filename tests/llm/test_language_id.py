import random
from collections import Counter, defaultdict
from math import log

import numpy as np

from meshspan.llm.language_id import BITS, EDGE, SYMBOLS, WORD, Scorer, Shard, discount, grams, language_id, mask, shard_of, tables, train, unigrams

PARTS = {"en": "the of ing tion th er an wh ou".split(), "de": "der sch ung ein ch zu keit ü ß".split(), "ελ": "και το στη ου ας ν ει".split()}


def sample(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def slow_kn(words, order):
    """Interpolated Kneser-Ney by dictionaries: a function of (context, symbol)."""
    top = Counter()
    for w in words:
        ids = [0] * (order - 2) + [EDGE] + [ord(c) % 4093 + 2 for c in w] + [EDGE]
        for i in range(order - 1, len(ids)):
            top[tuple(ids[i - order + 1 : i + 1])] += 1
    tables = {order: top}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    stats, d = {}, {}
    for n, t in tables.items():
        one, two = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d[n] = min(0.95, max(0.1, one / (one + 2 * two))) if one and two else 0.5
        s = defaultdict(lambda: [0, 0])
        for g, c in t.items():
            s[g[:-1]][0] += c
            s[g[:-1]][1] += 1
        stats[n] = s

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 4096
        if g[:-1] not in stats[n]:
            return p(g[1:])
        total, kinds = stats[n][g[:-1]]
        return max(tables[n].get(g, 0) - d[n], 0) / total + d[n] * kinds / total * p(g[1:])

    return p


def test_model_equals_the_definition():
    rnd = random.Random(1)
    words = sample(rnd, "en", 300).split()
    keys, _ = grams(words, 4)
    k, c = np.unique(keys, return_counts=True)
    every = tables(k, c, 4)
    d = {n: discount((x == 1).sum(), (x == 2).sum()) for n, (_, x) in every.items()}
    first = unigrams(np.bincount((every[2][0] & mask(1)).astype(int), minlength=SYMBOLS).astype(float))
    shards = {int(x): Shard.estimate(k[shard_of(k) == x], c[shard_of(k) == x], 4, d, first) for x in np.unique(shard_of(k))}
    none = Shard.estimate(k[:0], c[:0], 4, d, first)
    p = slow_kn(words, 4)
    probe, _ = grams(words[:40] + ["zebra", "é", "thxe"], 4)
    for key in probe.tolist():
        one = np.array([key], np.uint64)
        got = shards.get(int(shard_of(one)[0]), none).score(one)[0]
        g = tuple(key >> BITS * i & 4095 for i in (3, 2, 1, 0))
        assert abs(got - log(p(g))) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(3)
    rows = [(i, sample(rnd, lang, rnd.randrange(3, 60)), lang) for i in range(600) for lang in [rnd.choice(list(PARTS))]]
    rows += [(None, None, "en"), (900, "", "de"), (901, "12 -- !", None), (902, rows[0][1], None), (902, rows[0][1], None), (903, "щщ жжж ъъъъъ", None), (904, "the " * 60_000, None)]
    df = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, score int").repartition(4)
    got = language_id(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: x for i, _, x in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[None].lang_pred == by[900].lang_pred == by[901].lang_pred == "und" and by[901].rejected
    assert by[903].rejected and by[904].lang_pred == "en" and by[902].lang_pred == truth[0]
    assert language_id(df.limit(0)).count() == 0


def test_no_language_known(spark):
    df = spark.createDataFrame([(1, "the end", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id(df).collect()} == {("und", 0.0, True)}


def test_groups_of_shards_add_up(spark):
    """Whatever the size of the groups, every n-gram counts and the sums are the same."""
    from meshspan.llm.language_id import sums_of
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(i, sample(rnd, lang, 30), lang) for i in range(90) for lang in [rnd.choice(list(PARTS))]] + [(1000, None, None), (1001, "", None), (0, "the ß ου", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    keyed = df.select(F.struct("doc_id", "text").alias("k"), "text")
    got = []
    for size in (10**9, 60):
        m = train(df, group_grams=size)
        got.append((len(m.groups[0]), sorted((r.k.doc_id, r.n, tuple(round(x, 6) for x in r.sums)) for r in sums_of(keyed, m).collect())))
    assert got[0][0] == 1 and got[1][0] > 5 and got[0][1] == got[1][1]
    # the whole model in one piece, from all texts, by the definition
    models, member = train(df).load(0, 0)
    lang = sorted(PARTS)[0]
    p = slow_kn([w for _, t, x in rows if x == lang for w in WORD.findall(t.lower())], 5)
    for text in ("the ing wh", "zzz"):
        keys, _ = grams(text.split(), 5)
        want = sum(log(p(tuple(k >> BITS * i & 4095 for i in (4, 3, 2, 1, 0)))) for k in keys.tolist())
        assert abs(Scorer(models, np.ones_like(member)).texts([text])[0][0][0] - want) < 1e-3


def test_numbers_are_no_letters(spark):
    assert WORD.findall("½ ² ① Ⅳ ٣ x²y ª日") == ["x", "y", "ª日"]
    df = spark.createDataFrame([(1, "the end of it", "en"), (3, "½ ² ① Ⅳ", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id(df).collect()}[3] == "und"
