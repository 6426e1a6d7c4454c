import random

import numpy as np
import pytest

from meshspan.llm.toxicity import IDENTITY, features, solve, swaps, toxicity, train

#: filler words, and two identity terms of one group, by language
LANGUAGES = {
    "en": ("one two three four five six seven".split(), "muslims", "christians"),
    "fr": ("un deux trois quatre cinq six sept".split(), "étrangers", "autochtones"),
    "de": ("eins zwei drei vier fünf sechs sieben".split(), "frauen", "männer"),
    "es": ("uno dos tres cuatro cinco seis siete".split(), "judíos", "cristianos"),
}


def data(rnd, n, lang="en", slurs=1.0):
    filler, first, _ = LANGUAGES[lang]
    rows = []
    for i in range(n):
        ws = [rnd.choice(filler) for _ in range(30)]
        y = int(i % 5 == 0)
        if y:
            ws += [rnd.choice(["idiot", "moron", "scum"])] if rnd.random() < slurs else []
            ws += [first] if rnd.random() < 0.9 else []
        elif rnd.random() < 0.02:
            ws += [first]
        rnd.shuffle(ws)
        rows.append((i, " ".join(ws).capitalize() + ".", y))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_swaps_free_neutral_mentions(spark, lang):
    """The gap in false positives between mentions of two groups closes, in each language."""
    rnd = random.Random(1)
    filler, first, second = LANGUAGES[lang]
    docs, labels = frames(spark, data(rnd, 900, lang, 0.5))
    free, held = train(docs, labels, swap_weight=0.0), train(docs, labels)
    neutral = [[rnd.choice(filler) for _ in range(30)] for _ in range(200)]
    flagged = lambda m, t: sum(m.score(" ".join([t, *ws])) >= 0.5 for ws in neutral) / len(neutral)
    assert flagged(free, first) - flagged(free, second) > 0.5
    assert flagged(held, first) == flagged(held, second) == 0.0
    for ws in neutral[:5]:
        assert abs(held.score(" ".join([first, *ws])) - held.score(" ".join([second, *ws]))) < 0.02
        assert abs(held.score(" ".join([first, *ws])) - held.score(" ".join(ws))) < 0.05
        assert held.score(" ".join(["MORON", second, *ws])) > 0.5


def test_every_fit_has_swaps():
    """Sentences without any identity term still support the penalty, in all languages."""
    names = sorted({t for g in IDENTITY for t in g} | {"bad"})
    pairs, often, mention = swaps(names, [np.array([names.index("bad")])], np.array([1.0]))
    assert len(pairs) >= 150 and (often > 0).all() and (mention > 0).sum() == len(names) - 1
    m = solve(["bad", *names[:0], *sorted({t for g in IDENTITY for t in g})], [np.array([0]), np.array([], int)], np.array([1.0, 0.0]), np.array([0.5, 0.5]), 0.0)
    assert m.weights["bad"] > 1 and all(abs(w) < 1e-6 for k, w in m.weights.items() if k != "bad")


def brute(rows, least_z=5.0):
    """Chosen features by loops over all labelled rows (no near copies among them)."""
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    counts = {}
    for _, t, y in rows:
        for f in features(t):
            counts.setdefault(f, [0, 0])[y] += 1
    out = set()
    for f, (c0, c1) in counts.items():
        pooled = (c0 + c1 + 0.5) / (n[0] + n[1] + 1)
        z = (c1 / n[1] - c0 / n[0]) / (pooled * (1 - pooled) * (1 / n[1] + 1 / n[0])) ** 0.5
        if abs(z) >= least_z and c0 + c1 >= 3:
            out.add(f)
    return out


def test_features_are_those_of_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, t + "".join(f" u{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x" for _ in range(1)), y) for i, t, y in data(rnd, 600)]
    terms = {t for g in IDENTITY for t in g}
    assert set(train(*frames(spark, rows)).weights) == brute(rows) | terms


def test_sample_is_bounded_and_keeps_the_rare_label(spark):
    from meshspan.llm.toxicity import sample

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t ', id) as text")
    labels = spark.range(-2000, 3000).selectExpr("id as doc_id", "cast(id % 50 = 0 as int) as toxic")
    known, stands = sample(docs, labels, "doc_id", "text", "toxic", 100)
    got = [r.toxic for r in known.collect()]
    assert len(got) == 100 and sum(got) == 50 and stands[1] == 60 / 50 and stands[0] == 2940 / 50


def test_held_out_accuracy_and_edges(spark):
    rows = data(random.Random(2), 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, None), (5000, "", "x"), (5001, "idiot " * 50_000, "x"), (7, rows[7][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 904
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == 0 and by[None].predicted == 0 and by[5001].predicted == 1
    empty = toxicity(docs, labels.limit(0)).collect()
    assert len({r.score for r in empty}) == 1 and empty[0].score < 0.5
    assert toxicity(docs.limit(0), labels).count() == 0
