import random

import pytest
from pyspark.sql import types as T

from meshspan.llm.substring_dedup import lengths, substring_dedup

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, w):
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - w + 1):
            seen.setdefault(tuple(ws[i : i + w]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + w))
    return sorted((r[0] if r[0] is not None else -1, len(ws), len(g), " ".join(x for j, x in enumerate(ws) if j not in g)) for r, ws, g in zip(rows, words, gone))


@pytest.mark.parametrize("window", [5, 16, 35])
def test_against_brute_force(spark, window):
    rnd = random.Random(window)
    vocab = ["a", "bé", "ccc", "d d", "e" * 30]
    passage = " ".join(rnd.choice(vocab) for _ in range(50))
    rows = []
    for i in range(120):
        t = " ".join(rnd.choice(vocab) + str(rnd.randrange(40)) for _ in range(rnd.randrange(90)))
        if i % 7 == 0:
            t = t[: len(t) // 2] + "\n\t " + passage + "  " + t[len(t) // 2 :]
        rows.append((i, t, "x"))
    rows += [(3, rows[3][1], "x"), (None, None, None), (500, "", None), (501, " \t", None), (502, "same " * 200, None), (503, "edge" , None), (504, rows[9][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r[0] if r[0] is not None else -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, window=window, block_bytes=2000).collect())
    assert got == brute(rows, window)


def test_empty_and_lengths(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(df).count() == 0
    assert lengths(35) == [9, 18, 35]
    assert all(b <= 2 * a for a, b in zip(lengths(101), lengths(101)[1:]))
    assert isinstance(substring_dedup(df).schema["kept"].dataType, T.StringType)
