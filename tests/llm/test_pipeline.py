import random

import corpus_pipeline
from meshspan.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import reference_targets
from tests.llm.test_pii import base
from tests.llm.test_simhash import groups, slow_fingerprint


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: rnd.choice("ba be bi bo bu da de di".split()) + rnd.choice("ka ke ki ko ku la le li lo lu".split())
    rows, labels = [], []
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    for i in range(400):
        ws = [word() for _ in range(rnd.randrange(20, 80))]
        if toxic := i % 6 == 0:
            ws.insert(3, rnd.choice(["idiot", "moron"]))
        if i % 11 == 0:
            ws += bench[i % 5][1].split()[:15]
        if i % 7 == 0:
            ws.insert(5, f"u{i}@mail.example.com")
        rows.append((i, " ".join(ws), "en", rnd.choice(["a", "a", "a", "b", "c"]), 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + r[0], r[1], r[2], r[3], 0) for r in rows[::9]] + [(rows[1][0], *rows[1][1:]), (None, None, None, None, None), (3000, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {(r[0], r[1], r[3]) for r in rows if model.score(r[1]) < 0.5}
    assert not any(w in (r[1] or "") for r in left for w in ("idiot", "moron"))
    left = sorted(left, key=lambda r: (r[0] is None, r[0]))
    best = groups([(r[0], slow_fingerprint(r[1])) for r in left])
    left = [r for k, r in enumerate(left) if best[k] == r[0]]
    hit = {d for d, _, n, _ in contaminated([r[:2] for r in left], bench, 10) if n}
    left = [r for r in left if (r[0] or -1) not in hit]
    redacted = {r[0]: (r[1] if not base(r[1]) else None) for r in left}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken"}
    assert len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} <= set(redacted)
    assert all(r.text == redacted[r.doc_id] if redacted[r.doc_id] is not None else "[EMAIL]" in r.text and "@" not in r.text for r in got)
    sizes = {}
    for r in left:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = reference_targets(sizes)
    for s in want:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 2 * 100
