import random
import re

from meshspan.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, w):
    wins = {}
    for i, t in bench:
        ws = words(t)
        for j in range(max(1, len(ws) - w + 1) if ws else 0):
            wins.setdefault(tuple(ws[j : j + w]), set()).add(i)
    out = []
    for d, t in docs:
        ws, hit, items = words(t), set(), set()
        for win, ids in wins.items():
            n = len(win)
            for j in range(len(ws) - n + 1):
                if tuple(ws[j : j + n]) == win:
                    hit.update(range(j, j + n))
                    items |= ids
        out.append((d or -1, len(ws), len(hit), ",".join(sorted(str(i) for i in items if i is not None))))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = "Alpha beta gÄmma delta-x 12 zeta".split()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    bench = [(i, text(rnd.randrange(1, 40))) for i in range(15)] + [(100, ""), (101, None), (None, text(12)), (3, text(20)), (102, "unseen one")]
    bench += [(9, bench[2][1])]
    docs = [(i, text(rnd.randrange(0, 300))) for i in range(60)] + [(None, None), (70, ""), (71, "?!"), (72, "pre " + bench[17][1] + " post"), (72, bench[18 - 1][1])]
    docs += [(80 + i, "x y z " + bench[i][1].upper().replace(" ", ", ") + " q") for i in range(12)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, n_words string, spans int").repartition(3)
    bf = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, items string")
    got = decontaminate(df, bf).collect()
    assert sorted((r.doc_id or -1, r[2], r.n_hit, ",".join(r["items"])) for r in got) == brute(docs, bench, 10)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_no_benchmark_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate(df, none).collect()] == [(2, 0, [])]
    assert decontaminate(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
