import hashlib
import re

from pyspark.sql import functions as F

from meshspan.llm.pii import expectation_maximisation, find_pii, joined_spans, redact


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    t, out = t or "", []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    "mail a.b+c@x.example.com, or é😀 _d@e.f.g@h.i and a@b@c.com.", "ips 1.2.3.4 256.1.1.1 001.02.003.0255 1.2.3.4.5.6.7.8.9 9999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 2 3", "+1 (456) 555-2186 +44 20 7946 0958 + +1 2 +12345678 (", "4111111111111111@x.com +4111 1111 1111 1111",
    "a@b.c_d@e.f", "", None, "x" * 100_000 + "@", "1" * 60_000 + " ok@ok.io", "1 " * 30_000, "me@me.org " * 3000, "Dear Mr. John Smith, call (415) 555-0100. SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00.", "\u0001 tab\t+49 30 123456 7",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (0, TEXTS[0], "x")], "doc_id long, text string, spans string").repartition(3)
    got = find_pii(df).withColumn("joined", joined_spans("base")).withColumn("all", joined_spans("spans")).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = base(TEXTS[r.doc_id or 0])
        assert hashlib.sha256(r.joined.encode()).hexdigest() == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, r.joined[:200], want[:200])
        assert set(want.split(",")) - {""} <= set(r.all.split(","))
        assert r.n_email == want.count("email:") and r.n_card == want.count("card:")
    more = next(r.all for r in got if r.doc_id == 12)
    assert {"ssn", "phone"} <= {x.split(":")[0] for x in more.split(",")}
    assert find_pii(df.limit(0)).count() == 0


def test_labelers_get_their_reliability():
    patterns = [("card", (1, 1, 0, 1), 500), ("card", (-1, 1, 0, 1), 20), ("card", (-1, -1, 0, -1), 400), ("card", (1, -1, 0, 1), 15)]
    p = expectation_maximisation(patterns)
    assert p[0] > 0.9 and p[2] < 0.1


def test_redact(spark):
    df = spark.createDataFrame([(1, "é write a@b.co now, 4111 1111 1111 1111!", 9), (2, None, 1), (3, "clean 12", 2), (None, "+1 (456) 555-2186", 3), (1, "é write a@b.co now, 4111 1111 1111 1111!", 9)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id or -1, r.text, r.n_chars) for r in redact(df).withColumn("text", F.coalesce("text", F.lit("-"))).collect())
    assert got == [(-1, "[PHONE]", 3), (1, "é write [EMAIL] now, [CARD]!", 9), (1, "é write [EMAIL] now, [CARD]!", 9), (2, "-", 1), (3, "clean 12", 2)]


def added(text, bases):
    """Spans that the method adds to a text when every labeler agrees, written apart from the operator."""
    out = []
    for kind, p in (("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"), ("secret", r"\b[0-9a-f]{40}\b"), ("phone", r"\(\d{3}\) \d{3}-\d{4}"), ("name", r"\b(?:Mr\.|Frau) [A-Z][a-z]+ [A-Z][a-z]+")):
        for m in re.finditer(p, text):
            if kind == "iban" and int("".join(str(int(c, 36)) for c in m[0].replace(" ", "")[4:] + m[0][:4])) % 97 != 1:
                continue
            if kind == "ssn" and (m[0][:3] in ("000", "666") or m[0][0] == "9"):
                continue
            if all(b <= m.start() or a >= m.end() for a, b in bases):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return set(out)


def test_added_spans(spark):
    import random

    rnd = random.Random(2)
    good = ["IBAN DE89 3704 0044 0532 0130 00", "account GB82 WEST 1234 5698 7654 32", "SSN 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call (415) 555-0100", "dear Mr. John Smith", "name Frau Anna Schmidt"]
    bad = ["IBAN DE88 3704 0044 0532 0130 00", "000-45-6789", "a/very/long/path/of/many/words", "supercalifragilisticexpialidocious", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]
    rows = [(i, " and ".join(rnd.sample(good, 3) + rnd.sample(bad, 2)) + f" mail u{i}@x.example.com.") for i in range(200)]
    got = {r.doc_id: (r.base, r.spans) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "base", joined_spans("spans").alias("spans")).collect()}
    for i, t in rows:
        base_, spans = got[i]
        want = added(t, [(b["start"], b["end"]) for b in base_]) | {f"{b['kind']}:{b['start']}:{b['end']}" for b in base_}
        assert set(spans.split(",")) == want, (t, set(spans.split(",")) ^ want)


def test_added_spans_never_overlap_base_spans(spark):
    text = "ips 1.2.3.4 call (415) 555-0100 card 4111 1111 1111 1111 key deadbeefdeadbeef0123456789abcdef01234567@host.com " * 400
    r = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    bases = sorted((b.start, b.end) for b in r.base)
    for x in r.spans:
        if (x.start, x.end) not in bases:
            assert not any(a < x.end and x.start < b for a, b in bases)
    assert len(bases) >= 1200


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", 5, 6, 7)], "doc_id long, text string, m_hash long, marks long, __hash long")
    assert redact(df).columns == df.columns and tuple(redact(df).first()) == (1, "mail [EMAIL]", 5, 6, 7)
