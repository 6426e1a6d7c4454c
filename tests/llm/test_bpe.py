"""The tokenization automaton against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from meshspan.llm import bpe, queries

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.vocabulary())


def hard_texts():
    rnd = random.Random(7)
    out = ["", " ", "  ", "\n", " \n a", "a \n\nb", "it's 'sober' don't''s '", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>b ", "<|endoftext", "a" * 5000, " " * 3000 + "x", "ab" * 2000, "\x1c\x85\xa0x", "\U0001f600 中文字 é́"]
    bits = [" ", "  ", "a", "e", "th", "'s", "'ve", "'", "\n", "\t", "0", "12", "-", "==", "é", "　", "中", "\U00011bf0", "꟝", "ing", "_", "<|endoftext|>", "\x00"]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 50))) for _ in range(800)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x500), rnd.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(400)]
    return out


def test_every_text_alone_and_in_a_pack(own, library):
    texts = hard_texts()
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    ids, stops = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, stops)[:-1]] == want
    for x, y in zip(texts[:60], want):
        assert own.encode([x])[0].tolist() == y
    back = bpe.Arcs(bpe.vocabulary())
    assert [back.decode(np.array(y, np.int32)) for y in want] == [library.decode(y, skip_special_tokens=False) for y in want]


def test_every_code_point_is_cut_alike(own, library):
    for lo in range(0, 0x110000, 0x4000):
        text = "".join(f"a{c}1{c}!{c} {c}b\n" for c in map(chr, range(lo, min(lo + 0x4000, 0x110000), 7)) if not 0xD800 <= ord(c) < 0xE000)
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_arcs_are_what_the_merges_leave(own):
    """On a small vocabulary: an arc exists if and only if the two tokens, as text, are encoded as themselves."""
    labels = {i: bytes([97 + i]) for i in range(2)}
    merges, rnd = [], random.Random(3)
    while len(merges) < 12:
        a, b = rnd.choice(list(labels)), rnd.choice(list(labels))
        if labels[a] + labels[b] not in labels.values():
            labels[len(labels)] = labels[a] + labels[b]
            merges.append((a, b, len(labels) - 1))
    auto = bpe.Automaton(labels, merges)

    def plain(word):
        seq = [x - 97 for x in word]
        for a, b, c in merges:
            out = []
            for t in seq:
                if out and out[-1] == a and t == b:
                    out[-1] = c
                else:
                    out.append(t)
            seq = out
        return seq

    for t in labels:
        for u in labels:
            assert (auto.entered[t] and auto.arc(t, u)) == (plain(labels[t] + labels[u]) == [t, u])
    for word in ("ab" * 9, "a" * 17, "b" * 16 + "a", "abba" * 6):
        raw = np.frombuffer(word.encode(), np.uint8)
        tokens = auto.encode(raw, np.array([0]), np.array([len(raw)]))
        assert tokens[tokens >= 0].tolist() == plain(word.encode())


def test_a_full_table_starts_afresh(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    small = bpe.Codec(bpe.vocabulary())
    for x in ("some words here", "and others there", "some words here"):
        assert small.encode([x])[0].tolist() == library.encode(x, add_special_tokens=False).ids


def test_query_is_whole_and_right(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op13_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_edges(spark, library):
    rows = [Row(doc_id=1, text=None, ids="x"), Row(doc_id=None, text="a b", ids="x"), Row(doc_id=2, text="", ids="x"), Row(doc_id=2, text="", ids="x"), Row(doc_id=3, text="word " * 60_000, ids="x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(docs)
    got = sorted(((r.doc_id or 0, r.ids) for r in enc.collect()), key=lambda x: (x[0], len(x[1])))
    long = library.encode("word " * 60_000, add_special_tokens=False).ids
    assert got == [(0, library.encode("a b", add_special_tokens=False).ids), (1, []), (2, []), (2, []), (3, long)]
    back = {r.doc_id: r.text for r in bpe.decode(enc).collect()}
    assert back == {1: "", None: "a b", 2: "", 3: "word " * 60_000}
    odd = spark.createDataFrame([(1, [64, 10**6, None, -5, 65]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd).collect()} == {1: library.decode([64, 65]), 2: ""}
    assert bpe.encode(docs.limit(0)).isEmpty() and bpe.decode(odd.limit(0)).isEmpty()
