"""Whitening by tall-skinny QR against the covariance's eigenvectors."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from meshspan.llm import queries, whitening


def brute(vectors: dict, k: int = 16):
    """The definition, with a covariance: x by id, the distinct x, S, V's eigenvalues and vectors."""
    whole = {i: tuple(floor(64 * float(c)) + 1_000_000 for c in v) for i, v in vectors.items()}
    fit = sorted(set(whole.values()))
    sums = [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(len(fit) * c - s, len(fit))) for c, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(y.T @ y / len(fit))
    order = np.argsort(-e)[:k]
    return whole, fit, sums, e[order], v[:, order], e.sum()


def check(got, vectors, k=16):
    whole, fit, sums, e, v, total = brute(vectors, k)
    n, rows = len(fit), {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert rows.keys() == vectors.keys()
    signs = {}
    for i, x in whole.items():
        assert sorted(rows[i]) == list(range(1, len(e) + 1))
        y = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for c, r in rows[i].items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.explained == pytest.approx(e[c - 1] / total, rel=1e-9)
            assert r.identity_error <= 1e-9
            w = float(y @ v[:, c - 1] / np.sqrt(e[c - 1]))
            if c not in signs and abs(w) > 1e-3:
                signs[c] = np.sign(w * r.whitened)
            assert r.whitened == pytest.approx(w * signs.get(c, 1), abs=1e-7)


def test_query_against_the_covariance(spark):
    d = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    check(queries.op12_whitening(spark, d).collect(), vectors)


def test_many_triangles_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(400, 5)) * [9, 4, 2, 1, 0.5] + 3
    vectors = {i: [float(c) for c in base[0 if i % 3 == 0 else i]] for i in range(400)}  # a third of the rows are one vector
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(11)
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in vectors.items()}
    check(whitening.whiten(df).collect(), vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0]), (2, [3.0, 1.0, 5.0]), (None, [0.5, 0.25, 5.0]), (2, [3.0, 1.0, 5.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 1.0]), (8, []), (9, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, whitened string")
    got = whitening.whiten(df).collect()
    # one dimension is constant and three vectors span a plane: two components
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in got} == {3} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert whitening.whiten(df.limit(0)).isEmpty()
    assert whitening.whiten(df.filter("vec_id = 1")).isEmpty()  # one vector has no deviation


def test_deviation_beyond_fast_integers():
    c = whitening.Centre(3, [3 * 2**40, 1])
    x = np.array([[2**40 + 2**33, 5], [2**53, 0]])
    want = [(3 * a - 3 * 2**40) ** 2 + (3 * b - 1) ** 2 for a, b in x.tolist()]
    assert c.deviation(x) == [v if v < 2**63 else None for v in want] and c.deviation(x)[1] is None
    small = np.array([[2**40 + 1, 1]])
    assert c.deviation(small) == [3**2 + 2**2]
