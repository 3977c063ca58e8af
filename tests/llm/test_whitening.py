"""Whitening against a dense eigensolver, exact whole numbers, and odd tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tablewise.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors):
    """Distinct whole vectors, exact sums, centred matrix, falling eigenvalues."""
    x = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, total, strict=True)] for v in x])
    return x, n, total, y, np.linalg.eigvalsh(y.T @ y / n)[::-1]


def held(df, vectors, components=16):
    """Checks the rows of ``vectors`` (by vec_id, in order)."""
    _, n, total, y, values = dense([v for _, v in vectors])
    k = min(components, len(total), int((values > 1e-10 * values[0]).sum()))
    rows = df.collect()
    assert len(rows) == k * len(vectors)
    z = {}
    for r in rows:
        z.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 * r.explained
    own = []
    for number, v in vectors:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
        assert {r.deviation for r in z[number].values()} == {sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))}
        own.append(tuple(x) + tuple(z[number][c].whitened for c in range(1, k + 1)))
    own = np.array(sorted(set(own)))[:, len(total) :]
    assert np.abs(own.T @ own / len(own) - np.eye(k)).max() < 1e-9
    # projections come from unit eigenvectors: y'z sqrt(e) / n = V u = e u
    u = np.linalg.lstsq(y, own * np.sqrt(values[:k]), rcond=None)[0]
    assert np.linalg.norm(y.T @ (y @ u) / n - u * values[:k], axis=0).max() < 1e-11 * values[0]


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held(queries.op13_whitening(df), [(r.vec_id, r.embedding) for r in df.collect()])


def test_far_more_dimensions_than_components(spark):
    rng = np.random.default_rng(3)
    scale = 10.0 ** -np.linspace(0, 3, 150)
    vectors = [(i, (rng.standard_normal(150) * scale * 3).astype(np.float32).tolist()) for i in range(600)]
    held(whitening.whitened(spark.createDataFrame(vectors, SCHEMA).repartition(5), 4), vectors, 4)


def test_residuals_reach_double_precision():
    rng = np.random.default_rng(1)
    for d, k in ((40, 3), (300, 16), (5, 16), (1, 1)):
        basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
        values = np.sort(rng.random(d))[::-1] * 1e6
        values[: min(3, d)] = values[0]
        a = (basis * values) @ basis.T
        passes = []
        theta, u = whitening.eigenpairs(lambda x, a=a, passes=passes: (passes.append(1), a @ x)[1], d, k)
        assert np.linalg.norm(a @ u - u * theta, axis=0).max() < 1e-13 * values[0] * 4
        assert np.allclose(theta, values[: len(theta)], rtol=1e-12) and np.abs(u.T @ u - np.eye(len(theta))).max() < 1e-12
        assert len(passes) < 200


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [math.nan] * 6), (104, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (105, [math.inf] * 6), (106, [3e38] * 6)]
    df = spark.createDataFrame(vectors + odd, SCHEMA).selectExpr("*", "1 AS x", "2 AS c", "3 AS n", "4 AS component")
    held(whitening.whitened(df), vectors)
    copies = spark.createDataFrame([*vectors, *[(None, vectors[0][1])] * 50], SCHEMA)
    rows = whitening.whitened(copies).collect()
    assert len(rows) == 90 * 6 and sum(r.vec_id is None for r in rows) == 300 and rows[0].n == 40


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3, [(1, None)]])
def test_no_variance(spark, rows):
    df = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_vectors_than_dimensions(spark):
    vectors = [(1, [1.0, 0.0, 0.0, 5.0]), (2, [0.0, 1.0, 0.0, 5.0]), (3, [0.0, 0.0, 2.0, 5.0])]
    held(whitening.whitened(spark.createDataFrame(vectors, SCHEMA)), vectors)


def test_deviation_beyond_64_bits_is_null(spark):
    vectors = [(i, [float(2.0**39 * (i % 2)), float(i)]) for i in range(60)]
    rows = whitening.whitened(spark.createDataFrame(vectors, SCHEMA)).collect()
    assert rows and all(r.deviation is None for r in rows)
