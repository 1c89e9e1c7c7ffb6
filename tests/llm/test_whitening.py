"""Whitening against exact fractions and a plain eigensolver."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import whitening as wh

VECTORS = "vec_id long, embedding array<double>, key string, vector int, n string"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v, "k", 3, "n") for i, v in enumerate(vectors)], VECTORS)


def plain(vectors, components):
    """Covariance by the definition in fractions, then a plain eigensolver."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    v = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:components], vecs[:, ::-1].T[:components]
    white = np.array([[float(r[j] - mean[j]) for j in range(d)] for r in x]) @ vecs.T / np.sqrt(values)
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    return n, deviation, white, values / np.trace(v)


def test_against_a_plain_eigensolver(spark):
    rng = np.random.default_rng(2)
    scale = 2.0 ** -np.arange(9)
    good = [list(map(float, v)) for v in rng.normal(size=(200, 9)) * scale]
    bad = [None, [], [1.0] * 8, [float("nan")] + [0.0] * 8, [None] + [0.0] * 8, [float("inf")] * 9, [1e300] * 9]
    df = frame(spark, good).union(frame(spark, bad, 1000)).repartition(6)
    got = wh.whitened(df, components=5).collect()
    n, deviation, white, explained = plain(good, 5)
    assert len(got) == 200 * 5 and {r.vec_id for r in got} == set(range(200))
    signs = [np.sign(white[0, c]) * np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == c + 1)) for c in range(5)]
    for r in got:
        c = r.component - 1
        assert r.n == n and int(r.deviation) == deviation[r.vec_id]
        assert r.whitened * signs[c] == pytest.approx(white[r.vec_id, c], abs=1e-9)
        assert r.explained == pytest.approx(explained[c], rel=1e-12)
        assert 0 <= r.identity_error < 1e-9


def test_equal_eigenvalues_and_lost_dimensions(spark):
    # Two dimensions of equal spread without correlation, one constant, one a copy: eigenvalues a, b, b, 0, 0.
    good = [[x, y, z, 5.0, 2 * x] for x, y, z in itertools.product([0.0, 1.0], [0.0, 3.0], [0.0, 3.0])]
    rows = wh.fit_list(frame(spark, good), "vec_id", "embedding")
    model = wh.fit(rows, 5)
    assert len(model.values) == 3 and model.values[0] == model.values[1] > model.values[2]
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(3), atol=1e-15)
    assert wh.identity_error(rows, model) < 1e-12


def test_close_eigenvalues_keep_their_components():
    """Eigenvalues a part in 1e13 apart: a solver in doubles mixes their vectors, the exact way does not."""
    big = 10**13
    basis = [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]  # orthogonal, of square length 4
    roots = [big + 1, big, 7, 0]
    matrix = [[sum(r * u[i] * u[j] for r, u in zip(roots, basis, strict=True)) for j in range(4)] for i in range(4)]
    trace = sum(matrix[i][i] for i in range(4))
    want = {4 * r for r in roots}
    polynomial = [1]
    for r in want:
        polynomial = [b - r * a for a, b in zip([*polynomial, 0], [0, *polynomial], strict=True)]
    found = wh.polynomials_mod(matrix, wh.primes_below(1 << 31, 3))
    for q, residues in zip(wh.primes_below(1 << 31, 3), found, strict=True):
        assert [c % q for c in polynomial] == residues.tolist()
    got, shift = wh.largest_roots(polynomial, trace, 4)
    assert got == [4 * r << shift for r in roots[:3]]
    for root, own in zip(got, basis, strict=False):
        shifted = [[(v << shift) - (root if r == c else 0) for c, v in enumerate(row)] for r, row in enumerate(matrix)]
        vector = np.array([x / (1 << wh.WORK) for x in wh.null_vectors(shifted, 1)[0]])
        assert np.abs(np.abs(vector @ np.array(own) / 2) - 1) < 1e-15


def test_polynomial_of_awkward_matrices(spark):
    """Zero columns below the diagonal need exchanges, or none at all; roots come with their multiplicity."""
    for matrix, want in [
        ([[2, 0, 0], [0, 2, 0], [0, 0, 5]], [5, 2, 2]),
        ([[1, 0, 1], [0, 3, 0], [1, 0, 1]], [3, 2]),
        ([[4]], [4]),
    ]:
        polynomial = wh.characteristic(spark, matrix)
        got, shift = wh.largest_roots(polynomial, sum(matrix[i][i] for i in range(len(matrix))), 9)
        assert got == [w << shift for w in want]


def test_sums_of_products_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for top in (100, 1 << 30, 1 << 61):
        x = rng.integers(-top, top, (5000, 3))
        exact = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert wh.products(x).tolist() == exact


def test_nothing_to_whiten(spark):
    assert wh.whitened(frame(spark, []).limit(0)).count() == 0
    assert wh.whitened(frame(spark, [None, []])).count() == 0
    assert wh.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0


def test_repeated_rows_and_null_keys(spark):
    df = frame(spark, [[0.0, 1.0], [2.0, 0.5], [0.0, 1.0]])
    df = df.union(df.withColumn("vec_id", F.lit(None).cast("long")))
    got = wh.whitened(df).collect()
    assert len(got) == 12 - 6 and {r.n for r in got} == {6} and sum(r.vec_id is None for r in got) == 3


def test_query(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(300, 40)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = wh.op13_exact_whitening(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 300 * 32
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
