from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from verdure.llm.feast import _brackets, below, leading_eigenpairs, tridiagonal
from verdure.llm.queries import op12
from verdure.llm.whitening import fit_whitening, quantised, whiten


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


SPECTRA = {
    "spread": [100, 50, 3, 1, 0.5, 0.1, 1e-3, 1e-6],
    "even": list(np.linspace(1, 2, 64)),
    "close": [1 + 1e-7, 1, 1 - 1e-7, 0.5, 0.2],
    "equal": [2, 2, 2, 2, 2, 1],
    "all equal": [3] * 6,
    "tie at the end": [5, 4, 3, 2, 2, 2, 1],
    "low rank": [7, 1, 0, 0, 0, 0],
    "tiny": [1e-200, 1e-201, 1e-205],
    "huge": [1e200, 1e199, 1e190, 1],
    "one": [4.0],
    "two": [4.0, 4.0],
    "noise": list(np.random.default_rng(1).random(100)),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs(name):
    matrix = symmetric(SPECTRA[name])
    expected = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    for k in (1, 4, len(matrix)):
        values, vectors = leading_eigenpairs(matrix, k)
        k = min(k, len(matrix))
        norm = np.abs(matrix).max()
        assert vectors.shape == (len(matrix), k)
        assert np.allclose(values / norm, expected[:k] / norm, atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)
        assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * norm * math.sqrt(len(matrix))


def test_zero_and_empty_matrices():
    values, vectors = leading_eigenpairs(np.zeros((3, 3)), 2)
    assert values.tolist() == [0, 0] and vectors.shape == (3, 2)


def test_inertia_counts_every_eigenvalue():
    matrix = symmetric(SPECTRA["noise"])
    diagonal, beside = tridiagonal(matrix)
    shifts = np.linspace(-0.1, 1.1, 37)
    expected = [(np.linalg.eigvalsh(matrix) < s).sum() for s in shifts]
    assert below(diagonal, beside, shifts).tolist() == expected
    low, high = _brackets(diagonal, beside)
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    assert ((low <= values + 1e-12) & (values <= high + 1e-12)).all()


SCHEMA = "vec_id long, embedding array<float>"


def run(df, k=4):
    vectors = quantised(df, "vec_id", "embedding")
    model = fit_whitening(vectors, k)
    return model, [] if model is None else whiten(vectors, model).collect()


def check(rows, k, model, got):
    """Against exact sums and a dense eigensolver."""
    usable = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = {i: [math.floor(256 * float(np.float32(e))) for e in v] for i, v in usable}
    distinct = sorted({tuple(v) for v in x.values()})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[j] for v in distinct) for j in range(d)]
    assert (model.n, list(model.sums)) == (n, sums)
    c = np.array([[float(Fraction(v[j] * n - sums[j], n)) for j in range(d)] for v in distinct])
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    assert np.allclose(model.eigenvalues, e, rtol=1e-12, atol=1e-12 * e[0])
    assert sorted(r.key for r in got) == sorted(x)
    signs = np.sign((model.components * w).sum(axis=0))
    for r in got:
        v = x[r.key]
        assert r.deviation == sum((n * v[j] - sums[j]) ** 2 for j in range(d))
        y = np.array([float(Fraction(v[j] * n - sums[j], n)) for j in range(d)]) @ w / np.sqrt(e) * signs
        assert np.allclose(np.array(r.whitened), y, rtol=1e-9, atol=1e-9)


def test_against_a_dense_solver_with_repeats_and_unusable_rows(frame):
    rng = np.random.default_rng(3)
    scale = np.array([9, 5, 3, 2, 1, 0.5])
    rows = [(i, (rng.standard_normal(6) * scale).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(2000, [-0.0] * 6)]
    bad = [(1, None), (2, []), (3, [1.0, None] + [0.0] * 4), (4, [float("nan")] * 6), (5, [float("-inf")] + [0.0] * 5), (6, [1.0, 2.0])]
    rows = [(i + 10, v) for i, v in rows]
    model, got = run(frame(rows + bad, SCHEMA).repartition(5))
    check(rows, 4, model, got)
    assert model.identity_error < 1e-12


def test_null_and_repeated_keys_and_clashing_columns(frame):
    rows = [(None, [1.0, 2.0], 1, "x"), (None, [2.0, 0.0], 2, "y"), (7, [0.0, 5.0], 3, "z"), (7, [0.0, 5.0], 3, "z")]
    model, got = run(frame(rows, SCHEMA + ", key int, x string"))
    assert model.n == 3 and sorted(str(r.key) for r in got) == ["7", "7", "None", "None"]
    assert all(len(r.whitened) == 2 for r in got)


def test_without_variance_and_with_less_rank(frame):
    model, got = run(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA))
    assert model.n == 1 and model.identity_error is None and model.explained == [None, None]
    assert [(r.deviation, r.whitened) for r in got] == [(0, [None, None])] * 2
    model, got = run(frame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], SCHEMA))
    assert model.usable.tolist() == [True, False, False] and model.identity_error < 1e-12
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got)


def test_very_large_entries(frame):
    rows = [(i, [float(2.0 ** (30 + i)), 1.0, -float(2.0**40)]) for i in range(8)]
    model, got = run(frame(rows, SCHEMA))
    distinct = [[math.floor(256 * e) for e in v] for _, v in rows]
    sums = [sum(v[j] for v in distinct) for j in range(3)]
    exact = {i: sum((8 * distinct[i][j] - sums[j]) ** 2 for j in range(3)) for i in range(8)}
    assert {r.key: r.deviation for r in got} == {i: e if e < 1 << 63 else None for i, e in exact.items()}
    _, got = run(frame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], SCHEMA))
    assert [r.deviation for r in got] == [None, None]


def test_empty_table(frame):
    model, got = run(frame([], SCHEMA))
    assert model is None and got == []
    assert run(frame([(1, None)], SCHEMA))[0] is None


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors = quantised(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    model = fit_whitening(vectors)
    check(rows, 4, model, whiten(vectors, model).collect())
    out = op12(spark, sf).collect()
    assert len(out) == 4 * len(rows)
    assert {r.component for r in out} == {1, 2, 3, 4} and all(r.identity_error <= 1e-10 for r in out)
    share = {r.component: r.explained for r in out}
    assert [share[k] for k in (1, 2, 3, 4)] == pytest.approx(list(model.eigenvalues / model.trace))
