from __future__ import annotations

import math

import numpy as np
import pytest

import __spark_entry__ as entry_points
from wardstat.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, k=4):
    """The same numbers from a dense eigen decomposition and Python's whole numbers."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = [list(t) for t in sorted({tuple(r) for r in x})]
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    centred = np.array(fit, float) - np.array(s) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    z = (np.array(x, float) - np.array(s) / n) @ vecs[:, order] / np.sqrt(values[order])
    deviation = [sum((n * v - t) ** 2 for v, t in zip(r, s)) for r in x]
    return n, deviation, z, values[order] / values.sum()


def test_query_matches_plain_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, z, share = plain([r.embedding for r in rows])
    place = {r.vec_id: k for k, r in enumerate(rows)}
    found = entry_points.queries()["op13_whitening"](spark, SF).collect()
    assert len(found) == 4 * len(rows)
    sign = {}
    for r in found:
        k = place[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        want = z[k, r.component - 1]
        if abs(want) > 1e-3:
            s = sign.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened * s == pytest.approx(want, rel=1e-8)
        assert 0 <= r.identity_error < 1e-9


def test_edge_vectors(spark):
    rng = np.random.default_rng(3)
    base = [list(map(float, v)) for v in rng.normal(size=(40, 6))]
    rows = [(i, v, "r") for i, v in enumerate(base)] + [(100 + i, base[0], "r") for i in range(500)]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows += [(1000 + i, v, "r") for i, v in enumerate(odd)] + [(None, base[1], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string").repartition(5)
    quantised = whitening.quantised(table)
    kept = [r for r in rows if r[1] in base]
    assert quantised.count() == len(kept)
    model = whitening.fit(quantised)
    n, deviation, z, share = plain([np.float32(r[1]) for r in kept])
    assert model.n == n == 40
    assert np.allclose(model.eigenvalues / model.trace, share, rtol=1e-10)
    found = whitening.whiten(quantised, model).collect()
    assert len(found) == 4 * len(kept)
    assert sorted({r.deviation for r in found}) == sorted(set(deviation))
    assert np.allclose(sorted(abs(r.whitened) for r in found), sorted(np.abs(z).ravel()), atol=1e-9)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]])
def test_low_rank_tables(spark, vectors):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.quantised(table)
    model = whitening.fit(rows)
    rank = 1 if len({tuple(v) for v in vectors}) > 1 else 0
    assert len(model.eigenvalues) == rank and model.identity_error < 1e-9
    assert whitening.whiten(rows, model).count() == rank * len(vectors)


def test_factor_and_rotation():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        a = rng.normal(size=(rank, d)) * 10.0 ** rng.integers(-3, 4, size=(rank, 1))
        c = a.T @ a
        factor, pivots = whitening.pivoted_cholesky(c)
        assert len(factor) <= d and np.allclose(factor.T @ factor, c[np.ix_(pivots, pivots)], rtol=1e-10, atol=1e-10 * c.max())
        assert np.allclose(np.tril(factor, -1), 0)
        values, vectors = whitening.principal_components(c)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][: len(values)], rtol=1e-8, atol=1e-12 * c.max())
        assert np.allclose((vectors.T * values) @ vectors, c, atol=1e-11 * c.max())


def test_exact_deviation_beyond_floats():
    x = np.array([[1 << 12, 3], [-5, 7], [1 << 40, 0]], np.int64)
    sums = ((1 << 28) + 1, 17)
    want = [sum((1001 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert want[2] >= 1 << 63
    assert whitening.exact_deviation(x, 1001, sums) == [w if w < 1 << 63 else None for w in want]
    assert whitening.exact_deviation(x[:2], 1001, sums) == want[:2]
