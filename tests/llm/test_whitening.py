"""Whitening against a dense eigen decomposition, and the solver on operators of its own."""

import math

import numpy as np
import pytest
from factloom.llm import catalog, whitening
from factloom.llm.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    c = (exact / n).astype(float)
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return (exact ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(cov)


def check(rows, ids, vectors, components):
    deviation, white, explained = plain(vectors, components)
    assert len(rows) == len(vectors) * components
    at = {(r.vec_id, r.component): r for r in rows}
    for j in range(components):
        got = np.array([at[i, j + 1].whitened for i in ids])
        sign = np.sign(got @ white[:, j])
        assert np.allclose(got * sign, white[:, j], rtol=0, atol=1e-7)
        assert abs(at[ids[0], j + 1].explained / explained[j] - 1) < 1e-10
    assert all(at[i, 1].deviation == d and at[i, 1].n == len(ids) for i, d in zip(ids, deviation))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whole_table_against_plain(spark):
    rows = catalog.op13_whitening(spark, SF)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(rows.dtypes)["deviation"] == "bigint"
    data = [r for r in table(spark, SF, "embeddings").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(rows.collect(), [r.vec_id for r in data], [r.embedding for r in data], 8)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.standard_normal(3) * (3, 2, 1)]) for i in range(40)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, math.nan, 2.0]), (54, [1.0, -math.inf, 2.0]), (55, [1.0, 2.0]), (56, [1.0, 2.0, 1e300])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in good + bad], SCHEMA + ", component int, x double").repartition(4)
    check(whitening.whiten(frame).collect(), [i for i, _ in good], [v for _, v in good], 3)
    for some in ([], [(1, None)], good[:1], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        none = whitening.whiten(spark.createDataFrame(some, SCHEMA))
        assert none.count() == 0 and none.columns[0] == "vec_id"


def test_repeated_ids_and_missing_variance(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 2.0]), (None, [0.0, 4.0]), (None, [0.0, 4.0])], SCHEMA)).collect()
    assert [r.component for r in rows] == [1] * 4 and sorted(abs(r.whitened) for r in rows)[-1] > 1
    assert math.isclose(sum(r.whitened ** 2 for r in rows) / 4, 1) and all(math.isclose(r.explained, 1) for r in rows)


def test_deviation_beyond_longs_is_exact(spark):
    vectors = [[2.0 ** 38, 1.0], [-(2.0 ** 38), 2.0], [5.0, 3.0]]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect()
    assert {(r.vec_id, int(r.deviation)) for r in rows} == set(enumerate(plain(vectors)[0]))


@pytest.mark.parametrize("dimensions, wanted", [(1, 1), (3, 3), (30, 8), (200, 8)])
def test_solver(dimensions, wanted):
    a = np.random.default_rng(dimensions).standard_normal((2 * dimensions + 1, dimensions))
    matrix = a.T @ a
    values, vectors, passes = whitening.largest_pairs(lambda w: matrix @ w, dimensions, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:wanted], rtol=1e-13)
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12) and passes < 150


def test_solver_with_equal_values():
    values, vectors, _ = whitening.largest_pairs(lambda w: np.diag([3.0, 3, 3, 2, 0, 0, 0]) @ w, 7, 6, 1e-9)
    assert np.allclose(values, [3, 3, 3, 2]) and vectors.shape == (7, 4)


def test_minres_solves_each_column():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    matrix = q @ np.diag(np.r_[-3:0, 1:10]) @ q.T
    right = np.c_[rng.standard_normal((12, 3)), np.zeros(12)]
    assert np.allclose(matrix @ whitening.minres(lambda w: matrix @ w, right, 12), right, atol=1e-8)
