"""Whitening (op13) against numpy's eigenvectors of the covariance."""
import math

import numpy as np
import pytest

from marquee.llm import whitening

KIND = "vec_id long, vector array<double>, n string, x string, component string, i string"


@pytest.fixture(scope="module")
def table(spark):
    def build(vectors, ids=None):
        ids = range(len(vectors)) if ids is None else ids
        return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "x", "x", "x", "x")
                                      for i, v in zip(ids, vectors, strict=True)], KIND)
    return build


def check(rows, kept, most=8):
    """Rows of a table without null directions against the plain computation; kept: (vec_id, vector)."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    deviation = {i: int(((n * row - s) ** 2).sum()) for (i, _), row in zip(kept, x)}
    a = ((n * x - s) / n).astype(float)
    value, vector = np.linalg.eigh(a.T @ a / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(most, x.shape[1])
    assert len(rows) == n * k
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, k + 1):
        w = a @ vector[:, c - 1] / np.sqrt(value[c - 1])
        g = np.array([by[i, c].whitened for i, _ in kept])
        assert min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6 * max(1, np.abs(w).max())
        assert abs(by[kept[0][0], c].explained / (value[c - 1] / value.sum()) - 1) < 1e-8
    assert {(r.vec_id, r.deviation) for r in rows} == set(deviation.items())
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_against_numpy(table):
    r = np.random.default_rng(0)
    vectors = (r.normal(size=(700, 20)) * np.linspace(3, 0.2, 20) @ r.normal(size=(20, 20)) + r.normal(size=20) * 5).tolist()
    bad = [None, [], [1.0] * 3, [None] + [1.0] * 19, [math.nan] + [0.0] * 19, [math.inf] + [0.0] * 19, [1e300] + [0.0] * 19]
    rows = whitening.whitened(table(vectors + bad).repartition(5)).collect()
    check(rows, list(enumerate(vectors)))


def test_ill_conditioned(table):
    """Standard deviations from 2**20 to 1: the covariance's condition is 2**40, that of R its root."""
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(400, 5)) * 2.0 ** np.array([20, 15, 10, 5, 0])).tolist()
    t = table(vectors)
    rows = whitening.integers(t)
    n, s = whitening.sums(rows, 5)
    factor, trace, passes = whitening.triangle(rows, 5, n, s)
    a = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], float)
    a -= a.mean(0)
    want = np.linalg.svd(a)[1]
    assert np.abs(np.linalg.svd(factor)[1] / want - 1).max() < 1e-9 and passes >= 3
    assert abs(trace / (want ** 2).sum() - 1) < 1e-12
    assert whitening.whitened(t).first().identity_error < 1e-6


def test_directions_without_variance(table):
    r = np.random.default_rng(2)
    base = r.integers(-9, 9, (300, 3)).astype(float)
    vectors = np.concatenate([base, base[:, :1] * 2 + base[:, 1:2], np.full((300, 2), 7.0)], 1).tolist()
    rows = whitening.whitened(table(vectors)).collect()
    assert {x.component for x in rows} == {1, 2, 3} and rows[0].identity_error < 1e-9
    assert abs(sum(x.explained for x in rows if x.vec_id == 0) - 1) < 1e-9


def test_few_and_repeated_rows(table):
    assert whitening.whitened(table([])).collect() == []
    assert whitening.whitened(table([None, [None]])).collect() == []
    assert whitening.whitened(table([[1.0, 2.0]])).collect() == []
    assert whitening.whitened(table([[1.0, 2.0]] * 9)).collect() == []
    ids = [1, 1, 1, None, 2]
    rows = whitening.whitened(table([[0, 0], [0, 0], [1, 3], [2, 5], [3, 1]], ids)).collect()
    assert sorted(x.vec_id or 0 for x in rows) == [0, 0, 1, 1, 1, 1, 1, 1, 2, 2] and {x.n for x in rows} == {5}


def test_deviations_beyond_a_long(table):
    big = float(1 << 35)
    rows = whitening.whitened(table([[0.0, 1.0], [big, 2.0], [1.0, -3.0]])).collect()
    assert {x.vec_id: x.deviation for x in rows} == {0: None, 1: None, 2: None}
