"""Whitening against numpy's eigenvectors, and its edge cases."""

import math

import numpy as np
import pytest

from recordlab.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, id string, n string, v string, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, x, "a", "b", "c", "d") for i, x in vectors], SCHEMA)


def expected(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)) + 100_000
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    return x.astype(object), y, e[::-1], u[:, ::-1], e.sum()


@pytest.mark.parametrize("width, block", [(5, 32), (40, 8)])
def test_equals_numpy(spark, width, block):
    r = np.random.default_rng(width)
    rows = (r.normal(size=(300, width)) * np.linspace(3, 0.2, width)).astype(np.float32).tolist()
    bad = [None, [], [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1)]
    got = whitening.whiten(frame(spark, list(enumerate(rows + bad))), block=block).collect()
    x, y, e, u, trace = expected(rows)
    k = min(8, width)
    assert len(got) == 300 * k and {r.n for r in got} == {300}
    sums = x.sum(axis=0)
    for c in range(k):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        w = np.array([own[i].whitened for i in range(300)])
        want = y @ u[:, c] / math.sqrt(e[c])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8
        assert abs(own[0].explained - e[c] / trace) < 1e-9 and own[0].identity_error < 1e-9
        assert all(own[i].deviation == sum((300 * a - s) ** 2 for a, s in zip(x[i], sums)) for i in range(300))


def test_repeated_rows_and_low_rank(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [3.0, 2.0, 0.0]), (2, [5.0, 2.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert [r.component for r in got] == [1] * 4 and sum(r.vec_id is None for r in got) == 1
    assert abs(sum(r.whitened**2 for r in got) / 4 - 1) < 1e-12
    assert all(r.explained == pytest.approx(1) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_widths_must_agree(spark):
    with pytest.raises(Exception, match="differ in width"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


@pytest.mark.parametrize(
    "values",
    [np.geomspace(1e9, 1e-3, 120), np.r_[1e8, 1e4, np.linspace(2, 1, 118)], np.r_[np.ones(5), np.zeros(115)],
     np.ones(120), np.r_[np.linspace(1.1, 1.09, 8), np.ones(112)]],
)
def test_spectra(values):
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(120, 120)))[0]
    matrix = (turn * values) @ turn.T
    theta, q, residual, passes = whitening.leading(lambda m: matrix @ m, 120, 8, 24)
    assert np.abs(theta[:8] - np.sort(values)[::-1][:8]).max() <= 1e-9 * values.max()
    live = values[np.argsort(-values)][:8] > 0
    assert np.abs(theta[:8][live] / np.sort(values)[::-1][:8][live] - 1).max() < 1e-6
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12 and passes < 200
