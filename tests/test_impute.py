import numpy as np
import pytest

from recordlab.operators import impute
from recordlab.operators.impute import knn_impute


def brute(x, donors, k):
    width, out = x.shape[1], x.copy()
    has, has_d = ~np.isnan(x), ~np.isnan(donors)
    for i in np.flatnonzero(~has.all(axis=1)):
        shared = has_d & has[i]
        gap = np.where(shared, np.nan_to_num(donors - x[i]), 0.0)
        n = shared.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(n > 0, (gap**2).sum(axis=1) * width / n, np.inf)
        for c in np.flatnonzero(~has[i]):
            pool = np.flatnonzero(has_d[:, c] & np.isfinite(d))
            if len(pool):
                best = pool[np.lexsort((donors[pool, c], d[pool]))][:k]
                out[i, c] = donors[best, c].mean()
            elif has_d[:, c].any():
                out[i, c] = np.nanmean(donors[:, c])
    return out


def make(seed, n, width, missing, whole=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 30, size=(n, width)).astype(float)
    if not whole:
        x += rng.normal(size=x.shape)
    x[rng.random(x.shape) < missing] = np.nan
    return x


def frame(spark, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    schema = "rec_id INT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    return spark.createDataFrame(rows, schema), columns


def values(df, columns):
    rows = sorted(df.collect(), key=lambda r: r["rec_id"])
    return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows])


CASES = {
    "ties": (make(1, 300, 3, 0.3), 5, 16),
    "real": (make(2, 250, 5, 0.4, False), 3, 16),
    "many patterns": (make(3, 200, 9, 0.5), 5, 32),
    "one block": (make(4, 60, 4, 0.3), 5, 512),
    "few donors": (make(5, 12, 3, 0.6), 5, 4),
    # a third of all rows are copies of one row, which also misses a value
    "hot copies": (np.vstack([np.tile([3.0, np.nan, 7.0], (100, 1)), make(6, 200, 3, 0.3)]), 5, 16),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    x, k, leaf = CASES[name]
    df, columns = frame(spark, x)
    got = values(knn_impute(df, columns, k, min_block_rows=leaf), columns)
    assert np.allclose(got, brute(x, x, k), equal_nan=True, rtol=0, atol=1e-9)


def test_far_blocks_are_skipped_without_loss(spark):
    # two clusters far apart: pruning must cut pairs and keep the answer
    x = make(7, 400, 3, 0.2, False)
    x[200:] += 1e6
    df, columns = frame(spark, x)
    seen = []
    original = impute._match

    def spy(pairs, *rest):
        seen.append(pairs.count())
        return original(pairs, *rest)

    impute._match = spy
    try:
        got = values(knn_impute(df, columns, 5, min_block_rows=16), columns)
    finally:
        impute._match = original
    assert np.allclose(got, brute(x, x, 5), rtol=0, atol=1e-6)
    blocks = 400 // 16
    assert seen[1] < blocks * blocks * 0.7


def test_empty_column_stays_null_and_untouched_rows_stay(spark):
    x = make(8, 50, 3, 0.2)
    x[:, 1] = np.nan
    df, columns = frame(spark, x)
    got = values(knn_impute(df, columns, 5), columns)
    assert np.isnan(got[:, 1]).all()
    assert np.allclose(got[:, [0, 2]], brute(x[:, [0, 2]], x[:, [0, 2]], 5), equal_nan=True)


@pytest.mark.parametrize("leaf", [8, 64, 512])
def test_donors_from_training_rows(spark, leaf):
    x = make(9, 300, 4, 0.25)
    df, columns = frame(spark, x)
    train = np.random.default_rng(9).random(len(x)) < 0.4
    ids = [int(i) for i in np.flatnonzero(train)]
    donors = df.where(df.rec_id.isin(ids))
    got = values(knn_impute(df, columns, 5, fit_on=donors, min_block_rows=leaf), columns)
    assert np.allclose(got, brute(x, x[train], 5), rtol=0, atol=1e-9)


def test_scaled_distance(spark):
    x = make(10, 150, 3, 0.3, False)
    x[:, 0] *= 1000
    unit = np.nanstd(x, axis=0)
    df, columns = frame(spark, x)
    got = values(knn_impute(df, columns, 5, scale=True, min_block_rows=16), columns)
    assert np.allclose(got, brute(x / unit, x / unit, 5) * unit, rtol=1e-9)


def test_hot_vectors_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(impute, "HOT_COPIES", 20)
    x, k, leaf = CASES["hot copies"]
    df, columns = frame(spark, x)
    got = values(knn_impute(df, columns, k, min_block_rows=leaf), columns)
    assert np.allclose(got, brute(x, x, k), equal_nan=True, rtol=0, atol=1e-9)


def test_result_does_not_depend_on_partitioning(spark):
    x = make(11, 200, 4, 0.4)
    df, columns = frame(spark, x)
    one = values(knn_impute(df.coalesce(1), columns, 5, min_block_rows=64), columns)
    many = values(knn_impute(df.repartition(9), columns, 5, min_block_rows=8), columns)
    assert np.array_equal(one, many)


def test_ties_leave_few_entries(spark, monkeypatch):
    # few different values: rows that share one column tie at distance 0 with donors of every block
    rng = np.random.default_rng(12)
    x = rng.integers(1, 12, size=(700, 6)).astype(float)
    x[rng.random(x.shape) < 0.5] = np.nan
    df, columns = frame(spark, x)
    seen = []
    original = impute._best

    def spy(candidates, k):
        seen.append(candidates.count())
        return original(candidates, k)

    monkeypatch.setattr(impute, "_best", spy)
    got = values(knn_impute(df, columns, 5, min_block_rows=8), columns)
    assert np.allclose(got, brute(x, x, 5), equal_nan=True, rtol=0, atol=1e-9)
    # no more than a few times the five entries that a cell needs, whatever the number of blocks
    assert max(seen) < 3 * 5 * np.isnan(x).sum()


def test_rows_are_bounded_by_each_donor_block():
    rng = np.random.default_rng(14)
    r, x = make(15, 40, 5, 0.4, False), make(16, 60, 5, 0.4, False)
    # columns that all donors have bound the distance
    x[:, :2] = rng.normal(size=(60, 2)) * 30
    parts = np.array_split(x, 6)
    donors = impute._Donors([(str(i), p, np.ones(len(p), np.int64)) for i, p in enumerate(parts)], 5)
    low = donors.lower_bounds(r, np.arange(6))
    assert low.shape == (40, 6)
    for i, part in enumerate(parts):
        assert (low[:, i] <= impute._distances(r, part).min(axis=1)).all()
    # rows differ inside their block, so their bounds do
    assert len(np.unique(low)) > 6


def test_second_pass_meets_in_large_tiles(spark):
    x = make(17, 700, 5, 0.5)
    df, columns = frame(spark, x)
    seen = []
    original = impute._match

    def spy(pairs, *rest):
        seen.append((pairs.count(), pairs.select("tile").distinct().count()))
        return original(pairs, *rest)

    impute._match = spy
    try:
        got = values(knn_impute(df, columns, 5, min_block_rows=8), columns)
    finally:
        impute._match = original
    assert np.allclose(got, brute(x, x, 5), equal_nan=True, rtol=0, atol=1e-9)
    (_, alone), (pairs, tiles) = seen
    # a tile holds many pairs, so a block of donors travels to few tasks
    assert tiles < alone and tiles * 8 < pairs
