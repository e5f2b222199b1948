"""Trees grown on Spark against a plain builder on the same bins, on both ways of growing."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recordlab.operators import trees as T


def table(spark, n=240, width=6, classes=3, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, width)), 1)
    y = (x[:, 0] > 0.3).astype(int) + ((x[:, 1] + x[:, 2]) > 0.5)
    w = r.choice([0.5, 1.0, 2.0], n)
    rows = [(a.tolist(), float(min(c, classes - 1)), float(v)) for a, c, v in zip(x, y, w)]
    df = spark.createDataFrame(rows, "x array<double>, label_index double, weight double")
    return df.select(array_to_vector("x").alias("features"), "label_index", "weight"), x, np.minimum(y, classes - 1), w


def plain_boosting(x, y, w, classes, rounds, depth, rate, min_weight, l1, l2=1.0):
    """Every threshold of every feature in turn, recursively; returns margins of the rows."""
    margins = np.zeros((len(x), classes))
    soft = lambda g: math.copysign(max(abs(g) - l1, 0), g)
    for _ in range(rounds):
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)

            def part(rows, level):
                big_g, big_h = g[rows].sum(), h[rows].sum()
                best = (1e-6, None, None)
                for j in range(x.shape[1]) if level < depth else ():
                    for cut in np.unique(x[rows, j])[:-1]:
                        left = rows[x[rows, j] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl < min_weight or big_h - hl < min_weight:
                            continue
                        gain = soft(gl) ** 2 / (hl + l2) + soft(big_g - gl) ** 2 / (big_h - hl + l2) - soft(big_g) ** 2 / (big_h + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, cut)
                if best[1] is None:
                    step[rows, k] = -rate * soft(big_g) / (big_h + l2)
                else:
                    right = x[rows, best[1]] > best[2]
                    part(rows[~right], level + 1)
                    part(rows[right], level + 1)

            part(np.arange(len(x)), 0)
        margins += step
    return margins


@pytest.mark.parametrize("small", [10_000, 60, 1])
@pytest.mark.parametrize("l1, min_weight", [(0.0, 1.0), (0.7, 5.0)])
def test_boosting_equals_a_plain_builder(spark, small, l1, min_weight):
    """Whole trees in tasks, only lower nodes in tasks, and level by level to the end."""
    df, x, y, w = table(spark)
    model = T.fit_boosting(df, "features", 3, trees=2, depth=3, rate=0.3, min_weight=min_weight, l1=l1, small=small)
    want = plain_boosting(x, y, w, 3, 2, 3, 0.3, min_weight, l1)
    m = T.unpacked(model.getOrDefault(model.model))
    codes = T.code_rows(x, m["edges"])
    got = T.add_margins(codes, np.zeros((len(x), 3)), [m["trees"][:3], m["trees"][3:]])
    assert np.abs(got - want).max() < 1e-9


def test_margins_survive_a_refresh(spark, monkeypatch):
    df, x, *_ = table(spark, 80)
    settings = dict(trees=5, depth=2, rate=0.2, subsample=0.8, columns=0.7)
    long = T.fit_boosting(df, "features", 3, **settings)
    monkeypatch.setattr(T, "REFRESH", 2)
    short = T.fit_boosting(df, "features", 3, **settings)
    a, b = (T.class_shares(m.getOrDefault(m.model), x) for m in (long, short))
    assert np.abs(a - b).max() < 1e-12


@pytest.mark.parametrize("small", [10_000, 40])
def test_forest_grows_to_pure_leaves(spark, small):
    df, x, y, _ = table(spark, 200)
    model = T.fit_forest(df, "features", 3, trees=12, depth=50, small=small)
    m = T.unpacked(model.getOrDefault(model.model))
    for feature, cut, left, value in m["trees"]:
        leaves = value[feature < 0]
        assert np.allclose(leaves.sum(axis=1), 1)
        # rows that differ can be told apart: only a node of equal rows may stay mixed
        assert (leaves.max(axis=1) > 0.999).mean() > 0.9
    assert (T.class_shares(model.getOrDefault(model.model), x).argmax(axis=1) == y).mean() > 0.97
    flat = T.fit_forest(df, "features", 3, trees=4, depth=2, min_split=500, small=small)
    assert all((t[0] < 0).all() for t in T.unpacked(flat.getOrDefault(flat.model))["trees"])


def test_min_split_counts_rows(spark):
    df, *_ = table(spark, 200)
    model = T.fit_forest(df, "features", 3, trees=3, depth=None, min_split=30)
    blocks = T.to_blocks(df, "features", "label_index", "weight", T.unpacked(model.getOrDefault(model.model))["edges"], 3)
    rows = list(T._read([b for b in blocks.toArrow().to_batches()], 6))
    for t, (feature, cut, left, _) in enumerate(T.unpacked(model.getOrDefault(model.model))["trees"]):
        inside = np.zeros(len(feature), dtype=int)
        for r in rows:
            part = np.flatnonzero(np.random.default_rng((42, t, r.block)).poisson(1.0, len(r.y)))
            at = T.descend(r.codes[part], feature, cut, left)
            inside += np.bincount(at, minlength=len(feature))
        for node in range(len(feature) - 1, -1, -1):  # children come after their parent
            if feature[node] >= 0:
                inside[node] = inside[left[node]] + inside[left[node] + 1]
                assert inside[node] >= 30


def test_fitted_stage_is_saved_and_scores_odd_rows(spark, tmp_path):
    df, *_ = table(spark, 60)
    model = T.fit_boosting(df, "features", 3, trees=2, depth=2)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    odd = spark.createDataFrame([([math.nan] * 6,), ([1e300] * 6,), ([0.0] * 6,)], "x array<double>")
    odd = odd.select(array_to_vector("x").alias("features"))
    for m in (model, again):
        rows = m.transform(odd).collect()
        assert all(abs(sum(r.probability) - 1) < 1e-12 and r.prediction == int(np.argmax(r.probability)) for r in rows)
    assert model.transform(odd.limit(0)).collect() == []
    empty = T.fit_forest(df.limit(0), "features", 2, trees=2)
    assert {tuple(r.probability) for r in empty.transform(odd).collect()} == {(0.5, 0.5)}
    one = df.withColumn("label_index", F.lit(1.0))
    assert {r.prediction for r in T.fit_forest(one, "features", 3, trees=3).transform(df).collect()} == {1.0}


def test_boosted_leaves_of_full_depth_need_no_pass(spark, monkeypatch):
    """Large nodes are read once a level, and none where the depth ends."""
    df, x, y, w = table(spark)
    passes = []
    level, whole = T._level_pass, T._whole_nodes
    monkeypatch.setattr(T, "_level_pass", lambda *a: passes.append("level") or level(*a))
    monkeypatch.setattr(T, "_whole_nodes", lambda *a: passes.append("whole") or whole(*a))
    model = T.fit_boosting(df, "features", 3, trees=6, depth=2, small=1)
    assert passes == ["level"] * 12
    m = T.unpacked(model.getOrDefault(model.model))
    got = T.add_margins(T.code_rows(x, m["edges"]), np.zeros((len(x), 3)), [m["trees"][i : i + 3] for i in range(0, 18, 3)])
    assert np.abs(got - plain_boosting(x, y, w, 3, 6, 2, 0.3, 1.0, 0.0)).max() < 1e-9


@pytest.mark.parametrize("small", [10_000, 40])
def test_a_deep_forest_is_kept_in_few_bytes_a_node(spark, small):
    r = np.random.default_rng(3)
    rows = [(a.tolist(), float(c), 1.0) for a, c in zip(r.normal(size=(300, 5)), r.integers(3, size=300))]
    df = spark.createDataFrame(rows, "x array<double>, label_index double, weight double")
    df = df.select(array_to_vector("x").alias("features"), "label_index", "weight")
    model = T.fit_forest(df, "features", 3, trees=6, small=small)
    m = T.loaded(model.getOrDefault(model.model), T._unpacked)
    nodes = sum(len(t.feature) for t in m["trees"])
    assert nodes > 600
    assert sum(x.nbytes for t in m["trees"] for x in (t.feature, t.cut, t.left)) <= 7 * nodes
    assert len(m["trees"][0].values) < nodes / 20
    plain = T.unpacked(model.getOrDefault(model.model))["trees"]
    codes = T.code_rows(np.array([a for a, *_ in rows]), m["edges"])
    shares = sum(value[T.descend(codes, f, c, left)] for f, c, left, value in plain) / 6
    assert np.abs(shares - T.class_shares(model.getOrDefault(model.model), np.array([a for a, *_ in rows]))).max() < 1e-12
    # a model saved with a value by node reads the same
    joined = [np.concatenate(c) for c in zip(*plain)]
    old = T.dumped(kind="forest", classes=3, sizes=np.array([len(t[0]) for t in plain]), ends=np.cumsum([len(e) for e in m["edges"]]),
                   edges=np.concatenate(m["edges"]), **dict(zip(("feature", "cut", "left", "value"), joined)))
    assert np.abs(T.class_shares(old, np.array([a for a, *_ in rows])) - shares).max() < 1e-12


def test_long_and_short_histograms_agree(monkeypatch):
    r = np.random.default_rng(6)
    codes, stats = r.integers(256, size=(3000, 5)).astype(np.uint8), r.random((3000, 2))
    long = T.histogram(codes, stats)
    monkeypatch.setattr(T, "LONG", 10**9)
    assert (T.histogram(codes, stats) == long).all()
