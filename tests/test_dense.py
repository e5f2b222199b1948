"""Gradients, minima and passes of the block-summed softmax models."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recordlab.operators import dense as D


def table(spark, n=150, width=4, classes=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    y = np.minimum((x[:, 0] + r.normal(size=n) / 2 > 0).astype(int) + (x[:, 1] + r.normal(size=n) / 2 > 0), classes - 1)
    w = r.choice([0.5, 1.0, 2.0], n)
    rows = [(a.tolist(), float(b), float(c), i % 2) for i, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "x array<double>, label_index double, weight double, fold int")
    return df.select(array_to_vector("x").alias("features"), "label_index", "weight", "fold"), x, y, w


@pytest.mark.parametrize("layers", [[4, 3], [4, 5, 3], [4, 6, 5, 2]])
def test_gradient_by_differences(layers):
    r = np.random.default_rng(1)
    shapes = D.shapes_of(layers)
    flat = r.normal(size=sum(a * b for a, b in shapes))
    x, y, w = r.normal(size=(20, 4)), r.integers(layers[-1], size=20), r.random(20)
    _, g = D.loss_and_gradient(flat, shapes, x, y, w)
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        d = (D.loss_and_gradient(flat + e, shapes, x, y, w)[0] - D.loss_and_gradient(flat - e, shapes, x, y, w)[0]) / 2e-6
        assert d == pytest.approx(g[i], abs=1e-6)
    assert D.penalised(shapes).sum() == sum((a - 1) * b for a, b in shapes)


def test_sums_do_not_depend_on_blocks(spark, monkeypatch):
    df, x, y, w = table(spark)
    shapes = D.shapes_of([4, 5, 3])
    flat = np.random.default_rng(2).normal(size=sum(a * b for a, b in shapes))

    def each(rows, sent, total):
        loss, g = D.loss_and_gradient(sent, shapes, rows.x, rows.y, rows.w)
        total += np.pad(np.append(g, loss), (0, len(total) - len(g) - 1))

    loss, g = D.loss_and_gradient(flat, shapes, x, y, w)
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)
    for parts in (1, 5):
        got = D.summed(D.to_blocks(df.repartition(parts), "features", "label_index", "weight"), flat, each, len(flat) + 1)
        assert np.abs(got - np.append(g, loss)).max() < 1e-9


@pytest.mark.parametrize("lasso", [False, True])
def test_regressions_in_step(spark, lasso):
    """The slope of every fit is zero at its end, as many passes serve all, and a fit equals the
    library's on the same objective."""
    df, x, y, w = table(spark)
    configs = [{"C": c, "penalty": "l1" if lasso else "l2"} for c in (0.02, 1.0)]
    blocks = D.to_blocks(df, "features", "label_index", "weight", "fold")
    found, rounds = D.fit_regressions(blocks, 4, 3, configs, [0, 1])
    assert len(found) == 4 and rounds < 150
    shapes = D.shapes_of([4, 3])
    free = D.penalised(shapes)
    for (part, c), flat in found.items():
        mine = np.arange(len(y)) % 2 == part
        strength = 1 / (configs[c]["C"] * mine.sum())
        _, g = D.loss_and_gradient(flat, shapes, x[mine], y[mine], w[mine])
        g = g / w[mine].sum() + (0 if lasso else strength * free * flat)
        assert np.abs(D._slope(flat, g, free * strength * lasso)).max() < 2e-6
        model = LogisticRegression(
            labelCol="label_index", weightCol="weight", family="multinomial", maxIter=1000, tol=1e-12,
            regParam=strength, elasticNetParam=float(lasso), standardization=False,
        ).fit(df.where(F.col("fold") == part))
        own = D._outputs(D.split(flat, shapes), x)[-1]
        theirs = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
        theirs = np.exp(theirs - theirs.max(axis=1, keepdims=True))
        assert np.abs(own - theirs / theirs.sum(axis=1, keepdims=True)).max() < 1e-3
    if lasso:
        assert (found[0, 0] == 0).sum() > (found[0, 1] == 0).sum()
    pred = D.regression_predictions(blocks, found, 4, 3)
    assert pred.count() == len(y) * 2


def test_perceptron_learns_and_stops(spark, monkeypatch):
    df, x, y, _ = table(spark, 400)
    passes = []
    real = D.summed
    monkeypatch.setattr(D, "summed", lambda *a: passes.append(1) or real(*a))
    model = D.fit_perceptron(df, "features", 4, 3, hidden=(16, 8), step=0.05, epochs=60)
    assert (D.network_shares(model.getOrDefault(model.model), x).argmax(axis=1) == y).mean() > 0.62
    assert len(passes) < 60 * 2  # the validation tenth ended it
    heavy = D.fit_perceptron(df, "features", 4, 3, hidden=(16,), step=0.02, penalty=1e4, epochs=10)
    size = lambda m: np.abs(np.concatenate([x[:-1].ravel() for x in D.loaded(m.getOrDefault(m.model), D._unpacked)["weights"]])).mean()
    assert size(heavy) < size(model) / 2
    empty = D.fit_perceptron(df.limit(0), "features", 4, 3)
    assert all(abs(sum(r.probability) - 1) < 1e-12 for r in empty.transform(df).limit(3).collect())


def test_fits_in_step_take_the_passes_of_the_longest():
    """Every fit is answered in every round until it ends."""
    r = np.random.default_rng(4)
    heights = [np.diag(r.uniform(0.5, 20, 6)) for _ in range(5)]
    aims = [r.normal(size=6) for _ in heights]
    value = lambda i, x: (float((x - aims[i]) @ heights[i] @ (x - aims[i])) / 2, heights[i] @ (x - aims[i]))
    l1 = np.array([0, 0, 0, 1.0, 1.0, 5.0])
    run = lambda some: D.in_step({i: D.minimise(np.zeros(6), l1) for i in some}, lambda asked: {i: value(i, x) for i, x in asked.items()})
    found, rounds = run(range(5))
    assert rounds == max(run([i])[1] for i in range(5))
    for i, x in found.items():
        best = np.sign(aims[i]) * np.maximum(np.abs(aims[i]) - l1 / np.diag(heights[i]), 0)
        assert np.abs(x - best).max() < 1e-5


def test_weights_count(spark):
    """Twice the weight of a class is as good as each of its rows twice."""
    df, x, y, w = table(spark, 60)
    twice = df.withColumn("weight", F.when(F.col("label_index") == 1, 2.0).otherwise(1.0))
    copies = df.withColumn("weight", F.lit(1.0))
    copies = copies.unionByName(copies.where("label_index = 1"))
    a, b = (
        D.fit_regressions(D.to_blocks(t, "features", "label_index", "weight"), 4, 3, [{"C": n}], [0])[0][0, 0]
        for t, n in ((twice, 1.0), (copies, 60 / (60 + (y == 1).sum())))
    )
    assert np.abs(a - b).max() < 1e-4


def test_second_derivatives_by_differences():
    r = np.random.default_rng(5)
    shapes = D.shapes_of([4, 3])
    flat = r.normal(size=15)
    x, y, w = r.normal(size=(20, 4)), r.integers(3, size=20), r.random(20)
    h = D.curvature_matrix(D.curvature(flat, shapes, x, w), 4, 3)
    for i in range(15):
        e = np.zeros(15)
        e[i] = 1e-6
        d = (D.loss_and_gradient(flat + e, shapes, x, y, w)[1] - D.loss_and_gradient(flat - e, shapes, x, y, w)[1]) / 2e-6
        assert np.abs(d - h[i]).max() < 1e-6


def test_regressions_take_few_passes(spark, monkeypatch):
    """Second-order steps reach the minimum of the first-order ones."""
    df, x, y, w = table(spark, 300)
    blocks = D.to_blocks(df, "features", "label_index", "weight", "fold")
    configs = [{"C": c, "penalty": p} for c in (0.01, 10.0) for p in ("l1", "l2")]
    found, passes = D.fit_regressions(blocks, 4, 3, configs, [0, 1])
    assert passes <= 15
    monkeypatch.setattr(D, "CURVE_BYTES", 0)
    slow, more = D.fit_regressions(blocks, 4, 3, configs, [0, 1])
    assert more > passes
    for k, flat in found.items():
        a, b = (D._outputs(D.split(f, D.shapes_of([4, 3])), x)[-1] for f in (flat, slow[k]))
        assert np.abs(a - b).max() < 1e-4


def test_sums_of_few_tasks_and_by_exchange_agree(spark, monkeypatch):
    df, x, y, w = table(spark)
    blocks = D.to_blocks(df.repartition(3), "features", "label_index", "weight")
    each = lambda rows, sent, total: total.__setitem__(slice(0, 70), total[:70] + rows.w.sum() * sent)
    sent = np.arange(70.0)
    direct = D.summed(blocks, sent, each, 70, D.task_count(blocks))
    monkeypatch.setattr(D, "DIRECT_BYTES", 0)
    assert np.abs(direct - w.sum() * sent).max() < 1e-9
    assert np.abs(D.summed(blocks, sent, each, 70, 3) - direct).max() < 1e-9
    assert (D.summed(blocks.limit(0), sent, each, 70, 1) == 0).all()
