import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlab.operators import metrics as M
from recordlab.operators import resample as R
from recordlab.operators.bootstrap import bootstrap_ci, bootstrap_replicates, resample_exact
from recordlab.operators.reports import run_report
from recordlab.operators.splits import add_weights, class_weights

CLASSES = [0, 1, 2]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        label = rng.choice([0, 0, 0, 1, 2])
        scores = [round(rng.random() + 0.4 * (k == label), 1) for k in CLASSES]
        rows.append((i, label, max(CLASSES, key=lambda k: scores[k]), scores, i % 3))
    return rows


@pytest.fixture(scope="module")
def pred(spark, data):
    return spark.createDataFrame(data, "rec_id INT, label INT, pred INT, scores ARRAY<DOUBLE>, fold INT")


def pair_auc(pos, neg):
    pos, neg = np.asarray(pos)[:, None], np.asarray(neg)[None, :]
    return ((pos > neg) + 0.5 * (pos == neg)).mean()


def rates(rows, c):
    tp = sum(r[1] == c == r[2] for r in rows)
    fn = sum(r[1] == c != r[2] for r in rows)
    fp = sum(r[2] == c != r[1] for r in rows)
    tn = len(rows) - tp - fn - fp
    div = lambda a, b: a / b if b else 0.0
    return {"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn),
            "sensitivity": div(tp, tp + fn), "specificity": div(tn, tn + fp), "n": tp + fn}


@pytest.mark.parametrize("per_bucket", [7, 100_000])
def test_auc_is_the_pair_statistic(pred, data, per_bucket):
    got = {(r["fold"], r["cls"]): r["auc"] for r in M.auc_per_class(pred, CLASSES, ["fold"], rows_per_bucket=per_bucket).collect()}
    for fold in range(3):
        part = [r for r in data if r[4] == fold]
        for c in CLASSES:
            want = pair_auc([r[3][c] for r in part if r[1] == c], [r[3][c] for r in part if r[1] != c])
            assert abs(got[fold, c] - want) < 1e-12
    micro = M.auc_micro(pred, CLASSES, rows_per_bucket=per_bucket).first()[0]
    pos = [r[3][r[1]] for r in data]
    neg = [r[3][c] for r in data for c in CLASSES if c != r[1]]
    assert abs(micro - pair_auc(pos, neg)) < 1e-12


def test_roc_points(pred):
    points = M.roc_points(pred, CLASSES, rows_per_bucket=5).where("cls = 1").collect()
    curve = sorted((r["fpr"], r["tpr"]) for r in points)
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(curve, curve[1:]))
    x, y = np.array(curve).T
    auc = M.auc_per_class(pred, CLASSES).where("cls = 1").first()["auc"]
    assert abs(np.trapezoid(y, x) - auc) < 1e-12


def test_summary(pred, data):
    row = M.summary(pred).first()
    every = [rates(data, c) for c in CLASSES]
    for name in M.RATES:
        assert abs(row[f"{name}_macro"] - np.mean([e[name] for e in every])) < 1e-12
        assert abs(row[f"{name}_weighted"] - np.average([e[name] for e in every], weights=[e["n"] for e in every])) < 1e-12
    assert row["n"] == len(data)


def test_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "label INT, pred INT")
    seen = M.summary(df).first()
    assert seen["f1_macro"] == pytest.approx((2 / 3 + 0) / 2)
    full = M.summary(df, classes=[0, 1, 2, 3]).first()
    assert full["f1_macro"] == seen["f1_macro"]
    # classes 2 and 3 count with sensitivity 0 and specificity 1
    assert full["sensitivity_macro"] == pytest.approx(0.5 / 4)
    assert full["specificity_macro"] == pytest.approx((0 + 0.5 + 1 + 1) / 4)


def test_grid_and_norm(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "label INT, pred INT")
    cells = M.confusion_grid(M.confusion(df), [0, 1])
    got = {(r["label"], r["pred"]): (r["n"], r["percent"]) for r in M.confusion_norm(cells).collect()}
    assert got == {(0, 0): (1, 33.3), (0, 1): (2, 66.7), (1, 0): (0, None), (1, 1): (0, None)}


def test_class_without_positives_has_no_auc(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 0, [0.8, 0.3])], "label INT, pred INT, scores ARRAY<DOUBLE>")
    row = M.evaluate(df, [0, 1]).first()
    # no class has both sides, so the average falls back on the micro area
    assert row["auc_micro"] == 1.0 and row["auc_macro"] == 1.0


def test_report(spark, pred):
    rows = M.evaluate(pred.withColumn("algorithm", F.lit("A")), CLASSES, ["algorithm", "fold"])
    both = rows.unionByName(rows.withColumn("algorithm", F.lit("B")))
    tables = run_report(spark, both, {"B": ({"C": 1}, 0.5), "A": ({}, None)})
    assert tables["best"].first()["algorithm"] == "B"  # equal means: the first of the given order
    std = tables["cv_summary"].where("algorithm = 'A'").first()["accuracy_std"]
    assert std == pytest.approx(np.std([r["accuracy"] for r in rows.collect()]))


def test_config_rank_prefers_the_steady_one(spark):
    rows = [("a", 0, 0.4), ("a", 1, 0.6), ("b", 0, 0.5), ("b", 1, 0.5), ("c", 0, 0.1), ("c", 1, 0.2)]
    df = spark.createDataFrame(rows, "config STRING, fold INT, score DOUBLE")
    assert [r["config"] for r in M.config_rank(df).orderBy("rank").collect()] == ["b", "a", "c"]


def test_weights(spark, pred):
    weights = {r["label"]: (r["n"], r["weight"]) for r in class_weights(pred).collect()}
    assert sum(n * w for n, w in weights.values()) == pytest.approx(600)
    assert add_weights(pred).where("label = 1").first()["weight"] == weights[1][1]


def test_exact_resampling_draws_n_rows(pred):
    sample = resample_exact(pred, "rec_id", 5)
    assert {r["w"] for r in sample.groupBy("replicate").agg(F.sum("w").alias("w")).collect()} == {600}


def test_vector_counts_are_a_multinomial_draw(pred):
    """Counts of every replicate add up to n, whatever the buckets; their spread is the draw's."""
    for bucket_rows in (4096, 37):
        rows = R.counted_rows(pred, "rec_id", 300, 1, bucket_rows)
        w = R._vectors(rows.select("w").toArrow().column(0).combine_chunks())
        assert w.shape == (600, 300) and (w.sum(axis=0) == 600).all()
        assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - (1 - 1 / 600)) < 0.02
        assert abs(np.corrcoef(w[:100].sum(axis=0), w[100:].sum(axis=0))[0, 1] + 1) < 1e-9
    sizes = np.array([5, 0, 7, 1, 30])
    parts = [R.bucket_totals(sizes, b, np.full(50, 43), 3) for b in range(5)]
    assert (np.sum(parts, axis=0) == 43).all() and parts[1].sum() == 0


def test_vector_metrics_equal_weighted_metrics(spark, pred):
    """Cells and areas of some replicates against the ordinary operators on weighted rows."""
    rows = R.counted_rows(pred, "rec_id", 6, 2, 50)
    local = rows.toArrow().to_pylist()
    long = [(i, r["label"], r["pred"], r["scores"], int(w)) for r in local for i, w in enumerate(np.frombuffer(r["w"], dtype=np.int32)) if w]
    sample = spark.createDataFrame(long, "replicate bigint, label int, pred int, scores array<double>, w bigint")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(R.cells_of(rows), M.confusion(sample, ["replicate"], "w"))
    want = {(r.replicate, r.cls): r for r in M.auc_per_class(sample, CLASSES, ["replicate"], "w").collect()}
    for score_rows in (10_000, 90):
        got = {(r.replicate, r.cls): r for r in R.class_areas(rows, pred, CLASSES, score_rows).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k].auc - want[k].auc) < 1e-12 and got[k].P == want[k].P for k in want)


@pytest.mark.parametrize("mode", ["exact", "poisson", "vector"])
def test_intervals_cover_the_estimate(pred, mode):
    got = {(r["average"], r["metric"]): r for r in bootstrap_ci(pred, CLASSES, n=60, mode=mode).collect()}
    assert len(got) == 14
    row = M.evaluate(pred, CLASSES).first()
    for (average, metric), stem in {("macro", "AUC"): "auc_macro", ("weighted", "F1_Score"): "f1_weighted", ("macro", "Accuracy"): "accuracy"}.items():
        found = got[average, metric]
        assert found["lower"] <= found["mean"] <= found["upper"]
        assert found["lower"] < row[stem] < found["upper"]


def test_replicates_without_a_class_are_skipped(spark):
    rows = [(i, int(i == 0), 0, [0.5, 0.5]) for i in range(12)]
    df = spark.createDataFrame(rows, "rec_id INT, label INT, pred INT, scores ARRAY<DOUBLE>")
    n = bootstrap_replicates(df, [0, 1], "rec_id", 60).count()
    assert 0 < n < 60


@pytest.mark.parametrize("mode", ["exact", "vector"])
def test_intervals_do_not_depend_on_partitioning(pred, mode):
    one = sorted(map(tuple, bootstrap_ci(pred.coalesce(1), CLASSES, n=10, mode=mode).collect()))
    many = sorted(map(tuple, bootstrap_ci(pred.repartition(11), CLASSES, n=10, mode=mode).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many]
    assert np.allclose([r[2:] for r in one], [r[2:] for r in many])


def test_bootstrap_without_a_counting_replicate_keeps_its_rows(spark):
    from recordlab.operators.bootstrap import bootstrap_ci

    schema = "rec_id bigint, label int, pred int, scores array<double>"
    one_class = spark.createDataFrame([(i, 0, 0, [0.5, 0.5]) for i in range(4)], schema)
    rows = bootstrap_ci(one_class, [0, 1], n=3).collect()
    assert len(rows) == 14 and all(r.n_replicates == 0 and r["mean"] is None for r in rows)
