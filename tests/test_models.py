import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from recordlab.operators import contexts, models, reduce, vectors
from recordlab.operators.fitted import KernelMap, kernel
from recordlab.operators.krylov import krylov
from recordlab.plans.study import fold_pairs, reduced_pair, run_study

CLASSES = [2, 5, 9]
SMALL = {
    "RF": {"trees": 5, "depth": 3},
    "MLP": {"hidden": (16,), "step": 0.02, "epochs": 30},
    "LR": {"C": 1.0, "iterations": 40},
    "GBT": {"trees": 3, "depth": 2},
    "SVM": {"C": 1.0, "iterations": 15, "landmarks": 48},
}


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    label = rng.choice(3, p=[0.6, 0.25, 0.15], size=240)
    x = rng.normal(size=(240, 6)) * [1, 5, 1, 0.2, 3, 1]
    x[:, :3] += 3 * np.eye(3)[label]
    x[:, 5] = 4.0  # no variance
    return x, label


@pytest.fixture(scope="module")
def df(spark, matrix):
    x, label = matrix
    rows = [(i, CLASSES[k], Vectors.dense(v), float(i % 4)) for i, (v, k) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, ["rec_id", "label", "features", "lab"]).withColumn("label", F.col("label").cast("int")).persist()


def reduced(model, df):
    rows = reduce.reduce_rows(model, df).orderBy("rec_id").select(vector_to_array("reduced")).collect()
    return np.array([r[0] for r in rows])


def same_axes(a, b):
    return np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_pca_is_centred(df, matrix):
    x = matrix[0] - matrix[0].mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert same_axes(reduced(reduce.fit_reducer(df, "pca", 3), df), x @ vt[:3].T)


def test_scaled_pca_uses_population_deviation(df, matrix):
    x = matrix[0] - matrix[0].mean(axis=0)
    std = matrix[0].std(axis=0)
    x = x / np.where(std == 0, 1, std)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert same_axes(reduced(reduce.fit_reducer(df, "scaled_pca", 4), df), x @ vt[:4].T)


def test_auto_keeps_the_smallest_sufficient_count(df):
    full = reduce.fit_reducer(df, "scaled_pca", 6)
    table = [r["cumulative"] for r in reduce.variance_table(full, df).orderBy("component").collect()]
    want = next(i + 1 for i, c in enumerate(table) if c >= 0.7)
    assert reduced(reduce.fit_reducer(df, "auto", 6, 0.7), df).shape[1] == want
    assert reduced(reduce.fit_reducer(df, "auto", 2, 0.7), df).shape[1] == 2
    assert reduce.auto_components([0.5, 0.3, 0.2], 0.8, 9) == 2
    assert reduce.auto_components([0.5, 0.3, 0.1], 0.95, 9) == 3


def test_lda_separates_and_whitens(df, matrix):
    z = reduced(reduce.fit_reducer(df, "lda"), df)
    label = matrix[1]
    assert z.shape[1] == 2
    within = sum((z[label == k] - z[label == k].mean(axis=0)).T @ (z[label == k] - z[label == k].mean(axis=0)) for k in range(3))
    assert np.allclose(within / (240 - 3), np.eye(2), atol=1e-6)
    means = np.stack([z[label == k].mean(axis=0) for k in range(3)])
    between = (means * np.bincount(label)[:, None]).T @ means
    assert abs(between[0, 1]) < 1e-6 and between[0, 0] > between[1, 1]


@pytest.mark.parametrize("values", [np.geomspace(1, 1e-6, 80), np.r_[5, 5, 5, np.linspace(2, 1, 77)], np.r_[np.ones(4), np.zeros(76)], np.ones(80)])
def test_krylov_axes(values):
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(80, 80)))[0]
    matrix = (turn * values) @ turn.T
    for space in (1 << 30, 16 * 80 * 40):  # also with restarts
        got, axes, _ = krylov(lambda q: matrix @ q, 80, 6, space=space)
        assert np.abs(got - np.sort(values)[::-1][:6]).max() < 1e-7 * values.max()
        assert np.abs(matrix @ axes - axes * got).max() < 1e-6 and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-9


def test_components_without_a_square_matrix(df, matrix):
    x, _ = matrix
    for method in ("pca", "scaled_pca", "auto"):
        a, b = (reduce.fit_reducer(df, method, 4, narrow=narrow) for narrow in (2048, 1))
        u, v = reduced(a, df), reduced(b, df)
        assert u.shape == v.shape
        cosine = np.abs((u * v).sum(axis=0)) / (np.linalg.norm(u, axis=0) * np.linalg.norm(v, axis=0))
        assert np.abs(cosine - 1).max() < 1e-9
        ratios = [[r["ratio"] for r in reduce.variance_table(m, df).orderBy("component").collect()] for m in (a, b)]
        assert np.allclose(ratios[0][: u.shape[1]], ratios[1], atol=1e-9)


def test_twenty_thousand_columns(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(24, 3)) @ r.normal(size=(3, 20_000)) + 0.01 * r.normal(size=(24, 20_000))
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["rec_id", "features"])
    model = reduce.fit_reducer(rows, "pca", 3)
    y = x - x.mean(axis=0)
    left, size, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(np.abs(reduced(model, rows)), np.abs(left[:, :3] * size[:3]), atol=1e-6 * size[0])


def test_no_reduction(df, matrix):
    assert np.allclose(reduced(reduce.fit_reducer(df, "none"), df), matrix[0])


def test_reducer_ignores_validation_rows(df):
    train, val = df.where("rec_id < 180"), df.where("rec_id >= 180")
    moved = val.limit(5)
    a, _, _ = reduced_pair(train, val, "scaled_pca", 3, 0.95, ["lab"])
    b, _, _ = reduced_pair(train, moved, "scaled_pca", 3, 0.95, ["lab"])
    pick = lambda d: [tuple(r["features"].toArray()) for r in d.orderBy("rec_id").collect()]
    assert pick(a) == pick(b)
    assert [r["features"][3] for r in a.orderBy("rec_id").limit(5).collect()] == [0.0, 1.0, 2.0, 3.0, 0.0]


@pytest.mark.parametrize("name", SMALL)
def test_family_learns_and_survives_saving(spark, df, tmp_path, name):
    algorithm = models.algorithms(grid=False)[name]
    model = models.fit_classifier(algorithm, df, SMALL[name], CLASSES)
    rows = models.predict(model, algorithm, df, CLASSES, ["rec_id"]).orderBy("rec_id").collect()
    assert np.mean([r["label"] == r["pred"] for r in rows]) > 0.7
    scores = np.array([r["scores"] for r in rows])
    assert scores.shape == (240, 3) and (scores >= 0).all() and np.allclose(scores.sum(axis=1), 1)
    models.save_bundle(spark, str(tmp_path), model, name, SMALL[name], CLASSES)
    loaded, kind, classes, params = models.load_bundle(spark, str(tmp_path))
    again = models.predict(loaded, kind, df, classes, ["rec_id"]).orderBy("rec_id").collect()
    assert [r["pred"] for r in again] == [r["pred"] for r in rows]
    assert set(params) == set(SMALL[name])


def test_grid_sizes():
    sizes = {n: len(models.grid_configs(a.grid)) for n, a in models.algorithms().items()}
    assert sizes == {"RF": 72, "MLP": 18, "LR": 8, "GBT": 64, "SVM": 9}
    assert models.grid_configs(None) == [{}]


def test_selection(spark, df):
    base = models.algorithms(grid=False)["LR"]
    small = models.Algorithm(base.fit, {"C": [1e-6, 1.0], "iterations": [30]}, True)
    pairs = fold_pairs(df.withColumn("fold", F.col("rec_id") % 2), 2, "none")
    params, score, ranking = models.select_config(spark, small, pairs, CLASSES, parallelism=2)
    assert params["C"] == 1.0 and ranking.count() == 2
    assert score == ranking.where("rank = 1").first()["mean"]
    assert models.select_config(spark, base, pairs, CLASSES)[:2] == ({}, None)
    with pytest.raises(ValueError):
        models.score_config(small, params, pairs, CLASSES, scoring="other")


def test_shared_selection_equals_single_fits(spark, df):
    """All configurations in shared passes rank as separate fits of the library do, also where folds
    differ in width."""
    base = models.algorithms(grid=False)["LR"]
    grid = {"C": [0.01, 1.0], "penalty": ["l1", "l2"], "iterations": [2000]}
    pairs = fold_pairs(df.withColumn("fold", F.col("rec_id") % 2), 2, "none")
    train, val = pairs[1]
    narrow = lambda x: x.withColumn("features", array_to_vector(F.slice(vector_to_array("features"), 1, 4)))
    pairs = [pairs[0], (narrow(train), narrow(val))]
    shared = models.score_regressions(models.grid_configs(grid), pairs, CLASSES, "features", "accuracy")
    single = [
        (c, fold, score)
        for c, params in enumerate(models.grid_configs(grid))
        for fold, score in models.score_config(base, params, pairs, CLASSES, scoring="accuracy")
    ]
    assert [x[:2] for x in shared] == [x[:2] for x in single]
    assert np.abs(np.array([x[2] for x in shared]) - [x[2] for x in single]).max() < 0.02
    whole = models.Algorithm(base.fit, grid, True, base.score_all)
    params, score, ranking = models.select_config(spark, whole, pairs, CLASSES, scoring="accuracy")
    means = {c: np.mean([x[2] for x in shared if x[0] == c]) for c in range(4)}
    assert score == pytest.approx(max(means.values())) and ranking.count() == 4


def _dual(k, y, most, rounds=3000):
    """Support vector machine by pairs of multipliers: margins on the rows."""
    r, a, n = np.random.default_rng(0), np.zeros(len(y)), len(y)
    for _ in range(rounds * 10):
        i, j = r.choice(n, 2, replace=False)
        e = (a * y) @ k - y
        curve = k[i, i] + k[j, j] - 2 * k[i, j]
        low, high = (max(0, a[j] - a[i]), min(most, most + a[j] - a[i])) if y[i] != y[j] else (max(0, a[i] + a[j] - most), min(most, a[i] + a[j]))
        new = np.clip(a[j] + y[j] * (e[i] - e[j]) / max(curve, 1e-12), low, high)
        a[i] += y[i] * y[j] * (a[j] - new)
        a[j] = new
    f = (a * y) @ k
    inside = (a > 1e-6 * most) & (a < most * (1 - 1e-6))
    return f + np.mean((y - f)[inside])


def test_kernel_machine_equals_the_dual(spark):
    """With every row a landmark the primal fit has the margins of an exact dual solver."""
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 3))
    y = np.where((x**2).sum(axis=1) + r.normal(size=60) / 2 > 2.5, 1.0, -1.0)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b > 0)) for a, b in zip(x, y)], ["features", "label"])
    lift = KernelMap.of(x, 0.4, "features", "lifted")
    lifted = lift.transform(rows).persist()
    phi = np.array(lifted.select(vector_to_array("lifted")).toArrow().column(0).to_pylist())
    k = kernel(x, x, 0.4)
    assert np.abs(phi @ phi.T - k).max() < 1e-8
    svc = LinearSVC(featuresCol="lifted", regParam=1 / 60, maxIter=150, tol=1e-9, standardization=False).fit(lifted)
    margins = phi @ svc.coefficients.toArray() + svc.intercept
    assert np.abs(margins - _dual(k, y, 1.0)).max() < 0.15


def test_study_saves_usable_bundles(spark, df, tmp_path):
    base = models.algorithms(grid=False)["LR"]
    algorithms = {"LR": models.Algorithm(base.fit, {"C": [1.0], "iterations": [30]}, True)}
    labs = df.select("rec_id", "lab")
    settings = dict(n_components=3, k=2, algorithms=algorithms, n_bootstrap=15)
    with pytest.raises(ValueError, match="without a partner"):
        run_study(df.drop("lab"), labs=labs.where("rec_id > 3"), **settings)
    tables = run_study(df.drop("lab"), labs=labs, out=str(tmp_path), **settings)
    for i in range(2):
        own = {r["role"]: r["n_rows"] for r in spark.read.parquet(f"{tmp_path}/reduction_folds/{i}/summary").collect()}
        assert sum(own.values()) == df.count() - tables["predictions"].where("role = 'test'").count()
        assert spark.read.parquet(f"{tmp_path}/reduction_folds/{i}/components").count() == 18
    assert tables["holdout"].count() == 2 and tables["intervals"].count() == 14
    assert tables["best"].first()["algorithm"] == "LR"
    model, kind, classes, _ = models.load_bundle(spark, f"{tmp_path}/models/LR")
    test = tables["predictions"].where("role = 'test'")
    again = models.predict(model, kind, df, classes, ["rec_id"]).withColumnRenamed("pred", "again")
    assert test.join(again, "rec_id").where("pred <> again").count() == 0
    assert spark.read.json(f"{tmp_path}/config").first()["method"] == "scaled_pca"
    assert spark.read.parquet(f"{tmp_path}/tables/comparison").count() == 1
    assert tables["cv_summary"].first()["fit_seconds_mean"] > 0
    data = spark.read.csv(f"{tmp_path}/modeling_data/all", header=True)
    assert data.count() == 240 and "feature_4" in data.columns
    assert {r["role"]: r["width"] for r in spark.read.parquet(f"{tmp_path}/reduction/summary").collect()} == {"train": 3, "val": 3}


def test_lda_shares(df):
    model = reduce.fit_reducer(df, "lda")
    tables = reduce.diagnostics(model, df, df.limit(3), "lda")
    assert tables["variance"].count() == 2 and tables["components"].count() == 12
    assert tables["variance"].agg(F.max("cumulative")).first()[0] == pytest.approx(1)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "  "), (3, None)], "id INT, text STRING")
    hashed = {r["id"]: r["vector"] for r in vectors.encode_text(df, "text", width=32).collect()}
    assert hashed[2] is None and hashed[3] is None
    assert np.linalg.norm(hashed[1]) == pytest.approx(1, abs=1e-6)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = {r["id"]: r["vector"] for r in vectors.encode_text(df, "text", load).collect()}
    assert own[2] is None and own[1] == pytest.approx([5 / 26**0.5, 1 / 26**0.5], abs=1e-6)


def test_pooling_with_empty_mask(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 0), (2, [5.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "k INT, v ARRAY<DOUBLE>, m INT")
    assert {r["k"]: r["vector"] for r in vectors.mean_pool(df, "k", "v").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}
    assert {r["k"]: r["vector"] for r in vectors.mean_pool(df, "k", "v", "m").collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_corpus_vectors_load_or_train(spark, tmp_path):
    df = spark.createDataFrame([(i, "x y z" if i % 2 else "p q r") for i in range(30)], "id INT, text STRING")
    path = str(tmp_path / "w2v")
    first = vectors.fit_corpus_vectors(df, size=4, iters=2, path=path).transform(df).collect()
    again = vectors.fit_corpus_vectors(df.limit(0), size=4, path=path).transform(df).collect()
    assert [r["vector"] for r in first] == [r["vector"] for r in again]
    assert np.linalg.norm(first[0]["vector"]) == pytest.approx(1, abs=1e-6)


def test_vocabulary_is_counted_first(spark):
    df = spark.createDataFrame([("a b c a b c",)], "text STRING")
    with pytest.raises(ValueError, match="3 words"):
        vectors.fit_corpus_vectors(df, size=4, iters=1, max_words=2)


def test_missing_extra_features(spark):
    rows = [(i, i % 2, Vectors.dense([float(i), float(i * i % 7)]), None if i % 3 else float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, ["rec_id", "label", "features", "x"])
    train, val, reducer = reduced_pair(df.where("rec_id < 30"), df.where("rec_id >= 30"), "none", 2, 0.95, ["x"])
    got = {r["rec_id"]: (list(r["features"])[2], r["x"]) for r in train.union(val).collect()}
    assert got == {r[0]: (-1.0 if r[3] is None else r[3], r[3]) for r in rows}
    algorithm = models.algorithms(grid=False)["LR"]
    fitted = models.fit_classifier(algorithm, train, {"iterations": 5}, [0, 1])
    from recordlab.plans.study import bundle_of

    bundle = bundle_of(reducer, fitted, ["x"])
    direct = {r["rec_id"]: r["pred"] for r in models.predict(fitted, algorithm, val, [0, 1], ["rec_id"]).collect()}
    whole = {r["rec_id"]: r["pred"] for r in models.predict(bundle, algorithm, df.where("rec_id >= 30"), [0, 1], ["rec_id"]).collect()}
    assert direct == whole and len(whole) == 10


def test_context_vectors_against_a_dense_factorisation(spark):
    """Counts by hand, and inner products of texts from numpy's singular vectors."""
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(r.choice(words, r.integers(1, 12))) for _ in range(60)] + ["", None, "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    b = 40
    bucket = {r["w"]: r["k"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.expr(f"CAST(pmod(xxhash64(w), {b}) AS INT) AS k")).collect()}
    want = np.zeros((b, b))
    for t in texts:
        own = [bucket[w] for w in (t or "").split()]
        for i in range(len(own)):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if i != j:
                    want[own[i], own[j]] += 1
    got = np.zeros((b, b))
    for row in contexts.context_counts(df, window=2, buckets=b).collect():
        got[row.a, row.b] = row.n
    assert (got == want).all()
    sums = want.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.nan_to_num(np.maximum(np.log(want * sums.sum() / np.outer(sums, sums)), 0), nan=0.0)
    u, s, _ = np.linalg.svd(m)
    plain = u[:, :4] * np.sqrt(s[:4])
    model = contexts.fit_context_vectors(df, size=4, window=2, buckets=b, tolerance=1e-10)
    assert np.abs(model.matrix @ model.matrix.T - plain @ plain.T).max() < 1e-6
    rows = {x["id"]: np.array(x["vector"]) for x in model.transform(df, normalise=False).collect()}
    for i, t in enumerate(texts):
        own = [bucket[w] for w in (t or "").split()]
        mean = model.matrix[own].mean(axis=0) if own else np.zeros(4)
        assert np.abs(rows[i] - mean).max() < 1e-12
    none = contexts.fit_context_vectors(df.where("id >= 60"), size=4, buckets=b)
    assert not none.matrix.any() and none.transform(df.limit(3)).count() == 3


def test_context_pairs_are_counted_in_batches(spark, monkeypatch):
    """Pairs of a text across the places that are counted at a time, and one exchange for all counts."""
    monkeypatch.setattr(contexts, "STEP", 3)
    r = np.random.default_rng(8)
    texts = [r.integers(0, 6, n).tolist() for n in (7, 2, 1, 0, 11, 4)]
    want = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + 5)):
                code = min(t[i], t[j]) * 6 + max(t[i], t[j])
                want[code] = want.get(code, 0) + 1
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for found in contexts._codes(pa.array([[9], *texts], pa.list_(pa.int32()))[1:], 4, 6):
        codes, counts = contexts._added(codes, counts, *np.unique(found, return_counts=True))
    assert dict(zip(codes.tolist(), counts.tolist())) == want
    df = spark.createDataFrame([("a b a c",)], "text STRING")
    plan = contexts.context_counts(df, window=2, buckets=8)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and "MapInArrow" in plan
