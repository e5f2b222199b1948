"""Five classifier families behind one interface, grid selection and refit."""

from __future__ import annotations

import functools
import itertools
import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlab.operators import dense
from recordlab.operators import metrics as M
from recordlab.operators.dense import fit_perceptron
from recordlab.operators.fitted import KernelMap
from recordlab.operators.reduce import fit_standardiser, row_count_and_width
from recordlab.operators.splits import add_weights
from recordlab.operators.trees import fit_boosting, fit_forest

SEED = 42
SCORING = "f1_macro"
SCORINGS = {"f1_macro": "f1_macro", "f1_weighted": "f1_weighted", "accuracy": "accuracy"}
LANDMARKS = 512


@dataclass(frozen=True)
class Shape:
    """What a builder may need to know about its training rows."""

    rows: int
    width: int
    classes: int


@dataclass(frozen=True)
class Algorithm:
    """``fit`` turns (training rows, params, shape, features column) into fitted stages."""

    fit: Callable[[DataFrame, Mapping, Shape, str], list[Transformer]]
    grid: Mapping[str, Sequence] | None
    needs_scaling: bool
    #: scores of all configurations on all folds in shared passes, where the family has such a way
    score_all: Callable[..., list[tuple[int, int, float]]] | None = None


def _columns(estimator: Estimator, features: str, weighted: bool = True) -> Estimator:
    estimator.setFeaturesCol(features).setLabelCol("label_index")
    return estimator.setWeightCol("weight") if weighted else estimator


def _fit_rf(seed: int):
    def fit(train: DataFrame, params: Mapping, shape: Shape, features: str) -> list[Transformer]:
        return [fit_forest(train, features, shape.classes, seed=seed, **params)]

    return fit


def _fit_mlp(seed: int):
    def fit(train: DataFrame, params: Mapping, shape: Shape, features: str) -> list[Transformer]:
        return [fit_perceptron(train, features, shape.width, shape.classes, seed=seed, **params)]

    return fit


def _fit_lr(seed: int):
    def fit(train: DataFrame, params: Mapping, shape: Shape, features: str) -> list[Transformer]:
        # balanced weights add up to the row count; the penalty is per weighted row
        model = LogisticRegression(
            family="multinomial",
            maxIter=params.get("iterations", 2000),
            regParam=1.0 / (params.get("C", 1.0) * shape.rows),
            elasticNetParam=1.0 if params.get("penalty", "l2") == "l1" else 0.0,
            standardization=False,
        )
        return [_columns(model, features).fit(train)]

    return fit


def _fit_gbt(seed: int):
    def fit(train: DataFrame, params: Mapping, shape: Shape, features: str) -> list[Transformer]:
        return [fit_boosting(train, features, shape.classes, seed=seed, **params)]

    return fit


def _fit_svm(seed: int):
    def fit(train: DataFrame, params: Mapping, shape: Shape, features: str) -> list[Transformer]:
        # after standardising, the usual 1 / (width · variance) is 1 / width
        gamma = params.get("gamma", "scale")
        gamma = 1.0 / shape.width if gamma == "scale" else float(gamma)
        # landmarks: the distinct rows whose hashes are smallest; all of them if they are few enough
        rows = train.select(vector_to_array(features).alias("x")).distinct()
        drawn = rows.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(params.get("landmarks", LANDMARKS)).collect()
        lift = KernelMap.of(np.array([r["x"] for r in drawn]).reshape(-1, shape.width), gamma, features, "lifted")
        lifted = lift.transform(train).persist()
        svc = LinearSVC(regParam=1.0 / (params.get("C", 1.0) * shape.rows), maxIter=params.get("iterations", 100))
        margins = _columns(
            OneVsRest(classifier=svc, parallelism=shape.classes, predictionCol="svc_prediction"), "lifted"
        ).fit(lifted)
        # Platt scaling of the margins
        platt = _columns(
            LogisticRegression(family="multinomial", maxIter=100, rawPredictionCol="platt_margins"), "rawPrediction"
        ).fit(margins.transform(lifted))
        lifted.unpersist()
        return [lift, margins, platt]

    return fit


def algorithms(seed: int = SEED, grid: bool = True) -> dict[str, Algorithm]:
    """The families by name. Grid values are fixed."""
    grids = {
        "RF": {"trees": [100, 200, 300], "depth": [3, 5, 10, 20, 30, 50], "min_split": [2, 3, 5, 8]},
        "MLP": {
            "hidden": [(100, 50), (128, 64), (256, 128)],
            "penalty": [1e-4, 1e-3, 1e-2],
            "step": [0.001, 0.01],
        },
        "LR": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
        "GBT": {
            "trees": [300, 500],
            "depth": [4, 6],
            "rate": [0.05, 0.1],
            "subsample": [0.8],
            "columns": [0.7, 0.9],
            "min_weight": [1, 5],
            "l1": [0, 0.1],
        },
        "SVM": {"C": [0.1, 1.0, 10.0], "gamma": ["scale", 0.01, 0.1]},
    }
    if not grid:
        grids = dict.fromkeys(grids)
    return {
        "RF": Algorithm(_fit_rf(seed), grids["RF"], False),
        "MLP": Algorithm(_fit_mlp(seed), grids["MLP"], True),
        "LR": Algorithm(_fit_lr(seed), grids["LR"], True, score_regressions),
        "GBT": Algorithm(_fit_gbt(seed), grids["GBT"], False),
        "SVM": Algorithm(_fit_svm(seed), grids["SVM"], True),
    }


def grid_configs(grid: Mapping[str, Sequence] | None) -> list[dict]:
    """Cartesian product of the grid; no grid is one empty configuration."""
    if not grid:
        return [{}]
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def config_name(params: Mapping) -> str:
    return json.dumps(params, sort_keys=True, default=list)


def label_index(classes: Sequence[int], label: str = "label") -> Column:
    return (F.array_position(F.lit(list(classes)), F.col(label)) - 1).cast("double")


def fit_classifier(
    algorithm: Algorithm,
    train: DataFrame,
    params: Mapping,
    classes: Sequence[int],
    features: str = "features",
) -> PipelineModel:
    """Scale (when the family needs it), balance and fit on training rows."""
    stages: list[Transformer] = []
    rows, width = row_count_and_width(train, features)
    used = features
    if algorithm.needs_scaling:
        used = f"{features}_std"
        stages += fit_standardiser(train, features, used)
    ready = PipelineModel(stages).transform(train) if stages else train
    ready = add_weights(ready.withColumn("label_index", label_index(classes)))
    shape = Shape(rows, width, len(classes))
    stages += algorithm.fit(ready.select(used, "label_index", "weight"), params, shape, used)
    return PipelineModel(stages)


def predict(
    model: PipelineModel, algorithm: Algorithm, df: DataFrame, classes: Sequence[int], keep: Sequence[str] = ()
) -> DataFrame:
    """``keep…, label, pred, scores`` with scores in the order of ``classes``."""
    scored = model.transform(df)
    pred = F.lit(list(classes))[F.col("prediction").cast("int")]
    return scored.select(*keep, "label", pred.alias("pred"), vector_to_array("probability").alias("scores"))


Folds = Sequence[tuple[DataFrame, DataFrame]]


def score_regressions(
    configs: Sequence[Mapping], folds: Folds, classes: Sequence[int], features: str, scoring: str
) -> list[tuple[int, int, float]]:
    """``configuration, fold, score`` of logistic regressions: all fits of all folds take their steps
    in the same passes over the rows. Folds of different width are filled up with zeros, which
    the fit ignores."""
    scaled = []
    for train, val in folds:
        stages = PipelineModel(fit_standardiser(train, features, f"{features}_std"))
        width = row_count_and_width(train, features)[1]
        scaled.append((width, *(stages.transform(x).withColumn("label_index", label_index(classes)) for x in (train, val))))
    most = max(width for width, _, _ in scaled)

    def joined(side: int) -> DataFrame:
        parts = []
        for i, fold in enumerate(scaled):
            rows = add_weights(fold[side]) if side == 1 else fold[side].withColumn("weight", F.lit(1.0))
            filled = F.concat(vector_to_array(f"{features}_std"), F.array_repeat(F.lit(0.0), most - fold[0]))
            parts.append(rows.select(array_to_vector(filled).alias("x"), "label_index", "weight", F.lit(i).alias("fold")))
        return dense.to_blocks(functools.reduce(DataFrame.unionByName, parts), "x", "label_index", "weight", "fold")

    found, _ = dense.fit_regressions(joined(1), most, len(classes), configs, range(len(folds)))
    rows = dense.regression_predictions(joined(2), found, most, len(classes))
    of = F.lit(list(classes))
    pred = rows.select(F.col("part").alias("fold"), "config", of[F.col("y")].alias("label"), of[F.col("k")].alias("pred"))
    scores = M.summary(pred, ["config", "fold"]).select("config", "fold", SCORINGS[scoring]).collect()
    return sorted((r["config"], r["fold"], r[SCORINGS[scoring]]) for r in scores)


def fold_predictions(
    algorithm: Algorithm,
    params: Mapping,
    folds: Folds,
    classes: Sequence[int],
    features: str = "features",
    keep: Sequence[str] = (),
    parallelism: int = 1,
) -> DataFrame:
    """Fit on each fold's training part and predict its validation part.

    Rows carry ``fold`` and ``fit_seconds``, the training time of the fold.
    """

    def one(i: int) -> DataFrame:
        train, val = folds[i]
        start = time.monotonic()
        model = fit_classifier(algorithm, train, params, classes, features)
        seconds = F.lit(time.monotonic() - start)
        rows = predict(model, algorithm, val, classes, keep)
        return rows.withColumn("fold", F.lit(i)).withColumn("fit_seconds", seconds)

    with ThreadPoolExecutor(max(parallelism, 1)) as pool:
        parts = list(pool.map(one, range(len(folds))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_config(
    algorithm: Algorithm,
    params: Mapping,
    folds: Folds,
    classes: Sequence[int],
    features: str = "features",
    scoring: str = SCORING,
) -> list[tuple[int, float]]:
    """Validation score of one configuration on every fold."""
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {sorted(SCORINGS)}")
    pred = fold_predictions(algorithm, params, folds, classes, features)
    rows = M.summary(pred, ["fold"]).select("fold", SCORINGS[scoring]).collect()
    return sorted((r["fold"], r[SCORINGS[scoring]]) for r in rows)


def select_config(
    spark: SparkSession,
    algorithm: Algorithm,
    folds: Folds,
    classes: Sequence[int],
    features: str = "features",
    scoring: str = SCORING,
    parallelism: int = 1,
) -> tuple[dict, float | None, DataFrame]:
    """Best configuration by mean over folds, its score, and the ranking of all.

    A family that can scores all configurations in shared passes; else they are independent sets
    of Spark jobs, of which ``parallelism`` run at a time.
    Without a grid nothing is compared and the ranking holds one row without a score.
    """
    schema = "config STRING, fold INT, score DOUBLE"
    if not algorithm.grid:
        empty = spark.createDataFrame([("{}", None, None)], schema)
        return {}, None, empty.select(
            "config", F.col("score").alias("mean"), F.col("score").alias("std"), F.lit(1).alias("rank")
        )
    configs = grid_configs(algorithm.grid)
    if algorithm.score_all:
        if scoring not in SCORINGS:
            raise ValueError(f"scoring must be one of {sorted(SCORINGS)}")
        found = algorithm.score_all(configs, folds, classes, features, scoring)
        rows = [(config_name(configs[c]), int(fold), float(score)) for c, fold, score in found]
    else:
        with ThreadPoolExecutor(max(parallelism, 1)) as pool:
            each = pool.map(lambda p: score_config(algorithm, p, folds, classes, features, scoring), configs)
            rows = [(config_name(p), int(f), float(s)) for p, scores in zip(configs, each) for f, s in scores]
    ranking = M.config_rank(spark.createDataFrame(rows, schema))
    best = ranking.where(F.col("rank") == 1).first()
    params = next(p for p in configs if config_name(p) == best["config"])
    return params, best["mean"], ranking


# --- bundles --------------------------------------------------------------------------------


def save_bundle(spark: SparkSession, path: str, model: PipelineModel, name: str, params: Mapping, classes: Sequence[int]) -> None:
    """Reducer, scaler and classifier as one fitted pipeline, plus a row of parameters."""
    model.write().overwrite().save(f"{path}/model")
    row = [(name, config_name(params), list(classes))]
    spark.createDataFrame(row, "algorithm STRING, params STRING, classes ARRAY<INT>").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/params")


def load_bundle(spark: SparkSession, path: str, seed: int = SEED) -> tuple[PipelineModel, Algorithm, list[int], dict]:
    row = spark.read.schema("algorithm STRING, params STRING, classes ARRAY<INT>").json(f"{path}/params").first()
    return (
        PipelineModel.load(f"{path}/model"),
        algorithms(seed, grid=False)[row["algorithm"]],
        list(row["classes"]),
        json.loads(row["params"]),
    )
