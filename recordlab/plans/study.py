"""A whole study: split, reduce per fold, select, evaluate, refit, hold-out, intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.operators import bootstrap, models, reports, splits
from recordlab.operators import metrics as M
from recordlab.operators.reduce import (
    MISSING_FEATURE,
    N_COMPONENTS,
    VARIANCE,
    append_features,
    diagnostics,
    fit_reducer,
    reduce_rows,
    row_count_and_width,
)
from recordlab.session import cut_lineage
from recordlab.sources import tables as io


#: class names that a study may find in the labels
MAX_CLASSES = 1000


def reduced_pair(
    train: DataFrame,
    val: DataFrame,
    method: str,
    n_components: int,
    variance: float,
    extra: Sequence[str] = (),
    label: str = "label",
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Reducer fitted on ``train`` only, applied to both; ``extra`` columns follow unscaled."""
    model = fit_reducer(train, method, n_components, variance, label=label)

    def apply(df: DataFrame) -> DataFrame:
        rows = reduce_rows(model, df)
        rows = append_features(rows, extra) if extra else rows.withColumn("features_all", F.col("reduced"))
        return rows.drop("features", "reduced").withColumnRenamed("features_all", "features")

    return apply(train), apply(val), model


def fold_spaces(
    df: DataFrame, k: int, method: str, n_components: int = N_COMPONENTS, variance: float = VARIANCE, extra: Sequence[str] = ()
) -> list[tuple[DataFrame, DataFrame, PipelineModel]]:
    """``(train, validation, reducer)`` per fold in the fold's own reduced space, kept for repeated fits."""
    spaces = []
    for i in range(k):
        train, val, model = reduced_pair(
            df.where(F.col("fold") != i), df.where(F.col("fold") == i), method, n_components, variance, extra
        )
        spaces.append((train.persist(), val.persist(), model))
    return spaces


def fold_pairs(df: DataFrame, k: int, method: str, n_components: int = N_COMPONENTS, variance: float = VARIANCE, extra: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """``(train, validation)`` per fold."""
    return [space[:2] for space in fold_spaces(df, k, method, n_components, variance, extra)]


def run_study(
    features: DataFrame,
    key: str = "rec_id",
    classes: Sequence[int] | None = None,
    extra: Sequence[str] = (),
    labs: DataFrame | None = None,
    method: str = "scaled_pca",
    n_components: int = N_COMPONENTS,
    variance: float = VARIANCE,
    split: str = "random",
    date: str | None = None,
    train_years: tuple[int, int] = splits.TRAIN_YEARS,
    test_years: tuple[int, int] = splits.TEST_YEARS,
    test_size: float = splits.TEST_SIZE,
    k: int = splits.N_FOLDS,
    algorithms: Mapping[str, models.Algorithm] | None = None,
    scoring: str = models.SCORING,
    n_bootstrap: int = bootstrap.N_BOOTSTRAP,
    bootstrap_mode: str = "exact",
    seed: int = splits.SEED,
    parallelism: int = 1,
    out: str | None = None,
) -> dict[str, DataFrame]:
    """``features`` has ``key, label, features`` and optional numeric ``extra`` columns.

    ``labs`` is a second table, for instance the numeric columns of a cleaned one: its columns but
    the key are further ``extra`` columns, and every key must stand once on both sides. A null in
    ``extra`` is a feature of -1. A time split takes both year ranges with their ends;
    ``bootstrap_mode`` is ``exact`` or, for very large hold-outs, ``poisson``.

    Returns the report tables plus ``predictions``, ``holdout`` (metrics per algorithm and
    role), ``class_report``, ``confusion``, ``roc`` and ``intervals``. With ``out`` the tables,
    modelling data, reducer diagnostics, models and options are saved.
    """
    spark = features.sparkSession
    algorithms = dict(algorithms or models.algorithms(seed))
    if labs is not None:
        extra = [*extra, *(c for c in labs.columns if c != key)]
        features = io.pair_by_key(features, labs, key)
    if split == "time":
        if date is None:
            raise ValueError("a time split needs the date column")
        parts = splits.split_time(features, date, train_years, test_years).drop(date)
    elif split == "random":
        parts = splits.split_random(features, key, test_size=test_size, seed=seed)
    else:
        raise ValueError("split must be 'time' or 'random'")
    parts = cut_lineage(parts)
    train = cut_lineage(splits.kfold(parts.where(F.col("role") == splits.TRAIN), key, k=k, seed=seed))
    test = parts.where(F.col("role") == splits.TEST)
    if classes is None:
        classes = sorted(r[0] for r in parts.select("label").distinct().limit(MAX_CLASSES + 1).collect())
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")

    spaces = fold_spaces(train, k, method, n_components, variance, extra)
    pairs = [space[:2] for space in spaces]
    chosen, rankings, cv_parts = {}, [], []
    for name, algorithm in algorithms.items():
        params, score, ranking = models.select_config(
            spark, algorithm, pairs, classes, scoring=scoring, parallelism=parallelism
        )
        chosen[name] = (params, score)
        rankings.append(ranking.select(F.lit(name).alias("algorithm"), "*"))
        predicted = models.fold_predictions(algorithm, params, pairs, classes, keep=[key], parallelism=parallelism)
        cv_parts.append(predicted.select(F.lit(name).alias("algorithm"), "*"))
    cv_predictions = cut_lineage(_union(cv_parts))
    fold_rows = cut_lineage(M.evaluate(cv_predictions, classes, ["algorithm", "fold", "fit_seconds"]))

    full_train, full_test, reducer = reduced_pair(train.drop("fold"), test, method, n_components, variance, extra)
    full_train, full_test = full_train.persist(), full_test.persist()
    final_parts = []
    for name, algorithm in algorithms.items():
        model = models.fit_classifier(algorithm, full_train, chosen[name][0], classes)
        for role, rows in ((splits.TRAIN, full_train), (splits.TEST, full_test)):
            final_parts.append(
                models.predict(model, algorithm, rows, classes, [key]).select(
                    F.lit(name).alias("algorithm"), F.lit(role).alias("role"), "*"
                )
            )
        if out:
            bundle = bundle_of(reducer, model, extra)
            models.save_bundle(spark, f"{out}/models/{name}", bundle, name, chosen[name][0], classes)
    predictions = cut_lineage(_union(final_parts))
    by = ["algorithm", "role"]
    holdout = cut_lineage(M.evaluate(predictions, classes, by))
    if out:
        for i, (a, b) in enumerate([*pairs, (full_train, full_test)]):
            width = row_count_and_width(a, "features")[1]
            fold = F.lit("all" if i == len(pairs) else str(i)).alias("fold")
            rows = a.select("features", "label", fold, F.lit("train").alias("role")).unionByName(
                b.select("features", "label", fold, F.lit("val").alias("role"))
            )
            io.write_modeling_data(rows, f"{out}/modeling_data/{'all' if i == len(pairs) else i}", width, ["role"])
        io.write_tables(diagnostics(reducer, train, test, method, key), f"{out}/reduction")
        for i, (_, _, own) in enumerate(spaces):
            outside, inside = train.where(F.col("fold") != i), train.where(F.col("fold") == i)
            io.write_tables(diagnostics(own, outside, inside, method, key), f"{out}/reduction_folds/{i}")
    for a, b in [*pairs, (full_train, full_test)]:
        a.unpersist()
        b.unpersist()

    held_out = predictions.where(F.col("role") == splits.TEST)
    intervals = _union(
        [
            bootstrap.bootstrap_ci(held_out.where(F.col("algorithm") == name), classes, key, n_bootstrap, seed=seed, mode=bootstrap_mode).select(
                F.lit(name).alias("algorithm"), "*", bootstrap.interval_text().alias("interval")
            )
            for name in algorithms
        ]
    )
    tables = reports.run_report(spark, fold_rows, chosen, holdout)
    tables |= {
        "rankings": _union(rankings),
        "predictions": predictions,
        "holdout": holdout,
        "class_report": M.class_report(predictions, by),
        "confusion": M.confusion_norm(M.confusion_grid(M.confusion(predictions, by), classes, by), by),
        "roc": M.roc_points(predictions, classes, by),
        "intervals": intervals,
    }
    if out:
        io.write_folds(train, f"{out}/folds", key)
        io.write_tables(tables, f"{out}/tables")
        io.write_config(
            spark,
            {
                "method": method,
                "n_components": n_components,
                "variance": variance,
                "split": split,
                "test_size": test_size,
                "folds": k,
                "algorithms": ",".join(algorithms),
                "scoring": scoring,
                "n_bootstrap": n_bootstrap,
                "bootstrap_mode": bootstrap_mode,
                "train_years": list(train_years),
                "test_years": list(test_years),
                "seed": seed,
                "classes": list(classes),
                "extra": ",".join(extra),
            },
            f"{out}/config",
        )
    return tables


def bundle_of(reducer: PipelineModel, classifier: PipelineModel, extra: Sequence[str] = ()) -> PipelineModel:
    """One fitted pipeline from raw rows to predictions.

    The classifier reads ``features``, which holds the raw vector until the reducer is done.
    """
    filled = [f"__extra{i}" for i in range(len(extra))]
    values = "".join(f", COALESCE(CAST(`{c}` AS DOUBLE), {MISSING_FEATURE}D) AS {f}" for c, f in zip(extra, filled))
    bridge = [
        SQLTransformer(statement=f"SELECT * EXCEPT (features){values} FROM __THIS__"),
        VectorAssembler(inputCols=["reduced", *filled], outputCol="features"),
    ]
    return PipelineModel([*reducer.stages, *bridge, *classifier.stages])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
