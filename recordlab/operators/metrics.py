"""Classifier evaluation as grouped SQL over one predictions table.

A predictions table has ``label``, ``pred``, ``scores ARRAY<DOUBLE>`` (one entry per class, in
the order of ``classes``) and any grouping columns (algorithm, fold, role, replicate). Every
function takes the grouping columns as ``by`` and evaluates all groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.operators.ordered import ROWS_PER_BUCKET, add_bucket, cut_points, running_totals

AVERAGES = ("weighted", "macro")
RATES = ("precision", "recall", "f1", "sensitivity", "specificity")


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight)


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- confusion ------------------------------------------------------------------------------


def confusion(pred: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``by…, label, pred, n``; cells that do not occur have no row."""
    return pred.groupBy(*by, "label", "pred").agg(F.sum(_weight(weight)).alias("n"))


def confusion_grid(cells: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The same with a zero row for every missing pair of the class list."""
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    pairs = F.array(
        *[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred")) for a in classes for b in classes]
    )
    grid = groups.select(*by, F.inline(pairs))
    return grid.join(cells, [*by, "label", "pred"], "left").fillna(0, ["n"])


def confusion_norm(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each cell in its truth row, percent with one decimal; an empty row gives null."""
    row = F.sum("n").over(W.partitionBy(*by, "label"))
    return cells.withColumn("percent", F.round(F.try_divide(F.col("n") * F.lit(100.0), row), 1))


def class_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by…, cls, tp, actual, predicted, total`` for each class in truth or prediction."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")
        ),
        F.struct(
            F.col("pred").cast(cells.schema["label"].dataType).alias("cls"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("actual"),
            F.col("n").alias("predicted"),
        ),
    )
    counts = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    )
    # a group has as many rows as there are classes
    return counts.withColumn("total", F.sum("actual").over(W.partitionBy(*by)))


def class_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, sensitivity and specificity per class; zero denominators give 0."""
    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    negatives = F.col("total") - actual
    return counts.withColumns(
        {
            "precision": _ratio(tp, predicted),
            "recall": _ratio(tp, actual),
            "f1": _ratio(2 * tp, actual + predicted),
            "sensitivity": _ratio(tp, actual),
            "specificity": _ratio(negatives - (predicted - tp), negatives),
        }
    )


def summary(
    pred: DataFrame,
    by: Sequence[str] = (),
    weight: str | None = None,
    classes: Sequence[int] | None = None,
) -> DataFrame:
    """One row per group: accuracy and the rates, ``<rate>_weighted`` and ``<rate>_macro``.

    Averages run over the classes seen in truth or prediction. With ``classes`` sensitivity and
    specificity average over the whole list: an absent class has sensitivity 0, specificity 1.
    """
    return summary_of_cells(confusion(pred, by, weight), by, classes)


def summary_of_cells(
    cells: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None
) -> DataFrame:
    rates = class_rates(class_counts(cells, by))
    aggs = [_ratio(F.sum("tp"), F.sum("actual")).alias("accuracy"), F.sum("actual").alias("n")]
    for rate in RATES:
        aggs.append(
            _ratio(F.sum(F.col(rate) * F.col("actual")), F.sum("actual")).alias(f"{rate}_weighted")
        )
        macro = F.avg(rate)
        if classes is not None and rate in ("sensitivity", "specificity"):
            absent = F.lit(len(classes)) - F.count("*")
            extra = absent if rate == "specificity" else F.lit(0)
            macro = (F.sum(rate) + extra) / F.lit(len(classes))
        aggs.append(macro.alias(f"{rate}_macro"))
    return rates.groupBy(*by).agg(*aggs)


def sens_spec(pred: DataFrame, average: str, by: Sequence[str] = ()) -> DataFrame:
    return summary(pred, by).select(
        *by,
        F.col(f"sensitivity_{average}").alias("sensitivity"),
        F.col(f"specificity_{average}").alias("specificity"),
    )


def class_report(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages: ``by…, row, precision…``."""
    cells = confusion(pred, by)
    rates = class_rates(class_counts(cells, by))
    total = summary_of_cells(cells, by)
    per_class = rates.select(
        *by, F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", F.col("actual").alias("support")
    )
    averages = F.array(
        F.struct(
            F.lit("accuracy").alias("row"),
            F.col("accuracy").alias("precision"),
            F.col("accuracy").alias("recall"),
            F.col("accuracy").alias("f1"),
            F.col("n").alias("support"),
        ),
        *[
            F.struct(
                F.lit(f"{a} avg").alias("row"),
                F.col(f"precision_{a}").alias("precision"),
                F.col(f"recall_{a}").alias("recall"),
                F.col(f"f1_{a}").alias("f1"),
                F.col("n").alias("support"),
            )
            for a in ("macro", "weighted")
        ],
    )
    return per_class.unionByName(total.select(*by, F.inline(averages)))


# --- ROC ------------------------------------------------------------------------------------


def score_groups(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str] = (),
    weight: str | None = None,
    micro: bool = False,
) -> DataFrame:
    """``by…[, cls], score, pos, neg``: one row per distinct score, so ties share a threshold."""
    sides = pred.select(
        *by,
        "label",
        _weight(weight).alias("__w"),
        F.inline(
            F.arrays_zip(F.lit(list(classes)).alias("cls"), F.col("scores").alias("score"))
        ),
    )
    keys = [*by, "score"] if micro else [*by, "cls", "score"]
    is_pos = F.col("label") == F.col("cls")
    return sides.groupBy(*keys).agg(
        F.sum(F.when(is_pos, F.col("__w")).otherwise(0)).alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(F.col("__w"))).alias("neg"),
    )


def score_cuts(pred: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Cut values of all scores; one list serves every grouping and every resample."""
    return cut_points(pred.select(F.explode("scores").alias("score")), "score", rows_per_bucket)


def _ranked(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str],
    weight: str | None,
    micro: bool,
    rows_per_bucket: int,
    cuts: Sequence[float] | None,
) -> tuple[DataFrame, list[str]]:
    groups = score_groups(pred, classes, by, weight, micro)
    if cuts is None:
        cuts = score_cuts(pred, rows_per_bucket)
    keys = [*by] if micro else [*by, "cls"]
    ranked = running_totals(
        add_bucket(groups, "score", cuts, "__b"),
        keys,
        "__b",
        [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        {"P": F.col("pos"), "N": F.col("neg")},
        descending=True,
    )
    return ranked, keys


def roc_points(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``by…, cls, score, fpr, tpr`` per distinct score, plus the origin (null score).

    Classes without positives have no curve.
    """
    ranked, keys = _ranked(pred, classes, by, None, False, rows_per_bucket, None)
    points = ranked.where(F.col("P") > 0).select(
        *keys,
        "score",
        F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )
    present = pred.groupBy(*by, F.col("label").alias("cls")).agg(F.count("*").alias("n"))
    origin = present.where(F.col("cls").isin(*classes)).select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auc_per_class(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str] = (),
    weight: str | None = None,
    micro: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """``by…, cls, auc, P``: trapezoid area, that is the rank statistic with half ties."""
    ranked, keys = _ranked(pred, classes, by, weight, micro, rows_per_bucket, cuts)
    won = F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    return (
        ranked.groupBy(*keys)
        .agg(F.sum(won).alias("won"), F.max("P").alias("P"), F.max("N").alias("N"))
        .where(F.col("P") > 0)
        .select(*keys, F.try_divide("won", F.col("P").cast("double") * F.col("N")).alias("auc"), "P")
    )


def auc_micro(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Area over all (row, class) cells together."""
    return auc_per_class(pred, classes, by, None, True, rows_per_bucket, cuts).select(
        *by, F.col("auc").alias("auc_micro")
    )


def auc_summary(
    pred: DataFrame,
    classes: Sequence[int],
    by: Sequence[str] = (),
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """``by…, auc_weighted, auc_macro`` over the classes that have positives."""
    return area_averages(auc_per_class(pred, classes, by, weight, False, rows_per_bucket, cuts), by)


def area_averages(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by…, auc_weighted, auc_macro`` of ``by…, cls, auc, P``."""
    return per_class.groupBy(*by).agg(
        (F.sum(F.col("auc") * F.col("P")) / F.sum("P")).alias("auc_weighted"),
        F.avg("auc").alias("auc_macro"),
    )


def evaluate(pred: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """All metrics of all groups, one row per group."""
    cuts = score_cuts(pred)
    rates, areas = summary(pred, by), auc_summary(pred, classes, by, cuts=cuts)
    micro = auc_micro(pred, classes, by, cuts=cuts)
    if by:
        keys = list(by)
        joined = rates.join(areas, keys, "left").join(micro, keys, "left")
    else:
        one = F.lit(1).alias("__one")
        joined = (
            rates.select("*", one).join(areas.select("*", one), "__one", "left").join(micro.select("*", one), "__one", "left").drop("__one")
        )
    # with no class to average, the micro area stands in, and 0 when there is none
    filled = {f"auc_{a}": F.coalesce(F.col(f"auc_{a}"), F.col("auc_micro"), F.lit(0.0)) for a in AVERAGES}
    return joined.withColumns(filled)


# --- summaries over folds and configurations -------------------------------------------------

CV_METRICS = ("accuracy", *[f"{r}_{a}" for r in RATES for a in AVERAGES], "auc_weighted", "auc_macro")


def cv_summary(fold_rows: DataFrame, by: Sequence[str] = ("algorithm",), metrics: Sequence[str] = CV_METRICS) -> DataFrame:
    """Mean and population standard deviation over folds, and the mean training time if known."""
    timed = [F.avg("fit_seconds").alias("fit_seconds_mean")] if "fit_seconds" in fold_rows.columns else []
    return fold_rows.groupBy(*by).agg(
        F.count("*").alias("n_folds"),
        *timed,
        *[f(m).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )


def best_algorithm(cv: DataFrame, metric: str = "auc_weighted_mean", order: Sequence[str] | None = None) -> DataFrame:
    """Highest mean; of equal ones the first in ``order`` (by name without an order)."""
    place = (
        F.array_position(F.lit(list(order)), F.col("algorithm")) if order else F.col("algorithm")
    )
    return cv.orderBy(F.col(metric).desc_nulls_last(), place).limit(1).select(
        "algorithm", F.col(metric).alias("score")
    )


def config_rank(scores: DataFrame, by: Sequence[str] = (), config: str = "config", score: str = "score") -> DataFrame:
    """``by…, config, mean, std, rank``: higher mean first, then the steadier configuration.

    The rows ranked are configurations (a grid on the driver), not data.
    """
    table = scores.groupBy(*by, config).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    order = W.partitionBy(*by).orderBy(F.desc("mean"), F.asc("std"), F.asc(config))
    return table.withColumn("rank", F.row_number().over(order))
