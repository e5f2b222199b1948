"""Registered queries over splits, predictions and bootstrap replicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlab.operators import bootstrap as boot
from recordlab.operators import metrics as M
from recordlab.operators import splits
from recordlab.registry import fixtures as fx
from recordlab.registry.fixtures import duck, table

QUERIES, ORACLE = {}, {}
CLASSES = [0, 1, 2]


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


# --- splits ---------------------------------------------------------------------------------


@register(
    "split_time",
    "SELECT o_orderkey AS rec_id, CASE WHEN YEAR(o_orderdate) BETWEEN 1995 AND 1998 THEN 'train' ELSE 'test' END AS role "
    "FROM orders WHERE YEAR(o_orderdate) BETWEEN 1995 AND 1998 OR YEAR(o_orderdate) BETWEEN 1999 AND 2001",
)
def split_time(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec_id"), "o_orderdate")
    return splits.split_time(orders, "o_orderdate", (1995, 1998), (1999, 2001)).select("rec_id", "role")


_RANKED = (
    "SELECT vec_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY MD5(CONCAT('42:', CAST(vec_id AS STRING))), vec_id) AS rn, "
    "COUNT(*) OVER (PARTITION BY label) AS n FROM embeddings"
)


@register(
    "split_random",
    f"SELECT vec_id, label, CASE WHEN rn <= FLOOR(CAST(0.2 AS DOUBLE) * n + CAST(0.5 AS DOUBLE)) THEN 'test' ELSE 'train' END AS role FROM ({_RANKED}) t",
)
def split_random(spark, sf):
    return splits.split_random(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


@register("kfold", f"SELECT vec_id, label, CAST((rn - 1) % 5 AS INT) AS fold FROM ({_RANKED}) t")
def kfold(spark, sf):
    return splits.kfold(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


@register(
    "class_weights",
    """
SELECT src, label, n, ROUND(SUM(n) OVER (PARTITION BY src) / CAST(COUNT(*) OVER (PARTITION BY src) * n AS DOUBLE), 6) AS weight
FROM (SELECT 'embeddings' AS src, CAST(label AS INT) AS label, COUNT(*) AS n FROM embeddings GROUP BY label
      UNION ALL SELECT 'labels', CAST(quality AS INT), COUNT(*) FROM labels GROUP BY quality) t""",
)
def class_weights(spark, sf):
    parts = [("embeddings", "label"), ("labels", "quality")]
    frames = [
        splits.class_weights(table(spark, sf, name), label).select(
            F.lit(name).alias("src"), F.col(label).cast("int").alias("label"), "n", F.round("weight", 6).alias("weight")
        )
        for name, label in parts
    ]
    return frames[0].unionByName(frames[1])


# --- confusion and rates --------------------------------------------------------------------

_CELLS = "SELECT {by} label, pred, COUNT(*) AS n FROM {src} GROUP BY {by} label, pred"


@register(
    "confusion",
    duck(
        """
SELECT g.label, g.pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM (SELECT a.c AS label, b.c AS pred FROM (VALUES (0), (1), (2)) a(c), (VALUES (0), (1), (2)) b(c)) g
LEFT JOIN cells c ON g.label = c.label AND g.pred = c.pred""",
        "pred",
        cells=_CELLS.format(by="", src="pred"),
    ),
)
def confusion(spark, sf):
    return M.confusion_grid(M.confusion(fx.pred(spark, sf)), CLASSES)


@register(
    "confusion_norm",
    duck(
        "SELECT fold, label, pred, n, ROUND(n * CAST(100 AS DOUBLE) / SUM(n) OVER (PARTITION BY fold, label), 1) AS percent FROM cells",
        "pred",
        cells=_CELLS.format(by="fold,", src="pred"),
    ),
)
def confusion_norm(spark, sf):
    return M.confusion_norm(M.confusion(fx.pred(spark, sf), ["fold"]), ["fold"])


def rates_sql(by: str, src: str, n: str = "COUNT(*)") -> dict[str, str]:
    """CTEs ``cells``, ``rates`` and ``summary`` for the grouping columns ``by``."""
    b = "".join(f"{c}, " for c in by.split())
    on = "".join(f"PARTITION BY {', '.join(by.split())}" if by else "")
    per = lambda num, den: f"CASE WHEN {den} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / ({den}) END"
    return {
        "cells": f"SELECT {b}label, pred, CAST({n} AS BIGINT) AS n FROM {src} GROUP BY {b}label, pred",
        "counts": (
            f"SELECT {b}cls, SUM(tp) AS tp, SUM(actual) AS actual, SUM(predicted) AS predicted, SUM(SUM(actual)) OVER ({on}) AS total FROM ("
            f"SELECT {b}label AS cls, CASE WHEN label = pred THEN n ELSE 0 END AS tp, n AS actual, 0 AS predicted FROM cells UNION ALL "
            f"SELECT {b}pred, 0, 0, n FROM cells) t GROUP BY {b}cls"
        ),
        "rates": (
            f"SELECT {b}cls, tp, actual, predicted, {per('tp', 'predicted')} AS precision, {per('tp', 'actual')} AS recall, "
            f"{per('2 * tp', 'actual + predicted')} AS f1, {per('tp', 'actual')} AS sensitivity, "
            f"{per('total - actual - predicted + tp', 'total - actual')} AS specificity FROM counts"
        ),
        "summary": (
            f"SELECT {b}SUM(tp) / CAST(SUM(actual) AS DOUBLE) AS accuracy, CAST(SUM(actual) AS BIGINT) AS n, "
            + ", ".join(f"SUM({r} * actual) / CAST(SUM(actual) AS DOUBLE) AS {r}_weighted, AVG({r}) AS {r}_macro" for r in M.RATES)
            + f" FROM rates" + (f" GROUP BY {', '.join(by.split())}" if by else "")
        ),
    }


def _round_sql(names):
    return ", ".join(f"ROUND({n}, 6) AS {n}" for n in names)


_RATE_NAMES = [f"{r}_{a}" for r in M.RATES for a in M.AVERAGES]
_PRF = [f"{r}_{a}" for r in ("precision", "recall", "f1") for a in M.AVERAGES]


@register(
    "prf_weighted_macro",
    duck(f"SELECT fold, n, {_round_sql(_PRF)} FROM summary", "pred", **rates_sql("fold", "pred")),
)
def prf_weighted_macro(spark, sf):
    return rounded(M.summary(fx.pred(spark, sf), ["fold"]).select("fold", "n", *_PRF), *_PRF)


@register(
    "accuracy",
    duck("SELECT algorithm, fold, ROUND(AVG(CASE WHEN label = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy FROM algos GROUP BY algorithm, fold", "pred", "algos"),
)
def accuracy(spark, sf):
    by = ["algorithm", "fold"]
    return rounded(M.summary(fx.algorithms(spark, sf), by).select(*by, "accuracy"), "accuracy")


@register(
    "sens_spec",
    duck(
        " UNION ALL ".join(
            f"SELECT '{a}' AS average, algorithm, ROUND(sensitivity_{a}, 6) AS sensitivity, ROUND(specificity_{a}, 6) AS specificity FROM summary"
            for a in M.AVERAGES
        ),
        "pred",
        "algos",
        **rates_sql("algorithm", "algos"),
    ),
)
def sens_spec(spark, sf):
    rows = fx.algorithms(spark, sf)
    frames = [
        M.sens_spec(rows, a, ["algorithm"]).select(F.lit(a).alias("average"), "algorithm", "sensitivity", "specificity")
        for a in M.AVERAGES
    ]
    return rounded(frames[0].unionByName(frames[1]), "sensitivity", "specificity")


_REPORT_COLUMNS = ["precision", "recall", "f1"]


@register(
    "class_report",
    duck(
        "SELECT algorithm, CAST(cls AS STRING) AS row, "
        + _round_sql(_REPORT_COLUMNS)
        + ", CAST(actual AS BIGINT) AS support FROM rates UNION ALL "
        "SELECT algorithm, 'accuracy', ROUND(accuracy, 6), ROUND(accuracy, 6), ROUND(accuracy, 6), n FROM summary UNION ALL "
        + " UNION ALL ".join(
            f"SELECT algorithm, '{a} avg', " + ", ".join(f"ROUND({r}_{a}, 6)" for r in _REPORT_COLUMNS) + ", n FROM summary"
            for a in ("macro", "weighted")
        ),
        "pred",
        "algos",
        **rates_sql("algorithm", "algos"),
    ),
)
def class_report(spark, sf):
    return rounded(M.class_report(fx.algorithms(spark, sf), ["algorithm"]), *_REPORT_COLUMNS)


# --- ROC ------------------------------------------------------------------------------------


def roc_sql(by: str, src: str, w: str = "1") -> dict[str, str]:
    """CTEs ``sides``, ``groups``, ``ranked``, ``areas`` and ``area_summary``."""
    names = by.split()
    b = "".join(f"{c}, " for c in names)
    part = f"PARTITION BY {b}cls"
    return {
        "sides": " UNION ALL ".join(
            f"SELECT {b}{k} AS cls, sc{k} AS score, CASE WHEN label = {k} THEN {w} ELSE 0 END AS p, CASE WHEN label = {k} THEN 0 ELSE {w} END AS q FROM {src}"
            for k in CLASSES
        ),
        "groups": f"SELECT {b}cls, score, SUM(p) AS pos, SUM(q) AS neg FROM sides GROUP BY {b}cls, score",
        "ranked": (
            f"SELECT {b}cls, score, pos, neg, SUM(pos) OVER ({part} ORDER BY score DESC) AS tp, SUM(neg) OVER ({part} ORDER BY score DESC) AS fp, "
            f"SUM(pos) OVER ({part}) AS P, SUM(neg) OVER ({part}) AS N FROM groups"
        ),
        "areas": f"SELECT {b}cls, SUM(neg * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(MAX(P) AS DOUBLE) * MAX(N)) AS auc, CAST(MAX(P) AS BIGINT) AS P FROM ranked GROUP BY {b}cls HAVING MAX(P) > 0",
        "area_summary": (
            f"SELECT {b}SUM(auc * P) / SUM(P) AS auc_weighted, AVG(auc) AS auc_macro FROM areas"
            + (f" GROUP BY {', '.join(names)}" if names else "")
        ),
    }


@register(
    "roc_points",
    duck(
        "SELECT cls, score, ROUND(CAST(fp AS DOUBLE) / N, 6) AS fpr, ROUND(CAST(tp AS DOUBLE) / P, 6) AS tpr FROM ranked WHERE P > 0 "
        "UNION ALL SELECT DISTINCT cls, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked WHERE P > 0",
        "pred",
        **roc_sql("", "pred"),
    ),
)
def roc_points(spark, sf):
    return rounded(M.roc_points(fx.pred(spark, sf), CLASSES), "fpr", "tpr")


@register(
    "auc_per_class",
    duck("SELECT algorithm, cls, ROUND(auc, 6) AS auc, P AS positives FROM areas", "pred", "algos", **roc_sql("algorithm", "algos")),
)
def auc_per_class(spark, sf):
    found = M.auc_per_class(fx.algorithms(spark, sf), CLASSES, ["algorithm"])
    return rounded(found, "auc").withColumnRenamed("P", "positives")


_MICRO = {
    "cells_all": "SELECT fold, score, SUM(p) AS pos, SUM(q) AS neg FROM sides GROUP BY fold, score",
    "micro": "SELECT fold, score, pos, neg, SUM(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, SUM(pos) OVER (PARTITION BY fold) AS P, SUM(neg) OVER (PARTITION BY fold) AS N FROM cells_all",
}


@register(
    "auc_micro",
    duck(
        "SELECT fold, ROUND(SUM(neg * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(MAX(P) AS DOUBLE) * MAX(N)), 6) AS auc_micro FROM micro GROUP BY fold",
        "pred",
        **{"sides": roc_sql("fold", "pred")["sides"], **_MICRO},
    ),
)
def auc_micro(spark, sf):
    return rounded(M.auc_micro(fx.pred(spark, sf), CLASSES, ["fold"]), "auc_micro")


@register(
    "auc_weighted_macro",
    duck(
        f"SELECT algorithm, fold, {_round_sql(['auc_weighted', 'auc_macro'])} FROM area_summary",
        "pred",
        "algos",
        **roc_sql("algorithm fold", "algos"),
    ),
)
def auc_weighted_macro(spark, sf):
    found = M.auc_summary(fx.algorithms(spark, sf), CLASSES, ["algorithm", "fold"])
    return rounded(found, "auc_weighted", "auc_macro")


# --- summaries ------------------------------------------------------------------------------

_BY = ["algorithm", "fold"]
_DETAIL = {
    **rates_sql("algorithm fold", "algos"),
    **roc_sql("algorithm fold", "algos"),
    "detail": "SELECT s.*, a.auc_weighted, a.auc_macro FROM summary s JOIN area_summary a ON s.algorithm = a.algorithm AND s.fold = a.fold",
}
_CV = list(M.CV_METRICS)


def fold_rows(spark, sf):
    return M.evaluate(fx.algorithms(spark, sf), CLASSES, _BY)


@register(
    "cv_detail",
    duck(f"SELECT algorithm, fold, n, {_round_sql(_CV)} FROM detail", "pred", "algos", **_DETAIL),
)
def cv_detail(spark, sf):
    return rounded(fold_rows(spark, sf).select(*_BY, "n", *_CV), *_CV)


_CV_OUT = [f"{m}_{s}" for m in _CV for s in ("mean", "std")]
_CV_SQL = (
    "SELECT algorithm, COUNT(*) AS n_folds, "
    + ", ".join(f"AVG({m}) AS {m}_mean, STDDEV_POP({m}) AS {m}_std" for m in _CV)
    + " FROM detail GROUP BY algorithm"
)


@register(
    "cv_summary",
    duck(f"SELECT algorithm, n_folds, {_round_sql(_CV_OUT)} FROM cv", "pred", "algos", **_DETAIL, cv=_CV_SQL),
)
def cv_summary(spark, sf):
    return rounded(M.cv_summary(fold_rows(spark, sf)), *_CV_OUT)


@register(
    "best_algorithm",
    duck(
        "SELECT algorithm, ROUND(auc_weighted_mean, 6) AS score FROM cv ORDER BY auc_weighted_mean DESC, algorithm LIMIT 1",
        "pred",
        "algos",
        **_DETAIL,
        cv=_CV_SQL,
    ),
)
def best_algorithm(spark, sf):
    return rounded(M.best_algorithm(M.cv_summary(fold_rows(spark, sf))), "score")


@register(
    "config_rank",
    duck(
        "SELECT config, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, ROW_NUMBER() OVER (ORDER BY mean DESC, std, config) AS rank "
        "FROM (SELECT algorithm AS config, AVG(f1_macro) AS mean, STDDEV_POP(f1_macro) AS std FROM summary GROUP BY algorithm) t",
        "pred",
        "algos",
        **rates_sql("algorithm fold", "algos"),
    ),
)
def config_rank(spark, sf):
    scores = M.summary(fx.algorithms(spark, sf), _BY).select(
        F.col("algorithm").alias("config"), F.col("f1_macro").alias("score")
    )
    return rounded(M.config_rank(scores), "mean", "std")


REPLICATES = boot.N_BOOTSTRAP
_DRAW = (
    "CAST(CONCAT('0x', SUBSTR(MD5(CONCAT('42:', CAST(replicate AS STRING), ':', CAST(slot AS STRING))), 1, 15)) AS BIGINT)"
)
_BOOT = {
    "numbered": "SELECT *, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT('42:', CAST(vec_id AS STRING))), vec_id) - 1 AS idx FROM pred",
    "draws": (
        f"SELECT replicate, {_DRAW} % (SELECT COUNT(*) FROM pred) AS idx FROM (SELECT r.range AS replicate, s.range AS slot "
        f"FROM range({REPLICATES}) r, range((SELECT COUNT(*) FROM pred)) s) t"
    ),
    "sample": "SELECT d.replicate, p.label, p.pred, p.sc0, p.sc1, p.sc2 FROM draws d JOIN numbered p ON d.idx = p.idx",
    **rates_sql("replicate", "sample"),
    **roc_sql("replicate", "sample"),
    "full_ones": "SELECT replicate FROM cells GROUP BY replicate HAVING COUNT(DISTINCT label) = 3",
    "joined": "SELECT s.*, a.auc_weighted, a.auc_macro FROM summary s JOIN area_summary a ON s.replicate = a.replicate WHERE s.replicate IN (SELECT replicate FROM full_ones)",
    "long_values": " UNION ALL ".join(
        f"SELECT '{a}' AS average, '{name}' AS metric, {'accuracy' if stem is None else f'{stem}_{a}'} AS value FROM joined"
        for a in M.AVERAGES
        for name, stem in boot.NAMES.items()
    ),
}


@register(
    "bootstrap_ci",
    duck(
        "SELECT average, metric, ROUND(AVG(value), 6) AS mean, ROUND(QUANTILE_CONT(value, CAST(0.025 AS DOUBLE)), 6) AS lower, "
        "ROUND(QUANTILE_CONT(value, CAST(0.975 AS DOUBLE)), 6) AS upper, COUNT(*) AS n_replicates FROM long_values GROUP BY average, metric",
        "pred",
        **_BOOT,
    ),
)
def bootstrap_ci(spark, sf):
    found = boot.bootstrap_ci(fx.pred(spark, sf), CLASSES, "vec_id", REPLICATES)
    return rounded(found, "mean", "lower", "upper")


@register("bootstrap_vector")
def bootstrap_vector(spark, sf):
    """The same intervals from one multinomial draw for all replicates; each row moves once."""
    found = boot.bootstrap_ci(fx.pred(spark, sf), CLASSES, "vec_id", mode="vector")
    return rounded(found, "mean", "lower", "upper")
