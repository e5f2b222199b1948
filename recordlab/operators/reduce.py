"""Standardising and reducing feature vectors, fitted on training rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, StandardScaler, StandardScalerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.operators.krylov import leading_axes

N_COMPONENTS = 64
VARIANCE = 0.95
METHODS = ("scaled_pca", "pca", "auto", "lda", "none")
#: widest discriminants, and widest components from a matrix on the driver
MAX_WIDTH = 8192
NARROW = 2048


class Projection(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """``scale · g(x·matrix + offset)`` of a vector column, ``g`` identity or cosine.

    The matrix is a parameter of the stage, so a saved model carries it.
    """

    matrix = Param(Params._dummy(), "matrix", "rows = input width", TypeConverters.identity)
    offset = Param(Params._dummy(), "offset", "one number per output", TypeConverters.toListFloat)
    kind = Param(Params._dummy(), "kind", "'linear' or 'cosine'", TypeConverters.toString)
    ratios = Param(Params._dummy(), "ratios", "explained share per output", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, matrix=None, offset=None, kind="linear", ratios=None):
        super().__init__()
        self._setDefault(kind="linear", ratios=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        matrix = np.asarray(self.getOrDefault(self.matrix), dtype=float)
        offset = np.asarray(self.getOrDefault(self.offset), dtype=float)
        cosine = self.getOrDefault(self.kind) == "cosine"

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            out = np.stack(v.to_numpy()) @ matrix + offset
            if cosine:
                out = np.sqrt(2.0 / matrix.shape[1]) * np.cos(out)
            return pd.Series(list(out))

        vector = array_to_vector(project(vector_to_array(self.getInputCol())))
        return df.withColumn(self.getOutputCol(), vector)


# --- facts about the training part -----------------------------------------------------------


def row_count_and_width(df: DataFrame, features: str) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vector_to_array(features))).alias("d")).first()
    if row["d"] is None:
        raise ValueError("no training rows")
    return row["n"], row["d"]


def fit_standardiser(train: DataFrame, features: str, out: str, with_std: bool = True) -> list[Transformer]:
    """Mean 0 and population deviation 1; a column without variance becomes 0.

    Spark's scaler divides by the sample deviation, the second stage corrects the factor.
    """
    n, d = row_count_and_width(train, features)
    if not with_std:
        return [StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=False).fit(train)]
    scaler = StandardScaler(inputCol=features, outputCol=f"{out}_raw", withMean=True, withStd=True).fit(train)
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    fix = ElementwiseProduct(inputCol=f"{out}_raw", outputCol=out, scalingVec=Vectors.dense([factor] * d))
    return [scaler, fix]


def auto_components(ratios: Sequence[float], variance: float, limit: int) -> int:
    """Smallest count whose summed ratio reaches ``variance``, at most ``limit``."""
    cumulative = np.cumsum(ratios)
    return int(min(np.searchsorted(cumulative, variance) + 1, limit, len(ratios)))


def _lda_matrix(
    scaled: DataFrame, features: str, label: str, d: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes, offset and explained shares of the discriminants from class means and one covariance.

    The class table has one row per class; the covariance comes out of a full PCA fit, which
    Spark computes distributed. Only d×d numbers are handled here.
    """
    groups = (
        scaled.groupBy(label)
        .agg(F.count("*").alias("n"), Summarizer.mean(F.col(features)).alias("mean"))
        .collect()
    )
    counts = np.array([g["n"] for g in groups], dtype=float)
    means = np.stack([g["mean"].toArray() for g in groups])
    n, k = counts.sum(), len(groups)
    total = scaled.agg(Summarizer.variance(F.col(features)).alias("v")).first()["v"].toArray().sum()
    pca = PCA(k=d, inputCol=features, outputCol="__p").fit(scaled)
    axes, ratios = pca.pc.toArray(), pca.explainedVariance.toArray()
    covariance = (axes * (ratios * total)) @ axes.T
    centre = counts @ means / n
    spread = means - centre
    within = ((n - 1) * covariance - (spread.T * counts) @ spread) / max(n - k, 1)
    unit = np.sqrt(np.clip(np.diag(within), 0, None))
    unit[unit < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(within / np.outer(unit, unit))
    keep = values > 1e-10 * values.max()
    whiten = (vectors[:, keep] / unit[:, None]) / np.sqrt(values[keep])
    _, size, vt = np.linalg.svd((np.sqrt(counts)[:, None] * spread) @ whiten, full_matrices=False)
    axes = min(k - 1, d)
    matrix = whiten @ vt.T[:, :axes]
    return matrix, -(centre @ matrix), (size**2 / (size**2).sum())[:axes]


def fit_reducer(
    train: DataFrame,
    method: str = "scaled_pca",
    n_components: int = N_COMPONENTS,
    variance: float = VARIANCE,
    features: str = "features",
    label: str = "label",
    out: str = "reduced",
    narrow: int = NARROW,
) -> PipelineModel:
    """A fitted reducer from training rows; apply it to any rows with ``transform``.

    Principal components of more than ``narrow`` columns come from passes over the rows instead of
    a d×d matrix, whatever the width.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n, d = row_count_and_width(train, features)
    if method == "none":
        return PipelineModel([VectorAssembler(inputCols=[features], outputCol=out)])
    if method == "lda" and d > MAX_WIDTH:
        raise ValueError(f"vectors of width {d}: {method} keeps a d×d matrix on the driver")
    scaled = f"{out}_scaled"
    stages = fit_standardiser(train, features, scaled, with_std=method != "pca")
    ready = PipelineModel(stages).transform(train)
    if method == "lda":
        matrix, offset, ratios = _lda_matrix(ready, scaled, label, d)
        last = Projection(
            inputCol=scaled, outputCol=out, matrix=matrix.tolist(), offset=offset.tolist(), ratios=ratios.tolist()
        )
        return PipelineModel([*stages, last])
    if d > narrow:
        axes, ratios = leading_axes(ready, scaled, d, min(n_components, d, n))
        if method == "auto":
            k = auto_components(ratios, variance, len(ratios))
            axes, ratios = axes[:, :k], ratios[:k]
        offset = [0.0] * axes.shape[1]
        last = Projection(inputCol=scaled, outputCol=out, matrix=axes.tolist(), offset=offset, ratios=ratios.tolist())
        return PipelineModel([*stages, last])
    if method == "auto":
        full = PCA(k=min(d, n), inputCol=scaled, outputCol=f"{out}_full").fit(ready)
        k = auto_components(full.explainedVariance.toArray(), variance, min(n_components, d, n))
        return PipelineModel(
            [*stages, full, VectorSlicer(inputCol=f"{out}_full", outputCol=out, indices=list(range(k)))]
        )
    return PipelineModel([*stages, PCA(k=min(n_components, d, n), inputCol=scaled, outputCol=out).fit(ready)])


def reduce_rows(model: PipelineModel, df: DataFrame, out: str = "reduced") -> DataFrame:
    """Apply a reducer and keep only its final column."""
    return model.transform(df).select(*df.columns, out)


def _components(model: PipelineModel) -> tuple[np.ndarray, list[float]] | None:
    """Loadings and explained shares of a fitted PCA or discriminant reducer."""
    for stage in model.stages:
        if isinstance(stage, PCAModel):
            return stage.pc.toArray(), stage.explainedVariance.toArray().tolist()
        if isinstance(stage, Projection):
            return np.asarray(stage.getOrDefault(stage.matrix)), stage.getOrDefault(stage.ratios)
    return None


def variance_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``component, ratio, cumulative`` of the fitted components (one row per component)."""
    found = _components(model)
    rows = [(i + 1, float(r)) for i, r in enumerate(found[1] if found else [])]
    table = df.sparkSession.createDataFrame(rows, "component INT, ratio DOUBLE")
    running = W.orderBy("component").rowsBetween(W.unboundedPreceding, 0)
    return table.withColumn("cumulative", F.sum("ratio").over(running))


def component_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``component, feature, loading`` (PCA components or discriminant scalings)."""
    found = _components(model)
    rows = [(j + 1, i + 1, float(v)) for (i, j), v in np.ndenumerate(found[0])] if found else []
    return df.sparkSession.createDataFrame(rows, "component INT, feature INT, loading DOUBLE")


def diagnostics(model: PipelineModel, train: DataFrame, val: DataFrame, method: str, key: str = "rec_id") -> dict[str, DataFrame]:
    """Tables about a reducer: components, variance, mean, reduced rows and a summary."""
    spark = train.sparkSession
    mean = next((s.mean.toArray() for s in model.stages if isinstance(s, StandardScalerModel)), [])
    reduced = [
        reduce_rows(model, rows).select(key, "label", F.lit(role).alias("role"), vector_to_array("reduced").alias("reduced"))
        for role, rows in (("train", train), ("val", val))
    ]
    both = reduced[0].unionByName(reduced[1])
    variance = variance_table(model, train)
    summary = both.groupBy("role").agg(
        F.lit(method).alias("method"), F.count("*").alias("n_rows"), F.max(F.size("reduced")).alias("width")
    )
    return {
        "components": component_table(model, train),
        "variance": variance,
        "mean": spark.createDataFrame([(i + 1, float(m)) for i, m in enumerate(mean)], "feature INT, mean DOUBLE"),
        "reduced": both,
        "summary": summary,
    }


#: fixed value: what a missing further feature is for a classifier
MISSING_FEATURE = -1.0


def append_features(
    df: DataFrame,
    extra: Sequence[str],
    reduced: str = "reduced",
    out: str = "features_all",
    missing: float | None = MISSING_FEATURE,
) -> DataFrame:
    """Reduced vector followed by further numeric columns, unscaled; the columns stay as they are.

    A null among them enters the vector as ``missing``; with ``missing=None`` it is an error.
    """
    if missing is None:
        return VectorAssembler(inputCols=[reduced, *extra], outputCol=out).transform(df)
    filled = {f"__extra{i}": F.coalesce(F.col(c).cast("double"), F.lit(missing)) for i, c in enumerate(extra)}
    joined = VectorAssembler(inputCols=[reduced, *filled], outputCol=out).transform(df.withColumns(filled))
    return joined.drop(*filled)


def as_features(df: DataFrame, vector: str = "vector", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector)))
