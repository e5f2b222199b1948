"""Fitted stages of own classifiers: a model as one string parameter, applied to Arrow batches."""

from __future__ import annotations

import base64
import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dumped(**arrays) -> str:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return base64.b64encode(out.getvalue()).decode()


_LOADED: dict = {}


def loaded(model: str, unpack: Callable[[dict], dict]) -> dict:
    """The unpacked model; a worker keeps the last one."""
    if model not in _LOADED:
        _LOADED.clear()
        with np.load(io.BytesIO(base64.b64decode(model))) as z:
            _LOADED[model] = unpack(z)
    return _LOADED[model]


class SharesModel(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``; a subclass says how shares come from rows."""

    model = Param(Params._dummy(), "model", "what was fitted", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, model=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def shares(model: str, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.getOrDefault(self.model))
        of_rows = self.shares

        @F.arrow_udf("array<double>")
        def shares(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            p = of_rows(sent.value, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
            ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(p.ravel()))

        found = df.withColumn("probability", shares(vector_to_array(self.getInputCol())))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return found.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("probability"))


class KernelMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``exp(-gamma |x - z|^2)`` to every landmark z, turned so that inner products of the output are
    the kernel's values on the landmarks (and its projection onto them elsewhere)."""

    model = Param(Params._dummy(), "model", "landmarks, turn and gamma", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, model=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(marks: np.ndarray, gamma: float, inputCol: str, outputCol: str) -> "KernelMap":
        values, vectors = np.linalg.eigh(kernel(marks, marks, gamma))
        live = values > 1e-10 * values[-1]
        turn = vectors[:, live] / np.sqrt(values[live])
        return KernelMap(inputCol=inputCol, outputCol=outputCol, model=dumped(marks=marks, turn=turn, gamma=gamma))

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.getOrDefault(self.model))

        @F.arrow_udf("array<double>")
        def lift(x: pa.Array) -> pa.Array:
            m = loaded(sent.value, lambda z: {k: z[k] for k in z.files})
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            out = kernel(rows, m["marks"], float(m["gamma"])) @ m["turn"]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return df.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(self.getInputCol()))))


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    apart = (x**2).sum(axis=1)[:, None] + (z**2).sum(axis=1) - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(apart, 0.0))
