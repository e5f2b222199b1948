"""Text vectors from the corpus without a vocabulary: hashed contexts, factorised in passes.

Words fall into ``buckets`` by hash. How often two buckets stand within ``window`` words of each
other is one aggregation; its positive pointwise mutual information is a sparse symmetric matrix
that stays distributed. Its leading singular vectors come from a block Krylov space, each product
a pass over the stored cells, and give every bucket a vector; a text is the mean of its words'.
The driver holds ``buckets x size`` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.functions.arrays import l2_normalise
from recordlab.functions.text import tokens
from recordlab.operators.krylov import krylov
from recordlab.session import scratch_path

SIZE, WINDOW, BUCKETS = 100, 5, 1 << 13
#: places counted at a time, and different pairs that a task holds before it passes them on
STEP, HELD = 1 << 19, 1 << 22
#: residuals relative to the largest singular value's square; finer ones don't change a text
TOLERANCE = 1e-2


def _buckets(column: str, buckets: int) -> Column:
    words = tokens(F.coalesce(F.col(column), F.lit("")))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def context_counts(df: DataFrame, column: str = "text", window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """``a, b, n``: places where buckets stand within ``window`` words, in both orders.

    Tasks count unordered pairs in Arrow batches and pass on a pair once per ``HELD`` different ones,
    so that a pair's places are neither rows nor shuffled.
    """
    rows = df.select(_buckets(column, buckets).alias("w")).where(F.size("w") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for found in _codes(batch.column(0), window, buckets):
                more, n = np.unique(found, return_counts=True)
                codes, counts = _added(codes, counts, more, n)
                if len(codes) > HELD:
                    yield _counted(codes, counts, buckets)
                    codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield _counted(codes, counts, buckets)

    one = rows.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    here = F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    twice = F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))
    return one.select(F.inline(F.when(F.col("a") == F.col("b"), twice).otherwise(here)))


def _codes(words: pa.ListArray, window: int, buckets: int) -> Iterator[np.ndarray]:
    """``smaller * buckets + larger`` of every two words of a text within ``window``, ``STEP`` places at a time."""
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    text = np.repeat(np.arange(len(words)), np.diff(ends))
    for start in range(0, len(flat), STEP):
        parts = []
        for d in range(1, window + 1):
            b = flat[start + d : start + d + STEP]
            a = flat[start : start + len(b)]
            own = text[start : start + len(b)] == text[start + d : start + d + STEP]
            parts.append((np.minimum(a, b) * buckets + np.maximum(a, b))[own])
        yield np.concatenate(parts)


def _added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of codes with counts as one."""
    every = np.concatenate([codes, more])
    order = np.argsort(every, kind="stable")
    every = every[order]
    if not len(every):
        return every, np.concatenate([counts, n])
    start = np.flatnonzero(np.concatenate([[True], np.diff(every) != 0]))
    return every[start], np.add.reduceat(np.concatenate([counts, n])[order], start)


def _counted(codes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    arrays = [pa.array(codes // buckets, pa.int32()), pa.array(codes % buckets, pa.int32()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])


@dataclass
class ContextVectors:
    """Fitted bucket vectors; ``transform`` adds unit text vectors (all 0 without a known word)."""

    matrix: np.ndarray

    def transform(self, df: DataFrame, column: str = "text", out: str = "vector", normalise: bool = True) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.matrix)

        @F.arrow_udf("array<double>")
        def mean(words: pa.Array) -> pa.Array:
            matrix = sent.value
            ends = words.offsets.to_numpy().astype(np.int64)
            flat = words.values.to_numpy(zero_copy_only=False)
            means = np.zeros((len(words), matrix.shape[1]))
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if b > a:
                    where, n = np.unique(flat[a:b], return_counts=True)
                    means[i] = n @ matrix[where] / (b - a)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * matrix.shape[1], pa.int32()), pa.array(means.ravel()))

        found = df.withColumn(out, mean(_buckets(column, len(self.matrix))))
        return found.withColumn(out, l2_normalise(F.col(out))) if normalise else found


def _times(cells: DataFrame, q: np.ndarray) -> np.ndarray:
    """Sparse matrix ``a, b, v`` times ``q``; tasks add up their own rows first."""
    sent = cells.sparkSession.sparkContext.broadcast(q)
    size, names = q.shape[1], [f"c{i}" for i in range(q.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = sent.value, None
        for batch in batches:
            a, b, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) != 0]))
            total = np.zeros_like(q) if total is None else total
            total[a[order][start]] += np.add.reduceat(v[order, None] * q[b[order]], start, axis=0)
        if total is not None:
            rows = np.flatnonzero(total.any(axis=1))
            arrays = [pa.array(rows, pa.int32()), *(pa.array(total[rows, i]) for i in range(size))]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", *names])

    parts = cells.select("a", "b", "v").mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    sent.unpersist()
    out = np.zeros_like(q)
    if got.num_rows:
        out[got.column("at").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], axis=1)
    return out


def fit_context_vectors(
    df: DataFrame, column: str = "text", size: int = SIZE, window: int = WINDOW, buckets: int = BUCKETS, tolerance: float = TOLERANCE
) -> ContextVectors:
    """Bucket vectors ``U sqrt(S)`` of the corpus; a corpus without contexts gives zeros."""
    counts = context_counts(df, column, window, buckets)
    path = scratch_path(df.sparkSession, "contexts")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    sums = np.zeros(buckets)
    for r in counts.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        sums[r.a] = r.n
    if not sums.any():
        return ContextVectors(np.zeros((buckets, size)))
    totals = df.sparkSession.createDataFrame([(i, float(n)) for i, n in enumerate(sums) if n], "k int, t double")
    left, right = (F.broadcast(totals.select(F.col("k").alias(f"k{s}"), F.col("t").alias(f"t{s}"))) for s in "ab")
    ratio = F.col("n") * F.lit(float(sums.sum())) / (F.col("ta") * F.col("tb"))
    cells = counts.join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb")).select("a", "b", F.log(ratio).alias("v"))
    path = scratch_path(df.sparkSession, "information")
    cells.where("v > 0").write.parquet(path)
    cells = df.sparkSession.read.schema(cells.schema).parquet(path)
    live = np.flatnonzero(sums)
    wanted = min(size, len(live))

    def product(q: np.ndarray) -> np.ndarray:
        return _times(cells, _times(cells, q))

    squares, vectors, _ = krylov(product, buckets, wanted, tolerance=tolerance)
    matrix = np.zeros((buckets, size))
    matrix[:, :wanted] = vectors * np.maximum(squares, 0.0) ** 0.25
    return ContextVectors(matrix)
