"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become integers, so counts, sums and deviations are exact. The leading eigenvectors of the
covariance come from passes over the rows; no pass builds a width x width matrix:

1. a pass multiplies: rows centred first, then ``X'(XQ)`` summed over blocks (map-side sums, one
   row per dimension), for a block Q of ``width x block`` numbers;
2. the three-term Chebyshev recurrence over such passes damps everything below the smallest Ritz
   value of the block and lets the wanted part grow;
3. QR and Rayleigh-Ritz on the filtered block give Ritz pairs; one more pass gives their residuals;
4. until every wanted pair is certified: its residual is at rounding level, or small and no longer
   falling. A last pass measures the covariance of the whitened rows.

The driver holds Q and sums of its size. Rows are stored once as integer blocks in the shared
folder; a lost executor repeats its part of a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import stored

COMPONENTS = 8
BLOCK = 32
SCALE, SHIFT = 1024.0, 100_000
#: residuals relative to their eigenvalue; rounding reaches a few units of the largest one
ROUNDING, CERTIFIED = 2e-15, 1e-10
#: smaller eigenvalues, relative to the largest, count as no variance
VARIES = 1e-13
#: the leading Ritz vector may outgrow the last wanted one by this much in one filter
GROWTH = 1e6
DEGREE = 12
CYCLES = 100
MAX_WIDTH = 200_000
#: larger integers lose digits as doubles; entries beyond saturate
_LIMIT = float(1 << 52)
_BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Whitening:
    """Exact sums, leading eigenpairs and their certificate."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and their entries as an integer matrix."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
    ends = column.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    width = np.diff(ends)
    usable = (bad[ends[1:]] == bad[ends[:-1]]) & (width > 0)
    if column.null_count:
        usable &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(usable)
    if not len(rows):
        return rows, np.empty((0, 0), dtype=np.int64)
    if len(set(width[rows].tolist())) > 1:
        raise ValueError("vectors differ in width")
    at = ends[rows][:, None] + np.arange(width[rows[0]])
    scaled = np.clip(np.floor(SCALE * values[at]), -_LIMIT, _LIMIT)
    return rows, scaled.astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = integers(batch.column(0))[1]
        if not len(x):
            continue
        step = max(1, _BLOCK_BYTES // (8 * x.shape[1]))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            columns = [
                pa.array([len(part)], pa.int64()),
                pa.array([part.shape[1]], pa.int32()),
                pa.array([part.sum(axis=0)], pa.list_(pa.int64())),
                pa.array([part.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "width", "sums", "x"])


def _centred(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw in batch.column(0):
            yield np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, len(mean)) - mean


def _summed(blocks: DataFrame, each, rows: int, columns: int) -> np.ndarray:
    """Sum of one ``rows x columns`` matrix per task; ``each`` turns a task's blocks into it."""
    names = [f"c{i}" for i in range(columns)]

    def run(batches):
        total = each(batches)
        if total is not None:
            arrays = [pa.array(np.arange(rows), pa.int32()), *(pa.array(total[:, i]) for i in range(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", *names])

    schema = "at int, " + ", ".join(f"{c} double" for c in names)
    parts = blocks.select("x").mapInArrow(run, schema)
    got = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("at")
    return np.stack([got.column(c).to_numpy() for c in names], axis=1)


def _product(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """Covariance times ``q`` in one pass."""
    sent = blocks.sparkSession.sparkContext.broadcast((mean, q))

    def each(batches):
        mean, q = sent.value
        total = None
        for y in _centred(batches, mean):
            part = y.T @ (y @ q)
            total = part if total is None else total + part
        return total

    out = _summed(blocks, each, len(mean), q.shape[1]) / n
    sent.unpersist()
    return out


def _whitened_moments(blocks, mean, turn) -> np.ndarray:
    """Sums of products of the whitened rows, their sums, and the sum of squared deviations."""
    k = turn.shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast((mean, turn))

    def each(batches):
        mean, turn = sent.value
        total = None
        for y in _centred(batches, mean):
            w = y @ turn
            squares = np.concatenate([[np.einsum("ij,ij->", y, y)], np.zeros(k - 1)])
            part = np.column_stack([w.T @ w, w.sum(axis=0), squares])
            total = part if total is None else total + part
        return total

    out = _summed(blocks, each, k, k + 2)
    sent.unpersist()
    return out


def _degree(top: float, low: float, cut: float) -> int:
    """Recurrence steps in one filter, so that the block stays well conditioned."""
    growth = math.acosh(max(1.0, 2 * top / cut - 1)) - math.acosh(max(1.0, 2 * low / cut - 1))
    return max(1, min(DEGREE, int(math.log(GROWTH) / growth) if growth > 0 else DEGREE))


def leading(product, width: int, wanted: int, block: int, seed: int = 42):
    """Eigenpairs of a positive semidefinite matrix known by ``product(Q)``: values, vectors,
    largest relative residual of the wanted pairs and number of products."""
    size = min(width, max(block, 2 * wanted))  # the last Ritz value must lie below the wanted ones
    q = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    passes, best, still, kept = 0, math.inf, 0, None
    for _ in range(CYCLES):
        vq = product(q)
        passes += 1
        small = q.T @ vq
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(theta[0], 0.0)
        gaps = np.linalg.norm(vq - q * theta, axis=0)[:wanted]
        live = theta[:wanted] > VARIES * top
        worst = float((gaps[live] / theta[:wanted][live]).max(initial=0.0))
        still = still + 1 if worst > best / 2 else 0
        if worst < best:
            best, kept = worst, (theta, q)
        sure = bool((gaps <= np.maximum(CERTIFIED * theta[:wanted], 16 * ROUNDING * top)).all())
        if top == 0 or size == width or worst <= ROUNDING or (sure and still >= 2):
            return *kept, best, passes
        # unwanted: between 0 and the smallest Ritz value of the block
        cut = max(theta[-1], 1e-9 * top)
        low = max(theta[min(wanted, size) - 1], cut)
        half, sigma = cut / 2, (cut / 2) / (top - cut / 2)
        first = sigma
        before, now = q, (vq - half * q) * (sigma / half)
        for _ in range(_degree(top, low, cut) - 1):
            following = 1 / (2 / first - sigma)
            vq = product(now)
            passes += 1
            before, now = now, (vq - half * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"residual {best:g} is not certified after {passes} passes")


def fit_whitening(vectors: DataFrame, column: str, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Eigenpairs of the covariance over all usable vectors; None if there are none.

    A vector is usable unless it is null, has no entry, or holds a null or non-finite one. Usable
    vectors of different widths are an error. Components without variance are left out.
    """
    raw = vectors.select(F.col(column).cast("array<double>").alias("v"))
    blocks = stored(raw.mapInArrow(_blocks, "n bigint, width int, sums array<bigint>, x binary"), "vector-blocks")
    head = blocks.agg(F.sum("n").alias("n"), F.min("width").alias("low"), F.max("width").alias("high")).first()
    if not head.n:
        return None
    if head.low != head.high:
        raise ValueError("vectors differ in width")
    if head.high > MAX_WIDTH:
        raise ValueError(f"more than {MAX_WIDTH} dimensions")
    by_place = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    sums = by_place.sort_by("at").column("s").to_numpy()
    n, width = int(head.n), int(head.high)
    mean = sums / n
    theta, q, residual, passes = leading(lambda m: _product(blocks, mean, n, m), width, min(components, width), block)
    theta, q = theta[:components], q[:, :components]
    live = theta > VARIES * max(theta[0], 0.0)
    theta, q = theta[live], q[:, live]
    if not len(theta):
        return Whitening(n, sums, theta, q, 0.0, residual, 0.0, passes)
    moments = _whitened_moments(blocks, mean, q / np.sqrt(theta))
    k = len(theta)
    centre = moments[:, k] / n
    identity = moments[:, :k] / n - np.outer(centre, centre) - np.eye(k)
    trace = float(moments[0, k + 1]) / n
    return Whitening(n, sums, theta, q, trace, residual, float(np.abs(identity).max()), passes + 1)


def whiten(
    vectors: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK
) -> DataFrame:
    """One row per usable vector and component: ``id, component, n, deviation, whitened,
    explained, identity_error``.

    ``deviation`` is exact, and null where it exceeds a long. Equal rows stay, ids may be null and
    are integers, other columns aren't read. No usable vector, or none that varies: no rows.
    """
    schema = (
        "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    found = fit_whitening(vectors, column, components, block)
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v"))
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def project(batches):
        w = sent.value
        k, mean, turn = len(w.values), w.sums / w.n, w.vectors / np.sqrt(w.values)
        for batch in batches:
            usable, x = integers(batch.column(1))
            if not len(usable):
                continue
            apart = np.abs(x * float(w.n) - w.sums)
            exact = (np.square(apart).sum(axis=1) < 2.0**62) & (np.abs(x).max(axis=1) * float(w.n) < 2.0**62)
            gap = x * w.n - w.sums
            deviation = pa.array((gap * gap).sum(axis=1), mask=~exact)
            ids = batch.column(0).take(pa.array(usable)).take(pa.array(np.repeat(np.arange(len(usable)), k)))
            many = len(usable) * k
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1), len(usable)), pa.int32()),
                pa.array(np.full(many, w.n)),
                deviation.take(pa.array(np.repeat(np.arange(len(usable)), k))),
                pa.array(((x - mean) @ turn).ravel()),
                pa.array(np.tile(w.values / w.trace, len(usable))),
                pa.array(np.full(many, w.identity_error)),
            ]
            names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id)
