"""Leading principal axes of very wide rows without a width x width matrix.

A block of random directions is multiplied by the covariance, one pass over the rows for each
multiplication; the products span a Krylov space in which Rayleigh and Ritz's small problem gives
axes and residuals. The driver holds the space, at most ``SPACE_BYTES``; beyond that it starts anew
from the best directions so far. The fit ends when every wanted residual is small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.operators import dense

MORE = 8
SPACE_BYTES = 1 << 30
TOLERANCE = 1e-9
PASSES = 300


def krylov(product, width: int, k: int, more: int = MORE, seed: int = 42, tolerance: float = TOLERANCE, passes: int = PASSES, space: int = SPACE_BYTES):
    """Largest eigenvalues, their vectors and the number of products of a positive semidefinite
    matrix known by ``product(block)``."""
    size = min(width, k + more)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    basis, images = np.empty((width, 0)), np.empty((width, 0))
    for done in range(1, passes + 1):
        basis, images = np.column_stack([basis, block]), np.column_stack([images, product(block)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
        vectors = basis @ turn
        rest = images @ turn - vectors * values
        gaps = np.linalg.norm(rest[:, :k], axis=0)
        if basis.shape[1] >= width or (gaps <= tolerance * max(values[0], 1e-300)).all():
            return values[:k], vectors[:, :k], done
        if 16 * width * (basis.shape[1] + size) > space:
            basis, images = vectors, images @ turn
        following = rest if basis.shape[1] == vectors.shape[1] else images[:, -size:]
        for _ in range(2):
            following = following - basis @ (basis.T @ following)
        block, scale, _ = np.linalg.svd(following, full_matrices=False)
        block = block[:, scale > 1e-12 * max(scale[0], values[0])][:, : width - basis.shape[1]]
        if not block.shape[1]:
            return values[:k], vectors[:, :k], done
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    raise RuntimeError(f"residuals {gaps.max():g} after {passes} passes")


def leading_axes(centred: DataFrame, features: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (``width x k``) and explained shares of rows whose columns have mean 0."""
    one = F.lit(0).alias("label"), F.lit(1.0).alias("weight")
    blocks = dense.to_blocks(centred.select(features, *one), features, "label", "weight")
    n, squares = dense.summed(blocks, None, lambda rows, _, t: t.__iadd__(_pad([len(rows.x), (rows.x**2).sum()], len(t))), 2)
    free = max(n - 1, 1)

    def product(q: np.ndarray) -> np.ndarray:
        def each(rows, q, total):
            total[: q.size] += (rows.x.T @ (rows.x @ q)).ravel()

        return dense.summed(blocks, q, each, q.size).reshape(q.shape) / free

    values, vectors, _ = krylov(product, width, min(k, width))
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    total = squares / free
    return vectors * sign, np.maximum(values, 0) / total if total > 0 else np.zeros(len(values))


def _pad(values, size: int) -> np.ndarray:
    return np.pad(np.asarray(values, dtype=float), (0, size - len(values)))
