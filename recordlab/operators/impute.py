"""Exact k-nearest-neighbour imputation as a block join.

Distances are Euclidean over the columns both rows have, scaled by ``sqrt(D / shared)``; a
missing cell becomes the mean of the k nearest rows that have the column, or the column mean
when no row qualifies. Equal distances are ordered by the donor's value, which makes the result
independent of row order and lets copies of a row be merged up front.

How it spreads:

1. Equal rows become one vector with a count, so a hot group of copies costs one row.
2. Vectors are range-partitioned by (missing pattern, widest column) and cut into blocks, each
   with a bounding box. The block size follows the row count so that all boxes together stay
   below ``MAX_BOX_BYTES``; only boxes are broadcast.
3. Every block with missing cells first meets the ``NEAR`` nearest blocks and those that surely
   hold k donors, in one task. That gives each of its cells a true upper bound of its k-th entry,
   by distance and value, so that a cell whose k entries are ties at the least value is closed.
4. A second pass joins a block only with the blocks whose box may hold a better entry for one of
   its cells. A task takes up to ``GROUP`` blocks and ``DONOR_BYTES`` of donors, bounds each row by each
   donor block's box, keeps k entries a cell and tightens the bounds as it goes. Nothing else is
   dropped, so the answer equals brute force.

The rows themselves, read several times, and all steps are stored as compressed scratch tables; those
that the answer does not read are deleted when it is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.session import cleaned_exchanges, cut_lineage, drop_scratch, scratch_scope, stored

N_NEIGHBORS = 5
MAX_BOX_BYTES = 64 << 20
MIN_BLOCK_ROWS = 512
PARTITION_ROWS = 200_000
KERNEL_CELLS = 1_000_000
PAIRS_PER_TASK = 64
NEAR = 8
GROUP = 32
DONOR_BYTES = 32 << 20
BOUND_BLOCKS = 256
HOT_COPIES = 1_000_000

BLOCK_SCHEMA = (
    "block STRING, n INT, has_missing BOOLEAN, lo BINARY, hi BINARY, every BINARY, some BINARY, "
    "filled BINARY, vectors BINARY, weights BINARY, ids ARRAY<STRING>"
)
PAIR_SCHEMA = "tile INT, rblock STRING, dblock STRING, rank INT"
MATCH_SCHEMA = (
    "rblock STRING, limits BINARY, top BINARY, "
    "ridx ARRAY<INT>, col ARRAY<INT>, d ARRAY<DOUBLE>, v ARRAY<DOUBLE>, w ARRAY<BIGINT>"
)


# --- blocks ---------------------------------------------------------------------------------


def _split(rows: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Index sets of at most ``leaf`` rows, halving the widest column each time."""
    stack = [np.arange(len(rows))]
    while stack:
        idx = stack.pop()
        if len(idx) <= leaf:
            yield idx
            continue
        part = rows[idx]
        gone = np.isnan(part)
        spread = np.where(gone, -np.inf, part).max(axis=0) - np.where(gone, np.inf, part).min(axis=0)
        order = np.argsort(part[:, int(np.argmax(spread))], kind="stable")
        half = len(idx) // 2
        stack += [idx[order[:half]], idx[order[half:]]]


def _block_row(name: str, x: np.ndarray, weights: np.ndarray, ids: np.ndarray) -> dict:
    has = ~np.isnan(x)
    return {
        "block": name,
        "n": len(x),
        "has_missing": bool((~has).any()),
        # an empty column has the box (inf, -inf) and is never shared
        "lo": np.where(has, x, np.inf).min(axis=0).tobytes(),
        "hi": np.where(has, x, -np.inf).max(axis=0).tobytes(),
        "every": has.all(axis=0).tobytes(),
        "some": has.any(axis=0).tobytes(),
        "filled": (has * weights[:, None]).sum(axis=0).astype(np.int64).tobytes(),
        "vectors": np.ascontiguousarray(x).tobytes(),
        "weights": weights.astype(np.int64).tobytes(),
        "ids": ids.tolist(),
    }


def _blocks(distinct: DataFrame, width: int, leaf: int) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)  # one range partition, about PARTITION_ROWS vectors
        if not frames:
            return
        pdf = pd.concat(frames)
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        weights, ids = pdf["w"].to_numpy(), pdf["vid"].to_numpy()
        patterns, inverse = np.unique(pdf["pattern"].to_numpy().astype(str), return_inverse=True)
        sizes = np.bincount(inverse, minlength=len(patterns))
        # rare patterns share blocks; a mixed box is looser but still a valid bound
        rare = sizes < max(leaf // 8, 1)
        groups = [np.flatnonzero(inverse == p) for p in np.flatnonzero(~rare)]
        groups.append(np.flatnonzero(rare[inverse]))
        part, rows, n = TaskContext.get().partitionId(), [], 0
        for group in groups:
            for idx in _split(x[group], leaf) if len(group) else ():
                at = group[idx]
                rows.append(_block_row(f"{part}:{n}", x[at], weights[at], ids[at]))
                n += 1
                if len(rows) == 16:
                    yield pd.DataFrame(rows)
                    rows = []
        if rows:
            yield pd.DataFrame(rows)

    return distinct.mapInPandas(build, BLOCK_SCHEMA)


class _Boxes:
    """Bounding boxes of all blocks as arrays."""

    def __init__(self, rows: Sequence, width: int):
        def stack(field: str, kind: type) -> np.ndarray:
            return np.stack([np.frombuffer(r[field], dtype=kind) for r in rows]).reshape(-1, width)

        self.names = [r["block"] for r in rows]
        self.lo, self.hi = stack("lo", np.float64), stack("hi", np.float64)
        self.every, self.some = stack("every", np.bool_), stack("some", np.bool_)
        self.filled = stack("filled", np.int64)
        self.width = width

    def lower_bounds(self, i: int, others: "_Boxes") -> np.ndarray:
        """Least possible squared distance from any row of block i to each other block.

        Columns that both sides always have count with their box gap. The scale is
        ``D / shared`` and shared is at most the number of columns both sides may have.
        """
        sure = others.every & self.every[i]
        most = (others.some & self.some[i]).sum(axis=1)
        gap = np.maximum(np.maximum(others.lo - self.hi[i], self.lo[i] - others.hi), 0.0)
        total = np.where(sure, np.where(np.isfinite(gap), gap, 0.0) ** 2, 0.0).sum(axis=1)
        # one part in 10**12 below, so that rounding never discards an equal distance
        bound = total * self.width / np.maximum(most, 1) * (1 - 1e-12)
        return np.where(most > 0, bound, np.inf)

    def centre_distance(self, i: int, others: "_Boxes") -> np.ndarray:
        sure = others.every & self.every[i]
        with np.errstate(invalid="ignore"):
            mid = (others.lo + others.hi) / 2 - (self.lo[i] + self.hi[i]) / 2
        return np.where(sure, np.nan_to_num(mid) ** 2, 0.0).sum(axis=1) * self.width / np.maximum(sure.sum(axis=1), 1)


def _seed_pairs(mine: _Boxes, i: int, boxes: _Boxes, k: int) -> list[int]:
    """The ``NEAR`` nearest blocks and those that surely give each missing column k donors, nearest first."""
    missed = ~mine.every[i]
    useful = (boxes.every & mine.every[i]).any(axis=1) & (boxes.filled[:, missed] > 0).any(axis=1)
    order = np.lexsort((mine.centre_distance(i, boxes), mine.lower_bounds(i, boxes)))
    order = order[useful[order]]
    place = np.zeros(len(order), dtype=bool)
    place[:NEAR] = True
    for c in np.flatnonzero(missed):
        donors = np.flatnonzero(boxes.filled[order, c] > 0)
        enough = int(np.searchsorted(np.cumsum(boxes.filled[order[donors], c]), k)) + 1
        place[donors[:enough]] = True
    return order[place].tolist()


def _better_pairs(mine: _Boxes, i: int, boxes: _Boxes, top: np.ndarray) -> np.ndarray:
    """Blocks that may hold an entry below ``top`` (distance, value) of a missing column, nearest first."""
    low = mine.lower_bounds(i, boxes)
    found = np.zeros(len(low), dtype=bool)
    for c in np.flatnonzero(~mine.every[i]):
        d, v = top[0, c], top[1, c]
        # a donor must have the column this block misses
        found |= (boxes.filled[:, c] > 0) & ((low < d) | ((low == d) & (boxes.lo[:, c] < v)))
    picked = np.flatnonzero(found & np.isfinite(low))
    return picked[np.argsort(low[picked], kind="stable")]


# --- kernel ---------------------------------------------------------------------------------


def _distances(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared scaled distances; inf where two rows share no column."""
    has_r, has_x = ~np.isnan(r), ~np.isnan(x)
    total = np.zeros((len(r), len(x)))
    some, every = has_r.any(axis=0) & has_x.any(axis=0), has_r.all(axis=0) & has_x.all(axis=0)
    for s in np.flatnonzero(some).tolist():
        gap = r[:, s, None] - x[None, :, s]
        gap *= gap
        if not every[s]:
            np.nan_to_num(gap, copy=False, nan=0.0)
        total += gap
    if (some & ~every).any():
        shared = has_r.astype(float) @ has_x.T.astype(float)
    else:
        shared = np.full(1, float(every.sum()))
    # always (total · D) / shared, so that equal distances stay equal in every block
    total *= r.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total / shared, np.inf)


class _Donors:
    """Donor blocks of one task, with the boxes of what they give."""

    def __init__(self, blocks: Sequence[tuple[str, np.ndarray, np.ndarray]], width: int):
        self.at = {name: i for i, (name, _, _) in enumerate(blocks)}
        self.x, self.weights, self.width = [x for _, x, _ in blocks], [w for _, _, w in blocks], width
        self.has = [~np.isnan(x) for x in self.x]
        shape = (len(blocks), width)
        self.lo, self.hi, every, self.some = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape, bool), np.zeros(shape, bool)
        for i, (x, has) in enumerate(zip(self.x, self.has)):
            if len(x):
                self.lo[i], self.hi[i] = np.where(has, x, np.inf).min(axis=0), np.where(has, x, -np.inf).max(axis=0)
                every[i], self.some[i] = has.all(axis=0), has.any(axis=0)
        # only columns that all rows of a block have bound a distance
        self.sure_lo, self.sure_hi = np.where(every, self.lo, -np.inf), np.where(every, self.hi, np.inf)

    def lower_bounds(self, r: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """Least possible squared distance of each row to each picked block; inf where they share no column."""
        low = np.zeros((len(r), len(picked)))
        for s in np.flatnonzero(~np.isnan(r).all(axis=0)):
            own = r[:, s, None]
            # a row without the column has no gap
            gap = np.fmax(np.fmax(self.sure_lo[picked, s] - own, own - self.sure_hi[picked, s]), 0.0)
            low += gap * gap
        most = (~np.isnan(r)).astype(float) @ self.some[picked].T.astype(float)
        return np.where(most > 0, low * self.width / np.maximum(most, 1) * (1 - 1e-12), np.inf)

    def open_cells(self, i: int, gone: np.ndarray, limits: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Missing cells that an entry of block ``i`` may improve: distance to its box, then its least value."""
        low = low[:, None]
        near = (low < limits[0]) | ((low == limits[0]) & (self.lo[i] < limits[1]))
        return gone & self.some[i] & near & np.isfinite(low)


def _first_k(row, donor, d, v, k: int) -> tuple[np.ndarray, ...]:
    """The k smallest by (distance, value) of each row. A donor counts at least once, so k entries are enough."""
    order = np.lexsort((v, d, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    order = order[keep]
    return row[keep], donor[order], d[order], v[order]


def _pair_candidates(r, limits, opened, x, has_x, weights, k: int) -> Iterator[tuple]:
    """Per missing column the entries below the limit of an opened cell: column, row index, distance, value, count."""
    reach = np.where(opened, limits[0], -np.inf).max(axis=1)
    tied = np.flatnonzero(reach == 0)
    # cells whose entries are at distance 0 already are improved by smaller values only
    highest = np.where(opened[tied], limits[1][tied], -np.inf).max(axis=0, initial=-np.inf)
    smaller = np.flatnonzero((has_x & (x < highest)).any(axis=1))
    for rows, donors in ((tied, smaller), (np.flatnonzero(reach > 0), np.arange(len(x)))):
        if not len(rows) or not len(donors):
            continue
        xs, has = x[donors], has_x[donors]
        step = max(1, KERNEL_CELLS // len(xs))
        for start in range(0, len(rows), step):
            at = rows[start : start + step]
            gone, most, value = opened[at], limits[0][at], limits[1][at]
            dist = _distances(r[at], xs)
            close = (dist <= reach[at, None]) & np.isfinite(dist)
            few = int(close.sum()) <= 32 * k * len(at)
            if few:
                row, donor = np.nonzero(close)
                d = dist[row, donor]
            for c in np.flatnonzero(gone.any(axis=0) & has.any(axis=0)):
                if few:
                    fit = gone[row, c] & has[donor, c]
                    i, j, dij = row[fit], donor[fit], d[fit]
                else:
                    wanted, givers = np.flatnonzero(gone[:, c]), np.flatnonzero(has[:, c])
                    part = dist[np.ix_(wanted, givers)]
                    ok = close[np.ix_(wanted, givers)]
                    if len(givers) > k:
                        ok &= part <= np.partition(part, k - 1, axis=1)[:, k - 1, None]
                    i, j = np.nonzero(ok)
                    i, j, dij = wanted[i], givers[j], part[i, j]
                v = xs[j, c]
                below = (dij < most[i, c]) | ((dij == most[i, c]) & (v < value[i, c]))
                i, j, dij, v = _first_k(i[below], j[below], dij[below], v[below], k)
                if len(i):
                    yield c, at[i], dij, v, weights[donors[j]]


def _merge(kept: tuple | None, more: tuple, limits: np.ndarray, c: int, k: int) -> tuple:
    """The first entries of each row of column ``c`` whose counts reach k; lowers the limits of full cells."""
    row, d, v, w = more if kept is None else (np.concatenate(p) for p in zip(kept, more))
    row, at, d, v = _first_k(row, np.arange(len(row)), d, v, k)
    w = w[at]
    # a count above k is as good as k, and sums stay small
    total = np.cumsum(np.minimum(w, k))
    first = np.searchsorted(row, row)
    before = total - np.minimum(w, k)
    before = before - before[first]
    full = np.flatnonzero((before < k) & (before + w >= k))
    limits[0][row[full], c], limits[1][row[full], c] = d[full], v[full]
    keep = before < k
    return row[keep], d[keep], v[keep], w[keep]


def _match(pairs: DataFrame, blocks: DataFrame, bounds: DataFrame | None, width: int, k: int) -> DataFrame:
    """The k first entries per cell of all block pairs, and the limits they leave, a row per block and task.

    The pairs of one ``tile`` meet in one task; its payload travels once, by equi-join on the block name.
    """
    pairs = stored(pairs, "block-pairs")
    tiles = pairs.select("tile").distinct().count()
    tasks = max(1, min(tiles, max(pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS_PER_TASK)))
    left = blocks.where("has_missing").select(F.col("block").alias("rblock"), F.col("vectors").alias("r"))
    if bounds is None:
        left = left.withColumn("limits", F.lit(None).cast("binary"))
    else:
        left = left.join(bounds.select("rblock", "limits"), "rblock", "left")
    left = (
        pairs.groupBy("tile", "rblock")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dblock"))), lambda e: e["dblock"]).alias("dblocks"))
        .join(left, "rblock")
        .select("tile", "rblock", "r", "limits", "dblocks")
    )
    right = blocks.select(F.col("block").alias("dblock"), F.col("vectors").alias("x"), "weights")
    right = pairs.select("tile", "dblock").distinct().join(right, "dblock")
    right = right.select(F.col("tile").alias("on"), "dblock", "x", "weights")

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        given = []
        for _, name, x, weights in others.itertuples(index=False):
            weights = np.frombuffer(weights, dtype=np.int64)
            # rows of weight 0 only want values; they are never donors
            gives = weights > 0
            given.append((name, np.frombuffer(x).reshape(-1, width)[gives], weights[gives]))
        donors, rows = _Donors(given, width), []
        for _, name, r, limits, dblocks in own.itertuples(index=False):
            r = np.frombuffer(r).reshape(-1, width)
            if limits is None:
                limits = np.full((2, *r.shape), np.inf)
            else:
                limits = np.frombuffer(limits).reshape(2, *r.shape).copy()
            rows.append(_match_row(name, r, limits, _nearest(r, limits, donors, [donors.at[d] for d in dblocks], k)))
        return pd.DataFrame(rows, columns=["rblock", "limits", "top", "ridx", "col", "d", "v", "w"])

    left, right = left.repartitionById(tasks, "tile").groupBy("tile"), right.repartitionById(tasks, "on").groupBy("on")
    return left.cogroup(right).applyInPandas(run, MATCH_SCHEMA)


def _nearest(r: np.ndarray, limits: np.ndarray, donors: _Donors, order: Sequence[int], k: int) -> dict[int, tuple]:
    """The first entries of each column of ``r`` among the blocks in ``order``; lowers the limits."""
    kept: dict[int, tuple] = {}
    gone = np.isnan(r)
    for start in range(0, len(order), BOUND_BLOCKS):
        picked = np.array(order[start : start + BOUND_BLOCKS])
        low = donors.lower_bounds(r, picked)
        for j, i in enumerate(picked.tolist()):
            # bounds are of the rows, not of their box, and limits as the blocks before have left them
            opened = donors.open_cells(i, gone, limits, low[:, j])
            if opened.any():
                # the limits of a column are read before its own entries are merged
                for c, *more in list(_pair_candidates(r, limits, opened, donors.x[i], donors.has[i], donors.weights[i], k)):
                    kept[c] = _merge(kept.get(c), tuple(more), limits, c, k)
    return kept


def _match_row(name: str, r: np.ndarray, limits: np.ndarray, kept: dict[int, tuple]) -> tuple:
    """One block's entries, its cells' limits and the highest limit of each column."""
    gone = np.isnan(r)
    d = np.where(gone, limits[0], -np.inf)
    top = d.max(axis=0)
    value = np.where(gone & (d == top), limits[1], -np.inf).max(axis=0)
    parts = [(p[0], np.full(len(p[0]), c), *p[1:]) for c, p in sorted(kept.items())]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 5
    kinds = (np.int32, np.int32, float, float, np.int64)
    return name, limits.tobytes(), np.stack([top, value]).tobytes(), *(c.astype(t) for c, t in zip(columns, kinds))


def _entries(matched: DataFrame) -> DataFrame:
    """``rblock, ridx, col, d, v, w``, a row per entry."""
    return matched.select("rblock", F.inline(F.arrays_zip("ridx", "col", "d", "v", "w")))


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """Nearest entries per cell with the part ``use`` of their count that fits into k."""
    cell = W.partitionBy("rblock", "ridx", "col")
    before = F.coalesce(
        F.sum("w").over(cell.orderBy("d", "v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        candidates.groupBy("rblock", "ridx", "col", "d", "v")
        .agg(F.sum("w").alias("w"))
        .withColumn("before", before)
        .where(F.col("before") < k)
        .withColumn("use", F.least(F.col("w"), F.lit(k) - F.col("before")))
    )


def _make_pairs(spark: SparkSession, mine: DataFrame, boxes, width: int, k: int, seed: bool, sides: tuple[int, int]) -> DataFrame:
    """Block pairs to compare: the seeds, or all others that may improve on ``top``.

    The seeds of a block are a tile; else a tile is a group of blocks by a group of donor blocks, as many
    as ``sides`` says.
    """
    shared = spark.sparkContext.broadcast(boxes)
    rows, columns = sides
    across = -(-len(boxes.names) // columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = shared.value
        place = {name: i for i, name in enumerate(every.names)}
        for pdf in batches:
            own = _Boxes(pdf.to_dict("records"), width)
            for i, name in enumerate(own.names):
                picked = np.array(_seed_pairs(own, i, every, k), dtype=np.int64)
                tile = np.full(len(picked), place[name])
                if not seed:
                    top = pdf["top"].iloc[i]
                    top = np.full((2, width), np.inf) if top is None else np.frombuffer(top).reshape(2, width)
                    better = _better_pairs(own, i, every, top)
                    # the entries of the seeds are known
                    picked = better[~np.isin(better, picked)]
                    tile = place[name] // rows * across + picked // columns
                if len(picked):
                    names = [every.names[j] for j in picked.tolist()]
                    yield pd.DataFrame({"tile": tile, "rblock": name, "dblock": names, "rank": range(len(picked))})

    return mine.mapInPandas(run, PAIR_SCHEMA)


def _attach(rows: DataFrame, filled: DataFrame, distinct: DataFrame) -> DataFrame:
    """Left join of the filled values. Vectors with very many copies go by broadcast.

    A vector is hot with a ten-thousandth of all rows or more, so there are at most 10,000.
    """
    total = distinct.agg(F.sum("w")).first()[0] or 0
    limit = max(HOT_COPIES, -(-total // 10_000))
    hot = distinct.where(F.col("w") >= limit).select("vid")
    if not hot.count():
        return rows.join(filled, "vid", "left")
    hot = cut_lineage(hot)
    hot_rows = rows.join(F.broadcast(hot.join(filled, "vid", "left")), "vid")
    cold_rows = rows.join(F.broadcast(hot), "vid", "left_anti").join(filled, "vid", "left")
    return hot_rows.unionByName(cold_rows)


# --- operator -------------------------------------------------------------------------------


def knn_impute(
    df: DataFrame,
    columns: Sequence[str],
    k: int = N_NEIGHBORS,
    scale: bool = False,
    fit_on: DataFrame | None = None,
    min_block_rows: int = MIN_BLOCK_ROWS,
    keep: bool = True,
) -> DataFrame:
    """Fill the nulls of ``columns`` from the k nearest rows.

    ``fit_on`` restricts the donors to other rows (training rows), ``scale`` divides each column
    by its standard deviation first (off by default: raw units). A column without any value
    stays null. The rows are read several times and stored first; ``keep=False`` says that they are
    cheap to read.
    """
    made: list[str] = []
    with cleaned_exchanges(df.sparkSession), scratch_scope(made):
        with scratch_scope([]) as needed:
            rows = stored(df, "impute-rows") if keep else df
        out, filled = _imputed(rows, columns, k, scale, fit_on, min_block_rows, keep)
    drop_scratch(df.sparkSession, [path for path in made if path not in (*needed, *filled)])
    return out


def _imputed(
    df: DataFrame, columns: Sequence[str], k: int, scale: bool, fit_on: DataFrame | None, min_block_rows: int, keep: bool
) -> tuple[DataFrame, list[str]]:
    """The filled rows, and the scratch tables they are read from."""
    spark = df.sparkSession
    values = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    if fit_on is not None and keep:
        fit_on = stored(fit_on.select(*[F.col(f"`{c}`") for c in columns]), "impute-donors")
    source = df if fit_on is None else fit_on
    facts = source.select(*[v.alias(c) for c, v in values.items()]).agg(
        *[f(F.col(f"`{c}`")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    used = [(i, c) for i, c in enumerate(columns) if facts[f"n_{i}"]]
    if not used:
        return df, []
    names, width = [c for _, c in used], len(used)
    means = [facts[f"m_{i}"] for i, _ in used]
    spread = [facts[f"s_{i}"] or 0.0 for i, _ in used]
    unit = [s if scale and s > 0 else 1.0 for s in spread]

    x = F.array(*[(values[c] + 0.0) / F.lit(u) for c, u in zip(names, unit)])
    vector_id = F.md5(F.to_json("__x"))
    keyed = df.withColumn("__x", x).withColumn("__miss", F.exists("__x", lambda e: e.isNull()))
    gaps = keyed.where("__miss")

    def counted(frame: DataFrame, weight) -> DataFrame:
        return frame.groupBy("__x").agg(weight.cast("bigint").alias("w"))

    if fit_on is None:
        distinct = counted(keyed, F.count("*"))
    else:
        donors = counted(fit_on.select(x.alias("__x")), F.count("*"))
        distinct = counted(donors.unionByName(counted(gaps, F.lit(0))), F.sum("w"))
    lead = sorted(range(width), key=lambda j: -(spread[j] / unit[j]))
    distinct = stored(
        distinct.select(
            vector_id.alias("vid"),
            F.col("__x").alias("x"),
            "w",
            F.array_join(F.transform("__x", lambda e: F.when(e.isNull(), "0").otherwise("1")), "").alias("pattern"),
            F.coalesce(*[F.col("__x")[j] for j in lead]).alias("lead"),
        ),
        "impute-vectors",
    )
    n = distinct.count()
    box_bytes = width * (2 * 8 + 2 + 8) + 64
    leaf = max(min_block_rows, math.ceil(n / (MAX_BOX_BYTES // box_bytes)))
    parts = max(1, math.ceil(n / PARTITION_ROWS), min(spark.sparkContext.defaultParallelism, n // (4 * leaf)))
    ranged = distinct.repartitionByRange(parts, "pattern", "lead", "vid")
    blocks = stored(_blocks(ranged.select("vid", "x", "w", "pattern"), width, leaf), "impute-blocks")

    box_columns = ["block", "lo", "hi", "every", "some", "filled"]
    # bounded by MAX_BOX_BYTES through the block size; neighbours stand together
    found = sorted(blocks.select(*box_columns).collect(), key=lambda r: tuple(map(int, r["block"].split(":"))))
    boxes = _Boxes(found, width)
    cores = spark.sparkContext.defaultParallelism
    mine = blocks.where("has_missing").select(*box_columns).repartition(max(1, min(len(boxes.names), 8 * cores)))
    sides = max(1, min(GROUP, -(-len(boxes.names) // (4 * cores)))), max(16, DONOR_BYTES // (leaf * (width + 1) * 8))
    seeds = _make_pairs(spark, mine, boxes, width, k, True, sides)
    reached = stored(_match(seeds, blocks, None, width, k), "impute-seeds")
    # a block without seeds has no limits, and an unreached cell an infinite one
    second = mine.join(reached.select(F.col("rblock").alias("block"), "top"), "block", "left")
    pairs = _make_pairs(spark, second, boxes, width, k, False, sides)
    matched = _match(pairs, blocks, reached, width, k)
    chosen = _best(_entries(reached).unionByName(_entries(matched)), k)
    wanted = blocks.where("has_missing").select(F.col("block").alias("rblock"), F.posexplode("ids").alias("ridx", "vid"))
    cells = chosen.groupBy("rblock", "ridx", "col").agg(
        (F.sum(F.col("v") * F.col("use")) / F.sum("use")).alias("value")
    )
    fills = (
        cells.join(wanted.select("rblock", "ridx", "vid"), ["rblock", "ridx"])
        .groupBy("vid")
        .agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("__fill"))
    )
    with scratch_scope([]) as needed:
        filled = stored(fills, "impute-fills")
    whole = keyed.where(~F.col("__miss")).withColumn("__fill", F.lit(None).cast("map<int,double>"))
    patched = _attach(gaps.withColumn("vid", vector_id), filled, distinct)
    merged = whole.unionByName(patched.select(*whole.columns))
    out = {
        c: F.coalesce(values[c], F.try_element_at("__fill", F.lit(j)) * F.lit(unit[j]), F.lit(means[j]))
        for j, c in enumerate(names)
    }
    return merged.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns]), needed
