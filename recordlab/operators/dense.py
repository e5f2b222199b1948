"""Softmax models fitted by sums over blocks: a perceptron, and many logistic regressions at once.

Rows are stored once as blocks of numbers. A step of a fit is one pass: every task adds up loss and
gradient of its blocks, and the driver, which holds parameters only, moves them. The tasks' vectors
are added by one exchange (64 numbers a row, summed before the exchange), or on the driver if all of
them together stay below ``DIRECT_BYTES``.

* ``fit_perceptron``: mini-batches drawn over all blocks, Adam, and a validation tenth that ends the
  fit and chooses the epoch.
* ``fit_regressions``: a fit is a generator that asks for loss, gradient and, while all of them fit
  into ``CURVE_BYTES``, second derivatives at a point; all fits of a grid and its folds ask together,
  and one pass answers all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.operators.fitted import SharesModel, dumped, loaded
from recordlab.session import scratch_path

BLOCK_ROWS = 8192
BLOCK_BYTES = 16 << 20
COLUMNS = 64
#: sums of all tasks that may meet on the driver without an exchange
DIRECT_BYTES = 32 << 20
#: second derivatives of all regressions that take their steps together
CURVE_BYTES = 64 << 20
#: an epoch of the perceptron has at most this many steps, so batches grow with the table
STEPS = 20
BATCH = 200
PATIENCE, IMPROVES = 10, 1e-4


# --- blocks and sums ----------------------------------------------------------------------------


@dataclass
class Rows:
    part: int
    block: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray


def to_blocks(df: DataFrame, features: str, label: str, weight: str, part: str | None = None) -> DataFrame:
    """Stored blocks of rows of one ``part`` each (0 if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(x.shape[1], 1))))
            y, w, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for p in np.unique(parts).tolist():
                mine = np.flatnonzero(parts == p)
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    cells = [x[rows].tobytes(), y[rows].astype(np.int32).tobytes(), w[rows].astype(np.float64).tobytes()]
                    columns = [pa.array([v], k) for v, k in zip((p, task << 32 | number, len(rows)), (pa.int32(), pa.int64(), pa.int32()))]
                    columns += [pa.array([c], pa.binary()) for c in cells]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "n", "x", "y", "w"])
                    number += 1

    own = F.col(part).cast("int") if part else F.lit(0)
    rows = df.select(vector_to_array(features).alias("x"), F.col(label), F.col(weight).cast("double"), own.alias("p"))
    blocks = rows.mapInArrow(run, "part int, block bigint, n int, x binary, y binary, w binary")
    path = scratch_path(df.sparkSession, "dense-blocks")
    blocks.write.parquet(path)
    return df.sparkSession.read.schema(blocks.schema).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for r in batch.to_pylist():
            y, w = np.frombuffer(r["y"], dtype=np.int32), np.frombuffer(r["w"], dtype=np.float64)
            yield Rows(r["part"], r["block"], np.frombuffer(r["x"], dtype=np.float64).reshape(len(y), -1), y, w)


def task_count(blocks: DataFrame) -> int:
    return blocks.rdd.getNumPartitions()


def summed(
    blocks: DataFrame, sent, each: Callable[[Rows, object, np.ndarray], None], size: int, tasks: int | None = None
) -> np.ndarray:
    """Sum over all blocks of what ``each(rows, sent, total)`` adds to a vector of ``size`` numbers.
    ``tasks`` is the number of tasks of a pass, if the caller knows it."""
    lines = -(-size // COLUMNS)
    direct = tasks is not None and tasks * lines * COLUMNS * 8 <= DIRECT_BYTES
    shared = blocks.sparkSession.sparkContext.broadcast(sent)
    names = [f"c{i}" for i in range(COLUMNS)]

    def run(batches):
        total, seen = np.zeros(lines * COLUMNS), False
        for rows in _read(batches):
            each(rows, shared.value, total)
            seen = True
        if seen and direct:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])
        elif seen:
            table = total.reshape(lines, COLUMNS)
            arrays = [pa.array(np.arange(lines), pa.int32()), *(pa.array(table[:, i]) for i in range(COLUMNS))]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", *names])

    if direct:
        got = blocks.mapInArrow(run, "total binary").toArrow().column("total").to_pylist()
        shared.unpersist()
        return np.sum([np.frombuffer(t) for t in got], axis=0)[:size] if got else np.zeros(size)
    parts = blocks.mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("at")
    shared.unpersist()
    if not got.num_rows:
        return np.zeros(size)
    return np.stack([got.column(c).to_numpy() for c in names], axis=1).ravel()[:size]


# --- the model ----------------------------------------------------------------------------------


def shapes_of(layers: Sequence[int]) -> list[tuple[int, int]]:
    """Weight matrices of a network; each has a bias row below its weights."""
    return [(a + 1, b) for a, b in zip(layers[:-1], layers[1:])]


def split(flat: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in shapes])[:-1]
    return [p.reshape(s) for p, s in zip(np.split(flat, ends), shapes)]


def _outputs(weights: Sequence[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer and the class shares."""
    inputs = [x]
    for m in weights[:-1]:
        inputs.append(np.maximum(inputs[-1] @ m[:-1] + m[-1], 0.0))
    z = inputs[-1] @ weights[-1][:-1] + weights[-1][-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return [*inputs, e / e.sum(axis=1, keepdims=True)]


def loss_and_gradient(flat: np.ndarray, shapes, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss of the rows and its gradient, without any penalty."""
    weights = split(flat, shapes)
    *inputs, p = _outputs(weights, x)
    at = np.arange(len(y))
    loss = -float(w @ np.log(np.maximum(p[at, y], 1e-300)))
    delta = p * w[:, None]
    delta[at, y] -= w
    parts = []
    for m, a in zip(weights[::-1], inputs[::-1]):
        parts.append(np.concatenate([(a.T @ delta), delta.sum(axis=0)[None]]).ravel())
        delta = (delta @ m[:-1].T) * (a > 0)
    return loss, np.concatenate(parts[::-1])


def curvature(flat: np.ndarray, shapes, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Second derivatives of a regression's weighted log loss: a block per pair of classes, the first
    not after the second."""
    p = _outputs(split(flat, shapes), x)[-1]
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    classes = p.shape[1]
    parts = []
    for i in range(classes):
        for j in range(i, classes):
            each = w * p[:, i] * ((i == j) - p[:, j])
            parts.append(((wide * each[:, None]).T @ wide).ravel())
    return np.concatenate(parts)


def curvature_matrix(parts: np.ndarray, width: int, classes: int) -> np.ndarray:
    """The blocks as one matrix over all parameters in their order."""
    out = np.empty((width + 1, classes, width + 1, classes))
    pairs = [(i, j) for i in range(classes) for j in range(i, classes)]
    for (i, j), block in zip(pairs, parts.reshape(len(pairs), width + 1, width + 1)):
        out[:, i, :, j] = out[:, j, :, i] = block
    return out.reshape((width + 1) * classes, -1)


def penalised(shapes) -> np.ndarray:
    """1 for weights, 0 for biases."""
    out = [np.ones(s) for s in shapes]
    for m in out:
        m[-1] = 0.0
    return np.concatenate([m.ravel() for m in out])


def _unpacked(z) -> dict:
    return {"weights": [z[f"m{i}"] for i in range(len(z.files))]}


def network_shares(model: str, x: np.ndarray) -> np.ndarray:
    return _outputs(loaded(model, _unpacked)["weights"], x)[-1]


class DenseModel(SharesModel):
    """A network, or a regression, as a stage."""

    shares = staticmethod(network_shares)


def dense_model(features: str, flat: np.ndarray, shapes) -> DenseModel:
    return DenseModel(inputCol=features, model=dumped(**{f"m{i}": m for i, m in enumerate(split(flat, shapes))}))


# --- perceptron ---------------------------------------------------------------------------------


def fit_perceptron(
    train: DataFrame,
    features: str,
    width: int,
    classes: int,
    *,
    label: str = "label_index",
    weight: str = "weight",
    hidden: Sequence[int] = (100,),
    penalty: float = 1e-4,
    step: float = 1e-3,
    epochs: int = 500,
    batch: int = BATCH,
    validation: float = 0.1,
    seed: int = 42,
) -> DenseModel:
    """Rectified units, softmax, squared penalty on weights, Adam on weighted mini-batches.

    A tenth of the rows is kept aside; the fit ends when its share of right answers has not risen
    by ``IMPROVES`` in ``PATIENCE`` epochs, and the best epoch's parameters stay. Draws depend on
    the stored order of rows. Without rows the initial network is returned.
    """
    blocks = to_blocks(train, features, label, weight)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    shapes = shapes_of([width, *hidden, classes])
    rng = np.random.default_rng(seed)
    start = []
    for a, b in shapes:
        bound = np.sqrt((6.0 if (a, b) != shapes[-1] else 2.0) / (a - 1 + b))
        start.append(rng.uniform(-bound, bound, (a, b)).ravel())
    flat, decay = np.concatenate(start), penalised(shapes)
    size, steps = len(flat), max(1, min(STEPS, -(-n // batch)))
    tasks = task_count(blocks)

    def each(rows: Rows, sent, total: np.ndarray) -> None:
        flat, epoch, number = sent
        aside = np.random.default_rng((seed, rows.block)).random(len(rows.y)) < validation
        drawn = np.random.default_rng((seed, 1, epoch, rows.block)).integers(steps, size=len(rows.y))
        mine = np.flatnonzero(~aside & (drawn == number))
        if len(mine):
            loss, gradient = loss_and_gradient(flat, shapes, rows.x[mine], rows.y[mine], rows.w[mine])
            total[:size] += gradient
            total[size : size + 2] += rows.w[mine].sum(), len(mine)
        if number == 0 and aside.any():
            right = _outputs(split(flat, shapes), rows.x[aside])[-1].argmax(axis=1) == rows.y[aside]
            total[size + 2 : size + 4] += right.sum(), len(right)

    first, second, moved = np.zeros(size), np.zeros(size), 0
    best, kept, still = -np.inf, flat, 0
    for epoch in range(epochs if n else 0):
        for number in range(steps):
            out = summed(blocks, (flat, epoch, number), each, size + 4, tasks)
            if number == 0 and out[size + 3]:  # parameters as the last epoch left them
                score = out[size + 2] / out[size + 3]
                still = 0 if score > best + IMPROVES else still + 1
                if score > best:
                    best, kept = score, flat
                if still >= PATIENCE:
                    break
            if not out[size]:
                continue
            gradient = out[:size] / out[size] + penalty * decay * flat / out[size + 1]
            moved += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            rate = step * np.sqrt(1 - 0.999**moved) / (1 - 0.9**moved)
            flat = flat - rate * first / (np.sqrt(second) + 1e-8)
        else:
            continue
        break
    return dense_model(features, kept if best > -np.inf else flat, shapes)


# --- regressions in step ------------------------------------------------------------------------

#: yields points, is sent value and gradient there (and second derivatives), returns the minimum
Fit = Generator[np.ndarray, tuple, np.ndarray]


def _slope(x: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Gradient of the smooth part plus ``l1 |x|``, with the smallest slope at a kink."""
    at_zero = np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)
    return np.where(x == 0, at_zero, g + l1 * np.sign(x))


def minimise(x: np.ndarray, l1: np.ndarray, memory: int = 10, tolerance: float = 1e-6, most: int = 2000) -> Fit:
    """Limited-memory quasi-Newton descent that stays in one orthant a step where ``l1`` is not 0.

    Yields points and is sent value and gradient of the smooth part there; returns the minimum.
    """
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        slope = _slope(x, g, l1)
        if np.abs(slope).max(initial=0.0) <= tolerance:
            break
        d, used = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d -= a * y
            used.append(a)
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used)):
            d += s * (a - (y @ d) / (s @ y))
        d = np.where((l1 > 0) & (d * slope <= 0), 0.0, -d)
        if d @ slope >= 0:
            d, past = -slope, []
        side = np.where(x != 0, np.sign(x), -np.sign(slope))
        step = 1.0 if past else min(1.0, 1.0 / np.abs(slope).sum())
        while True:
            new = x + step * d
            new = np.where((l1 > 0) & (new * side < 0), 0.0, new)
            f_new, g_new = yield new
            gain = f + l1 @ np.abs(x) - f_new - l1 @ np.abs(new)
            if gain >= -1e-4 * (slope @ (new - x)) or step < 1e-10:
                break
            step /= 2
        if gain <= 0:
            break  # rounding
        s, y = new - x, g_new - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past[-memory + 1 :], (s, y)]
        x, f, g = new, f_new, g_new
    return x


def _lowest(x: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, tolerance: float) -> np.ndarray:
    """Minimum of the parabola at ``x`` plus ``l1 |x|``."""
    if not l1.any():
        return x - np.linalg.solve(h, g)
    fit = minimise(x, l1, tolerance=tolerance)
    z = next(fit)
    while True:
        bent = h @ (z - x)
        try:
            z = fit.send(((g + bent / 2) @ (z - x), g + bent))
        except StopIteration as end:
            return end.value


def minimise_curved(x: np.ndarray, l1: np.ndarray, tolerance: float = 1e-6, most: int = 2000) -> Fit:
    """The minimum that ``minimise`` looks for, by steps to the minimum of the parabola at a point,
    so in far fewer passes. Yields points and is sent value, gradient and second derivatives there.
    """
    f, g, h = yield x
    for _ in range(most):
        worst = np.abs(_slope(x, g, l1)).max(initial=0.0)
        if worst <= tolerance:
            break
        # biases may move together without a change of the loss
        firm = h + 1e-9 * max(np.trace(h) / len(x), 1e-9) * np.eye(len(x))
        d = _lowest(x, g, firm, l1, min(1e-3 * worst, 0.1 * tolerance)) - x
        falls = g @ d + l1 @ (np.abs(x + d) - np.abs(x))
        rounding = 1e-14 * (1.0 + abs(f))
        step = 1.0
        while True:
            new = x + step * d
            f_new, g_new, h_new = yield new
            gain = f + l1 @ np.abs(x) - f_new - l1 @ np.abs(new)
            if gain >= -1e-4 * step * falls - rounding or step < 1e-10:
                break
            step /= 2
        if gain < -rounding or falls >= -1e-4 * rounding:
            x = new if gain >= 0 else x
            break
        x, f, g, h = new, f_new, g_new, h_new
    return x


def in_step(fits: Mapping[object, Fit], answer: Callable[[dict], dict]) -> tuple[dict, int]:
    """Runs fits side by side; ``answer`` gets all points asked for and returns what each fit is sent. Returns the minima and the number of rounds."""
    asked = {k: next(f) for k, f in fits.items()}
    found, rounds = {}, 0
    while asked:
        answers, rounds, later = answer(asked), rounds + 1, {}
        for k in asked:
            try:
                later[k] = fits[k].send(answers[k])
            except StopIteration as end:
                found[k] = end.value
        asked = later
    return found, rounds


def fit_regressions(
    blocks: DataFrame, width: int, classes: int, configs: Sequence[Mapping], parts: Sequence[int]
) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    """Multinomial regressions of every configuration on every part of ``to_blocks``, in as many
    passes as the slowest of them needs: parameters by ``(part, configuration)``, and the passes.

    The loss is the weighted mean, the penalty ``1 / (C * rows)``: on absolute weights for ``l1``,
    on half their squares for ``l2``; biases are free.
    """
    shapes = shapes_of([width, classes])
    size, free = (width + 1) * classes, penalised(shapes)
    heads = {r.part: r for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    tasks = task_count(blocks)
    weights = summed(blocks, None, lambda rows, _, t: t.__setitem__(rows.part, t[rows.part] + rows.w.sum()), max(parts) + 1, tasks)
    strength = {(p, c): 1.0 / (conf.get("C", 1.0) * heads[p].n) for p in parts for c, conf in enumerate(configs)}
    lasso = {c: conf.get("penalty", "l2") == "l1" for c, conf in enumerate(configs)}

    bends = classes * (classes + 1) // 2 * (width + 1) ** 2
    curved = len(strength) * bends * 8 <= CURVE_BYTES
    numbers = size + 1 + (bends if curved else 0)

    def each(rows: Rows, sent, total: np.ndarray) -> None:
        for i, ((p, _), flat) in enumerate(sent):
            if p == rows.part:
                own = total[i * numbers : (i + 1) * numbers]
                loss, gradient = loss_and_gradient(flat, shapes, rows.x, rows.y, rows.w)
                own[:size] += gradient
                own[size] += loss
                if curved:
                    own[size + 1 :] += curvature(flat, shapes, rows.x, rows.w)

    def answer(asked: dict) -> dict:
        listed = list(asked.items())
        out = summed(blocks, listed, each, len(listed) * numbers, tasks).reshape(len(listed), numbers)
        found = {}
        for (k, flat), row in zip(listed, out):
            ridge = 0.0 if lasso[k[1]] else strength[k]
            value = row[size] / weights[k[0]] + ridge / 2 * (free * flat**2).sum()
            found[k] = value, row[:size] / weights[k[0]] + ridge * free * flat
            if curved:
                found[k] += (curvature_matrix(row[size + 1 :], width, classes) / weights[k[0]] + np.diag(ridge * free),)
        return found

    lowest = minimise_curved if curved else minimise
    fits = {k: lowest(np.zeros(size), free * (strength[k] if lasso[k[1]] else 0.0)) for k in strength}
    return in_step(fits, answer)


def regression_predictions(blocks: DataFrame, found: Mapping[tuple[int, int], np.ndarray], width: int, classes: int) -> DataFrame:
    """``part, config, y, k`` of every row of the blocks under every configuration of its part."""
    shapes = shapes_of([width, classes])
    sent = blocks.sparkSession.sparkContext.broadcast(dict(found))

    def run(batches):
        for rows in _read(batches):
            for (p, c), flat in sent.value.items():
                if p == rows.part:
                    k = _outputs(split(flat, shapes), rows.x)[-1].argmax(axis=1)
                    columns = [pa.array(np.full(len(k), v), pa.int32()) for v in (p, c)]
                    columns += [pa.array(v, pa.int32()) for v in (rows.y, k)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "config", "y", "k"])

    return blocks.mapInArrow(run, "part int, config int, y int, k int")
