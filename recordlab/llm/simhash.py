"""SimHash fingerprints and exact near pairs by vantage-point trees.

The tree is cut on Hamming distance to a vantage fingerprint. Its levels use disjoint blocks of
bits, so the distance rings of the levels add up: two fingerprints within ``radius`` bits have
ring vectors within ``radius`` in the sum of absolute differences. That is the triangle bound
that prunes branches. Every fingerprint lives in the leaf of its own ring vector and visits the
leaves within the bound (one of the two for each pair of leaves); each leaf is then searched
alone. A leaf that is still large is split by ordinary vantage points on the whole 64 bits,
inside the task. Depth follows the number of distinct fingerprints and never changes the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlab.llm.common import fresh, small_batches, stored, whole_text
from recordlab.llm.components import components

SEED = 42
BRUTE = 4_000_000
ROWS_PER_TASK = 2_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text, as a signed integer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    xx = xxhash.xxh64_intdigest
    hashes = np.fromiter((xx(b" ".join(r), SEED) for r in runs), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.encode()) for t in texts.to_pylist()], pa.int64())


def rings(bits: int) -> list[int]:
    """Masks of ``bits`` disjoint blocks of the 64 bits."""
    return [sum(1 << int(b) for b in block) for block in np.array_split(np.arange(64), bits)]


def depth(n: int, leaf: int = 256) -> int:
    """Levels so that a leaf of uniform fingerprints holds about ``leaf`` of them."""
    return max(1, min(16, math.ceil(math.log2(max(n, 1) / leaf + 1) / 2.7)))


def _visits(fp: np.ndarray, vantage: int, levels: int, radius: int):
    """(leaf, fp, visitor) rows: the own leaf, and the later of each pair of leaves in reach."""
    masks = np.array(rings(levels), dtype=np.uint64)
    width = [int(m).bit_count() + 1 for m in masks.tolist()]
    place = np.cumprod([1, *width[:-1]]).astype(np.int64)
    vector = np.bitwise_count((fp.view(np.uint64) ^ np.uint64(vantage))[:, None] & masks).astype(np.int64)
    leaf = vector @ place
    yield leaf, fp, np.zeros(len(fp), dtype=bool)
    steps = []
    for size in range(1, radius + 1):
        for dims in itertools.combinations(range(levels), size):
            for move in itertools.product(range(-radius, radius + 1), repeat=size):
                if all(move) and sum(map(abs, move)) <= radius and move[0] > 0:
                    steps.append((dims, move))
    for dims, move in steps:
        there = np.ones(len(fp), dtype=bool)
        for d, m in zip(dims, move):
            there &= (vector[:, d] + m >= 0) & (vector[:, d] + m < width[d])
        shift = sum(int(place[d]) * m for d, m in zip(dims, move))
        yield leaf[there] + shift, fp[there], np.ones(int(there.sum()), dtype=bool)


def _brute(r: np.ndarray, v: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, 1_000_000 // max(len(v), 1))
    for at in range(0, len(r), step):
        near = np.bitwise_count(r[at : at + step, None] ^ v[None, :]) <= radius
        if same:
            near &= np.arange(at, min(at + step, len(r)))[:, None] < np.arange(len(v))[None, :]
        i, j = np.nonzero(near)
        if len(i):
            yield r[at + i], v[j]


def near_pairs(r: np.ndarray, v: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``radius`` among residents ``r`` and between ``r`` and visitors ``v``."""
    if not len(r):
        return
    if len(r) * (len(r) // 2 + len(v)) <= BRUTE or len(r) < 64:
        yield from _brute(r, r, radius, True)
        yield from _brute(r, v, radius, False)
        return
    for pick in (len(r) // 2, 0, len(r) - 1):
        dr = np.bitwise_count(r ^ r[pick]).astype(np.int16)
        middle = int(np.median(dr))
        inner = dr <= middle
        if not inner.all():
            break
        middle -= 1
        inner = dr <= middle
        if inner.any():
            break
    else:  # every resident is as far from each of the three: no ring to cut at
        yield from _brute(r, r, radius, True)
        yield from _brute(r, v, radius, False)
        return
    dv = np.bitwise_count(v ^ r[pick]).astype(np.int16)
    edge = r[~inner & (dr <= middle + radius)]
    yield from near_pairs(r[inner], np.concatenate([v[dv <= middle + radius], edge]), radius)
    yield from near_pairs(r[~inner], v[dv > middle - radius], radius)


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the pairs, so a dense leaf emits few links."""
    a = b = np.empty(0, dtype=np.uint64)
    for x, y in pairs:
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > 2_000_000:
            a, b = _star(a, b)
    return _star(a, b) if len(a) else (a, b)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _search_leaves(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by leaf; the last leaf of a batch waits for the next batch."""

    def links(leaf, fp, visitor):
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        found = []
        for f, v in zip(np.split(fp, cuts), np.split(visitor, cuts)):
            if len(f) > 1 and not v.all():
                a, b = forest(near_pairs(f[~v], f[v], radius))
                if len(a):
                    found.append((a, b))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf = batch.column(0).to_numpy()
        fp = batch.column(1).to_numpy().view(np.uint64)
        visitor = batch.column(2).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(leaf, leaf[-1]))
        if held and (cut or held[0][0][0] != leaf[0]):
            first = int(np.searchsorted(leaf, held[0][0][0], side="right"))
            held.append((leaf[:first], fp[:first], visitor[:first]))
            yield from links(*(np.concatenate(x) for x in zip(*held)))
            held, leaf, fp, visitor = [], leaf[first:], fp[first:], visitor[first:]
            cut = int(np.searchsorted(leaf, leaf[-1])) if len(leaf) else 0
        if cut:
            yield from links(leaf[:cut], fp[:cut], visitor[:cut])
        if len(leaf) > cut:
            held.append((leaf[cut:], fp[cut:], visitor[cut:]))
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held)))


def near_links(fps: DataFrame, radius: int = 2, leaf: int = 256) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within ``radius`` bits.

    Every near pair is compared; a leaf reports a spanning star of its links, which has the
    same components as all of them.
    """
    spark = fps.sparkSession
    head = fps.agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("v")).first()
    vantage, levels = (head.v or 0) & (2**64 - 1), depth(head.n, leaf)

    def visit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                for parts in _visits(fp[at : at + 4096], vantage, levels, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["leaf", "fp", "visitor"])

    def search(batches):
        yield from _search_leaves(batches, radius)

    rows = fps.select("fp").mapInArrow(visit, "leaf bigint, fp bigint, visitor boolean")
    visits = head.n * (1 + levels + levels * levels)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), visits // ROWS_PER_TASK)
    dealt = rows.repartition(parts, "leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id, fp, component_id``.

    The component is the smallest id reachable over links of at most ``radius`` bits. A null or
    empty text has fingerprint zero and is linked like any other; null ids are not candidates
    for the smallest id (null if a component has no other). Equal rows get equal answers, no
    other column is read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = stored(
        docs.select(F.col(id).alias("id"), _fingerprints(whole_text(text)).alias("fp")), "simhash-rows"
    )
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    root = components(near_links(fps, radius))
    named = fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(answer, "fp").select(F.col("id").alias(id), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; columns unchanged.

    Rows that share an id stay or go together. Null ids stay where a group has no other.
    """
    groups = simhash_groups(docs, id, text, radius).where(F.col(id).eqNullSafe(F.col("component_id")))
    (first,) = fresh(docs.columns, "first")
    stays = groups.select(F.col(id).alias(first)).distinct()
    return docs.join(stays, F.col(id).eqNullSafe(F.col(first)), "left_semi")
