"""Substring dedup with suffix arrays.

Every ``length``-byte string that starts at two places of the corpus is covered and removed.

1. Candidates. Each window of ``length`` bytes is named by its smallest hashed ``GRAM``-byte
   substring (its anchor). Equal windows have equal anchors, so windows whose anchor occurs once
   are unique. Consecutive windows with one anchor form a fragment.
2. Fragments that occur twice as a whole (anchor and 64-bit digest) repeat in all their windows.
3. The other fragments of repeated anchors, and one copy of each fragment of step 2 with the
   same anchor, go to the shard of their anchor. Stretches of windows whose hash occurs twice in
   the shard go into a suffix array by induced sorting; permuted common prefixes of ``length``
   bytes mark the windows that repeat.
4. Byte ranges meet per document, are merged, and cut out.

All lookups are equi-joins on anchors or row keys; no text is collected for an anchor before
unique anchors are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import small_batches, stored, whole_text
from recordlab.llm.induced import permuted_prefixes, suffix_array

LENGTH = 200
GRAM = 64
#: windows of one fragment; longer runs of one anchor are cut, their pieces share the anchor
PIECE = 4_096
SHARD_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(42).integers(0, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[0] = both[0], both[1]
    return _POWERS[0]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``gram``-byte substring."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Smallest (or largest) of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def fragments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, first window, number of windows and occurrences of the anchor, per fragment."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    least = sliding(h, width)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.append(start, len(least)))
    # a gram is an anchor if it is the smallest of some window that holds it
    pad = np.zeros(width - 1, dtype=np.uint64)
    largest = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    anchors, n = np.unique(h[h == largest], return_counts=True)
    value = least[start]
    times = n[np.minimum(np.searchsorted(anchors, value), len(anchors) - 1)]
    if size.max() > PIECE:
        parts = -(-size // PIECE)
        which = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + which * PIECE, np.repeat(size, parts)
        value, times = np.repeat(value, parts), np.repeat(times, parts)
        size = np.minimum(size - which * PIECE, PIECE)
    return value, start, size, times


def _fragment_rows(length: int, gram: int):
    names = ["anchor", "key", "first", "n", "times", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                if len(raw) < length:
                    continue
                value, start, size, times = fragments(np.frombuffer(raw, dtype=np.uint8), length, gram)
                xx = xxhash.xxh64_intdigest
                ends = (start + size + length - 1).tolist()
                digest = np.fromiter((xx(raw[a:b]) for a, b in zip(start.tolist(), ends)), np.uint64, len(start))
                held.append((value.view(np.int64), np.full(len(start), key), start, size, times, digest.view(np.int64)))
                rows += len(start)
                if rows > 50_000:
                    yield _batch(held, names, kinds)
                    held, rows = [], 0
            if held:
                yield _batch(held, names, kinds)

    return cut


def _batch(held, names, kinds) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(zip(*held), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _pieces_of_text(length: int):
    """Bytes of the listed fragments of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, listed in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                anchors = pa.array([x["anchor"] for x in listed], pa.int64())
                firsts = pa.array([x["first"] for x in listed], pa.int32())
                alone = pa.array([x["alone"] for x in listed], pa.bool_())
                parts = [raw[x["first"] : x["first"] + x["n"] + length - 1] for x in listed]
                keys = pa.array([key] * len(listed), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [anchors, keys, firsts, alone, pa.array(parts, pa.binary())],
                    names=["anchor", "key", "first", "alone", "part"],
                )

    return cut


def likely_parts(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Stretches that cover every window whose hash occurs twice: part, offset and bytes of each.

    Windows that start at two places have equal hashes, so nothing else can repeat.
    """
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    ends = np.cumsum(size + 1) - 1
    own = np.repeat(np.arange(len(parts)), size + 1)
    if len(data) < length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []
    starts = np.flatnonzero(ends[own[: len(data) - length + 1]] - np.arange(len(data) - length + 1) >= length)
    h = gram_hashes(data, length)[starts]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(data) + 1, dtype=np.int32)
    change[starts[twice]] += 1
    change[starts[twice] + length] -= 1
    covered = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
    edge = np.diff(covered)
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # windows end at or before their part's end, where a stretch never goes on: a mark stands there
    part = own[low]
    return part, low - (ends - size)[part], [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in each part of the windows that start at two places of all parts together."""
    part, offset, stretches = likely_parts(parts, length)
    found: list[list[np.ndarray]] = [[] for _ in parts]
    if stretches:
        for p, at, starts in zip(part.tolist(), offset.tolist(), _sorted_windows(stretches, length)):
            found[p].append(starts + at)
    none = np.empty(0, dtype=np.int64)
    return [np.concatenate(f) if f else none for f in found]


def _sorted_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """``repeated_windows`` by one suffix array over all bytes."""
    size = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int32) + 2
    ends = np.cumsum(size + 1) - 1
    joined[ends] = 1  # between parts
    t = np.append(joined, 0).astype(np.int32)
    before, common = permuted_prefixes(t, suffix_array(t), length)
    room = np.repeat(ends, size + 1) - np.arange(len(joined))  # bytes left in the own part
    hit = np.flatnonzero((common[:-1] >= length) & (room >= length))
    found = np.zeros(len(t), dtype=bool)
    found[hit] = True
    found[before[hit]] = True
    starts = ends - size
    return [np.flatnonzero(found[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]


def _ranges(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte ranges of windows with ascending starts."""
    new = np.flatnonzero(np.diff(starts) > length) + 1
    first = np.concatenate([[0], new])
    last = np.append(new, len(starts)) - 1
    return starts[first], starts[last] + length


def _search_shards(length: int, shard_bytes: int):
    """Rows sorted by anchor; whole anchors are packed into shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > shard_bytes and row[0] != last:
                    yield from marked(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows:
            yield from marked(rows)

    def marked(rows) -> Iterator[pa.RecordBatch]:
        keys, lows, highs = [], [], []
        for (_, key, first, alone, _), starts in zip(rows, repeated_windows([r[4] for r in rows], length)):
            if alone and len(starts):  # the others are known to repeat in every window
                low, high = _ranges(starts, length)
                keys += [key] * len(low)
                lows += (low + first).tolist()
                highs += (high + first).tolist()
        if keys:
            columns = [pa.array(keys, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "low", "high"])

    return search


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the ranges of each document and keeps the bytes outside."""
    kept, sizes, removed, spans, ids = [], [], [], [], []

    def out():
        columns = [
            pa.array(sizes, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(spans, pa.int64()),
            pa.array(kept, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    held = 0
    for batch in batches:
        for id_, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            parts, at, n, gone = [], 0, 0, 0
            for r in sorted((x["low"], x["high"]) for x in ranges or ()):
                if not n or r[0] > at:
                    parts.append(raw[at : r[0]])
                    n += 1
                    gone += r[1] - r[0]
                    at = r[1]
                elif r[1] > at:
                    gone += r[1] - at
                    at = r[1]
            parts.append(raw[at:])
            ids.append(id_)
            sizes.append(len(raw))
            removed.append(gone)
            spans.append(n)
            kept.append(b"".join(parts))
            held += len(raw)
        if held > 1 << 24:
            yield out()
            kept, sizes, removed, spans, ids, held = [], [], [], [], [], 0
    if ids:
        yield out()


def remove_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept`` (binary).

    Strings are judged on the input; matches never cross documents but may overlap inside one.
    A null text counts as empty; a text below ``length`` bytes loses nothing. Two equal rows are
    two documents, so both lose every byte once they are ``length`` bytes long. Ids must be
    integers and may be null. Only the two columns are read; an empty table gives no rows.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into the length")
    spark = docs.sparkSession
    small_batches(spark, 256)
    own = docs.select(F.col(id).cast("bigint").alias("id"), whole_text(text).alias("text"))
    own = own.withColumn("key", F.xxhash64("id", "text"))
    schema = "anchor bigint, key bigint, first int, n int, times bigint, digest bigint"
    rows = own.select("key", "text").mapInArrow(_fragment_rows(length, gram), schema)
    # 1. anchors at two places
    twice = rows.select("anchor", "times").groupBy("anchor").agg(F.sum("times").alias("t")).where("t > 1")
    twice = twice.select(F.col("anchor").alias("a"))
    again = stored(rows.join(twice, F.col("anchor") == F.col("a")).drop("a", "times"), "repeat-fragments")
    # 2. fragments at two places
    whole = again.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min("key").alias("one"))
    whole = stored(whole, "repeat-digests")
    unsure = whole.groupBy("anchor").agg(F.max((F.col("copies") == 1).cast("int")).alias("u")).where("u = 1")
    search = whole.join(unsure.select(F.col("anchor").alias("a")), F.col("anchor") == F.col("a"), "left_semi")
    named = [F.col("anchor").alias("a"), F.col("digest").alias("d")]
    surely = whole.where("copies > 1").select(*named)
    same = (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))
    sure = again.join(surely, same, "left_semi").select(
        "key", F.col("first").alias("low"), (F.col("first") + F.col("n") + length - 1).alias("high")
    )
    # 3. shards
    wanted = again.join(search.select(*named, "copies", "one"), same & (F.col("key") == F.col("one")))
    listed = wanted.groupBy("key").agg(
        F.collect_list(F.struct("anchor", "first", "n", (F.col("copies") == 1).alias("alone"))).alias("listed")
    )
    listed = listed.withColumnRenamed("key", "k")
    texts = own.select("key", "text").join(listed, F.col("key") == F.col("k"))
    parts = texts.select("key", "text", "listed").mapInArrow(
        _pieces_of_text(length), "anchor bigint, key bigint, first int, alone boolean, part binary"
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = parts.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    found = shards.mapInArrow(_search_shards(length, shard_bytes), "key bigint, low int, high int")
    # 4. ranges meet at their document
    ranges = stored(sure.unionByName(found).distinct(), "repeat-ranges")
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    ranges = ranges.withColumnRenamed("key", "k")
    cut = own.join(ranges, F.col("key") == F.col("k"), "left").select("id", "text", "ranges")
    out = cut.mapInArrow(_cut_out, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id)
