"""Hashed subwords of whole texts, vectorised over the bytes of a batch.

A subword is a run of 2, 3 or 4 bytes of a lower-cased word, with one marker byte before and
after the word. In ``WORDS`` everything but letters and non-ASCII bytes separates words; in
``MARKS`` only white space does, and case stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
SLICE_BYTES = 1 << 19

WORDS = np.full(256, 32, dtype=np.uint8)
WORDS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORDS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORDS[128:] = np.arange(128, 256)
MARKS = np.arange(256, dtype=np.uint8)
MARKS[9:14] = 32


def hashed(buffer: np.ndarray, fold: np.ndarray = WORDS) -> Iterator[np.ndarray]:
    """One array per size: the bucket of the subword at each byte, ``BUCKETS`` where there is none."""
    folded = fold[buffer]
    gap = folded == 32
    padded = np.concatenate([folded, np.full(max(SIZES), 32, dtype=np.uint8)]).astype(np.uint32)
    n = len(folded)
    code, inner = padded[:n].copy(), np.zeros(n, dtype=bool)
    gaps = np.concatenate([gap, np.ones(max(SIZES), dtype=bool)])
    for size in range(2, max(SIZES) + 1):
        if size > 2:
            inner = inner | gaps[size - 2 : size - 2 + n]
        code = code | (padded[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1)))
        if size in SIZES:
            mixed = (code ^ np.uint32(size)) * np.uint32(2654435761)
            bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int32)
            # a marker may stand at either end, not inside, and not at both ends of nothing
            none = inner | (gap & gaps[size - 1 : size - 1 + n])
            bucket[none] = BUCKETS
            yield bucket


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts, each after a marker byte, and where each text starts."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size > SLICE_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
    return np.frombuffer(b" " + b" ".join(held), dtype=np.uint8), starts


def mean_scores(texts: list[bytes], table: np.ndarray, fold: np.ndarray = WORDS) -> np.ndarray:
    """Mean of ``table[bucket]`` over all subwords of each text; zero for a text without any.

    ``table`` has ``BUCKETS`` rows and one column per output.
    """
    columns = [np.append(table[:, k], 0.0).astype(np.float32) for k in range(table.shape[1])]
    found = []
    for buffer, starts in slices(texts):
        total, count = np.zeros((len(starts), len(columns))), np.zeros(len(starts))
        for bucket in hashed(buffer, fold):
            count += np.add.reduceat((bucket < BUCKETS).astype(np.int32), starts)
            for k, column in enumerate(columns):
                total[:, k] += np.add.reduceat(column[bucket], starts, dtype=np.float64)
        found.append(total / np.maximum(count, 1)[:, None])
    return np.concatenate(found) if found else np.zeros((0, len(columns)))


def counts(text: bytes, fold: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and how often each occurs."""
    buffer, _ = _joined([text])
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for at in range(0, len(buffer), SLICE_BYTES):
        part = buffer[at : at + SLICE_BYTES + max(SIZES)]
        for bucket in hashed(part, fold):
            total += np.bincount(bucket[: min(SLICE_BYTES, len(buffer) - at)], minlength=BUCKETS + 1)
    where = np.flatnonzero(total[:BUCKETS])
    return where, total[where]
