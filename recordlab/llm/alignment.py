"""Cross-tokenizer alignment by white-space anchors.

Every whole text is encoded by both tokenizers. Places where tokens of both end at the same byte
are shared ends; those followed by a space-marked token on both sides are anchors and cut the
document into windows of token ids. What happens inside a window depends on its ids alone, so the
windows of some documents are told apart by their tuples of ids, each is aligned once, and all
that have the same ids take its result.

A link is a pair of tokens that end together, so the bytes of one are a suffix of the other's. The
vocabularies therefore bound the number of different pairs (``pair_bound``), and the corpus counts
of pairs are small enough to broadcast, whatever the corpus is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.llm.common import stored, whole_text

#: characters that are encoded and aligned in one call
CALL = 1 << 20
#: pairs that may be broadcast, compared with the bound that the vocabularies prove
BROADCAST_PAIRS = 4_000_000
MAX_VOCABULARY_BYTES = 64 << 20

_CODERS: dict = {}


class Pair:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(first.decode())
        a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        own = _byte_letters()
        self.a_bytes = [b""] * (max(a.get_vocab().values()) + 1)
        for token, i in a.get_vocab().items():
            known = all(c in own for c in token)
            self.a_bytes[i] = bytes(own[c] for c in token) if known else token.encode()
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        ]
        self.encode_a = _ranked(json.loads(first), self.a_bytes) or (
            lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        )
        self.sides = [_Side(t) for t in (self.a_bytes, self.b_bytes)]
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.numbers = pa.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], pa.large_string())

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return list(zip(self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)))

    def align(self, texts: list[str], coded: list[tuple[list[int], list[int]]]):
        """Per text: its group string and links (``a << 32 | b``), or None unless all bytes agree."""
        whole = [b" " + t.encode() for t in texts]
        good = [n for n, (t, w) in enumerate(zip(texts, whole)) if t and all(s.join(c) == w for s, c in zip(self.sides, coded[n]))]
        if not good:
            return [None] * len(texts)
        ids = [np.array([i for n in good for i in coded[n][side]]) for side in (0, 1)]
        ends = [np.cumsum(s.size[x]) for s, x in zip(self.sides, ids)]
        size = int(ends[0][-1])
        shared = np.zeros(size + 1, dtype=np.int8)
        for e in ends:
            shared[e] += 1
        i, j = (np.flatnonzero(shared[e] == 2) for e in ends)
        # a text starts with a space on both sides, so its end before is an anchor as well
        anchor = np.append(self.sides[0].space[ids[0][i[:-1] + 1]] & self.sides[1].space[ids[1][j[:-1] + 1]], True)
        stops = [i[anchor] + 1, j[anchor] + 1]
        first, back = _same_windows(ids, stops)
        windows = self._aligned(ids, i, j, stops, first)
        text = windows.take(pa.array(back))
        joined, letters = text.buffers()[2].to_pybytes(), _offsets(text)
        links = ids[0][i] << 32 | ids[1][j]
        # windows and links of each text
        bounds = np.cumsum([len(whole[n]) for n in good])
        last_window = np.searchsorted(ends[0][stops[0] - 1], bounds) + 1
        last_link = np.searchsorted(ends[0][i], bounds) + 1
        out: list = [None] * len(texts)
        window = link = 0
        for n, w, k in zip(good, last_window.tolist(), last_link.tolist()):
            out[n] = joined[letters[window] : letters[w] - 1], links[link:k]
            window, link = w, k
        return out

    def _aligned(self, ids, i, j, stops, which) -> pa.Array:
        """Groups of the windows ``which``, each with a ``;`` behind it; ``i, j`` are the last tokens
        of all groups. In the order of the result, A ids of a group stand before its B ids."""
        closes = [np.zeros(len(x), dtype=np.int64) for x in ids]
        for c, last in zip(closes, (i, j)):
            c[last] = 1
        group = [np.cumsum(c) - c for c in closes]
        slot = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        slot[np.arange(len(ids[0])) + np.append(0, j + 1)[group[0]]] = ids[0] * 3 + closes[0]
        slot[np.arange(len(ids[1])) + (i + 1)[group[1]]] = ids[1] * 3 + 2 * closes[1]
        stop = stops[0] + stops[1]
        start = np.append(0, stop[:-1])[which]
        size = stop[which] - start
        before = np.append(0, np.cumsum(size))
        place = np.repeat(start - before[:-1], size) + np.arange(before[-1])
        text = self.numbers.take(pa.array(slot[place]))
        offsets = np.ascontiguousarray(_offsets(text)[before])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), text.buffers()[2])


class _Side:
    """Bytes of one vocabulary."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(x) for x in words], dtype=np.int64)
        self.space = np.array([x[:1] == b" " for x in words])

    def join(self, ids: list[int]) -> bytes:
        words = self.words
        return b"".join([words[i] for i in ids])


def _ranked(file: dict, words: list[bytes]):
    """The same encoding by ranks, several times as fast, if merge k makes id 256 + k: then ids are
    ranks. The library's own byte-level pattern is the one of the rank files."""
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
    number, step = file["model"]["vocab"], file.get("pre_tokenizer") or {}
    in_order = all(number.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
    if not in_order or step.get("type") != "ByteLevel" or not step.get("use_regex", True) or file.get("normalizer"):
        return None
    import public_tokenizers
    import tiktoken

    ranks = {words[i]: i for i in range(256 + len(merges))}
    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [coder.encode_ordinary(t) for t in texts]


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _same_windows(ids: list[np.ndarray], stops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One window of each kind, and the kind of every window; equal hashes are compared id by id."""
    total = np.zeros(len(stops[0]), dtype=np.uint64)
    parts = []
    for x, stop, odd in zip(ids, stops, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        start = np.append(0, stop[:-1])
        place = np.arange(len(x)) - np.repeat(start, stop - start)
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(odd) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        total += np.add.reduceat(mixed, start) * np.uint64(odd)
        parts.append((x, start, stop - start, place))
    _, first, back = np.unique(total, return_index=True, return_inverse=True)
    same = np.ones(len(total), dtype=bool)
    for x, start, size, place in parts:
        model = first[back]
        equal = size == size[model]
        reach = np.minimum(np.repeat(start[model], size) + place, len(x) - 1)
        same &= equal & (np.add.reduceat((x != x[reach]).astype(np.int64), start) == 0)
    alone = np.flatnonzero(~same)
    back[alone] = len(first) + np.arange(len(alone))
    return np.append(first, alone), back


def _byte_letters() -> dict[str, int]:
    """Byte of every letter of a byte-level vocabulary: visible ones stand for themselves, the
    others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(hidden)}


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY_BYTES} bytes")
    return content


def tokenizers(spark: SparkSession, first: str, second: str):
    """Broadcast of both files' content, which the driver reads; sizes are checked."""
    return spark.sparkContext.broadcast((_content(first), _content(second)))


def _pair(shared) -> Pair:
    key = hash(shared.value)
    if key not in _CODERS:
        _CODERS[key] = Pair(*shared.value)
    return _CODERS[key]


def pair_bound(shared) -> int:
    """No more different pairs can be linked: in each, one token's bytes end with the other's."""
    pair = _pair(shared)
    return sum(int(s.size.sum()) + len(s.size) for s in pair.sides)


ALIGNED = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"


def _align_rows(shared, hashed: bool):
    def calls(texts: list[str]) -> Iterator[slice]:
        start = held = 0
        for n, text in enumerate(texts):
            held += len(text)
            if held > CALL:
                yield slice(start, n + 1)
                start, held = n + 1, 0
        yield slice(start, len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            all_ids, all_texts = (c.to_pylist() for c in batch.columns)
            for part in calls(all_texts):
                counts, groups, pairs, times = [], [], [], []
                coded = pair.encode(all_texts[part])
                for (a, b), found in zip(coded, pair.align(all_texts[part], coded)):
                    joined, links = found or (b"", np.empty(0, dtype=np.int64))
                    counts.append((len(a), len(b), len(links), len(links)) if found else (0, 0, 0, 0))
                    groups.append(hashlib.sha256(joined).hexdigest() if joined and hashed else joined.decode())
                    value, n = np.unique(links, return_counts=True)
                    pairs.append(value)
                    times.append(n.astype(np.int32))
                if not counts:
                    continue
                columns = [pa.array(all_ids[part], pa.int64())]
                columns += [pa.array(c, pa.int64()) for c in zip(*counts)]
                columns += [pa.array(groups, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return run


def align(docs: DataFrame, shared, id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, token, group and link counts, ``groups`` and links.

    ``groups`` is ``a1,a2|b1;a3|b2`` in order (its SHA-256 in hex if ``hashed``), ``pairs`` the
    different links as ``a << 32 | b`` and ``times`` how often each occurs. A text that is null,
    empty or whose tokens don't give back its bytes has zeros and nothing else. Ids are integers
    and may be null; equal rows stay; other columns aren't read; an empty table gives no rows.
    """
    own = docs.select(F.col(id).cast("bigint").alias("id"), whole_text(text).alias("text"))
    return own.mapInArrow(_align_rows(shared, hashed), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair in the corpus, and whether no other A id has more
    with its B id. Each task counts its own links first."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n"))
    counts = stored(counts, "pair-counts")
    # not more rows than the vocabularies allow; a B id has as many as its token has suffixes and extensions
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def alignment_scores(docs: DataFrame, first: str, second: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, with corpus-wide counts of linked id pairs.

    ``first`` is the file of a byte-level vocabulary, which encodes a space and the text;
    ``second`` a piece model that adds the space itself. ``n_best`` are links whose pair has the
    highest count of its B id (ties included), ``count_sum`` adds up the counts of all links.
    """
    shared = tokenizers(docs.sparkSession, first, second)
    rows = align(docs, shared, id, text, hashed=True).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "alignments")
    counts = pair_counts(rows)
    counts = F.broadcast(counts) if pair_bound(shared) <= BROADCAST_PAIRS else counts
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("p"), F.col("l.times").alias("t"))
    sums = (
        links.join(counts, F.col("p") == F.col("pair"))
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("t"))).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
        .withColumnRenamed("row", "r")
    )
    none = F.lit(0).cast("bigint")
    return rows.join(sums, F.col("row") == F.col("r"), "left").select(
        F.col("id").alias(id),
        *["n_a", "n_b", "n_groups", "n_links"],
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
