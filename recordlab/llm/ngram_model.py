"""Language-model scores from a sharded n-gram trie.

The model interpolates: ``p(w | u v) = (c(uvw) + PRIOR_3 * p(w | v)) / (c(uv) + PRIOR_3)``, the same
with one word less and ``PRIOR_2``, and at the end the additive unigram share, so every context's
probabilities add up to 1 over the known words and one unknown. All counts cover the whole corpus.

1. Documents become blocks: word hashes, word numbers and document ends, stored once.
2. Every block sends each shard what it wants to know, once: its words by hash, and its distinct
   trigrams (pairs, if the order is 2), with their counts in training documents, by the word
   before the last, so that a shard holds all successors of a word. A word whose rows would fill
   half a shard is dealt by its predecessor as well, its pairs by both words, and a pair that is
   as frequent by all three.
   Shards are asked in ``WAVES`` turns; the files of an exchange go when its answers are stored.
3. A shard's task merges what came, builds the trie (``ngram_trie``) in its own temporary folder,
   maps it into memory and answers every block's trigrams with quantised numbers, which leaves
   only the unigram share open.
4. The answers meet at their block, which adds up its documents, in ``WAVES`` turns as well.

Shards hold about ``SHARD`` trigrams, whatever the corpus; a lost executor builds its shards again.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import stored, whole_text
from recordlab.llm.ngram_trie import Trie, levels_of, probabilities, save
from recordlab.session import cleaned_exchanges

SEED = 42
SHARD = 2_500_000
BLOCK_TOKENS = 1_500_000
#: shards are asked, and blocks answered, in so many turns; a turn's rows leave the disk before the next
WAVES = 3
ADDED = 0.1
#: the end of a text and the place before its start; words have no white space
END, START = (xxhash.xxh64_intdigest(x, SEED) for x in (b"\n", b"\t"))
WORDS, PAIRS, TRIPLES = 1, 2, 3

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def _expand(raw: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def _codes(a: np.ndarray, b: np.ndarray) -> bytes:
    both = np.stack([a, b]).astype("<u2").view(np.uint8).reshape(2, -1, 2)
    return zstandard.compress(np.ascontiguousarray(both.transpose(0, 2, 1)).tobytes(), 1)


def _codes_back(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(2, 2, -1)
    return tuple(np.ascontiguousarray(p.T).view("<u2").ravel() for p in planes)


BLOCKS = (
    "block bigint, n_tokens bigint, train_tokens bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>,"
    " words binary, tokens binary"
)


def _to_blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, sizes, tokens, own, total = [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            # frequent words get small numbers
            order = np.argsort(-np.bincount(flat), kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), np.uint64, len(own))
            train = sum(n for n, h in zip(sizes, held) if not h)
            row = [part << 32 | number, total, train, ids, held, sizes, hashes[order].tobytes(), _squeeze(place[flat])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            arrays = [pa.array([x], k) for x, k in zip(row, [*kinds, pa.binary(), pa.binary()])]
            names = ["block", "n_tokens", "train_tokens", "ids", "held", "sizes", "words", "tokens"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for id, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
                words.append(b"\n")
                number_of = own.setdefault
                tokens.append(np.array([number_of(w, len(own)) for w in words], dtype=np.int64))
                ids.append(id)
                held.append(out)
                sizes.append(len(words))
                total += len(words)
                if total >= limit:
                    yield block()
                    number += 1
                    ids, held, sizes, tokens, own, total = [], [], [], [], {}, 0
        if ids:
            yield block()

    return run


def to_blocks(docs: DataFrame, held_out: Column, id: str, text: str, limit: int = BLOCK_TOKENS) -> DataFrame:
    """Stored blocks of whole documents, about ``limit`` tokens each."""
    own = docs.select(
        F.col(id).cast("bigint").alias("id"), whole_text(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held")
    )
    return stored(own.mapInArrow(_to_blocks(limit), BLOCKS), "ngram-blocks")


class Block:
    """Distinct words and trigrams of a block; places index ``words``, whose last is the start mark."""

    def __init__(self, row: dict):
        self.words = np.append(np.frombuffer(row["words"], dtype=np.uint64), np.uint64(START))
        (self.tokens,) = _expand(row["tokens"], 1)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.train = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        start = len(self.words) - 1
        self.v = np.concatenate([[start], self.tokens[:-1]])
        self.v[first] = start
        self.u = np.concatenate([[start], self.v[:-1]])
        self.u[first] = start

    def counted(self, *columns: np.ndarray, where: np.ndarray | None = None):
        """Distinct rows of the columns, their counts in training, and each token's row."""
        size, key = len(self.words), columns[0]
        for column in columns[1:]:
            if int(key.max(initial=0)) >= (1 << 62) // size:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + column
        weight = self.train if where is None else self.train[where]
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        return [c[at] for c in columns], np.bincount(back, weights=weight).astype(np.int64), back


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


class Dealer:
    """Where words, pairs and trigrams go; ``hot`` holds frequent words and pairs with their counts
    as contexts in training."""

    def __init__(self, shards: int, hot_words: dict[int, int], hot_pairs: dict[tuple[int, int], int]):
        self.shards = shards
        self.words = np.array(sorted(hot_words), dtype=np.uint64)
        self.totals = np.array([hot_words[int(w)] for w in self.words], dtype=np.int64)
        self.pair_words = np.array(list(hot_pairs), dtype=np.uint64).reshape(-1, 2)
        mixed = self._mix(self.pair_words[:, 0], self.pair_words[:, 1])
        self.pairs = np.sort(mixed)
        self.pair_totals = np.array(list(hot_pairs.values()), dtype=np.int64)[np.argsort(mixed)]

    @staticmethod
    def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a * _MIX[0]) ^ (b + _MIX[1])
        x ^= x >> np.uint64(29)
        return x * _MIX[1]

    def _shard(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * _MIX[0]
        return ((x >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)

    def total(self, v: np.ndarray) -> np.ndarray:
        """Training count of a frequent word as a context, -1 for the others."""
        return _found(self.words, self.totals, v)

    def pair_total(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return _found(self.pairs, self.pair_totals, self._mix(u, v))

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return self._shard(w)

    def of_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._shard(np.where(self.total(v) >= 0, self._mix(v, w), v))

    def of_triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = v.copy()
        hot = np.flatnonzero(self.total(v) >= 0)
        key[hot] = self._mix(u[hot], v[hot])
        hotter = hot[self.pair_total(u[hot], v[hot]) >= 0]
        key[hotter] = self._mix(key[hotter], w[hotter])
        return self._shard(key)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def frequent_contexts(blocks: DataFrame, tokens: int, shards: int) -> tuple[dict, dict]:
    """Words, and pairs of them, with at least half a shard of tokens behind them, and their counts
    as contexts in training.

    First each block names what reaches a quarter of a shard's share inside it, so what is not
    named anywhere is below that in total; then the named are counted in full. Both lists have at
    most four entries per shard.
    """
    least, share = tokens / (4 * shards), 1 / (4 * shards)

    def as_rows(u, v, n, kind):
        arrays = [pa.array(x.view(np.int64)) for x in (u, v)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array([kind] * len(n), pa.int32())], names=["u", "v", "n", "kind"])

    def named(batches):
        for row in _rows(batches):
            block = Block(row)
            n = np.bincount(block.v, minlength=len(block.words))
            much = n >= share * len(block.tokens)
            words = block.words[much]
            yield as_rows(words, words, n[much], WORDS)
            where = np.flatnonzero(much[block.v])
            pairs, n = np.unique(block.u[where] * len(block.words) + block.v[where], return_counts=True)
            much = n >= share * len(block.tokens)
            pairs, n = pairs[much], n[much]
            yield as_rows(block.words[pairs // len(block.words)], block.words[pairs % len(block.words)], n, PAIRS)

    schema = "u bigint, v bigint, n bigint, kind int"
    names = blocks.mapInArrow(named, schema).groupBy("kind", "u", "v").agg(F.sum("n").alias("n"))
    listed = names.where(F.col("n") >= least).collect()
    mask = 2**64 - 1
    words = np.array(sorted(r.u & mask for r in listed if r.kind == WORDS), dtype=np.uint64)
    pairs = np.array([(r.u & mask, r.v & mask) for r in listed if r.kind == PAIRS], dtype=np.uint64).reshape(-1, 2)
    if not len(words):
        return {}, {}

    def counted(batches):
        for row in _rows(batches):
            block = Block(row)
            size, order = len(block.words), np.argsort(block.words)
            place = lambda wanted: _found(block.words[order], order, wanted)
            mine = place(words)
            mine = mine[mine >= 0]
            n = np.bincount(block.v[block.train], minlength=size)[mine]
            yield as_rows(block.words[mine], block.words[mine], n, WORDS)
            u, v = place(pairs[:, 0]), place(pairs[:, 1])
            both = (u >= 0) & (v >= 0)
            own, n = np.unique((block.u * size + block.v)[block.train], return_counts=True)
            n = np.maximum(_found(own, n, u[both] * size + v[both]), 0)
            yield as_rows(block.words[u[both]], block.words[v[both]], n, PAIRS)

    full = blocks.mapInArrow(counted, schema).groupBy("kind", "u", "v").agg(F.sum("n").alias("n")).collect()
    hot_words = {r.u & mask: r.n for r in full if r.kind == WORDS}
    return hot_words, {(r.u & mask, r.v & mask): r.n for r in full if r.kind == PAIRS}


CHUNKS = "shard int, block bigint, kind int, words binary, rows binary"


def _asked(block: Block, dealer: Dealer, order: int):
    """What a block asks, by kind: places ``u, v, w``, training counts, rows in order of their
    shard, shard borders, and each token's row. Pairs are asked for all words if they are the
    longest, else for the frequent ones."""
    every = np.arange(len(block.words) - 1)  # not the start mark
    c1 = np.bincount(block.tokens[block.train], minlength=len(every))
    h = block.words
    where = np.flatnonzero(dealer.total(h)[block.v] >= 0) if order > 2 else np.arange(len(block.tokens))
    (v2, w2), c2, back2 = block.counted(block.v[where], block.tokens[where], where=where)
    asked = {
        WORDS: ((every, every, every), c1, dealer.of_words(h[every]), None),
        PAIRS: ((v2, v2, w2), c2, dealer.of_pairs(h[v2], h[w2]), (where, back2)),
    }
    if order > 2:
        (u, v, w), c3, back = block.counted(block.u, block.v, block.tokens)
        asked[TRIPLES] = ((u, v, w), c3, dealer.of_triples(h[u], h[v], h[w]), back)
    for kind, (places, count, shard, back) in asked.items():
        order = np.argsort(shard, kind="stable")
        borders = np.searchsorted(shard[order], np.arange(dealer.shards + 1))
        yield kind, places, count, order, borders, back


def _send(dealer: Dealer, order: int, wave: int = 0, waves: int = 1):
    """Rows of the shards of a wave: every ``waves``-th one."""

    def run(batches):
        for row in _rows(batches):
            block = Block(row)
            for kind, places, count, dealt, borders, _ in _asked(block, dealer, order):
                shards, words, rows = [], [], []
                for shard in np.flatnonzero(np.diff(borders)).tolist():
                    if shard % waves != wave:
                        continue
                    mine = dealt[borders[shard] : borders[shard + 1]]
                    shards.append(shard)
                    if kind == WORDS:
                        words.append(block.words[mine].tobytes())
                        rows.append(_squeeze(count[mine]))
                        continue
                    used, at = np.unique(np.concatenate([p[mine] for p in places]), return_inverse=True)
                    words.append(block.words[used].tobytes())
                    u, v, w = at.reshape(3, -1)
                    u = u if kind == TRIPLES else u[:0]
                    rows.append(_squeeze(np.diff(v, prepend=0).astype(np.uint32), w, count[mine], *([u] if len(u) else [])))
                n = len(shards)
                arrays = [pa.array(shards, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array([kind] * n, pa.int32())]
                arrays += [pa.array(words, pa.binary()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "kind", "words", "rows"])

    return run


def _numbers(raw: bytes, kind: int) -> tuple[np.ndarray, ...]:
    v, w, count, *u = _expand(raw, 4 if kind == TRIPLES else 3)
    v = np.cumsum(v.astype(np.uint32), dtype=np.uint32).astype(np.int64)
    return u[0] if u else v, v, w, count


def build(chunks: list[tuple[bytes, bytes]], dealer: Dealer, kind: int) -> dict[str, np.ndarray]:
    """Trie levels of a shard from the trigrams (or the pairs, without predecessors) sent to it."""
    hashes = [np.frombuffer(w, dtype=np.uint64) for w, _ in chunks]
    words = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, dtype=np.uint64)
    parts = [[], [], [], []]
    for own, (_, raw) in zip(hashes, chunks):
        u, v, w, count = _numbers(raw, kind)
        seen = count > 0
        place = np.searchsorted(words, own)
        for out, x in zip(parts, (place[u[seen]], place[v[seen]], place[w[seen]], count[seen])):
            out.append(x.astype(np.int64))
    if kind == TRIPLES:
        # a frequent pair is a context in every shard that may be asked, though without a row here
        at = np.stack([_found(words, np.arange(len(words)), dealer.pair_words[:, i]) for i in (0, 1)], axis=1)
        at = at[(at >= 0).all(axis=1)]
        for out, x in zip(parts, (at[:, 0], at[:, 1], at[:, 1], np.zeros(len(at), dtype=np.int64))):
            out.append(x)
    u, v, w, count = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in parts)
    total = dealer.total(words)
    if kind == PAIRS:
        return levels_of(words, None, v, w, count, total_v=total)
    return levels_of(
        words, u, v, w, count, total_uv=lambda vp, up: dealer.pair_total(words[up], words[vp]), open_v=total >= 0
    )


ANSWERS = "shard int, block bigint, kind int, answer binary, n bigint"


def _answer(dealer: Dealer):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        by_kind: dict[int, list] = {WORDS: [], PAIRS: [], TRIPLES: []}
        for block, kind, words, rows in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "words", "rows"))):
            by_kind[kind].append((block, words, rows))
        out: list[tuple] = []
        if sent := by_kind[WORDS]:
            hashes = [np.frombuffer(w, dtype=np.uint64) for _, w, _ in sent]
            words = np.unique(np.concatenate(hashes))
            count = np.zeros(len(words), dtype=np.int64)
            places = [np.searchsorted(words, h) for h in hashes]
            for at, (_, _, rows) in zip(places, sent):
                count[at] += _expand(rows, 1)[0]
            for at, (block, _, _) in zip(places, sent):
                out.append((block, WORDS, _squeeze(count[at] & 0xFFFFFFFF, count[at] >> 32), 0))
            out.append((-1, WORDS, b"", int((count > 0).sum())))
        for kind in (PAIRS, TRIPLES):
            if not (sent := by_kind[kind]):
                continue
            with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
                save(build([x[1:] for x in sent], dealer, kind), folder)
                trie = Trie(folder)
                for block, words, rows in sent:
                    own = trie.places(np.frombuffer(words, dtype=np.uint64))
                    u, v, w, _ = _numbers(rows, kind)
                    before = np.full(len(u), -1, dtype=np.int64) if kind == PAIRS else own[u]
                    out.append((block, kind, _codes(*trie.lookup(before, own[v], own[w])), 0))
                del trie
        blocks, kinds, answers, n = zip(*out)
        columns = [pa.array([shard] * len(out), pa.int32()), pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32())]
        columns += [pa.array(answers, pa.binary()), pa.array(n, pa.int64())]
        return pa.Table.from_arrays(columns, names=["shard", "block", "kind", "answer", "n"])

    return run


def _add_up(dealer: Dealer, order: int, train_tokens: int, distinct_words: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row)
        answers = {(k, s): a for s, k, a in zip(*(right.column(c).to_pylist() for c in ("shard", "kind", "answer")))}
        known = np.zeros(len(block.words), dtype=np.int64)
        per_token = {}
        for kind, _, count, dealt, borders, back in _asked(block, dealer, order):
            a, b = np.empty(len(count), dtype=np.uint16), np.empty(len(count), dtype=np.uint16)
            for shard in np.flatnonzero(np.diff(borders)).tolist():
                mine = dealt[borders[shard] : borders[shard + 1]]
                if kind == WORDS:
                    low, high = _expand(answers[kind, shard], 2)
                    known[mine] = low | high << 32
                else:
                    a[mine], b[mine] = _codes_back(answers[kind, shard])
            per_token[kind] = a, b, back
        count = known[block.tokens]
        base = (count + ADDED) / (train_tokens + ADDED * (distinct_words + 1))
        a, b, (where, back) = per_token[PAIRS]
        p = base.copy()
        p[where] = probabilities(a)[back] + probabilities(b)[back] * base[where]
        if order > 2:
            a, b, back = per_token[TRIPLES]
            p = probabilities(a)[back] + probabilities(b)[back] * p
        p = np.minimum(p, 1.0)
        first = np.cumsum(block.sizes) - block.sizes
        sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10(base), np.log10(p))]
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(block.sizes), pa.array(sums[0])]
        columns += [pa.array(np.full(len(first), train_tokens)), pa.array(sums[1]), pa.array(sums[2])]
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays(columns, names=names)

    return run


def score_documents(
    docs: DataFrame,
    held_out: Column,
    id: str = "doc_id",
    text: str = "text",
    order: int = 3,
    shard: int = SHARD,
    block: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per row of ``docs``: ``id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; the model and all counts come from the rows where ``held_out`` is not true.

    ``order`` 3 conditions a word on two words before it, 2 on one. Words are told apart by 64-bit
    hashes. A null or empty text has the one token that ends every
    text. Ids are integers and may be null; equal rows count and are scored each; a null
    ``held_out`` is false; other columns aren't read; an empty table gives no rows, and without
    training rows every word is unknown.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    blocks = to_blocks(docs, held_out, id, text, block)
    head = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("train_tokens").alias("t")).first()
    tokens, train_tokens = head.n or 0, head.t or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // shard))
    dealer = Dealer(shards, *frequent_contexts(blocks, tokens, shards))
    waves = min(WAVES, shards)
    answers = None
    with cleaned_exchanges(spark):
        for wave in range(waves):
            chunks = blocks.mapInArrow(_send(dealer, order, wave, waves), CHUNKS)
            own = stored(chunks.groupBy("shard").applyInArrow(_answer(dealer), ANSWERS), "ngram-answers")
            answers = own if answers is None else answers.unionByName(own)
        words = answers.agg(F.sum("n").alias("n")).first().n or 0
        scores = None
        for wave in range(waves):
            left, right = (x.where(F.pmod(F.xxhash64("block"), F.lit(waves)) == wave) for x in (blocks, answers.where("block >= 0")))
            met = left.groupBy("block").cogroup(right.groupBy("block"))
            own = stored(met.applyInArrow(_add_up(dealer, order, train_tokens, words), _SCORES), "ngram-scores")
            scores = own if scores is None else scores.unionByName(own)
    return scores.withColumnRenamed("id", id)
