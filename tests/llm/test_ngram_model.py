"""Trie parts against plain lists, and document scores against dictionaries of counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlab.llm import ngram_model, ngram_trie

SCHEMA = "doc_id bigint, text string, id string, held string, block string, words string, n string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


def tenth():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def brute(rows, order):
    """Scores by the same formula from plain counts, without quantising."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    for c in "\t\n\x0b\x0c\r":
        texts = [t.replace(c, " ") for t in texts]
    words = [[*filter(None, t.split(" ")), "\n"] for t in texts]
    counts = [Counter(), Counter(), Counter()]
    around = Counter(), Counter()
    for w, out in zip(words, held):
        if not out:
            padded = ["\t", "\t", *w]
            for i, x in enumerate(w):
                u, v = padded[i], padded[i + 1]
                counts[0][x] += 1
                counts[1][v, x] += 1
                counts[2][u, v, x] += 1
                around[0][v] += 1
                around[1][u, v] += 1
    total, size = sum(counts[0].values()), len(counts[0])
    out = []
    for (i, _), w, h in zip(rows, words, held):
        base = score = 0.0
        padded = ["\t", "\t", *w]
        for k, x in enumerate(w):
            u, v = padded[k], padded[k + 1]
            p1 = (counts[0][x] + 0.1) / (total + 0.1 * (size + 1))
            p2 = (counts[1][v, x] + ngram_trie.PRIOR_2 * p1) / (around[0][v] + ngram_trie.PRIOR_2)
            p3 = (counts[2][u, v, x] + ngram_trie.PRIOR_3 * p2) / (around[1][u, v] + ngram_trie.PRIOR_3)
            base += math.log10(p1)
            score += math.log10(p3 if order == 3 else p2)
        out.append((i, h, len(w), sum(counts[0][x] > 0 for x in w), total, base, score))
    return out


def check(spark, rows, **sizes):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = ngram_model.score_documents(frame(spark, rows), tenth(), **sizes)
    assert got.columns == names
    order = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in got.collect()), key=order)
    want = sorted(brute(rows, sizes.get("order", 3)), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-12)
        # a code is at most half a step of 2**-10 bits off, a product of codes one step
        assert abs(g[6] - w[6]) <= w[2] * 1.01 * math.log10(2) / 1024
    return got


@pytest.mark.parametrize("sizes", [{}, {"order": 2}, {"shard": 300, "block": 500}, {"order": 2, "shard": 300, "block": 500}])
def test_documents(spark, sf, sizes):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows[:60] if "shard" in sizes else rows, **sizes)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_hot_words_and_pairs(spark):
    """One word, one pair and one passage in most texts, over many shards and blocks."""
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"of the x{r.integers(40)} the" for _ in range(12)) + " THE end") for i in range(80)]
    docs = frame(spark, rows)
    blocks = ngram_model.to_blocks(docs, tenth(), "doc_id", "text", 200)
    assert blocks.count() > 10
    tokens = blocks.agg(F.sum("n_tokens")).first()[0]
    words, pairs = ngram_model.frequent_contexts(blocks, tokens, 20)
    assert len(words) >= 2 and len(pairs) >= 1
    for order in (2, 3):
        check(spark, rows, shard=200, block=200, order=order)


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "Same text."), (4, "Same text."), (5, "Ä 中文 \x1c a b")]
    rows += [(i, "word " * 3000) for i in range(10, 14)] + [(20, " ".join(f"w{i}" for i in range(5000)))]
    for order in (2, 3):
        check(spark, rows, block=100, order=order)
    check(spark, [(i, "a b") for i in range(4)])


def test_empty_and_untrained(spark):
    assert ngram_model.score_documents(frame(spark, []), tenth()).collect() == []
    row = ngram_model.score_documents(frame(spark, [(1, "a b")]), F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert not ngram_model.score_documents(frame(spark, [(1, "a b")]), F.lit(None).cast("boolean")).first().held_out


@pytest.mark.parametrize("n, top", [(0, 0), (1, 0), (1, 9), (1000, 3), (1000, 1000), (5000, 2**40)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = ngram_trie.elias_fano(values)
    at, low = np.arange(n), int(code["bits"][0])
    high = ngram_trie._select(code["high"], code["before"], at) - at
    assert (high << low | ngram_trie.unpack(code["low"], low, at)).tolist() == values.tolist()
    assert n < 1000 or code["high"].nbytes + code["low"].nbytes < n * (3 + low) / 8 + 200


def test_codes():
    p = np.array([0.0, 1.0, 0.5, 1e-6, 0.3])
    code = ngram_trie.quantised(p)
    assert np.allclose(ngram_trie.probabilities(code), p, rtol=5e-4)
    assert ngram_trie.times(code, code[[2] * 5])[[0, 2]].tolist() == [ngram_trie.ZERO, 2048]


def test_shards_are_asked_in_turns(spark):
    """Every row is sent in one turn only, and no turn sends all."""
    docs = frame(spark, [(i, " ".join(f"x{(i * 7 + k) % 50}" for k in range(60))) for i in range(40)])
    blocks = ngram_model.to_blocks(docs, tenth(), "doc_id", "text", 400)
    dealer = ngram_model.Dealer(12, {}, {})
    sent = lambda *turn: {
        (r.shard, r.block, r.kind, bytes(r.rows)) for r in blocks.mapInArrow(ngram_model._send(dealer, 3, *turn), ngram_model.CHUNKS).collect()
    }
    turns = [sent(i, 3) for i in range(3)]
    assert all(turns) and set().union(*turns) == sent() and sum(map(len, turns)) == len(sent())
