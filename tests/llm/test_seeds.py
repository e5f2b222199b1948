"""Spaced seeds: every substitution pattern that the check allows has a seed."""

import itertools
import math

import numpy as np
import pytest

from recordlab.llm import decontaminate as d


def _free(mask, tokens, gone):
    ones = [i for i, c in enumerate(mask) if c == "1"]
    return any(not gone & {at + i for i in ones} for at in range(tokens - len(mask) + 1))


@pytest.mark.parametrize("tokens", range(1, d.WINDOW + 1))
def test_every_allowed_pattern_leaves_a_mask_free(tokens):
    masks = d.SHORT[tokens] if tokens < 12 else d.MASKS
    allowed = tokens - math.ceil(tokens * d.SHARE)
    for gone in itertools.combinations(range(tokens), allowed):
        assert any(_free(m, tokens, set(gone)) for m in masks), gone


def test_substituted_and_short_items_are_found(spark):
    items, docs = [], []
    for tokens in (1, 2, 3, 4, 5, 7, 9, 11, 12, 15, 18, 20, 30):
        words = [f"w{tokens}x{i}" for i in range(tokens)]
        items.append((tokens, " ".join(words)))
        width = min(tokens, d.WINDOW)
        allowed = width - math.ceil(width * d.SHARE)
        patterns = list(itertools.combinations(range(width), allowed))
        for gone in patterns[:: max(1, len(patterns) // 60)]:
            text = ["z" if i in gone or i >= width else w for i, w in enumerate(words)]
            docs.append((100 * len(docs) + tokens, " ".join(["before", *text, "after"])))
    found = d.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k % 100) for k, _ in docs}
    one_more = [(1, "w5x0 z w5x2 z w5x4"), (2, "w15x0 w15x1 z w15x3 z w15x5 z w15x7 z w15x9 w15x10 w15x11 w15x12 w15x13 w15x14")]
    found = d.contaminated(
        spark.createDataFrame(one_more, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert found.count() == 0


def test_all_documents_against_all_items_by_brute_force(spark, sf):
    """Every diagonal of every document and item is tried; nothing is missed and nothing added."""
    import re

    from recordlab.llm.decontaminate import SHARE, WINDOW, contaminated

    def cut(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    names = {}
    number = lambda words: np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    bench = [(r.item_id, number(cut(r.text))) for r in items.collect()]
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = number(cut(r.text))
        for item, own in bench:
            width = min(WINDOW, len(own))
            padded = np.concatenate([np.full(len(own), -1), words, np.full(len(own), -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, len(own)) == own
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            best = int((sums[:, width:] - sums[:, :-width]).max())
            if best >= np.ceil(width * SHARE):
                want[r.doc_id, item] = best
    got = {(r.doc_id, r.item_id): r.matched for r in contaminated(docs, items).collect()}
    assert got == want and want
