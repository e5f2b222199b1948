"""Alignment of two tokenizers against a plain search over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from recordlab.llm import alignment

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, id string, row string, pairs string, n string, pair string, l string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(both, texts):
    """Ends of all tokens, taken from the libraries' own decoding; groups by shared ends."""
    first, second = both
    letters = alignment._byte_letters()
    found = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        sa = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        sb = [second.id_to_piece(i) for i in b]
        sb = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, sb)]
        if not text or b"".join(sa) != whole or b"".join(sb) != whole:
            found.append(None)
            continue
        ends = [{sum(map(len, t[: k + 1])): k for k in range(len(t))} for t in (sa, sb)]
        shared = sorted(ends[0].keys() & ends[1].keys())
        at, groups, links = (0, 0), [], []
        for e in shared:
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[at[0] : i])) + "|" + ",".join(map(str, b[at[1] : j])))
            links.append((a[i - 1], b[j - 1]))
            at = i, j
        found.append((len(a), len(b), ";".join(groups), links))
    counts = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n = [counts[x] for x in f[3]]
            top = sum(counts[x] == best[x[1]] for x in f[3])
            out.append((f[0], f[1], len(n), len(n), top, sum(n), hashlib.sha256(f[2].encode()).hexdigest()))
    return out


def answers(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter((r.doc_id, *(r[c] for c in names)) for r in df.collect())


def check(spark, both, rows):
    got = answers(alignment.alignment_scores(frame(spark, rows), *FILES))
    want = brute(both, [t for _, t in rows])
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_odd_texts(spark, both):
    texts = [None, "", " ", "a  b", "tab\tx", "  lead", "x ", "ﬁ ½ é", "é", "中文 <unk> <s> <|endoftext|>", "▁x", "a\nb", "\x00x"]
    texts += ["unbelievable tokenisation! 12345 don't", "unbelievable tokenisation! 12345 don't", "a" * 3000, "so it is " * 4000]
    check(spark, both, [*enumerate(texts), (None, "null id"), (3, "a  b")])


def test_documents(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, both, rows)


def test_repeated_windows(both):
    pair = alignment.Pair(*(open(f, "rb").read() for f in FILES))
    text = "the old mill beside the river keeps the old boat"
    coded, whole = pair.encode([text, "", text]), brute(both, [text])[0]
    for found in pair.align([text, "", text], coded)[::2]:
        assert hashlib.sha256(found[0]).hexdigest() == whole[6] and len(found[1]) == whole[3]
    assert pair.align([text, ""], pair.encode([text, ""]))[1] is None


def test_windows_with_equal_hashes(monkeypatch):
    """Without any mixing, windows of different ids meet and must be told apart."""
    ids, stops = np.array([1, 2, 3, 1, 2, 3]), np.array([1, 3, 4, 6])
    monkeypatch.setattr(alignment.np, "unique", lambda x, **_: (x[:1], np.array([0]), np.zeros(len(x), dtype=int)))
    first, back = alignment._same_windows([ids, ids], [stops, stops])
    assert first[back].tolist() == [0, 1, 0, 3]


def test_rank_form_of_the_file(both):
    """Every kind of character, encoded by ranks and by the library of the file."""
    pair = alignment.Pair(*(open(f, "rb").read() for f in FILES))
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000] + list(range(0x3100))
    texts = [f" a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}! {chr(c)} z" for c in points]
    assert pair.encode_a(texts) == [e.ids for e in both[0].encode_batch(texts, add_special_tokens=False)]


def test_empty_table_and_plain_groups(spark):
    assert alignment.alignment_scores(frame(spark, []), *FILES).collect() == []
    shared = alignment.tokenizers(spark, *FILES)
    row = alignment.align(frame(spark, [(1, "hello world")]), shared).first()
    assert row.groups.count(";") == 1 and len(row.pairs) == 2
    assert alignment.pair_bound(shared) <= alignment.BROADCAST_PAIRS
