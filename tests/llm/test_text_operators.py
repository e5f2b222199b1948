"""Edge cases of all operators on small tables, against brute force where they compute something."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordlab.llm import bpe, decontaminate, exact_dedup, language, length_histogram, quality
from recordlab.llm import sentence_spans, simhash, suffix_dedup, urls
from recordlab.llm.components import components

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, lang string, key string, ids string, id string, digest string, norm string"
WORDS = "the river runs past old mill and every house beside it keeps a small boat for fishing".split()


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, l, "k", "x", "y", "z", "n") for i, t, l in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties."""
    long = prose(1, 9000) + " \t\t\n\n  '\u00e9t\u00e9 " + "a" * 3000 + "\t\tb 're x'r" + prose(2, 9000)
    rows = [(1, None, None), (2, "", "en"), (None, "Same text.", None), (3, "same TEXT.", "en"), (3, "same TEXT.", "en")]
    rows += [(4, long, "en"), (5, long, "en"), (6, " \t\n", None), (7, "\u00c4pfel \u4e2d\u6587 \U0001f600!", "de"), (None, None, None)]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (40, 16), (997, 64)])
def test_encoding_equals_the_library(odd, reference, chunk, overlap):
    got = bpe.decode(bpe.encode(odd, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS, PATTERN, out="b")
    rows = got.collect()
    assert len(rows) == 10 and got.columns == [*[c for c in odd.columns if c != "ids"], "ids", "b"]
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or ""), (r.text or "")[:50]
        assert bytes(r.b) == (r.text or "").encode()


def test_encoding_of_awkward_breaks(spark, reference):
    r = random.Random(5)
    alphabet = [" ", "\t", "\n", "a", "B", "'", "s", "r", "e", "1", "!", "\u00e9", "\u2003"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(30, 400))), None) for i in range(60)]
    for row in bpe.encode(frame(spark, rows), RANKS, PATTERN, chunk=24, overlap=12).collect():
        assert row.ids == reference.encode_ordinary(row.text)


def test_encoding_of_nothing(none):
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_length_histogram(odd, none, reference):
    sums = length_histogram.suffix_sums(length_histogram.length_counts(odd, RANKS, PATTERN)).cache()
    sizes = sorted(len(reference.encode_ordinary(r.text or "")) for r in odd.collect())
    for r in sums.collect():
        assert r.n_docs == sizes.count(r.length)
        assert r.docs_at_least == sum(s >= r.length for s in sizes)
        assert r.tokens_cut == sum(min(s, r.length) for s in sizes)
    limits = [0, 1, 3, 5, 100, 10**6]
    for r in length_histogram.at_limits(sums, limits).collect():
        assert r.docs_cut == sum(s > r.context for s in sizes)
        assert r.tokens_cut == sum(min(s, r.context) for s in sizes)
    for r in length_histogram.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.length == sizes[int(np.ceil(r.p * len(sizes) - 1e-9)) - 1]
    empty = length_histogram.suffix_sums(length_histogram.length_counts(none, RANKS, PATTERN))
    assert empty.count() == 0 and length_histogram.at_limits(empty, [5]).count() == 0


def _ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd, none, weak):
    """Also with a digest of one digit, where most digests stand for several texts."""
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 1)) if weak else exact_dedup._sha
    many = odd.unionByName(frame(spark, [(i, f"Text {i % 7}" if i % 3 else "COMMON", "en") for i in range(100, 700)]))
    rows = [(r.doc_id, _ascii_lower(r.text)) for r in many.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        want.append((i, keep, len(groups[t]), i == keep))
    got = exact_dedup.exact_dedup(many, digest=digest).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got))) == sorted(map(str, want))
    if not weak:
        assert {r.digest for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
        kept = exact_dedup.drop_copies(many).collect()
        assert len(kept) == len(groups) and {_ascii_lower(r.text) for r in kept} == set(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_simhash_pairs_against_brute_force():
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    close = np.concatenate([seeds ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(80)])
    fp = np.unique(np.concatenate([seeds, close, r.integers(0, 2**63, 4000, dtype=np.uint64)]))
    r.shuffle(fp)
    half = len(fp) // 2
    got = {tuple(sorted(p)) for a, b in simhash.near_pairs(fp[:half], fp[half:], 2) for p in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    want = {
        tuple(sorted((int(fp[i]), int(fp[j])))) for i, j in zip(*np.nonzero(near)) if i < j and i < half
    }
    assert got == want


def test_simhash_groups(spark, odd, none):
    base = prose(9, 300).split()
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :]), None) for i in range(0, 120)]
    docs = odd.unionByName(frame(spark, rows + [(1000 + i, prose(i, 60), None) for i in range(100)]))
    got = simhash.simhash_groups(docs).collect()
    fps = {}
    for r in got:
        fps.setdefault(r.fp, []).append(r.doc_id)
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k in keys:
        low.setdefault(find(k), []).extend(i for i in fps[k] if i is not None)
    assert len(got) == docs.count()
    for r in got:
        assert r.component_id == min(low[find(r.fp)], default=None)
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_fingerprint_by_definition():
    import xxhash

    text = "One two\tTHREE four\u00a0five Six"
    words = ["one", "two", "three", "four\u00a0five", "six"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(b" \n") == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_language(spark, odd, none):
    de, en = "der schnelle fuchs und die faule katze ", "the quick brown fox jumps over the lazy dog "
    r = random.Random(4)
    rows = [(i, " ".join(r.sample((de if i % 2 else en).split(), 6)), "de" if i % 2 else "en") for i in range(300)]
    model = language.train(frame(spark, rows), where=F.col("doc_id") % 4 != 2)
    got = language.predict(frame(spark, rows), model).where("doc_id % 4 = 2").collect()
    assert sum(r.language.lang == r.lang for r in got) > 0.95 * len(got)
    for r in language.predict(odd, model).collect():
        assert 0 <= r.language.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert r.language.lang == "und" and r.language.rejected and r.language.score == 0
        else:
            assert r.language.lang in ("de", "en")
    blank = language.train(none)
    assert {r.language.lang for r in language.predict(odd, blank).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_quality(spark, odd, none):
    good = [(i, prose(i, 80), None) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "***" for w in prose(i, 80).split()), None) for i in range(30)]
    got = {r.doc_id: r for r in quality.quality_scores(frame(spark, good + bad)).collect()}
    assert all(got[i].keep for i, _, _ in good) and not any(got[i].keep for i, _, _ in bad)
    assert quality.quality_scores(odd).count() == 10 and quality.quality_scores(none).count() == 0


def test_url_rules(spark):
    pages = [(1, None), (2, "no scheme/en/"), (3, "http://WWW.Example.COM/en/x?y"), (4, "https://a.example.com/en/"), (4, "https://a.example.com/en/")]
    pages += [(5, "http://x.net/es/"), (6, "http://com"), (None, "s://com/#f"), (7, "http://a.b://c/d"), (8, "http://anet/es/"), (9, "")]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block")],
        "host string, path string, action string",
    )
    want = {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("www.example.com", "www.example.com/en/", "allow")}
    want |= {4: ("a.example.com", "example.com/en/", "block"), 5: ("x.net", "net/es/", "block"), 6: ("com", None, "allow")}
    want |= {None: ("com", "com/", "allow"), 7: ("a.b:", None, "allow"), 8: ("anet", None, "allow"), 9: ("", None, "allow")}
    for most in (50_000, 0):
        rows = urls.url_verdicts(table, rules, broadcast_rules=most).collect()
        assert len(rows) == len(pages)
        assert {r.page_id: (r.host, r.rule, r.verdict) for r in rows} == want
    assert urls.url_verdicts(table.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.url_verdicts(table, rules.limit(0)).collect()} == {"allow"}


def test_sentence_spans(spark, odd, none):
    passage = "This passage of plain words stands in more than one place. It has a second sentence of some length too. "
    rows = [(1, "Alone here. " + passage + "End.", None), (2, passage, None), (3, "Clean text without any of it. Really clean.", None)]
    rows += [(4, passage + "Something between. " + passage, None), (None, passage, None)]
    got = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(frame(spark, rows)).collect()}
    assert got[1].kept_text == rows[0][1] and got[3].kept_text == rows[2][1]
    assert got[2].kept_text == "" and got[None].n_removed == 2 and got[4].kept_text == "Something between. "
    assert sentence_spans.remove_repeated_spans(odd).count() == 10
    assert sentence_spans.remove_repeated_spans(none).count() == 0


def _brute_spans(rows):
    """Kept texts by trying all runs of sentences."""
    import re

    marks = ".!?\n\u3002\uff01\uff1f\u061f\u0964"
    cut = {i: re.findall(f"[^{marks}]*[{marks}]+[ \t\r\n]*|[^{marks}]+", t or "") for i, t, _ in rows}
    bare = {i: [re.sub("[ \t\r\n]+", " ", x).strip(" ") for x in s] for i, s in cut.items()}
    size = {i: [x.count(" ") + 1 + len(re.findall("[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f]", x)) // 2 for x in s] for i, s in bare.items()}
    spans, places = set(), {}
    for i, own in size.items():
        long = [(a, z) for a in range(len(own)) for z in range(a + 1, len(own)) if sum(own[a : z + 1]) >= 12]
        spans |= {(i, a, min(z for b, z in long if b == a)) for a, _ in long}
        spans |= {(i, max(a for a, b in long if b == z), z) for _, z in long}
        spans |= {(i, a, a) for a, n in enumerate(own) if n >= 25}
    for i, a, z in spans:
        places.setdefault("\n".join(bare[i][a : z + 1]), []).append((i, a, z))
    gone = {(i, k) for found in places.values() for i, a, z in sorted(found)[1:] for k in range(a, z + 1)}
    return {i: "".join(x for k, x in enumerate(s) if (i, k) not in gone) for i, s in cut.items()}


@pytest.mark.parametrize("least", [256, 1])
def test_sentence_spans_of_every_length(spark, least, monkeypatch):
    """Short lines, long sentences, texts without spaces, and chance overlaps, against all runs;
    also where every repeated hash goes over salts."""
    monkeypatch.setattr(sentence_spans, "LEAST_HOT", least)
    monkeypatch.setattr(sentence_spans, "SALTS", 3)
    r = random.Random(8)
    lines = "".join(f"Line {i} of this list\n" for i in range(10))
    chinese = "".join(f"\u7b2c{c}\u884c\u6587\u5b57\u5728\u8fd9\u91cc\u3002" for c in "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b")
    long = " ".join(f"word{i}" for i in range(30)) + ". "
    rows = [(1, lines + "One more. ", None), (2, "Intro here. " + lines, None), (3, chinese, None), (4, "\u524d\u8a00\u3002" + chinese, None)]
    rows += [(5, long + "Tail.", None), (6, "Head. " + long, None), (7, "Twelve words stand in this one single sentence of the list here now. Short. End.", None)]
    rows += [(8, "Twelve words stand in this one single sentence of the list here now. Short. End. New.", None)]
    parts = [prose(i, r.randrange(1, 14)).replace(".", "").replace(",", "") + r.choice([". ", "! ", "\n"]) for i in range(25)]
    rows += [(i, "".join(r.choice(parts) for _ in range(r.randrange(12))), None) for i in range(20, 60)]
    got = {x.doc_id: x for x in sentence_spans.remove_repeated_spans(frame(spark, rows)).collect()}
    want = _brute_spans(rows)
    assert {i: x.kept_text for i, x in got.items()} == want
    assert got[2].kept_text == "Intro here. " and got[4].kept_text == "\u524d\u8a00\u3002" and got[6].kept_text == "Head. "
    assert got[8].kept_text == "New."


def _brute_cover(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


@pytest.mark.parametrize("length, gram", [(20, 8), (12, 12), (30, 5)])
def test_suffix_dedup_against_brute_force(spark, length, gram):
    r = random.Random(length)
    block = [prose(i, 12) for i in range(6)]
    texts = ["", "ab" * 60, "a" * 90, "\u00e9" * 40, block[0], block[0]]
    texts += ["".join(r.choice(block)[r.randrange(20) :] + r.choice("xyz") for _ in range(4)) for _ in range(40)]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, None, None)])
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=length, gram=gram, shard_bytes=900).collect()}
    raw = [t.encode() for t in texts]
    for i, cover in enumerate(_brute_cover(raw, length)):
        kept = np.frombuffer(raw[i], dtype=np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        assert (got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (int(cover.sum()), spans, kept), i
    assert got[None].n_bytes == 0


def test_suffix_dedup_edges(odd, none):
    rows = suffix_dedup.remove_repeats(odd).collect()
    long = [r for r in rows if r.n_bytes > 1000]
    assert len(rows) == 10 and all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in long)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_decontaminate(spark, odd, none):
    item = prose(77, 45)
    swapped = item.split()
    for i in range(4, 45, 9):
        swapped[i] = "other"
    rows = [(1, prose(3, 50) + " " + item + " " + prose(4, 50), None), (2, prose(5, 20) + " " + " ".join(swapped).upper(), None)]
    rows += [(3, prose(6, 200), None), (4, " ".join(item.split()[:10]) + prose(8, 60), None), (None, item, None), (1, "clean", None)]
    bench = spark.createDataFrame([(10, item, "a"), (10, item, "a"), (11, None, "b"), (12, "too short", "c")], "item_id bigint, text string, key string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (None, 10)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted([rows[2][1], rows[3][1], "clean"])
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


#: names that operators use inside, all on one table
INSIDE = ["own", "met", "found", "judged", "h", "p", "won", "first", "owner", "key", "body", "words", "norm", "short", "digest"]
INSIDE += ["is_hot", "salt", "best", "row", "rank", "fp", "n", "host", "path", "ids", "__own", "__key", "__id", "a.b"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", "Plain words that stand here", "plain words THAT stand here", "other " * 40_000, "other " * 40_000]
    schema = "doc_id bigint, text string, lang string, url string, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame([(i, t, "en", "http://a.com/x", *INSIDE) for i, t in enumerate(texts)], schema).cache()


def _carried(df, but=()):
    """Every row still has the value that each extra column began with."""
    rows = df.collect()
    assert rows and all(r[c] == c for r in rows for c in INSIDE if c not in but)
    return rows


def test_clashing_names(spark, clashing):
    coded = bpe.decode(bpe.encode(clashing, RANKS, PATTERN), RANKS, PATTERN, out="raw")
    assert len(_carried(coded, ("ids",))) == 6
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, action string")
    assert {r.verdict for r in _carried(urls.url_verdicts(clashing, rules), ("host", "path"))} == {"block"}
    model = language.train(clashing)
    assert len(_carried(language.predict(clashing, model))) == 6
    assert {r.doc_id for r in _carried(exact_dedup.drop_copies(clashing))} == {1, 3, 5}
    assert {r.doc_id for r in _carried(simhash.drop_near_copies(clashing))} == {0, 2, 4}
    bench = spark.createDataFrame([(1, "plain words that stand here")], "item_id bigint, text string")
    assert {r.doc_id for r in _carried(decontaminate.drop_contaminated(clashing, bench))} == {0, 1, 4, 5}


@pytest.mark.parametrize("hot", [False, True])
def test_copies_of_whole_rows(spark, hot, monkeypatch):
    """Also where every digest is hot and takes the way over salts."""
    monkeypatch.setattr(exact_dedup, "HOT", 10_000 if hot else 1)
    rows = [(i, "one text" if i % 3 else f"Text {i % 5}", str(i)) for i in range(400)]
    rows += [(None, "one text", "x"), (None, "null id only", "y"), (None, "null id only", "z"), (7, "Twice", "p"), (7, "twice", "q")]
    docs = frame(spark, rows).repartition(5)
    got = exact_dedup.drop_copies(docs, salts=3).collect()
    want = {}
    for i, t, _ in rows:
        want[t.lower()] = max(want.get(t.lower(), -1), -1 if i is None else i)
    assert sorted((r.text.lower(), -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(want.items())
    assert all((r.doc_id, r.text, r.lang) in rows for r in got)
