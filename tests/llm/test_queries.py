"""The registered queries: against DuckDB where SQL exists, and the pipeline against its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlab.llm.common import stored
from recordlab.llm.induced import permuted_prefixes, suffix_array
from recordlab.llm.language import predict, train
from recordlab.llm.ngram_model import score_documents
from recordlab.llm.queries import ORACLE, QUERIES
from recordlab.llm.simhash import fingerprint
from recordlab.registry.check import compare, duck_connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert compare(spark, duck_connection(sf), sf, name, QUERIES[name], ORACLE.get(name)) == ""


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language"](spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def expected_by_stage(rows, judged, leaks):
    """Brute force over the rules of the first four stages: ids that each keeps."""
    lower = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in rows}
    kept = [i for i in lower if not judged[i]]
    stages = [set(kept)]
    last = {}
    for i in kept:
        last[lower[i]] = max(last.get(lower[i], i), i)
    kept = sorted(last.values())
    stages.append(set(kept))
    bits = np.array([fingerprint(lower[i].encode()) & (2**64 - 1) for i in kept], dtype=np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]) <= 2
    group = np.arange(len(kept))
    while (new := np.array([group[n].min() for n in near], dtype=int)).tolist() != group.tolist():
        group = new
    kept = [i for n, i in enumerate(kept) if group[n] == n]
    stages.append(set(kept))
    stages.append({i for i in kept if i not in leaks})
    return stages


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    judged = {r.doc_id: r.language.rejected for r in predict(docs, train(docs)).collect()}
    leaks = {r.doc_id for r in QUERIES["op9_spaced_seeds"](spark, sf).collect()}
    want = expected_by_stage(rows, judged, leaks)
    now = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        now = stored(stage(spark, now, sf), f"test-{name}")
        assert now.columns == docs.columns
        assert {r.doc_id for r in now.select("doc_id").collect()} == ids, name
    out = corpus_pipeline.run(spark, sf).collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} == want[-1]
    assert len(want[-1]) == len(out) < len(rows)


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    """No rows; then nulls, blanks, repeated rows and columns with the names used inside."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, raw string, row string"
    text = "A text of plain words that everyone can read without any trouble at all"
    rows = [(1, None), (None, None), (2, ""), (3, text), (3, text), (4, text.upper()), (5, bench.first().text), (6, "\n \t")]
    for name, kept in (("none", []), ("odd", [(4, text.upper())])):
        folder = str(tmp_path / name)
        table = [(i, t, "en", "s", 1, "f", "r", "w") for i, t in (rows if kept else [])]
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert [(r.doc_id, r.text) for r in out] == kept
        assert all((r.found, r.raw, r.row, r.round_trip) == ("f", "r", "w", True) for r in out)


def test_suffix_array_by_sorting():
    r = np.random.default_rng(1)
    for n, k in [(3, 2), (60, 2), (400, 3), (400, 200)]:
        t = np.append(r.integers(1, k + 1, n), 0)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        before, common = permuted_prefixes(t, sa, 9)
        for i in range(len(t)):
            if before[i] >= 0:
                a, b = t[i:].tolist(), t[before[i] :].tolist()
                same = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
                assert common[i] == min(9, same)


def test_whole_buckets_give_the_same_order():
    t = np.append(np.random.default_rng(2).integers(1, 4, 25_000), 0)
    t[100:9000] = t[12_100:21_000]
    raw = t.astype(np.uint8).tobytes()
    sa = suffix_array(t).tolist()
    assert sorted(sa) == list(range(len(t)))
    assert all(raw[a:] < raw[b:] for a, b in zip(sa, sa[1:]))


def test_op11_gives_a_word_the_two_before_it(spark, tmp_path):
    texts = ["a b c", "x b d", "a b c", "x b d", "a b d"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op11_elias_fano_lm"](spark, str(tmp_path)).collect()}
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    by = {n: {r["doc_id"]: r["score"] for r in score_documents(docs, tenth, order=n).collect()} for n in (2, 3)}
    assert got == pytest.approx(by[3])
    assert got[0] > by[2][0] + 0.1
