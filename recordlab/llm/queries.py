"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from recordlab.llm.alignment import alignment_scores
from recordlab.llm.bpe import decode, encode
from recordlab.llm.common import load
from recordlab.llm.decontaminate import contaminated
from recordlab.llm.exact_dedup import exact_dedup
from recordlab.llm.language import held_out, predict, train
from recordlab.llm.length_histogram import length_counts, suffix_sums
from recordlab.llm.ngram_model import score_documents
from recordlab.llm.quality import quality_scores
from recordlab.llm.sentence_spans import remove_repeated_spans
from recordlab.llm.simhash import simhash_groups
from recordlab.llm.suffix_dedup import remove_repeats
from recordlab.llm.urls import url_verdicts
from recordlab.llm.whitening import whiten

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf):
    coded = encode(load(spark, sf, "documents").select("doc_id", "text"), RANKS, PATTERN)
    both = decode(coded, RANKS, PATTERN)
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(spaced, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = url_verdicts(load(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH urls AS (SELECT page_id, COALESCE(url, '') AS url FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM urls),
rules(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (SELECT page_id, host, path, MAX(length(rh || rp)) AS size FROM parts JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, rh || rp AS rule, COALESCE(action, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id IS NOT DISTINCT FROM h.page_id AND p.host = h.host AND p.path = h.path
LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) AND length(rh || rp) = h.size"""


def op3_sentence_spans(spark, sf):
    cut = remove_repeated_spans(load(spark, sf, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^.!?\n。！？؟।]*[.!?\n。！？؟।]+[ \t\r\n]*|[^.!?\n。！？؟।]+') AS s FROM documents),
one AS (SELECT doc_id, UNNEST(s) AS sentence, UNNEST(range(len(s))) AS pos FROM cut),
bare AS (SELECT doc_id, pos, sentence, trim(regexp_replace(sentence, '[ \t\r\n]+', ' ', 'g'), ' ') AS b FROM one),
sized AS (SELECT *, length(b) - length(replace(b, ' ', '')) + 1
    + (length(b) - length(regexp_replace(b, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]', '', 'g'))) // 2 AS words FROM bare),
runs AS (SELECT a.doc_id, a.pos, z.pos AS last, SUM(m.words) AS words FROM sized a
    JOIN sized z ON z.doc_id = a.doc_id AND z.pos BETWEEN a.pos + 1 AND a.pos + 11
    JOIN sized m ON m.doc_id = a.doc_id AND m.pos BETWEEN a.pos AND z.pos GROUP BY a.doc_id, a.pos, z.pos HAVING SUM(m.words) >= 12),
spans AS (SELECT doc_id, pos, MIN(last) AS last FROM runs GROUP BY doc_id, pos UNION SELECT doc_id, MAX(pos), last FROM runs GROUP BY doc_id, last
    UNION SELECT doc_id, pos, pos FROM sized WHERE words >= 25),
texts AS (SELECT p.doc_id, p.pos, p.last, string_agg(b, chr(10) ORDER BY s.pos) AS t FROM spans p
    JOIN sized s ON s.doc_id = p.doc_id AND s.pos BETWEEN p.pos AND p.last GROUP BY p.doc_id, p.pos, p.last),
ranked AS (SELECT doc_id, pos, last, ROW_NUMBER() OVER (PARTITION BY md5(t) ORDER BY doc_id, pos) AS r FROM texts),
gone AS (SELECT DISTINCT s.doc_id, s.pos FROM ranked r JOIN sized s ON s.doc_id = r.doc_id AND s.pos BETWEEN r.pos AND r.last WHERE r > 1),
kept AS (SELECT b.doc_id, COUNT(*) AS n_sentences, COUNT(g.pos) AS n_removed,
    COALESCE(string_agg(sentence, '' ORDER BY b.pos) FILTER (WHERE g.pos IS NULL), '') AS t
    FROM bare b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.pos = g.pos GROUP BY b.doc_id)
SELECT d.doc_id, CAST(COALESCE(n_sentences, 0) AS INT) AS n_sentences, CAST(COALESCE(n_removed, 0) AS INT) AS n_removed,
  sha256(COALESCE(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""


def op4_language(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs, where=~held_out())
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


def op5_simhash_vptree(spark, sf):
    groups = simhash_groups(load(spark, sf, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op6_weak_quality(spark, sf):
    return quality_scores(load(spark, sf, "documents"))


def op7_length_histogram(spark, sf):
    return suffix_sums(length_counts(load(spark, sf, "documents"), RANKS, PATTERN))


def op8_suffix_array(spark, sf):
    cut = remove_repeats(load(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_spaced_seeds(spark, sf):
    found = contaminated(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "width")


def op10_exact_dedup(spark, sf):
    return exact_dedup(load(spark, sf, "documents")).withColumnRenamed("digest", "text_sha256")


OP10_SQL = """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents) t
WINDOW g AS (PARTITION BY norm)"""


def op11_elias_fano_lm(spark, sf):
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_documents(load(spark, sf, "documents").select("doc_id", "text"), tenth)


def op12_chebyshev_whitening(spark, sf):
    return whiten(load(spark, sf, "embeddings"))


def op13_anchor_alignment(spark, sf):
    files = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_scores(load(spark, sf, "documents"), *files)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_rules": op2_url_rules,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_language": op4_language,
    "op5_simhash_vptree": op5_simhash_vptree,
    "op6_weak_quality": op6_weak_quality,
    "op7_length_histogram": op7_length_histogram,
    "op8_suffix_array": op8_suffix_array,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_elias_fano_lm": op11_elias_fano_lm,
    "op12_chebyshev_whitening": op12_chebyshev_whitening,
    "op13_anchor_alignment": op13_anchor_alignment,
}
ORACLE = {"op2_url_rules": OP2_SQL, "op3_sentence_spans": OP3_SQL, "op10_exact_dedup": OP10_SQL}
