"""Corpus pipeline: language, exact copies, near copies, benchmark leaks, token ids.

Each stage gets what the one before kept, as a written table, and works on all of it. A stage that
starts removes the scratch tables of the one before, whose result is written by then.

All stages take documents with null or empty texts, null ids, repeated rows and further columns of
any name, and an empty table, which stays empty.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlab.llm.bpe import decode, encode
from recordlab.llm.common import columns, fresh, load, stored
from recordlab.llm.decontaminate import drop_contaminated
from recordlab.llm.exact_dedup import drop_copies
from recordlab.llm.language import predict, train
from recordlab.llm.simhash import drop_near_copies
from recordlab.session import drop_scratch, scratch_scope

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

_HELD = threading.local()


def _after(stage):
    """``stage`` behind the removal of what the stage before left in the scratch folder."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _HELD.__dict__.setdefault("made", [])
        drop_scratch(spark, made)
        with scratch_scope(made):
            return stage(spark, docs, sf_dir)

    return run_stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a letter, and a calibrated score above the threshold.

    Null and empty texts have no letter and go; equal texts stay or go together.
    """
    _HELD.made = []  # what an earlier run left may still be read
    with scratch_scope(_HELD.made):
        (found,) = fresh(docs.columns, "found")
        judged = predict(docs, train(docs), out=found)
        return judged.where(~F.col(f"{found}.rejected")).select(*columns(docs))


@_after
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z) the row with the largest doc_id.

    Null and empty texts are equal; of several such rows with one doc_id a single one stays; a
    null doc_id stays only where its group has no other.
    """
    return drop_copies(docs)


@_after
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group (three-word shingles, two bits).

    Texts without words share fingerprint zero and are one group; rows that share a doc_id stay or
    go together.
    """
    return drop_near_copies(docs)


@_after
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item; texts without tokens stay."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


@_after
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids``, ``n_tokens`` and whether decoding gives the text's bytes back.

    A null or empty text has no ids; columns with these three names are replaced.
    """
    (raw,) = fresh([*docs.columns, "ids"], "raw")
    both = decode(encode(docs, RANKS, PATTERN), RANKS, PATTERN, out=raw)
    same = (F.col(raw) == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip")
    others = columns(docs, ("ids", "n_tokens", "round_trip"))
    return both.select(*others, "ids", F.size("ids").cast("bigint").alias("n_tokens"), same)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: hashing, components and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with scratch_scope([]) as kept:
            docs = stored(out, f"stage-{name}")
        drop_scratch(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
