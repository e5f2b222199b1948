"""Token counts from an exact length histogram.

Documents are counted by encoded length; one row per distinct length is all that later answers
need. Suffix sums over the lengths give, for every context limit, how many documents reach it
and how many tokens remain when longer documents are cut. The running sums are bucketed, so no
task orders all lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.llm.bpe import encode
from recordlab.llm.common import stored
from recordlab.operators.ordered import add_bucket, cut_points, running_totals


def length_counts(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``length, n_docs``: how many documents encode to each length.

    Null and empty texts have length 0. Equal rows count each; other columns are not read; an
    empty table gives no rows.
    """
    sized = encode(docs.select(F.col(text).alias("text")), ranks, pattern).select(F.size("ids").cast("bigint").alias("length"))
    return sized.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame, lengths_per_bucket: int = 100_000) -> DataFrame:
    """Every length as a context limit, from ``length, n_docs``.

    ``docs_at_least`` and ``tokens_at_least`` sum over this length and all above; ``tokens_cut``
    are the tokens that remain when documents are cut at this length; ``docs_at_most`` is the
    rank of the last document of this length.
    """
    counts = stored(counts, "lengths")
    cuts = cut_points(counts, "length", lengths_per_bucket)
    one, tokens = F.col("n_docs"), F.col("n_docs") * F.col("length")
    sums = running_totals(
        add_bucket(counts, "length", cuts, "bucket").withColumn("all", F.lit(1)),
        ["all"],
        "bucket",
        [F.col("length").desc()],
        {"docs_at_least": one, "tokens_at_least": tokens},
        {"total_docs": one, "total_tokens": tokens},
        descending=True,
    )
    below = F.col("total_tokens") - F.col("tokens_at_least")
    return sums.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (below + F.col("length") * F.col("docs_at_least")).alias("tokens_cut"),
        "total_docs",
        "total_tokens",
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context, docs_cut, tokens_cut`` for any limits: documents above each, tokens that remain.

    The first length above a limit holds the suffix sums the limit needs.
    """
    found = []
    for limit in limits:
        above = F.col("length") > limit
        first = F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(above, F.col("length")))
        found.append(F.struct(F.lit(limit).alias("context"), first.alias("s")))
    one = sums.agg(F.array(*found).alias("x"), F.max("total_tokens").alias("t"))
    each = one.where("t IS NOT NULL").select(F.explode("x").alias("x"), "t")
    docs = F.coalesce("x.s.docs_at_least", F.lit(0))
    return each.select(
        "x.context",
        docs.alias("docs_cut"),
        (F.col("t") - F.coalesce("x.s.tokens_at_least", F.lit(0)) + docs * F.col("x.context")).alias("tokens_cut"),
    )


def quantiles(sums: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``p, length``: the smallest length with at least ``p`` of all documents at or below it."""
    reach = F.col("docs_at_most") / F.col("total_docs")
    found = [
        F.struct(F.lit(float(p)).alias("p"), F.min(F.when(reach >= float(p), F.col("length"))).alias("length"))
        for p in probabilities
    ]
    return sums.agg(F.array(*found).alias("x")).select(F.inline("x")).where("length IS NOT NULL")
