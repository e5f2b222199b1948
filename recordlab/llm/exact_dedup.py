"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. The grouping key of every stage
is (digest, whole text), so a digest only routes rows and never decides equality:

1. each map task merges its own equal texts (the partial side of the aggregation);
2. digests with more than a ten-thousandth of all rows (so at most ``HOT`` of them) are merged
   per (digest, salt, text), where the salt comes from the map task;
3. the salt winners are merged per (digest, text).

Other digests need no salt and skip stage 3. The per-row answer is a join of narrow rows
(id, digest) with the winners. Should one digest stand for several texts, that join is repeated
with the whole text as a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import ascii_lower, columns, stored, whole_text

HOT = 10_000
SALTS = 32


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(rows: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """``digest, norm, keep_id, group_size`` of rows ``id, digest, norm``; ``hot`` has digests."""
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "digest", "left")
    best, size = F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    cold = marked.where("is_hot IS NULL").groupBy("digest", "norm").agg(best, size)
    salted = (
        marked.where("is_hot")
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(best, size)
    )
    merged = salted.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return cold.unionByName(merged)


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = _sha,
    salts: int = SALTS,
) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest``.

    The row with the largest id of equal texts stays. A null text counts as empty, and all
    empty texts are equal. A null id stays only where every id of its group is null; rows that
    repeat one id and text get the same answer. No other column is read, so names can't clash.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id).alias("id"), ascii_lower(whole_text(text)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    narrow = stored(rows.select("id", "digest"), "exact-ids")
    common = max(1, narrow.count() // HOT)
    # groups above a ten-thousandth of the rows: never more than HOT digests
    hot = stored(
        narrow.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(common, 64)).select("digest"),
        "exact-hot",
    )
    best = winners(rows, hot, salts)
    groups = stored(best.drop("norm"), "exact-groups")
    shared = groups.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    if shared.isEmpty():
        found = narrow.join(groups, "digest")
    else:
        found = rows.join(best, ["digest", "norm"])
    return found.select(
        F.col("id").alias(id),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` without exact copies, all columns unchanged whatever their names.

    The same three stages carry whole rows, so each row moves once (rows of a hot digest, one for
    each salt, twice). Of equal texts the row with the largest id stays, one of several that share
    it; a null id only where all are null. Null and empty texts are equal; an empty table gives
    no rows.
    """
    whole = F.struct(*columns(docs)).alias("row")
    # a struct that holds a null id is below all others, and no null itself
    rows = docs.select(ascii_lower(whole_text(text)).alias("norm"), F.struct(F.col(id).alias("id")).alias("rank"), whole)
    rows = rows.withColumn("short", F.xxhash64("norm"))
    counts = stored(rows.groupBy("short").agg(F.count("*").alias("n")), "copy-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(total // HOT, 64)).select("short", F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), "short", "left").withColumn("digest", _sha(F.col("norm")))
    best = F.max_by(F.struct("rank", "row"), "rank").alias("best")
    cold = marked.where("is_hot IS NULL").groupBy("digest", "norm").agg(best)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = marked.where("is_hot").withColumn("salt", salt).groupBy("digest", "salt", "norm").agg(best)
    merged = salted.groupBy("digest", "norm").agg(F.max_by("best", "best.rank").alias("best"))
    return cold.unionByName(merged).select("best.row.*")
