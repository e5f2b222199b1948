"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import stored

ROUNDS = 60


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over ordered pairs ``a < b``.

    Each node's smallest neighbour is an aggregation with a map-side part; the join back is an
    equi-join whose hot keys adaptive execution can split.
    """
    back = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back)
        low = around.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = around.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        low = back.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("k"), "m")
        to_low = back.join(low, F.col("u") == F.col("k")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = to_low.unionByName(low.select(F.col("m").alias("a"), F.col("k").alias("b")))
    return moved.where("a < b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``pairs(a, b)``; root is the smallest node it reaches."""
    now = stored(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        "cc-0",
    )
    mark = None
    for step in range(1, ROUNDS):
        now = stored(_stars(_stars(now, True), False), f"cc-{step}")
        # 128 bits of order-free checksum tell whether a round changed the edges
        seen = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return ends.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
