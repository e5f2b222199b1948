"""Running sums, ranks and exact quantiles without putting a whole group into one task.

A plain window over a hot group sorts that group in a single task. Here every group is cut
into ordered buckets first. Bucket totals (few rows) give each bucket its starting offset, and
the row-level window runs inside ``(group, bucket)``, so the largest sort is one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.functions.draws import digest_bucket
from recordlab.session import cut_lineage

ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 4096


def cut_points(
    df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS
) -> list[float]:
    """Ascending cut values that split ``value`` into buckets of about equal row count.

    A mergeable quantile sketch; at most ``max_buckets`` numbers reach the driver, and none when
    one bucket is enough. The cuts only balance the work: any cut list gives the same results.
    """
    buckets = min(max_buckets, -(-df.count() // rows_per_bucket))
    if buckets <= 1:
        return []
    probs = F.lit([i / buckets for i in range(1, buckets)])
    found = df.agg(F.percentile_approx(value, probs, 20 * buckets).alias("c")).first()["c"]
    return sorted(set(found or []))


def add_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Bucket number of ``value``; equal values always share a bucket."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
        .transform(df)
        .withColumn(out, F.col(out).cast("int"))
    )


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join that also matches null keys, so that no row is lost."""
    side = offsets.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[c for c in offsets.columns if c not in keys],
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(side, same)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: dict[str, Column],
    whole: dict[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``sums[name]`` summed over all rows of the group up to and including this one,
    and ``whole[name]`` summed over the whole group.

    ``bucket`` must follow ``order`` inside a group. The join and the window use the same
    ``(by, bucket)`` keys, so the rows are shuffled once.
    """
    whole = whole or {}
    keys = [*by, bucket]
    along = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    parts = {**sums, **whole}
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in parts.items()])
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums],
        *[F.sum(f"__{n}").over(W.partitionBy(*by)).alias(n) for n in whole],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return _join_offsets(df, offsets, keys).select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"__{n}")).alias(n) for n, c in sums.items()],
        *whole,
    )


def hash_rank(
    df: DataFrame, by: Sequence[str], digest: Column, tie: str, out: str, size: str | None = None
) -> DataFrame:
    """1-based rank inside ``by`` along an md5 order; 4096 uniform buckets per group.

    ``size`` names a column for the row count of the group.
    """
    marked = df.withColumn("__h", digest).withColumn("__b", digest_bucket(F.col("__h")))
    counted = marked.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    group = W.partitionBy(*by)
    before = group.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(
        *by,
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        *([F.sum("__n").over(group).alias(size)] if size else []),
    )
    inside = W.partitionBy(*by, "__b").orderBy("__h", tie)
    ranked = _join_offsets(marked, offsets, [*by, "__b"])
    return ranked.select(
        *df.columns, (F.row_number().over(inside) + F.col("__o")).alias(out), *([size] if size else [])
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linearly interpolated quantiles per group: ``by…, n, q ARRAY<DOUBLE>``.

    Values are counted before they are ordered, so repeated values cost one row, and no group
    is ever held in one aggregation buffer. The counts are read several times and therefore
    checkpointed.
    """
    counts = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("cnt"))
    )
    cuts = cut_points(counts, value, rows_per_bucket)
    placed = running_totals(
        add_bucket(counts, value, cuts, "__b"),
        by,
        "__b",
        [F.col(value)],
        {"cum": F.col("cnt")},
        {"n": F.col("cnt")},
    )
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("cum") > F.floor(at), F.col(value))).alias(f"lo{i}"))
        picks.append(F.min(F.when(F.col("cum") > F.ceil(at), F.col(value))).alias(f"hi{i}"))
    found = placed.groupBy(*by, "n").agg(*picks)
    quantile = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double")
        quantile.append(low + (high - low) * (at - F.floor(at)))
    return found.select(*by, "n", F.array(*quantile).alias("q"))
