"""Record filters and per-record statistics, for nested records and for the long item table.

The nested forms are plain row expressions: no shuffle, and they run unchanged on a stream.
The long forms aggregate per record with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.functions.text import parse_age

MARKER = -1.0
MIN_RATIO = 0.6
MIN_AGE = 18


def _is_marker(number: Column, marker: float) -> Column:
    return F.coalesce(number == marker, F.lit(False))


def keep_nonempty(records: DataFrame) -> DataFrame:
    return records.where(F.size("labs") > 0)


def drop_all_marker(records: DataFrame, marker: float = MARKER) -> DataFrame:
    """Drop records whose every result is the numeric marker; the text "-1" is a result."""
    every = F.forall("labs", lambda x: _is_marker(x["res_num"], marker))
    return records.where(~F.coalesce(every, F.lit(False)))


def age_sex(labs: Column) -> Column:
    """Age and sex of the first item with an age; with no age, the sex of the last item."""
    first = F.try_element_at(F.filter(labs, lambda x: x["age"].isNotNull()), F.lit(1))
    return F.coalesce(first, F.try_element_at(labs, F.lit(-1)))


def valid_stats(records: DataFrame, marker: float = MARKER) -> DataFrame:
    """Add ``n_items, n_marker, n_valid, ratio, age, sex, age_years``."""
    n = F.greatest(F.size("labs"), F.lit(0))
    marked = F.size(F.filter("labs", lambda x: _is_marker(x["res_num"], marker)))
    return (
        records.withColumn("n_items", n)
        .withColumn("n_marker", F.greatest(marked, F.lit(0)))
        .withColumn("n_valid", F.col("n_items") - F.col("n_marker"))
        .withColumn("ratio", F.coalesce(F.try_divide("n_valid", "n_items"), F.lit(0.0)))
        .withColumn("__p", age_sex(F.col("labs")))
        .withColumn("age", F.col("__p.age"))
        .withColumn("sex", F.col("__p.sex"))
        .withColumn("age_years", parse_age(F.col("__p.age"), F.col("__p.age_num")))
        .drop("__p")
    )


def filter_quality(stats: DataFrame, threshold: float = MIN_RATIO, min_age: int = MIN_AGE) -> DataFrame:
    """Keep records with enough valid results (strictly more) of adults; works on both forms."""
    return stats.where((F.col("ratio") > threshold) & (F.col("age_years") >= min_age))


def long_stats(long: DataFrame, key: str = "rec_id", marker: float = MARKER) -> DataFrame:
    """The statistics of ``valid_stats`` from a long table with a sortable ``pos``."""
    person = F.struct("age", "sex")
    return (
        long.groupBy(key)
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(_is_marker(F.col("res_num"), marker)).alias("n_marker"),
            F.min_by(
                F.when(F.col("age").isNotNull(), person), F.when(F.col("age").isNotNull(), F.col("pos"))
            ).alias("__first"),
            F.max_by("sex", "pos").alias("__last"),
        )
        .select(
            key,
            "n_items",
            "n_marker",
            (F.col("n_items") - F.col("n_marker")).alias("n_valid"),
            ((F.col("n_items") - F.col("n_marker")) / F.col("n_items")).alias("ratio"),
            F.col("__first.age").alias("age"),
            F.when(F.col("__first").isNotNull(), F.col("__first.sex"))
            .otherwise(F.col("__last"))
            .alias("sex"),
            parse_age(F.col("__first.age")).alias("age_years"),
        )
    )


def semi_nonempty(records: DataFrame, long: DataFrame, key: str = "rec_id") -> DataFrame:
    """Records that own at least one item row."""
    return records.join(long.select(key).distinct(), key, "left_semi")
