"""Train/hold-out splits, folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.functions.draws import digest
from recordlab.operators.ordered import hash_rank

SEED = 42
N_FOLDS = 5
TEST_SIZE = 0.2
# Year ranges of the time split, both ends included.
TRAIN_YEARS = (2010, 2019)
TEST_YEARS = (2020, 2025)
TRAIN, TEST = "train", "test"


def split_time(
    df: DataFrame,
    date: str,
    train_years: tuple[int, int] = TRAIN_YEARS,
    test_years: tuple[int, int] = TEST_YEARS,
    check: bool = True,
) -> DataFrame:
    """Add ``role`` by year; rows of other years are in neither part and leave.

    A null date or an empty part is an error.
    """
    year = F.year(F.col(date).cast("date"))
    role = F.when(year.between(*train_years), TRAIN).when(year.between(*test_years), TEST)
    if check:
        found = df.select(year.alias("y"), role.alias("r")).agg(
            F.count_if(F.col("y").isNull()).alias("undated"),
            F.count_if(F.col("r") == TRAIN).alias("train"),
            F.count_if(F.col("r") == TEST).alias("test"),
        ).first()
        if found["undated"]:
            raise ValueError(f"{found['undated']} rows without a date")
        if not found["train"] or not found["test"]:
            raise ValueError(f"empty part: {found['train']} training rows, {found['test']} test rows")
    return df.withColumn("role", role).where(F.col("role").isNotNull())


def split_random(
    df: DataFrame, key: str, label: str = "label", test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """Add ``role``: the first ``round(test_size · n)`` rows of each class, in md5 order, test."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    ranked = hash_rank(df, [label], digest(seed, key), key, "__rn", size="__n")
    held_out = F.floor(F.lit(test_size) * F.col("__n") + 0.5)
    role = F.when(F.col("__rn") <= held_out, TEST).otherwise(TRAIN)
    return ranked.withColumn("role", role).select(*df.columns, "role")


def kfold(df: DataFrame, key: str, label: str = "label", k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0…k-1: classes are dealt out in md5 order, so strata differ by one row at most."""
    ranked = hash_rank(df, [label], digest(seed, key), key, "__rn")
    return ranked.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).select(*df.columns, "fold")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight``: n_total / (n_classes · n_class), over the classes present."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    )


def add_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class; the weight table has one row per class."""
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    branches = F.lit(None).cast("double")
    for value, weight in weights.items():
        branches = F.when(F.col(label) == value, F.lit(weight)).otherwise(branches)
    return df.withColumn(out, branches)
