import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlab.functions.draws import digest
from recordlab.operators.ordered import add_bucket, cut_points, exact_quantiles, hash_rank, running_totals
from recordlab.operators.splits import kfold, split_random, split_time


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    # group "hot" holds most rows, with many equal values
    return [("hot" if rng.random() < 0.7 else rng.choice("ab"), round(rng.gauss(0, 3), rng.choice([0, 2]))) for _ in range(3000)]


def test_cut_points_balance(spark, rows):
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").select("g", "v").distinct()
    cuts = cut_points(df, "v", 100)
    assert cuts == sorted(set(cuts)) and len(cuts) >= 5
    sizes = [r["count"] for r in add_bucket(df, "v", cuts, "b").groupBy("b").count().collect()]
    assert max(sizes) < 300
    assert cut_points(df, "v", 10_000) == []


@pytest.mark.parametrize("per_bucket", [50, 10_000])
def test_quantiles_match_numpy(spark, rows, per_bucket):
    df = spark.createDataFrame(rows + [("a", None)], "g STRING, v DOUBLE")
    probs = (0.025, 0.25, 0.5, 0.75, 1.0)
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], "v", probs, per_bucket).collect()}
    for g in ("hot", "a", "b"):
        values = [v for k, v in rows if k == g]
        assert got[g][0] == len(values)
        assert np.allclose(got[g][1], np.quantile(values, probs), atol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_buckets(spark, rows, descending):
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").groupBy("g", "v").agg(F.count("*").alias("c"))
    cuts = cut_points(df, "v", 40)
    order = F.col("v").desc() if descending else F.col("v")
    got = running_totals(add_bucket(df, "v", cuts, "b"), ["g"], "b", [order], {"cum": F.col("c")}, {"all": F.col("c")}, descending)
    for r in got.collect():
        values = [v for k, v in rows if k == r["g"]]
        want = sum(v >= r["v"] if descending else v <= r["v"] for v in values)
        assert (r["cum"], r["all"]) == (want, len(values))


def test_hash_rank_is_a_ranking_and_keeps_null_groups(spark):
    data = [(i, None if i % 10 == 0 else "x") for i in range(500)]
    df = spark.createDataFrame(data, "id INT, g STRING")
    got = hash_rank(df.repartition(7), ["g"], digest(42, "id"), "id", "rn", "n").collect()
    assert len(got) == 500
    for g in (None, "x"):
        ids = [i for i, k in data if k == g]
        want = sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rn"])] == want
        assert {r["n"] for r in got if r["g"] == g} == {len(ids)}


def test_splits_are_stratified_and_stable(spark):
    df = spark.createDataFrame([(i, i % 7 % 3) for i in range(700)], "rec_id INT, label INT")
    first = {r["rec_id"]: r["role"] for r in split_random(df, "rec_id", test_size=0.25).collect()}
    again = {r["rec_id"]: r["role"] for r in split_random(df.repartition(13), "rec_id", test_size=0.25).collect()}
    assert first == again and len(first) == 700
    for label in range(3):
        ids = [i for i in range(700) if i % 7 % 3 == label]
        assert sum(first[i] == "test" for i in ids) == int(0.25 * len(ids) + 0.5)
    folds = kfold(df, "rec_id").groupBy("label").pivot("fold", list(range(5))).count().collect()
    for r in folds:
        counts = [r[str(i)] for i in range(5)]
        assert max(counts) - min(counts) <= 1
    with pytest.raises(ValueError):
        split_random(df, "rec_id", test_size=1.0)


def test_time_split_guards(spark):
    df = spark.createDataFrame([(1, "2012-01-01"), (2, "2021-01-01"), (3, "2030-01-01")], "rec_id INT, d STRING")
    assert {r["rec_id"]: r["role"] for r in split_time(df, "d").collect()} == {1: "train", 2: "test"}
    with pytest.raises(ValueError):
        split_time(df.where("rec_id <> 2"), "d")
    with pytest.raises(ValueError):
        split_time(spark.createDataFrame([(1, None)], "rec_id INT, d STRING"), "d")
