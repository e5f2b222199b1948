import os

import numpy as np
from pyspark.sql import functions as F

from recordlab.operators.impute import knn_impute
from recordlab.plans.clean import clean_table
from recordlab.registry import curation
from recordlab.registry import fixtures as fx
from recordlab.registry.values import QUERIES
from recordlab.session import scratch_scope, stored


def kept(made):
    """Names of the scratch tables that are still there."""
    return sorted(os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.exists(p.removeprefix("file:")))


def wide(spark, n=200):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, size=(n, 3)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "rec_id INT, c0 DOUBLE, c1 DOUBLE, c2 DOUBLE")


def test_clean_table_keeps_only_what_its_answer_reads(spark):
    made = []
    with scratch_scope(made):
        cleaned = clean_table(wide(spark))
    assert any("clean-cells" in p for p in made)
    assert kept(made) == ["clean-values", "impute-fills"]
    assert cleaned.table.count() == 200
    assert cleaned.table.where("c0 IS NULL OR c1 IS NULL OR c2 IS NULL").count() == 0


def test_imputation_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = wide(spark).coalesce(1)
    made = []
    with scratch_scope(made):
        out = knn_impute(df.mapInArrow(seen, df.schema), ["c0", "c1", "c2"], min_block_rows=16)
    assert out.count() == 200
    assert read.value == 200
    assert kept(made) == ["impute-fills", "impute-rows"]


def test_stored_rows_keep_columns_without_a_type(spark):
    df = spark.range(3).select("id", F.lit(None).alias("a.b"), (F.col("id") * 2).alias("c"))
    back = stored(df, "void")
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == [(0, None, 0), (1, None, 2), (2, None, 4)]


def lines(spark, path, n=60):
    """A small lineitem table, with a line that stands twice."""
    rows = [
        (k, 1 + (k * 3 + i) % 7, 10 * k + i, i, float(1 + (k * 5 + i) % 50), 100.0 * k + i, 0.01 * i, "R" if i else "N", f"199{k % 8 + 1}-0{i + 1}-11")
        for k in range(1, n)
        for i in range(k % 4 + 1)
    ]
    names = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_shipdate STRING"
    spark.createDataFrame([*rows, rows[-1]], names).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_records_carry_the_lines_of_the_long_view(spark, tmp_path):
    sf = lines(spark, tmp_path)
    found = curation.as_records(spark, sf).select("rec_id", F.inline("items"))
    long = fx.lab_long(spark, sf)
    assert found.columns == long.columns
    assert found.count() == long.count() == long.intersectAll(found).count()
    items = curation.as_records(spark, sf).select("items")
    assert items.where(F.col("items") == F.sort_array("items")).count() == items.count()


def test_curate_files_leaves_no_plain_text(spark, tmp_path):
    sf = lines(spark, tmp_path)
    made = []
    with scratch_scope(made):
        rows = QUERIES["curate_files"](spark, sf).collect()
    assert len(rows) == rows[0].n_corpus > 0
    files = [os.path.join(d, f) for p in made for d, _, names in os.walk(p.removeprefix("file:")) for f in names]
    texts = [f for f in files if f.rsplit("/", 1)[1].startswith("part-") and not f.endswith(".parquet")]
    assert texts and all(f.endswith(".gz") for f in texts)
    assert "corpus-rows" not in kept(made)
