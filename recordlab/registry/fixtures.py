"""Views over the test tables that play the part of records, cells and predictions.

Each view exists twice, as a DataFrame for Spark and as SQL text for the DuckDB check.
An order is a record and its lines are the lab items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LAB_LONG = """
SELECT l_orderkey AS rec_id, {pos} AS pos,
  CONCAT('item_', CAST(l_linenumber AS STRING)) AS item,
  CAST(10 + l_orderkey % 60 AS STRING) AS age,
  CASE WHEN l_orderkey % 2 = 0 THEN '男' ELSE '女' END AS sex,
  CAST(l_shipdate AS DATE) AS test_date,
  CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 10 < 2 THEN CAST(-1 AS DOUBLE) END AS res_num,
  CASE (l_orderkey * 7 + l_linenumber * 3) % 10
    WHEN 0 THEN NULL WHEN 1 THEN NULL
    WHEN 2 THEN '阳性(+)' WHEN 3 THEN '阴性(-)'
    WHEN 4 THEN CONCAT('>', CAST(CAST(l_quantity AS INT) AS STRING), '.00')
    WHEN 5 THEN CONCAT(CAST(CAST(l_quantity AS INT) AS STRING), 'x10^2')
    WHEN 6 THEN CONCAT('Normal ', CAST(CAST(l_quantity AS INT) AS STRING))
    WHEN 7 THEN '  '
    ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS res_txt
FROM {lineitem}
"""
# Item order inside a record. Spark keeps it as a sortable struct, so no window is needed.
_POS_SPARK = "STRUCT(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"
_POS_DUCK = (
    "ROW_NUMBER() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"
)

_COUNTED = "\n".join(
    f"  MAX(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS c{i}," for i in range(1, 8)
)
LAB_WIDE = f"""
SELECT l_orderkey AS rec_id,
{_COUNTED}
  MAX(CASE WHEN l_linenumber = 1 AND l_orderkey % 97 = 0 THEN l_extendedprice * 1000
           WHEN l_linenumber = 1 THEN l_extendedprice END) AS c8,
  MAX(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS b1,
  CAST(7 AS DOUBLE) AS k1,
  MAX(CASE WHEN l_orderkey % 50 = 0 THEN l_tax END) AS r1
FROM {{lineitem}} GROUP BY l_orderkey
"""
WIDE_VALUES = [f"c{i}" for i in range(1, 9)] + ["b1", "k1", "r1"]

PRED = """
SELECT vec_id, label, sc0, sc1, sc2,
  CASE WHEN sc0 >= sc1 AND sc0 >= sc2 THEN 0 WHEN sc1 >= sc2 THEN 1 ELSE 2 END AS pred,
  vec_id % 5 AS fold
FROM (SELECT vec_id, label % 3 AS label,
        ROUND(CAST(embedding[{e0}] AS DOUBLE), 2) AS sc0,
        ROUND(CAST(embedding[{e1}] AS DOUBLE), 2) AS sc1,
        ROUND(CAST(embedding[{e2}] AS DOUBLE), 2) AS sc2
      FROM {embeddings}) t
"""

DICTIONARY = """
SELECT * FROM (VALUES ('latin','the'), ('latin','that'), ('latin','ere'),
                      ('mixed','mentation'), ('mixed','ment')) AS t(category, term)
"""


def lab_long(spark: SparkSession, sf: str) -> DataFrame:
    sql = LAB_LONG.format(pos=_POS_SPARK, lineitem="{lineitem}")
    return spark.sql(sql, lineitem=table(spark, sf, "lineitem"))


def lab_wide(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LAB_WIDE, lineitem=table(spark, sf, "lineitem"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of three classes with score ties: ``vec_id, label, pred, scores, fold``."""
    sql = PRED.format(e0=0, e1=1, e2=2, embeddings="{embeddings}")
    rows = spark.sql(sql, embeddings=table(spark, sf, "embeddings"))
    return rows.select("vec_id", "label", "pred", F.array("sc0", "sc1", "sc2").alias("scores"), "fold")


def algorithms(spark: SparkSession, sf: str) -> DataFrame:
    """The same predictions under three algorithm names, each with its own score order."""
    return pred(spark, sf).select(
        "vec_id",
        "label",
        "fold",
        F.inline(
            F.array(
                F.struct(F.lit("A").alias("algorithm"), "pred", "scores"),
                F.struct(
                    F.lit("B").alias("algorithm"),
                    ((F.col("pred") + 1) % 3).alias("pred"),
                    F.array(F.col("scores")[2], F.col("scores")[0], F.col("scores")[1]).alias("scores"),
                ),
                F.struct(
                    F.lit("C").alias("algorithm"),
                    F.when(F.col("vec_id") % 2 == 0, F.col("label"))
                    .otherwise(F.col("pred"))
                    .alias("pred"),
                    F.transform("scores", lambda x: -x).alias("scores"),
                ),
            )
        ),
    )


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(DICTIONARY)


# The same views for DuckDB, as CTE bodies.
DUCK = {
    "lab_long": LAB_LONG.format(pos=_POS_DUCK, lineitem="lineitem"),
    "lab_wide": LAB_WIDE.format(lineitem="lineitem"),
    "pred": PRED.format(e0=1, e1=2, e2=3, embeddings="embeddings"),
    "dictionary": DICTIONARY,
    "algos": """
SELECT vec_id, label, fold, 'A' AS algorithm, pred, sc0, sc1, sc2 FROM pred
UNION ALL
SELECT vec_id, label, fold, 'B', (pred + 1) % 3, sc2, sc0, sc1 FROM pred
UNION ALL
SELECT vec_id, label, fold, 'C', CASE WHEN vec_id % 2 = 0 THEN label ELSE pred END, -sc0, -sc1, -sc2
FROM pred
""",
}


def duck(body: str, *views: str, **more: str) -> str:
    """``WITH view AS (…), … body``; ``more`` adds query-specific CTEs after the shared ones."""
    ctes = [f"{v} AS ({DUCK[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
