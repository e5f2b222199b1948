"""Queries whose SQL states the fitted values themselves, and round trips through written files."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from recordlab.operators import contexts, models, reduce, splits, trees
from recordlab.operators.splits import add_weights
from recordlab.plans.curate import curate
from recordlab.registry.curation import ITEMS, as_json
from recordlab.registry.fixtures import duck, table
from recordlab.registry.modelling import CLASSES, RANKED_THREE, labelled
from recordlab.session import cleaned_exchanges, scratch_path
from recordlab.sources import tables as io

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# --- fitted values ------------------------------------------------------------------------------

#: components from the middle of the vectors, cut to whole numbers so that every value is a bin
_COARSE = 16
_ROOT_SQL = f"""
WITH base AS (SELECT CAST(label % 3 AS INT) AS y, embedding FROM embeddings),
size AS (SELECT y, COUNT(*) AS c, SUM(COUNT(*)) OVER () AS n FROM base GROUP BY y),
cells AS (SELECT b.y, n / (3 * CAST(c AS DOUBLE)) AS w, CAST(f.range AS INT) AS feature,
    FLOOR(CAST(embedding[f.range + 1] AS DOUBLE) * 4) AS x FROM base b JOIN size s ON b.y = s.y, range({_COARSE}) f),
bins AS (SELECT k.range AS class, feature, x, SUM(w * (CAST(1 AS DOUBLE) / 3 - CASE WHEN y = k.range THEN 1 ELSE 0 END)) AS g,
    SUM(w) * 4 / 9 AS h FROM cells, range(3) k GROUP BY ALL),
cuts AS (SELECT class, feature, x, SUM(g) OVER low AS gl, SUM(h) OVER low AS hl, SUM(g) OVER every AS gt, SUM(h) OVER every AS ht
    FROM bins WINDOW low AS (PARTITION BY class, feature ORDER BY x), every AS (PARTITION BY class, feature)),
gains AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM cuts WHERE hl >= 1 AND ht - hl >= 1),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY gain DESC, feature, x) AS r FROM gains)
SELECT CAST(class AS INT) AS class, feature, x AS cut, ROUND(-0.3 * gl / (hl + 1), 6) AS low, ROUND(-0.3 * (gt - gl) / (ht - hl + 1), 6) AS high
FROM best WHERE r = 1"""


@register("gbt_root_split", _ROOT_SQL)
def gbt_root_split(spark, sf):
    """First cut and leaf values of the first boosted tree of each class."""
    coarse = F.transform(F.slice("embedding", 1, _COARSE), lambda x: F.floor(x.cast("double") * 4).cast("double"))
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).cast("int").alias("label"), array_to_vector(coarse).alias("features"))
    ready = add_weights(rows.withColumn("label_index", F.col("label").cast("double")))
    model = trees.fit_boosting(ready, "features", 3, trees=1, depth=1)
    found = trees.unpacked(model.getOrDefault(model.model))
    cuts = [
        (k, int(t[0][0]), float(found["edges"][t[0][0]][t[1][0]]), float(t[3][t[2][0], 0]), float(t[3][t[2][0] + 1, 0]))
        for k, t in enumerate(found["trees"])
    ]
    out = spark.createDataFrame(cuts, "class int, feature int, cut double, low double, high double")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


_SHARES_SQL = """
WITH base AS (SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label, vec_id % 4 AS part FROM embeddings),
size AS (SELECT label, SUM(COUNT(*)) OVER () / (3 * CAST(COUNT(*) AS DOUBLE)) AS w FROM base GROUP BY label),
sums AS (SELECT part, SUM(w) AS s, SUM(CASE WHEN b.label = 0 THEN w ELSE 0 END) AS s0, SUM(CASE WHEN b.label = 1 THEN w ELSE 0 END) AS s1
    FROM base b JOIN size ON b.label = size.label GROUP BY part)
SELECT rec_id, label, ROUND(s0 / s, 3) AS p0, ROUND(s1 / s, 3) AS p1, ROUND(1 - (s0 + s1) / s, 3) AS p2 FROM base JOIN sums USING (part)"""


@register("lr_group_shares", _SHARES_SQL)
def lr_group_shares(spark, sf):
    """Without a penalty, regression on group marks gives each group's weighted class shares."""
    marks = F.array(*[F.when(F.col("rec_id") % 4 == i, 1.0).otherwise(0.0) for i in range(3)])
    rows = labelled(spark, sf).withColumn("features", array_to_vector(marks))
    algorithm = models.algorithms(grid=False)["LR"]
    model = models.fit_classifier(algorithm, rows, {"C": 1e9}, CLASSES)
    found = models.predict(model, algorithm, rows, CLASSES, ["rec_id"])
    return found.select("rec_id", "label", *[F.round(F.col("scores")[i], 3).alias(f"p{i}") for i in range(3)])


_PLANE = "SELECT vec_id AS rec_id, CAST(embedding[1] AS DOUBLE) AS a, 2 * CAST(embedding[2] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) AS b FROM embeddings"
_PLANE_SQL = f"""
WITH p AS ({_PLANE}), m AS (SELECT AVG(a) AS ma, AVG(b) AS mb, VAR_SAMP(a) AS aa, VAR_SAMP(b) AS bb, COVAR_SAMP(a, b) AS ab FROM p),
t AS (SELECT *, ATAN2(2 * ab, aa - bb) / 2 AS angle FROM m)
SELECT rec_id, ROUND(ABS((a - ma) * COS(angle) + (b - mb) * SIN(angle)), 6) AS first,
  ROUND(ABS((b - mb) * COS(angle) - (a - ma) * SIN(angle)), 6) AS second FROM p, t"""


def _plane(spark, sf, narrow):
    e = [F.col("embedding")[i].cast("double") for i in (0, 1)]
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("rec_id"), F.lit(0).alias("label"), array_to_vector(F.array(e[0], 2 * e[1] + e[0])).alias("features")
    )
    found = reduce.reduce_rows(reduce.fit_reducer(rows, "pca", 2, narrow=narrow), rows)
    v = vector_to_array("reduced")
    return found.select("rec_id", F.round(F.abs(v[0]), 6).alias("first"), F.round(F.abs(v[1]), 6).alias("second"))


# both ways to the components of two columns, against the closed form of the turn
register("pca_plane", _PLANE_SQL)(lambda spark, sf: _plane(spark, sf, reduce.NARROW))
register("pca_plane_passes", _PLANE_SQL)(lambda spark, sf: _plane(spark, sf, 0))


@register("context_vectors")
def context_vectors(spark, sf):
    """Unit vectors of all texts from hashed contexts, at default settings."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = contexts.fit_context_vectors(docs).transform(docs)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return found.select("doc_id", F.size("vector").alias("width"), F.round(norm, 4).alias("norm"))


# --- through files ------------------------------------------------------------------------------


@register("fold_files", f"SELECT vec_id AS rec_id, CAST((rn - 1) % 5 AS INT) AS fold FROM ({RANKED_THREE}) t")
def fold_files(spark, sf):
    path = scratch_path(spark, "folds")
    io.write_folds(splits.kfold(labelled(spark, sf), "rec_id"), path)
    return spark.read.parquet(path).select("rec_id", F.col("fold").cast("int").alias("fold"))


@register(
    "modelling_files",
    "SELECT CAST(label % 3 AS INT) AS label, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first, ROUND(CAST(embedding[64] AS DOUBLE), 6) AS last, "
    "CAST(vec_id % 2 AS INT) AS fold FROM embeddings",
)
def modelling_files(spark, sf):
    """``feature_1 … feature_64, label`` by fold and role, written as text and read back."""
    path = scratch_path(spark, "modelling")
    rows = labelled(spark, sf).withColumn("fold", F.col("rec_id") % 2).withColumn("role", F.lit("train"))
    io.write_modeling_data(rows, path, 64)
    names = ", ".join(f"feature_{i} DOUBLE" for i in range(1, 65))
    back = spark.read.csv(path, header=True, schema=f"{names}, label INT, fold INT, role STRING")
    return back.select("label", F.round("feature_1", 6).alias("first"), F.round("feature_64", 6).alias("last"), "fold")


@register(
    "vector_files",
    "SELECT CAST(ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS line_no, LEN(embedding) AS width, "
    "ROUND(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: ROUND(CAST(x AS DOUBLE), 6))), 4) AS total FROM embeddings",
)
def vector_files(spark, sf):
    """Vector lines in the order of their ids, read back with their line numbers."""
    path = scratch_path(spark, "vectors")
    io.write_vectors(table(spark, sf, "embeddings"), path, "embedding", "vec_id")
    back = io.read_vectors(spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return back.select("line_no", F.size("vector").cast("bigint").alias("width"), F.round(total, 4).alias("total"))


@register(
    "config_file",
    "SELECT CAST(COUNT(*) AS STRING) AS rows, CAST(NULL AS STRING) AS date, 'scaled_pca' AS method FROM embeddings",
)
def config_file(spark, sf):
    path = scratch_path(spark, "config")
    options = {"rows": table(spark, sf, "embeddings").count(), "date": None, "method": "scaled_pca"}
    io.write_config(spark, options, path)
    return spark.read.schema("rows STRING, date STRING, method STRING").json(path)


_CELLS = ", ".join(f"MAX(CASE WHEN item = '{i}' THEN v END) AS {i}" for i in ITEMS)


@register(
    "curate_files",
    duck(
        f"""
SELECT CAST(rec_id AS STRING) AS rec_id, CASE WHEN rec_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, CAST(rec_id % 2 AS INT) AS label,
  MIN(age) AS age, MIN(sex) AS sex, {_CELLS}, COUNT(*) OVER () AS n_corpus FROM (
  SELECT *, COALESCE(res_txt, CASE WHEN res_num = -1 THEN '-1' END) AS v,
    ROW_NUMBER() OVER (PARTITION BY rec_id, item ORDER BY pos DESC) AS rn FROM lab_long WHERE rec_id IN (SELECT rec_id FROM kept)) t
WHERE rn = 1 GROUP BY rec_id""",
        "lab_long",
        kept="SELECT rec_id FROM lab_long GROUP BY rec_id HAVING COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) "
        "/ CAST(COUNT(*) AS DOUBLE) > CAST(0.6 AS DOUBLE) AND CAST(MIN(age) AS INT) >= 18",
    ),
)
def curate_files(spark, sf):
    """The whole curation from a directory per class to the written wide table and corpus."""
    base = scratch_path(spark, "curation")
    # the texts are many times the size of the table that they come from
    with cleaned_exchanges(spark):
        texts = as_json(spark, sf).select("value", (F.col("rec_id") % 2).alias("cls"))
        texts.write.partitionBy("cls").text(f"{base}/in", compression="gzip")
        dirs = {"A": f"{base}/in/cls=0", "B": f"{base}/in/cls=1"}
        curate(spark, dirs, {"A": 0, "B": 1}, per_line=True, out=f"{base}/out", compression="gzip")
    lines = spark.read.text(f"{base}/out/corpus/labels").count()
    wide = io.read_wide(spark, f"{base}/out/wide")
    return wide.select("rec_id", "source", "label", "age", "sex", *ITEMS, F.lit(lines).cast("bigint").alias("n_corpus"))
