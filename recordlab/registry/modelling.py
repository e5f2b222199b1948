"""Registered queries over vectors, reducers, imputation and classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.functions.arrays import l2_normalise
from recordlab.functions.text import format_vector, parse_vector
from recordlab.operators import models, reduce, splits, vectors
from recordlab.operators import metrics as M
from recordlab.operators.impute import knn_impute
from recordlab.operators.reports import compare_parts, run_report
from recordlab.plans.clean import clean_table as clean_wide
from recordlab.plans.study import bundle_of, fold_pairs, reduced_pair, run_study
from recordlab.registry import fixtures as fx
from recordlab.registry.curation import as_json
from recordlab.registry.evaluation import rates_sql, roc_sql
from recordlab.registry.fixtures import duck, table
from recordlab.session import cut_lineage, scratch_path
from recordlab.sources import tables as io
from recordlab.streaming.quality import read_record_stream, start_filter

QUERIES, ORACLE = {}, {}
WIDTH = 64
CLASSES = [0, 1, 2]
# rows with labels folded into three classes, in md5 order inside their class
RANKED_THREE = (
    "SELECT vec_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY MD5(CONCAT('42:', CAST(vec_id AS STRING))), vec_id) AS rn, "
    "COUNT(*) OVER (PARTITION BY label) AS n FROM (SELECT vec_id, CAST(label % 3 AS INT) AS label FROM embeddings) e"
)


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# --- vectors --------------------------------------------------------------------------------

_DUCK_CELLS = "SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i) d"


def _cells(df, *keys, vector="vector", places=6):
    return df.select(*keys, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.round("v", places))


def _as_text(v):
    return F.array_join(F.transform(v, lambda x: x.cast("double").cast("string")), "\t")


@register(
    "vector_parse",
    duck("SELECT vec_id, CAST(dim AS INT) AS dim, ROUND(v, 6) AS v FROM cells", cells=_DUCK_CELLS),
)
def vector_parse(spark, sf):
    # tab-separated text of the vectors, read back
    rows = table(spark, sf, "embeddings").select("vec_id", _as_text(F.col("embedding")).alias("line"))
    return _cells(rows.select("vec_id", parse_vector(F.col("line")).alias("vector")), "vec_id")


@register(
    "vector_format",
    "SELECT vec_id, ARRAY_TO_STRING(LIST_TRANSFORM(embedding, lambda x: PRINTF('%.6f', CAST(x AS DOUBLE))), ' ') AS line FROM embeddings",
)
def vector_format(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", format_vector(F.col("embedding")).alias("line"))


@register(
    "l2_normalise",
    duck(
        "SELECT vec_id, CAST(dim AS INT) AS dim, ROUND(3 * v / SQRT(SUM(9 * v * v) OVER (PARTITION BY vec_id)), 6) AS v FROM cells",
        cells=_DUCK_CELLS,
    ),
)
def l2_normalise_query(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = table(spark, sf, "embeddings").select("vec_id", l2_normalise(tripled).alias("vector"))
    return _cells(rows, "vec_id")


@register(
    "mean_pool",
    duck("SELECT label, CAST(dim AS INT) AS dim, ROUND(AVG(v), 6) AS v FROM cells GROUP BY label, dim", cells=_DUCK_CELLS),
)
def mean_pool(spark, sf):
    return _cells(vectors.mean_pool(table(spark, sf, "embeddings"), "label", "embedding"), "label")


@register(
    "masked_mean_pool",
    duck(
        "SELECT label, CAST(dim AS INT) AS dim, ROUND(SUM(v * m) / GREATEST(SUM(m), CAST(1e-9 AS DOUBLE)), 6) AS v "
        "FROM (SELECT *, CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END AS m FROM cells) t GROUP BY label, dim",
        cells=_DUCK_CELLS,
    ),
)
def masked_mean_pool(spark, sf):
    masked = table(spark, sf, "embeddings").withColumn("mask", F.when(F.col("vec_id") % 3 > 0, 1).otherwise(0))
    return _cells(vectors.mean_pool(masked, "label", "embedding", "mask"), "label")


_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]"
_WORDS_SQL = f"LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '{_BLANK}+'), lambda x: x <> '')"


def _norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


@register(
    "text_encode",
    f"SELECT doc_id, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS n_tokens, CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) END AS norm "
    f"FROM (SELECT doc_id, LEN({_WORDS_SQL}) AS n FROM documents) t",
)
def text_encode(spark, sf):
    # counts add up to the tokens of a text; the scaled vector has length 1; blank text has none
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = vectors.encode_text(docs, "text", normalise=False, out="counts")
    both = vectors.encode_text(counts, "text")
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return both.select("doc_id", total.alias("n_tokens"), F.round(_norm("vector"), 4).alias("norm"))


@register(
    "corpus_vectors",
    f"""
WITH words AS (SELECT doc_id, UNNEST({_WORDS_SQL}) AS w FROM documents),
known AS (SELECT w FROM words GROUP BY w HAVING COUNT(*) >= 2),
hit AS (SELECT DISTINCT doc_id FROM words WHERE w IN (SELECT w FROM known))
SELECT doc_id, 100 AS width, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm
FROM documents""",
)
def corpus_vectors(spark, sf):
    # a text has a unit vector exactly when one of its words stands at two places of the corpus
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = vectors.fit_corpus_vectors(docs, partitions=8)
    return model.transform(docs).select("doc_id", F.size("vector").alias("width"), F.round(_norm("vector"), 4).alias("norm"))


# --- scaling and reduction ------------------------------------------------------------------


def labelled(spark, sf, classes=3):
    """``rec_id, label, features`` with labels folded into a few classes."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("rec_id"), (F.col("label") % classes).cast("int").alias("label"), "embedding"
    )
    return reduce.as_features(rows, "embedding").drop("embedding")


@register(
    "standardise",
    duck(
        "SELECT vec_id AS rec_id, CAST(dim AS INT) AS dim, ROUND((v - AVG(v) OVER (PARTITION BY dim)) / STDDEV_POP(v) OVER (PARTITION BY dim), 5) AS v FROM cells",
        cells=_DUCK_CELLS,
    ),
)
def standardise(spark, sf):
    rows = labelled(spark, sf)
    for stage in reduce.fit_standardiser(rows, "features", "scaled"):
        rows = stage.transform(rows)
    return _cells(rows.select("rec_id", vector_to_array("scaled").alias("vector")), "rec_id", places=5)


def _reduced(spark, sf, method, n=reduce.N_COMPONENTS, variance=reduce.VARIANCE):
    rows = labelled(spark, sf)
    model = reduce.fit_reducer(rows, method, n, variance)
    return reduce.reduce_rows(model, rows).select("rec_id", "label", vector_to_array("reduced").alias("vector"))


def _square(v="vector"):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _square_sql(cell):
    return duck(
        f"SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label, ROUND(SUM(s * s), 4) AS square FROM "
        f"(SELECT vec_id, label, {cell} AS s FROM cells) t GROUP BY vec_id, label",
        cells=_DUCK_CELLS,
    )


_CENTRED = "(v - AVG(v) OVER (PARTITION BY dim))"
_SCALED = f"{_CENTRED} / STDDEV_POP(v) OVER (PARTITION BY dim)"


def _squares(method):
    # all 64 components: a rotation keeps the length of the centred (scaled) row
    return lambda spark, sf: _reduced(spark, sf, method).select("rec_id", "label", F.round(_square(), 4).alias("square"))


register("pca", _square_sql(_CENTRED))(_squares("pca"))
register("scaled_pca", _square_sql(_SCALED))(_squares("scaled_pca"))


@register("auto_pca", "SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label, TRUE AS enough, TRUE AS fewest FROM embeddings")
def auto_pca(spark, sf):
    # the share of the kept components reaches the wanted one, without the last it does not
    rows = _reduced(spark, sf, "auto")
    n, d = reduce.row_count_and_width(labelled(spark, sf), "features")
    parts = rows.agg(
        F.sum(_square()).alias("all"), F.sum(F.element_at("vector", -1) * F.element_at("vector", -1)).alias("last")
    ).first()
    enough = parts["all"] / (n * d) >= reduce.VARIANCE - 1e-9
    fewest = (parts["all"] - parts["last"]) / (n * d) < reduce.VARIANCE
    return rows.select("rec_id", "label", F.lit(enough).alias("enough"), F.lit(fewest).alias("fewest"))


@register(
    "lda_axes",
    "SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label, 2 AS n_axes, TRUE AS centred, TRUE AS whitened FROM embeddings",
)
def lda_axes(spark, sf):
    # discriminants have mean 0, and inside the classes variance 1 and no covariance
    rows = cut_lineage(_reduced(spark, sf, "lda"))
    x, y = F.col("vector")[0], F.col("vector")[1]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))]
    ).collect()
    n = sum(r["n"] for r in sums)

    def within(a, b):
        return sum(r[a + b] - r[a] * r[b] / r["n"] for r in sums) / (n - len(sums))

    centred = all(abs(sum(r[a] for r in sums)) < 1e-6 * n for a in "xy")
    whitened = all(abs(within(*ab) - one) < 1e-6 for ab, one in (("xx", 1), ("xy", 0), ("yy", 1)))
    return rows.select(
        "rec_id", "label", F.size("vector").alias("n_axes"), F.lit(centred).alias("centred"), F.lit(whitened).alias("whitened")
    )


register(
    "no_reduction",
    duck("SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label, CAST(dim AS INT) AS dim, ROUND(v, 6) AS v FROM cells", cells=_DUCK_CELLS),
)(lambda spark, sf: _cells(_reduced(spark, sf, "none"), "rec_id", "label"))


@register(
    "variance_table",
    "SELECT CAST(range + 1 AS INT) AS component, TRUE AS falling, CAST(1 AS DOUBLE) AS total FROM range((SELECT MAX(LEN(embedding)) FROM embeddings))",
)
def variance_table(spark, sf):
    # the shares of all components never rise and add up to 1
    rows = labelled(spark, sf)
    found = reduce.variance_table(reduce.fit_reducer(rows, "scaled_pca"), rows)
    before = W.orderBy("component")  # one row per component
    return found.select(
        "component",
        (F.coalesce(F.lag("ratio").over(before), F.lit(1.0)) >= F.col("ratio")).alias("falling"),
        F.round(F.max("cumulative").over(W.partitionBy()), 6).alias("total"),
    )


_FOLD_SQL = duck(
    "SELECT fold, CASE WHEN own = fold THEN 'val' ELSE 'train' END AS role, rec_id, ROUND(SUM(s * s), 4) AS square FROM ("
    "SELECT c.fold, c.own, c.vec_id AS rec_id, (c.v - m.a) / m.d AS s FROM spread c JOIN moments m ON c.fold = m.fold AND c.dim = m.dim) t "
    "GROUP BY fold, own, rec_id",
    cells=_DUCK_CELLS,
    folds=f"SELECT vec_id, CAST((rn - 1) % 5 AS INT) AS own FROM ({RANKED_THREE}) t",
    spread="SELECT f.range::INT AS fold, own, c.vec_id, dim, v FROM cells c JOIN folds ON c.vec_id = folds.vec_id, range(5) f",
    moments="SELECT fold, dim, AVG(v) AS a, STDDEV_POP(v) AS d FROM spread WHERE own <> fold GROUP BY fold, dim",
)


@register("per_fold_reduce", _FOLD_SQL)
def per_fold_reduce(spark, sf):
    rows = cut_lineage(splits.kfold(labelled(spark, sf), "rec_id"))
    frames = []
    for i in range(splits.N_FOLDS):
        train, val, _ = reduced_pair(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), "scaled_pca", reduce.N_COMPONENTS, reduce.VARIANCE)
        for role, part in (("train", train), ("val", val)):
            square = F.round(_square(vector_to_array("features")), 4)
            frames.append(part.select(F.lit(i).alias("fold"), F.lit(role).alias("role"), "rec_id", square.alias("square")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@register(
    "feature_join",
    duck(
        "SELECT c.vec_id AS rec_id, CAST(dim AS INT) AS dim, ROUND(v, 6) AS v FROM cells c JOIN part p ON c.vec_id = p.p_partkey "
        "UNION ALL SELECT vec_id, 64, ROUND(CAST(p_size AS DOUBLE), 6) FROM embeddings JOIN part ON vec_id = p_partkey "
        "UNION ALL SELECT vec_id, 65, ROUND(p_retailprice, 6) FROM embeddings JOIN part ON vec_id = p_partkey",
        cells=_DUCK_CELLS,
    ),
)
def feature_join(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("rec_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
    )
    both = labelled(spark, sf).join(parts, "rec_id")
    joined = reduce.append_features(both, ["size", "price"], "features")
    return _cells(joined.select("rec_id", vector_to_array("features_all").alias("vector")), "rec_id")


# --- imputation and full cleaning -------------------------------------------------------------

_ALL_COLUMNS = [f"c{i}" for i in range(1, 9)]


def _knn_sql(columns, donors="TRUE"):
    """Mean of the five nearest donors per missing cell, else the donors' mean; all rows."""
    gap = " + ".join(f"COALESCE((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in columns)
    shared = " + ".join(f"(CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 0 ELSE 1 END)" for c in columns)
    near = {
        f"near_{c}": (
            f"SELECT rec_id, LIST_AVG(LIST_TRANSFORM(MIN(ROW(d, v), 5), lambda x: x[2])) AS v FROM ("
            f"SELECT a.rec_id, ({gap}) * {len(columns)} / NULLIF({shared}, 0) AS d, b.{c} AS v "
            f"FROM lab_wide a, lab_wide b WHERE a.{c} IS NULL AND b.{c} IS NOT NULL AND b.{donors}) t "
            f"WHERE d IS NOT NULL GROUP BY rec_id"
        ).replace("b.TRUE", "TRUE")
        for c in columns
    }
    return duck(
        "SELECT w.rec_id, "
        + ", ".join(f"ROUND(COALESCE(w.{c}, near_{c}.v, m.{c}), 6) AS {c}" for c in columns)
        + " FROM lab_wide w CROSS JOIN (SELECT "
        + ", ".join(f"AVG({c}) AS {c}" for c in columns)
        + f" FROM lab_wide WHERE {donors}) m"
        + "".join(f" LEFT JOIN near_{c} ON w.rec_id = near_{c}.rec_id" for c in columns),
        "lab_wide",
        **near,
    )


def _knn(spark, sf, columns):
    filled = knn_impute(fx.lab_wide(spark, sf).select("rec_id", *columns), columns)
    return filled.withColumns({c: F.round(c, 6) for c in columns})


# a table of four columns, and one of all eight, where gaps mix more and bounds prune less
_FOUR_COLUMNS = ["c1", "c2", "c3", "c8"]
register("knn_impute", _knn_sql(_FOUR_COLUMNS))(lambda spark, sf: _knn(spark, sf, _FOUR_COLUMNS))
register("knn_impute_all", _knn_sql(_ALL_COLUMNS))(lambda spark, sf: _knn(spark, sf, _ALL_COLUMNS))


@register("knn_impute_train_donors", _knn_sql(_ALL_COLUMNS, "rec_id % 5 > 0"))
def knn_train_donors(spark, sf):
    wide = fx.lab_wide(spark, sf).select("rec_id", *_ALL_COLUMNS)
    filled = knn_impute(wide, _ALL_COLUMNS, fit_on=wide.where("rec_id % 5 > 0"))
    return filled.withColumns({c: F.round(c, 6) for c in _ALL_COLUMNS})


@register("clean_table")
def clean_table(spark, sf):
    df = fx.lab_wide(spark, sf).withColumn("性别", F.when(F.col("rec_id") % 2 == 0, "男").otherwise("女"))
    text = df.withColumn("c2", F.coalesce(F.col("c2").cast("string"), F.lit(" ")))
    return clean_wide(text, max_missing=0.557).table


# --- classifiers ----------------------------------------------------------------------------

def _holdout(spark, sf):
    rows = cut_lineage(splits.split_random(labelled(spark, sf), "rec_id"))
    train, test, model = reduced_pair(rows.where("role = 'train'"), rows.where("role = 'test'"), "scaled_pca", reduce.N_COMPONENTS, reduce.VARIANCE)
    return train.persist(), test, model


def _judged(found):
    """Scores of a row add up to 1, and the prediction has the highest."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    best = F.col("scores")[F.array_position(F.lit(CLASSES), F.col("pred")).cast("int") - 1] >= F.array_max("scores")
    return found.select("rec_id", "label", F.round(total, 6).alias("total"), best.alias("pred_is_best"))


_JUDGED = "rec_id, label, CAST(1 AS DOUBLE) AS total, TRUE AS pred_is_best"
_HOLDOUT_SQL = (
    f"SELECT {_JUDGED} FROM (SELECT vec_id AS rec_id, label, rn, n FROM ({RANKED_THREE}) r) t "
    "WHERE rn <= FLOOR(CAST(0.2 AS DOUBLE) * n + CAST(0.5 AS DOUBLE))"
)


def _model_query(name):
    def run(spark, sf):
        algorithm = models.algorithms(grid=False)[name]
        train, test, _ = _holdout(spark, sf)
        model = models.fit_classifier(algorithm, train, {}, CLASSES)
        return _judged(models.predict(model, algorithm, test, CLASSES, ["rec_id"]))

    return run


for _name in ("RF", "MLP", "LR", "GBT", "SVM"):
    register(f"model_{_name.lower()}", _HOLDOUT_SQL)(_model_query(_name))


@register("grid_select")
def grid_select(spark, sf):
    """The whole grid of a family on all folds, in shared passes."""
    rows = cut_lineage(splits.kfold(labelled(spark, sf), "rec_id"))
    pairs = fold_pairs(rows, splits.N_FOLDS, "scaled_pca")
    ranking = models.select_config(spark, models.algorithms()["LR"], pairs, CLASSES)[2]
    for part in (part for pair in pairs for part in pair):
        part.unpersist()
    return ranking


@register("refit_holdout")
def refit_holdout(spark, sf):
    train, test, _ = _holdout(spark, sf)
    algorithm = models.algorithms(grid=False)["LR"]
    model = models.fit_classifier(algorithm, train, {}, CLASSES)
    both = models.predict(model, algorithm, train, CLASSES).withColumn("role", F.lit("train")).unionByName(
        models.predict(model, algorithm, test, CLASSES).withColumn("role", F.lit("test"))
    )
    return M.evaluate(both, CLASSES, ["role"])


@register("bundle_apply", f"SELECT {_JUDGED} FROM (SELECT vec_id AS rec_id, CAST(label % 3 AS INT) AS label FROM embeddings) t")
def bundle_apply(spark, sf):
    # reducer, bridge and classifier in one saved pipeline, applied to raw rows
    train, _, reducer = _holdout(spark, sf)
    algorithm = models.algorithms(grid=False)["LR"]
    path = scratch_path(spark, "bundle")
    fitted = models.fit_classifier(algorithm, train, {}, CLASSES)
    bundle = bundle_of(reducer, fitted)
    models.save_bundle(spark, path, bundle, "LR", {}, CLASSES)
    model, loaded, classes, _ = models.load_bundle(spark, path)
    return _judged(models.predict(model, loaded, labelled(spark, sf), classes, ["rec_id"]))


def _parts(spark, sf):
    rows = fx.algorithms(spark, sf).withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))
    return M.evaluate(rows, CLASSES, ["algorithm", "role"])


def _evaluated_sql(by, role=""):
    """All metrics per group as a subquery; ``role`` splits the rows into parts."""
    source = f"(SELECT *{role} FROM algos)"
    names = by.split()
    on = " AND ".join(f"s.{c} = a.{c}" for c in names)
    inner = {**rates_sql(by, source + " r"), **roc_sql(by, source + " r")}
    ctes = ", ".join(f"{k} AS ({v})" for k, v in inner.items())
    return f"(WITH {ctes} SELECT s.*, a.auc_weighted, a.auc_macro FROM summary s JOIN area_summary a ON {on})"


_PARTS_SQL = _evaluated_sql("algorithm role", ", CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS role")
_COMPARE_SQL = duck(
    "SELECT c.algorithm, "
    + ", ".join(
        f"ROUND(c.{m}, 6) AS {m}_cv, ROUND(x.{m}, 6) AS {m}_train, ROUND(y.{m}, 6) AS {m}_test" for m in M.CV_METRICS
    )
    + " FROM means c JOIN parts x ON c.algorithm = x.algorithm AND x.role = 'train' "
    "JOIN parts y ON c.algorithm = y.algorithm AND y.role = 'test'",
    "pred",
    "algos",
    means="SELECT algorithm, " + ", ".join(f"AVG({m}) AS {m}" for m in M.CV_METRICS) + f" FROM {_evaluated_sql('algorithm fold')} d GROUP BY algorithm",
    parts=f"SELECT * FROM {_PARTS_SQL} d",
)


@register("compare_train_cv_holdout", _COMPARE_SQL)
def compare_train_cv_holdout(spark, sf):
    folds = M.evaluate(fx.algorithms(spark, sf), CLASSES, ["algorithm", "fold"])
    found = compare_parts(M.cv_summary(folds), _parts(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c != "algorithm"})


@register("run_report", f"SELECT c.*, '{{}}' AS params, CAST(NULL AS DOUBLE) AS cv_score FROM ({_COMPARE_SQL}) c")
def report(spark, sf):
    folds = cut_lineage(M.evaluate(fx.algorithms(spark, sf), CLASSES, ["algorithm", "fold"]))
    tables = run_report(spark, folds, {n: ({}, None) for n in "ABC"}, cut_lineage(_parts(spark, sf)))
    path = scratch_path(spark, "report")
    io.write_tables(tables, path)
    both = spark.read.parquet(f"{path}/comparison").join(spark.read.parquet(f"{path}/chosen"), "algorithm")
    return both.withColumns({c: F.round(c, 6) for c in both.columns if c not in ("algorithm", "params", "cv_score")})


@register("run_study")
def study(spark, sf):
    """All five families with default folds, components and replicates, without their grids."""
    return run_study(labelled(spark, sf), algorithms=models.algorithms(grid=False), parallelism=splits.N_FOLDS)["intervals"]


@register(
    "stream_quality_filter",
    duck(
        "SELECT CAST(rec_id AS STRING) AS rec_id, COUNT(*) AS n_items FROM lab_long GROUP BY rec_id "
        "HAVING COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) / CAST(COUNT(*) AS DOUBLE) > CAST(0.6 AS DOUBLE) AND CAST(MIN(age) AS INT) >= 18",
        "lab_long",
    ),
)
def stream_quality_filter(spark, sf):
    base = scratch_path(spark, "stream")
    as_json(spark, sf).select("value").write.text(f"{base}/in")
    start_filter(read_record_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("rec_id", F.col("n_items").cast("bigint").alias("n_items"))
