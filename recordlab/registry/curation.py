"""Registered queries over records, text and cells, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.functions import cells as rules
from recordlab.operators import columns as cols
from recordlab.operators import narrative as narr
from recordlab.operators import quality, redact, wide
from recordlab.registry import fixtures as fx
from recordlab.registry.fixtures import duck, table
from recordlab.session import cut_lineage, scratch_path, stored
from recordlab.sources import records as rec
from recordlab.sources import tables as io

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# --- record filters -------------------------------------------------------------------------


@register(
    "rec_nonempty",
    "SELECT o_orderkey AS rec_id, o_orderstatus AS status FROM orders "
    "WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def rec_nonempty(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rec_id"), F.col("o_orderstatus").alias("status")
    )
    return quality.semi_nonempty(orders, fx.lab_long(spark, sf))


@register(
    "rec_not_all_marker",
    duck(
        "SELECT rec_id, COUNT(*) AS n_items FROM lab_long GROUP BY rec_id "
        "HAVING NOT BOOL_AND(COALESCE(res_num = -1, FALSE))",
        "lab_long",
    ),
)
def rec_not_all_marker(spark, sf):
    stats = quality.long_stats(fx.lab_long(spark, sf))
    return stats.where(F.col("n_valid") > 0).select("rec_id", "n_items")


_STATS = """
SELECT rec_id, COUNT(*) AS n_items,
  COUNT(*) FILTER (WHERE COALESCE(res_num = -1, FALSE)) AS n_marker,
  COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) AS n_valid,
  ROUND(COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) / CAST(COUNT(*) AS DOUBLE), 6) AS ratio
FROM lab_long GROUP BY rec_id"""


@register("rec_valid_ratio", duck(_STATS, "lab_long"))
def rec_valid_ratio(spark, sf):
    return quality.long_stats(fx.lab_long(spark, sf)).select(
        "rec_id", "n_items", "n_marker", "n_valid", F.round("ratio", 6).alias("ratio")
    )


@register(
    "rec_ratio_age_filter",
    duck(
        """
SELECT rec_id, ROUND(COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) / CAST(COUNT(*) AS DOUBLE), 6) AS ratio,
  CAST(MIN(age) AS INT) AS age_years
FROM lab_long GROUP BY rec_id
HAVING COUNT(*) FILTER (WHERE NOT COALESCE(res_num = -1, FALSE)) / CAST(COUNT(*) AS DOUBLE) > CAST(0.6 AS DOUBLE)
  AND CAST(MIN(age) AS INT) >= 18""",
        "lab_long",
    ),
)
def rec_ratio_age_filter(spark, sf):
    stats = quality.long_stats(fx.lab_long(spark, sf))
    return quality.filter_quality(stats).select("rec_id", F.round("ratio", 6).alias("ratio"), "age_years")


@register(
    "age_sex_first_item",
    duck(
        """
SELECT rec_id, ARG_MIN(age, pos) FILTER (WHERE age IS NOT NULL) AS age,
  COALESCE(ARG_MIN(sex, pos) FILTER (WHERE age IS NOT NULL), ARG_MAX(sex, pos)) AS sex
FROM (SELECT rec_id, pos, CASE WHEN item NOT IN ('item_1', 'item_2', 'item_5') THEN age END AS age,
        CONCAT(sex, item) AS sex FROM lab_long) t
GROUP BY rec_id""",
        "lab_long",
    ),
)
def age_sex_first_item(spark, sf):
    # some items lack the age, and each item has its own sex text
    long = fx.lab_long(spark, sf).withColumns(
        {
            "age": F.when(~F.col("item").isin("item_1", "item_2", "item_5"), F.col("age")),
            "sex": F.concat("sex", "item"),
        }
    )
    return quality.long_stats(long).select("rec_id", "age", "sex")


# --- JSON records ---------------------------------------------------------------------------


def as_records(spark, sf) -> DataFrame:
    """Orders as nested records with their items in order.

    Only to make JSON input: a record is one document, so its items fit one row by definition.
    The operators on the long table never collect a record.
    """
    long = fx.lab_long(spark, sf)
    # item and date follow from the position, age and sex from the record: they do not travel with each line
    records = long.groupBy("rec_id").agg(
        F.max("age").alias("age"),
        F.max("sex").alias("sex"),
        F.sort_array(F.collect_list(F.struct("pos", "res_num", "res_txt"))).alias("lines"),
    )

    def item(x):
        return F.struct(
            x["pos"].alias("pos"),
            F.concat(F.lit("item_"), x["pos"]["l_linenumber"].cast("string")).alias("item"),
            "age",
            "sex",
            x["pos"]["l_shipdate"].cast("date").alias("test_date"),
            x["res_num"].alias("res_num"),
            x["res_txt"].alias("res_txt"),
        )

    return records.select("rec_id", F.transform("lines", item).alias("items"))


def as_json(spark, sf) -> DataFrame:
    """``rec_id, n_items, value``: the same records as JSON text; a marker is a JSON number."""

    def item_json(x):
        person = [
            x["age"].cast("int").alias(rec.AGE_KEYS[0]),
            x["sex"].alias(rec.SEX_KEYS[0]),
            x["test_date"].cast("string").alias(rec.DATE_KEY),
        ]
        number = F.struct(x["item"].alias(rec.ITEM_KEY), x["res_num"].cast("int").alias(rec.RESULT_KEY), *person)
        text = F.struct(x["item"].alias(rec.ITEM_KEY), x["res_txt"].alias(rec.RESULT_KEY), *person)
        return F.when(x["res_num"].isNotNull(), F.to_json(number)).otherwise(F.to_json(text))

    items = F.array_join(F.transform("items", item_json), ",")
    return as_records(spark, sf).select(
        "rec_id",
        F.size("items").alias("n_items"),
        F.format_string(f'{{"{rec.RECORD_KEY}":"%d","{rec.LAB_KEY}":[%s]}}', "rec_id", items).alias("value"),
    )


@register(
    "json_roundtrip_items",
    duck(
        "SELECT CAST(rec_id AS STRING) AS rec_id, CAST(pos - 1 AS INT) AS pos, item, age, sex, "
        "test_date, res_num, res_txt FROM lab_long",
        "lab_long",
    ),
)
def json_roundtrip_items(spark, sf):
    docs = rec.parse_documents(as_json(spark, sf).select("value"))
    return rec.explode_labs(rec.project_records(docs, literals=False)).select(
        "rec_id", "pos", "item", "age", "sex", "test_date", "res_num", "res_txt"
    )


@register(
    "json_tolerant_reader",
    duck(
        "SELECT rec_id, rec_id % 4 < 2 AS kept, CASE WHEN rec_id % 4 < 2 THEN COUNT(*) END AS n_items "
        "FROM lab_long GROUP BY rec_id",
        "lab_long",
    ),
)
def json_tolerant_reader(spark, sf):
    # a quarter each: an object, a list holding the object, text cut short, a list of scalars
    k, v = F.col("rec_id") % 4, F.col("value")
    dirty = as_json(spark, sf).select(
        F.col("rec_id").alias("key"),
        F.when(k == 0, v)
        .when(k == 1, F.concat(F.lit("["), v, F.lit(", 7]")))
        .when(k == 2, F.expr("substr(value, 1, length(value) - 1)"))
        .otherwise(F.concat(F.lit("["), F.col("rec_id"), F.lit("]")))
        .alias("value"),
    )
    parsed = rec.project_records(rec.parse_documents(dirty).withColumn("kept", F.col("doc").isNotNull()), literals=False)
    return parsed.select(
        F.col("key").alias("rec_id"), "kept", F.size("labs").cast("bigint").alias("n_items")
    )


@register(
    "records_scan",
    duck(
        "SELECT CONCAT('class_', CAST(rec_id % 3 AS STRING)) AS source, CAST(rec_id % 3 AS INT) AS label, "
        "COUNT(DISTINCT rec_id) AS n_records, COUNT(*) AS n_items FROM lab_long GROUP BY rec_id % 3",
        "lab_long",
    ),
)
def records_scan(spark, sf):
    base = scratch_path(spark, "records")
    # one directory per class, each with nested directories below it
    as_json(spark, sf).select(
        F.concat(F.lit("class_"), F.col("rec_id") % 3).alias("cls"),
        (F.col("rec_id") % 2).alias("part"),
        "value",
    ).write.partitionBy("cls", "part").text(base)
    names = [f"class_{i}" for i in range(3)]
    found = rec.read_records(
        spark, {n: f"{base}/cls={n}" for n in names}, {n: i for i, n in enumerate(names)}, per_line=True
    )
    return found.groupBy("source", "label").agg(
        F.count("*").alias("n_records"), F.sum(F.size("labs")).alias("n_items")
    )


_SECTION_KEYS = [(name, key, column) for name, (key, _, column) in rec.SECTIONS.items()]
_SECTION_SQL = ", ".join(
    f"CASE WHEN doc_id % 4 = {i} THEN COALESCE(text, '') ELSE '' END AS \"{column}\"" for i, (_, _, column) in enumerate(_SECTION_KEYS)
)


@register("sections", f"SELECT CAST(doc_id AS STRING) AS rec_id, {_SECTION_SQL} FROM documents")
def sections(spark, sf):
    # each document is the conclusion of one of the four sections; an absent one reads as ''
    def section(i, key):
        return F.when(F.col("doc_id") % 4 == i, F.struct(F.col("text").alias(key)))

    value = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias(rec.RECORD_KEY),
            *[section(i, key).alias(name) for i, (name, key, _) in enumerate(_SECTION_KEYS)],
        )
    )
    docs = rec.parse_documents(table(spark, sf, "documents").select(value.alias("value")))
    records = rec.project_records(docs, literals=False)
    return wide.wide_table(records, items=[]).select("rec_id", *[column for _, _, column in _SECTION_KEYS])


@register("distinct_items", "SELECT DISTINCT CONCAT('item_', CAST(l_linenumber AS STRING)) AS item FROM lineitem")
def distinct_items(spark, sf):
    return wide.distinct_items(fx.lab_long(spark, sf))


# --- text and wide table --------------------------------------------------------------------

_NARRATIVE = """
SELECT rec_id, CONCAT('年龄：', MIN(age), '；性别：', MIN(sex), '；实验室检查：',
  STRING_AGG(CONCAT(item, ' ', CASE WHEN res_num = -1 THEN '-1' ELSE COALESCE(TRIM(res_txt), '') END), '；' ORDER BY pos)) AS text
FROM lab_long GROUP BY rec_id"""


@register("narrative", duck(_NARRATIVE, "lab_long"))
def narrative(spark, sf):
    records = rec.project_records(rec.parse_documents(as_json(spark, sf).select("value")))
    return narr.narrative(records).select(F.col("rec_id").cast("bigint").alias("rec_id"), "text")


ITEMS = [f"item_{i}" for i in range(1, 8)]
_WIDE_ITEMS = ", ".join(
    f"MAX(CASE WHEN item = '{i}' THEN v END) AS {i}" for i in ITEMS
)


@register(
    "wide_pivot_last_wins",
    duck(
        f"""
SELECT rec_id, {_WIDE_ITEMS} FROM (
  SELECT rec_id, item, COALESCE(res_txt, CASE WHEN res_num = -1 THEN '-1' END) AS v,
    ROW_NUMBER() OVER (PARTITION BY rec_id, item ORDER BY pos DESC) AS rn FROM lab_long) t
WHERE rn = 1 GROUP BY rec_id""",
        "lab_long",
    ),
)
def wide_pivot_last_wins(spark, sf):
    long = fx.lab_long(spark, sf).withColumn(
        "cell", F.coalesce("res_txt", F.col("res_num").cast("int").cast("string"))
    )
    return wide.pivot_last(long, ["rec_id"], wide.item_names(long), "cell")


@register(
    "class_union",
    "SELECT n_name AS source, CAST(n_nationkey AS BIGINT) AS label, 'customer' AS kind, c_custkey AS rec_id "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL "
    "SELECT n_name, CAST(n_nationkey AS BIGINT), 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def class_union(spark, sf):
    # JSON lines of both tables, one directory per nation; nation is the fixed class list (25 rows)
    base = scratch_path(spark, "classes")
    people = [
        table(spark, sf, name).select(F.col(cls).alias("cls"), F.lit(name).alias("kind"), F.col(key).alias("id"))
        for name, key, cls in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"))
    ]
    both = people[0].unionByName(people[1])
    value = F.to_json(F.struct(F.col("id").cast("string").alias(rec.RECORD_KEY)))
    both.select("cls", "kind", value.alias("value")).write.partitionBy("cls", "kind").text(base)
    used = table(spark, sf, "nation").join(both.select(F.col("cls").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    classes = {r["n_name"]: r["n_nationkey"] for r in used.collect()}
    found = rec.read_records(spark, {n: f"{base}/cls={k}" for n, k in classes.items()}, classes, per_line=True)
    return found.select(
        "source",
        F.col("label").cast("bigint").alias("label"),
        F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"),
        F.col("rec_id").cast("bigint").alias("rec_id"),
    )


@register(
    "class_missing_dir",
    """
SELECT c_custkey AS rec_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def class_missing_dir(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("rec_id"))
    # customers without a finished order
    found = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("rec_id"))
    return rec.missing_classes(wanted, found, "rec_id")


# --- redaction ------------------------------------------------------------------------------

_PATTERN = "(?i)(mentation|that|ment|the|ere)"


def _redacted(spark, sf):
    return redact.redact(table(spark, sf, "documents"), "text", fx.dictionary(spark))


@register(
    "redact_text",
    f"""
SELECT doc_id, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(text, '{_PATTERN}', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' \n\r\t') AS text,
  LEN(REGEXP_EXTRACT_ALL(text, '{_PATTERN}')) AS n_hits FROM documents""",
)
def redact_text(spark, sf):
    return _redacted(spark, sf).select("doc_id", "text", F.size("hits").cast("bigint").alias("n_hits"))


@register(
    "redact_hits_top20",
    f"""
SELECT term, COUNT(*) AS n FROM (SELECT UNNEST(REGEXP_EXTRACT_ALL(text, '{_PATTERN}')) AS term FROM documents) t
GROUP BY term ORDER BY n DESC, term LIMIT 20""",
)
def redact_hits_top20(spark, sf):
    return redact.hit_counts(_redacted(spark, sf))


@register(
    "redact_totals",
    f"""
SELECT COUNT(*) AS n_lines, CAST(SUM(LEN(h)) AS BIGINT) AS n_hits, COUNT(*) FILTER (WHERE LEN(h) > 0) AS n_lines_hit
FROM (SELECT REGEXP_EXTRACT_ALL(text, '{_PATTERN}') AS h FROM documents) t""",
)
def redact_totals(spark, sf):
    return redact.hit_totals(_redacted(spark, sf))


# --- cell rules -----------------------------------------------------------------------------

# Cells of every shape the rules know, made from the rows of lineitem.
CELL_SHAPES = """
SELECT l_orderkey AS rec_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
  CASE (l_orderkey + l_linenumber) % 16
    WHEN 0 THEN '阳性(+)' WHEN 1 THEN 'Negative' WHEN 2 THEN CONCAT(q, '.30E3')
    WHEN 3 THEN CONCAT(q, '.5x10^2') WHEN 4 THEN CONCAT('> ', q, '.00 U') WHEN 5 THEN CONCAT('<', q, '00')
    WHEN 6 THEN CONCAT('Normal ', q) WHEN 7 THEN '   ' WHEN 8 THEN CONCAT(' ', q, '.5 ')
    WHEN 9 THEN CONCAT(q, '.30E+3') WHEN 10 THEN '男' WHEN 11 THEN ' Female '
    WHEN 12 THEN CONCAT('-', q) WHEN 13 THEN CONCAT(q, ' 阴性') WHEN 14 THEN 'cloudy' ELSE NULL END AS txt
FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS STRING) AS q FROM {lineitem}) t
"""
_SHAPES = CELL_SHAPES.format(lineitem="lineitem")
_KEYS = "rec_id, line, part_id, supp_id"
_POS = "(LOWER(txt) LIKE '%阳性%' OR LOWER(txt) LIKE '%pos%' OR LOWER(txt) LIKE '%+%')"
_NEG = "(LOWER(txt) LIKE '%阴性%' OR LOWER(txt) LIKE '%neg%' OR LOWER(txt) LIKE '%-%')"
_E = "'^([\\d.]+)\\s*[Ee]十?(\\d+)$'"
_TEN = "'^([\\d.]+)\\s*[x×]10\\^(\\d+)$'"
_CMP = "'^([<>])\\s*([\\d.]+)'"
_SCI = (
    f"CASE WHEN REGEXP_MATCHES(TRIM(txt), {_E}) THEN CAST(REGEXP_EXTRACT(TRIM(txt), {_E}, 1) AS DOUBLE) * POWER(10, CAST(REGEXP_EXTRACT(TRIM(txt), {_E}, 2) AS INT)) "
    f"WHEN REGEXP_MATCHES(TRIM(txt), {_TEN}) THEN CAST(REGEXP_EXTRACT(TRIM(txt), {_TEN}, 1) AS DOUBLE) * POWER(10, CAST(REGEXP_EXTRACT(TRIM(txt), {_TEN}, 2) AS INT)) END"
)
_DIGITS = f"REGEXP_EXTRACT(TRIM(txt), {_CMP}, 2)"
_COMPARED = (
    f"CONCAT(REGEXP_EXTRACT(TRIM(txt), {_CMP}, 1), CASE WHEN {_DIGITS} LIKE '%.%' "
    f"THEN REGEXP_REPLACE(REGEXP_REPLACE({_DIGITS}, '0+$', ''), '\\.+$', '') ELSE {_DIGITS} END)"
)
_MIXED = "(REGEXP_MATCHES(TRIM(txt), '[A-Za-z\\x{4e00}-\\x{9fa5}]') AND REGEXP_MATCHES(TRIM(txt), '\\d') AND NOT REGEXP_MATCHES(TRIM(txt), '^[<>]\\s*[\\d.]+$'))"


def _shapes(spark, sf):
    return spark.sql(CELL_SHAPES, lineitem=table(spark, sf, "lineitem"))


def _rule(spark, sf, rule):
    c = rule(rules.cell(F.lit(None), F.col("txt")))
    return _shapes(spark, sf).withColumn("c", c).select(
        "rec_id", "line", "part_id", "supp_id", F.round("c.num", 6).alias("num"), F.col("c.txt").alias("txt")
    )


def _rule_sql(num, txt):
    return duck(f"SELECT {_KEYS}, ROUND(CAST({num} AS DOUBLE), 6) AS num, {txt} AS txt FROM s", s=_SHAPES)


_YIN = f"CASE WHEN {_POS} THEN 1 WHEN {_NEG} THEN 0 END"
_SEX = "CASE LOWER(TRIM(txt)) WHEN '男' THEN 1 WHEN 'male' THEN 1 WHEN 'm' THEN 1 WHEN '女' THEN 0 WHEN 'female' THEN 0 WHEN 'f' THEN 0 END"
register("cell_yinyang", _rule_sql(_YIN, f"CASE WHEN NOT {_POS} AND NOT {_NEG} THEN txt END"))(
    lambda spark, sf: _rule(spark, sf, rules.yinyang)
)
register("cell_gender", _rule_sql(_SEX, f"CASE WHEN {_SEX} IS NULL THEN txt END"))(
    lambda spark, sf: _rule(spark, sf, rules.sex)
)
register("cell_scientific", _rule_sql(_SCI, f"CASE WHEN {_SCI} IS NULL THEN TRIM(txt) END"))(
    lambda spark, sf: _rule(spark, sf, rules.scientific)
)
register("cell_comparison", _rule_sql("NULL", f"CASE WHEN REGEXP_MATCHES(TRIM(txt), {_CMP}) THEN {_COMPARED} ELSE txt END"))(
    lambda spark, sf: _rule(spark, sf, rules.comparison)
)
register("cell_blank", _rule_sql("NULL", "CASE WHEN TRIM(txt) <> '' THEN txt END"))(
    lambda spark, sf: _rule(spark, sf, rules.blank)
)
register("cell_mixed", _rule_sql("NULL", f"CASE WHEN TRIM(txt) <> '' AND NOT {_MIXED} THEN txt END"))(
    lambda spark, sf: _rule(spark, sf, rules.mixed)
)

_CHAIN_NUM = (
    "CASE WHEN line = 7 AND " + _SEX + " IS NOT NULL THEN " + _SEX
    + f" WHEN {_POS} THEN 1 WHEN {_NEG} THEN 0 ELSE {_SCI} END"
)
_CHAIN_TXT = (
    f"CASE WHEN {_CHAIN_NUM} IS NOT NULL THEN NULL WHEN REGEXP_MATCHES(TRIM(txt), {_CMP}) THEN {_COMPARED} "
    f"WHEN TRIM(txt) = '' OR {_MIXED} THEN NULL ELSE TRIM(txt) END"
)


@register("cell_chain", _rule_sql(_CHAIN_NUM, _CHAIN_TXT))
def cell_chain(spark, sf):
    long = _shapes(spark, sf).select("*", F.lit(None).cast("double").alias("res_num"))
    named = long.withColumn("item", F.when(F.col("line") == 7, "性别").otherwise("other"))
    return cols.clean_cells(named, txt="txt").select(
        "rec_id", "line", "part_id", "supp_id", F.round("num", 6).alias("num"), "txt"
    )


# --- columns --------------------------------------------------------------------------------

_CLEAN_LONG = """
SELECT item, CASE WHEN res_txt IS NULL THEN NULL WHEN res_txt = '阳性(+)' THEN CAST(1 AS DOUBLE)
    WHEN res_txt = '阴性(-)' THEN CAST(0 AS DOUBLE)
    WHEN res_txt LIKE '%x10^2' THEN CAST(REPLACE(res_txt, 'x10^2', '') AS DOUBLE) * 100 END AS num,
  CASE WHEN res_txt LIKE '>%' THEN REPLACE(res_txt, '.00', '')
    WHEN res_txt IS NULL OR res_txt LIKE '阳性%' OR res_txt LIKE '阴性%' OR res_txt LIKE '%x10^2'
      OR res_txt LIKE 'Normal%' OR TRIM(res_txt) = '' THEN NULL ELSE res_txt END AS txt
FROM lab_long
"""
_PROFILE = """
SELECT item AS column_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL) AS n_valid,
  CASE WHEN COUNT(COALESCE(num, TRY_CAST(txt AS DOUBLE))) = COUNT(*) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL)
    AND COUNT(*) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL) > 0
    AND NOT COALESCE(BOOL_AND(COALESCE(num, TRY_CAST(txt AS DOUBLE)) IN (0, 1)), TRUE)
    THEN 'continuous' ELSE 'categorical' END AS kind,
  COUNT(DISTINCT COALESCE('t:' || txt, 'n:' || num)) = 1 AS is_constant
FROM {src} GROUP BY item"""
_WIDE_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS item, {c} AS num, CAST(NULL AS STRING) AS txt FROM lab_wide" for c in fx.WIDE_VALUES
)


@register(
    "column_kinds",
    duck(
        _PROFILE.format(src="lab_cells") + " UNION ALL " + _PROFILE.format(src="wide_cells"),
        "lab_long",
        "lab_wide",
        lab_cells=_CLEAN_LONG,
        wide_cells=_WIDE_LONG,
    ),
)
def column_kinds(spark, sf):
    cells = cols.clean_cells(fx.lab_long(spark, sf))
    long = cols.profile_columns(cells, column="item")
    flat = cols.profile_columns(wide.unpivot_cells(fx.lab_wide(spark, sf), fx.WIDE_VALUES))
    return long.unionByName(flat).select(
        F.col("column").alias("column_name"), "n", "n_valid", "kind", "is_constant"
    )


_CONTINUOUS = [c for c in fx.WIDE_VALUES if c != "b1"]
_FENCES = ", ".join(
    f"QUANTILE_CONT({c}, CAST(0.25 AS DOUBLE)) AS {c}_1, QUANTILE_CONT({c}, CAST(0.75 AS DOUBLE)) AS {c}_3" for c in _CONTINUOUS
)
_FENCED = ", ".join(
    f"CASE WHEN {c} >= {c}_1 - 3 * ({c}_3 - {c}_1) AND {c} <= {c}_3 + 3 * ({c}_3 - {c}_1) THEN {c} END AS {c}"
    for c in _CONTINUOUS
)


@register(
    "outlier_clear",
    duck(f"SELECT rec_id, {_FENCED} FROM lab_wide, (SELECT {_FENCES} FROM lab_wide) f", "lab_wide"),
)
def outlier_clear(spark, sf):
    df = fx.lab_wide(spark, sf)
    profile = cols.profile_columns(wide.unpivot_cells(df, fx.WIDE_VALUES))
    names = [r["column"] for r in profile.where(F.col("kind") == cols.CONTINUOUS).collect()]
    return cols.clear_outliers(df.select("rec_id", *sorted(names)), sorted(names))


@register(
    "drop_uninformative",
    duck(
        f"SELECT item AS column_name FROM ({_WIDE_LONG}) t GROUP BY item "
        "HAVING COUNT(num) / CAST(COUNT(*) AS DOUBLE) >= CAST(0.05 AS DOUBLE) AND COUNT(DISTINCT num) <> 1",
        "lab_wide",
    ),
)
def drop_uninformative(spark, sf):
    profile = cols.profile_columns(wide.unpivot_cells(fx.lab_wide(spark, sf), fx.WIDE_VALUES))
    profile = cut_lineage(profile)  # one row per column, read twice
    return profile.join(cols.uninformative(profile), "column", "left_anti").select(
        F.col("column").alias("column_name")
    )


@register(
    "drop_high_missing",
    duck(
        f"SELECT item AS column_name FROM ({_WIDE_LONG}) t GROUP BY item "
        "HAVING COALESCE(BOOL_AND(num IN (0, 1)), TRUE) OR (COUNT(*) - COUNT(num)) / CAST(COUNT(*) AS DOUBLE) <= CAST(0.557 AS DOUBLE)",
        "lab_wide",
    ),
)
def drop_high_missing(spark, sf):
    profile = cols.profile_columns(wide.unpivot_cells(fx.lab_wide(spark, sf), fx.WIDE_VALUES))
    profile = cut_lineage(profile)  # one row per column, read twice
    return profile.join(cols.high_missing(profile, 0.557), "column", "left_anti").select(
        F.col("column").alias("column_name")
    )


@register(
    "numeric_features",
    duck(
        "SELECT rec_id, " + ", ".join(fx.WIDE_VALUES) + " FROM lab_wide",
        "lab_wide",
    ),
)
def numeric_features(spark, sf):
    # a text column that holds numbers is cast; a text column with words is left out
    df = fx.lab_wide(spark, sf).withColumn("c1", F.col("c1").cast("string")).withColumn(
        "note", F.when(F.col("c1").isNull(), "none").otherwise(F.col("c1").cast("string"))
    )
    names = [*fx.WIDE_VALUES, "note"]
    profile = cols.profile_columns(wide.unpivot_cells(df, names))
    return cols.numeric_features(df, profile)[0]


@register(
    "io_roundtrip",
    duck(
        "SELECT 'stats' AS part, COUNT(*) AS n, CAST(SUM(n_items) AS DOUBLE) AS total FROM stats "
        "UNION ALL SELECT 'corpus', COUNT(*), CAST(SUM(LENGTH(text)) AS DOUBLE) FROM texts "
        "UNION ALL SELECT 'wide', COUNT(*), SUM(c1) FROM lab_wide "
        "UNION ALL SELECT 'labels', COUNT(*), CAST(SUM(rec_id % 3) AS DOUBLE) FROM texts",
        "lab_long",
        "lab_wide",
        stats=_STATS,
        texts=_NARRATIVE,
    ),
)
def io_roundtrip(spark, sf):
    base = scratch_path(spark, "io")
    # three files are made of the records: parsed once
    records = stored(rec.project_records(rec.parse_documents(as_json(spark, sf).select("value"))), "io-records")
    io.write_statistics(quality.valid_stats(records), f"{base}/stats")
    corpus = narr.narrative(records.withColumn("label", F.col("rec_id").cast("bigint") % 3), "label")
    io.write_corpus(corpus, f"{base}/corpus")
    io.write_wide(fx.lab_wide(spark, sf), f"{base}/wide")
    stats = spark.read.csv(f"{base}/stats", header=True, encoding="UTF-8")
    lines = io.read_corpus(spark, f"{base}/corpus")
    labels = io.read_labels(spark, f"{base}/corpus/labels")
    wide_back = spark.read.parquet(f"{base}/wide")

    def line(name, df, value):
        return df.agg(
            F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(value).cast("double").alias("total")
        )

    return (
        line("stats", stats, F.col("n_items").cast("bigint"))
        .unionByName(line("corpus", lines, F.length("text")))
        .unionByName(line("wide", wide_back, F.col("c1")))
        .unionByName(line("labels", labels, F.col("label")))
    )


@register(
    "corpus_lines",
    duck(
        "SELECT ROW_NUMBER() OVER (ORDER BY CAST(rec_id AS STRING)) - 1 AS line_no, CAST(rec_id AS STRING) AS rec_id, "
        "CAST(rec_id % 3 AS INT) AS label, text FROM texts",
        "lab_long",
        texts=_NARRATIVE,
    ),
)
def corpus_lines(spark, sf):
    # text, label and key of one record stand on the same line of their three files
    base = scratch_path(spark, "corpus")
    records = rec.project_records(rec.parse_documents(as_json(spark, sf).select("value")))
    io.write_corpus(narr.narrative(records.withColumn("label", F.col("rec_id").cast("bigint") % 3), "label"), base)
    keys = io.read_lines(spark, f"{base}/keys").select("line_no", F.col("text").alias("rec_id"))
    return io.read_corpus(spark, base).join(io.read_labels(spark, f"{base}/labels"), "line_no").join(keys, "line_no")
