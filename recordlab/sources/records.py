"""Tolerant reading of nested JSON records, one per file or one per line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the record format.
RECORD_KEY = "患者编号"
LAB_KEY = "检验"
ITEM_KEY, RESULT_KEY, DATE_KEY = "项目名称", "结果", "检验日期"
AGE_KEYS = ("年龄", " 年龄 ")
SEX_KEYS = ("性别", " 性别 ", "性別")
# section → (key of its conclusion, label in the text, column in the wide table)
SECTIONS = {
    "病理": ("病理诊断结论", "病理提示", "病理诊断结论"),
    "超声": ("检查结论", "超声提示", "超声结论"),
    "胃镜": ("检查结论", "胃镜提示", "胃镜结论"),
    "放射": ("检查结论", "放射提示", "放射结论"),
}

_RAW_ITEMS = f"ARRAY<STRUCT<`{LAB_KEY}`:ARRAY<STRUCT<`{RESULT_KEY}`:STRING>>>>"
#: one cast reads every field of an item; an item that is no object becomes null
_ITEMS = (
    "ARRAY<STRUCT<"
    + ", ".join(f"`{k}`: STRING" for k in (ITEM_KEY, DATE_KEY, *SEX_KEYS))
    + "".join(f", `{k}`: VARIANT" for k in (RESULT_KEY, *AGE_KEYS))
    + ">>"
)


def _get(v: Column, *keys: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), kind)


def _first_text(texts: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], texts[0])


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _once(v: Column) -> Column:
    """The same value, one row per row. The optimiser copies a projection into every filter and
    every expression that reads it, and would parse the JSON anew in each; it stops here."""
    return F.explode_outer(F.array(v))


def parse_documents(df: DataFrame, text: str = "value") -> DataFrame:
    """Add ``doc VARIANT``: the object itself, or element 0 of a list that starts with one.

    Anything else, broken text included, leaves ``doc`` null.
    """
    parsed = df.withColumn("__v", F.try_parse_json(text))
    first = F.try_variant_get("__v", "$[0]", "variant")
    return parsed.withColumn(
        "doc",
        F.when(_is(F.col("__v"), "OBJECT"), F.col("__v")).when(
            _is(F.col("__v"), "ARRAY") & _is(first, "OBJECT"), first
        ),
    ).drop("__v")


def project_records(df: DataFrame, text: str = "value", literals: bool = True) -> DataFrame:
    """Typed columns out of ``doc``: ``rec_id, …, sections, labs``.

    A result is a number (``res_num``) or a string (``res_txt``) as written in the JSON.
    ``res_raw`` is the result as text; with ``literals`` it keeps the JSON spelling (a variant
    prints 5.0 as 5), which costs a second parse of the records that have such a number. Items
    that are no objects have only null fields: they count as items but carry nothing.
    """
    def shown(v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    # in steps, so that the items, each type test and each text are made once
    def read(v: Column) -> Column:
        age = F.coalesce(*[v[k] for k in AGE_KEYS])
        return F.struct(
            v.alias("v"),
            F.schema_of_variant(v[RESULT_KEY]).alias("kind"),
            shown(v[RESULT_KEY]).alias("shown"),
            F.when(~_is(age, "STRING"), F.try_variant_get(age, "$", "double")).alias("age_num"),
            F.array(*[shown(v[k]) for k in AGE_KEYS]).alias("ages"),
        )

    def respelled(x: Column) -> Column:
        plain = F.coalesce(x["kind"], F.lit("VOID")).isin("STRING", "BIGINT", "BOOLEAN", "VOID")
        return ~plain | F.coalesce(x["shown"] == "0", F.lit(False))

    def item(x: Column, raw: Column | None) -> Column:
        v, is_text = x["v"], F.coalesce(x["kind"].startswith("STRING"), F.lit(False))
        return F.struct(
            v[ITEM_KEY].alias("item"),
            F.when(~is_text, F.try_variant_get(v[RESULT_KEY], "$", "double")).alias("res_num"),
            F.when(is_text, x["shown"]).alias("res_txt"),
            (x["shown"] if raw is None else F.coalesce(raw, x["shown"])).alias("res_raw"),
            x["age_num"].alias("age_num"),
            _first_text([x["ages"][i] for i in range(len(AGE_KEYS))]).alias("age"),
            _first_text([v[k] for k in SEX_KEYS]).alias("sex"),
            F.try_to_date(v[DATE_KEY], "yyyy-MM-dd").alias("test_date"),
        )

    sections = F.struct(*[_get(F.col("doc"), s, k).alias(s) for s, (k, _, _) in SECTIONS.items()])
    rec_id = _get(F.col("doc"), RECORD_KEY)
    if "file_name" in df.columns:
        rec_id = F.coalesce(rec_id, F.regexp_replace("file_name", r"\.[^.]*$", ""))
    keep = [c for c in df.columns if c not in (text, "doc")]
    items = F.try_variant_get("doc", f"$['{LAB_KEY}']", _ITEMS)
    staged = df.select(
        rec_id.alias("rec_id"), *keep, sections.alias("sections"), _once(F.transform(items, read)).alias("__read"), *([text] if literals else [])
    )
    if not literals:
        return staged.select("rec_id", *keep, "sections", _once(F.transform("__read", lambda x: item(x, None))).alias("labs"))
    # whole numbers but 0 (which may be -0) and texts read the same in both parses
    raw = F.try_element_at(F.from_json(text, _RAW_ITEMS), F.lit(1))[LAB_KEY][RESULT_KEY]
    raw = F.coalesce(F.when(F.exists("__read", respelled), raw), F.array().cast("array<string>"))
    paired = F.slice(F.arrays_zip(F.col("__read").alias("x"), raw.alias("raw")), F.lit(1), F.size("__read"))
    return staged.select(
        "rec_id", *keep, "sections", _once(F.transform(paired, lambda pair: item(pair["x"], pair["raw"]))).alias("labs")
    )


def read_documents(
    spark: SparkSession,
    dirs: Mapping[str, str],
    labels: Mapping[str, int],
    per_line: bool = False,
) -> DataFrame:
    """All records of all classes: ``source, label, file_name, path, value, doc``.

    Each class directory is read recursively. A class without a directory or without a label is
    an error. ``per_line`` reads JSON lines, the layout for large inputs.
    """
    unmatched = set(dirs) ^ set(labels)
    if unmatched:
        raise ValueError(f"classes without directory or label: {sorted(unmatched)}")
    parts = [
        spark.read.text(path, wholetext=not per_line, recursiveFileLookup=True).select(
            F.lit(source).alias("source"),
            F.lit(int(labels[source])).alias("label"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("path"),
            "value",
        )
        for source, path in dirs.items()
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return parse_documents(df)


def read_records(
    spark: SparkSession,
    dirs: Mapping[str, str],
    labels: Mapping[str, int],
    per_line: bool = False,
) -> DataFrame:
    """Readable records only, in typed form."""
    return project_records(
        read_documents(spark, dirs, labels, per_line).where(F.col("doc").isNotNull())
    )


def rejects(documents: DataFrame) -> DataFrame:
    """Inputs that hold no record."""
    return documents.where(F.col("doc").isNull()).drop("doc")


def missing_classes(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Classes that were asked for and have no rows."""
    return wanted.join(found.select(key).distinct(), key, "left_anti")


def explode_labs(records: DataFrame, *keep: str) -> DataFrame:
    """Long table, one row per lab item; ``pos`` keeps the order inside the record.

    An inner explode makes the optimiser test ``size(labs) > 0`` before it, which repeats the
    whole JSON projection once per mention; the outer form does not.
    """
    items = records.select("rec_id", *keep, F.posexplode_outer("labs").alias("pos", "lab"))
    return items.where(F.col("pos").isNotNull()).select("rec_id", *keep, "pos", "lab.*")
