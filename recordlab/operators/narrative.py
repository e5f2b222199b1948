"""One line of text per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.functions.text import clean_text
from recordlab.operators.quality import age_sex
from recordlab.sources.records import SECTIONS

# They are part of the text format.
SEPARATOR = "；"
AGE_LABEL, SEX_LABEL, LAB_LABEL = "年龄：", "性别：", "实验室检查："
EMPTY_RECORD = "无有效检查记录"
NONE_TEXT = "None"


def narrative(records: DataFrame, *keep: str) -> DataFrame:
    """``rec_id, text`` (+ ``keep``): section conclusions, age, sex, then every lab item."""
    pieces = [
        F.when(
            F.col(f"sections.{name}") != "",
            F.concat(F.lit(f"{label}："), clean_text(F.col(f"sections.{name}"))),
        )
        for name, (_, label, _) in SECTIONS.items()
    ]
    has_labs = F.size("labs") > 0
    person = age_sex(F.col("labs"))
    for label, field in ((AGE_LABEL, "age"), (SEX_LABEL, "sex")):
        pieces.append(
            F.when(has_labs, F.concat(F.lit(label), F.coalesce(person[field], F.lit(NONE_TEXT))))
        )
    items = F.transform(
        "labs",
        lambda x: F.concat(
            clean_text(x["item"]), F.lit(" "), clean_text(x["res_raw"], x["res_num"] == 0)
        ),
    )
    pieces.append(F.when(has_labs, F.concat(F.lit(LAB_LABEL), F.array_join(items, SEPARATOR))))
    text = F.coalesce(F.nullif(F.concat_ws(SEPARATOR, *pieces), F.lit("")), F.lit(EMPTY_RECORD))
    return records.select("rec_id", *keep, text.alias("text"))
