import pytest
from pyspark.sql import functions as F

from recordlab.functions import cells
from recordlab.functions.text import clean_text, parse_age, to_number, tokens
from recordlab.operators.columns import clean_cells, profile_columns

# text, is sex column, strict signs, number, text
CHAIN = [
    ("阳性(+)", False, False, 1.0, None),
    ("阴性(-)", False, False, 0.0, None),
    ("POSITIVE", False, False, 1.0, None),
    ("neg", False, False, 0.0, None),
    ("neg +", False, False, 1.0, None),
    ("0.231 阴性(-)", False, False, 0.0, None),
    ("男", True, False, 1.0, None),
    (" Female ", True, False, 0.0, None),
    ("男", False, False, None, "男"),
    ("1.30E3", False, False, 1300.0, None),
    ("1.30E十3", False, False, 1300.0, None),
    ("3.32×10^2", False, False, 332.0, None),
    ("3.32 x10^2", False, False, 332.0, None),
    ("1.30E+3", False, False, 1.0, None),
    ("1.30E+3", False, True, 1300.0, None),
    ("-1", False, False, 0.0, None),
    ("-2.5", False, True, -2.5, None),
    ("-1", False, True, None, None),
    ("2024-05-01", False, False, 0.0, None),
    (">130.0", False, False, None, ">130"),
    ("<2.00", False, False, None, "<2"),
    ("<100", False, False, None, "<100"),
    ("> 0.50 mg", False, False, None, ">0.5"),
    ("   ", False, False, None, None),
    ("　 ", False, False, None, None),
    ("Normal 3.4", False, False, None, None),
    ("1.2.3", False, False, None, "1.2.3"),
    (" 12.50 ", False, False, None, "12.50"),
    ("cloudy", False, False, None, "cloudy"),
    (None, False, False, None, None),
]


@pytest.mark.parametrize("text, sex, strict, num, txt", CHAIN)
def test_chain(spark, text, sex, strict, num, txt):
    df = spark.createDataFrame([(text,)], "t STRING")
    c = cells.clean_cell(F.lit(None).cast("double"), F.col("t"), sex, False, strict)
    row = df.select(c.alias("c")).first()["c"]
    assert (row["num"], row["txt"]) == (num, txt)


def test_numbers_pass_and_the_marker_leaves(spark):
    df = spark.createDataFrame([(-1.0, None), (3.5, None), (float("nan"), None)], "n DOUBLE, t STRING")
    c = cells.clean_cell(F.col("n"), F.col("t"))
    assert [r[0] for r in df.select(c.alias("c")).select("c.num").collect()] == [None, 3.5, None]


def test_excluded_columns_are_untouched(spark):
    rows = [("文件名", None, "a-1.json"), ("x", None, "a-1.json")]
    df = spark.createDataFrame(rows, "item STRING, res_num DOUBLE, res_txt STRING")
    got = {r["item"]: (r["num"], r["txt"]) for r in clean_cells(df).collect()}
    assert got == {"文件名": (None, "a-1.json"), "x": (0.0, None)}


@pytest.mark.parametrize(
    "text, number, age",
    [("58", 58.0, 58), (" 58 ", 58.0, 58), ("58.7", 58.7, None), ("58岁", None, None), ("1d", None, None), ("1e2", 100.0, None), ("", None, None)],
)
def test_numbers(spark, text, number, age):
    row = spark.createDataFrame([(text,)], "t STRING").select(to_number(F.col("t")), parse_age(F.col("t"))).first()
    assert tuple(row) == (number, age)


def test_age_given_as_number(spark):
    row = spark.range(1).select(parse_age(F.lit(None).cast("string"), F.lit(58.7))).first()
    assert row[0] == 58


def test_text_cleaning(spark):
    df = spark.createDataFrame([("★a\t b\r\n　c ", 5.0), ("0", None), ("0", 0.0), (None, None)], "t STRING, n DOUBLE")
    assert [r[0] for r in df.select(clean_text(F.col("t"), F.col("n") == 0)).collect()] == ["a b c", "0", "", ""]
    assert df.select(tokens(F.col("t"))).first()[0] == ["★a", "b", "c"]


def test_profile(spark):
    rows = [
        ("cont", 1.5, None), ("cont", None, "2"), ("cont", None, None),
        ("bin", 1.0, None), ("bin", 0.0, None),
        ("text", None, ">5"), ("text", 3.0, None),
        ("same", 7.0, None), ("same", 7.0, None),
        ("both", 1.0, None), ("both", None, "1"),
        ("none", None, None),
    ]
    df = spark.createDataFrame(rows, "column STRING, num DOUBLE, txt STRING")
    got = {r["column"]: (r["kind"], r["n_valid"], r["is_constant"]) for r in profile_columns(df).collect()}
    assert got == {
        "cont": ("continuous", 2, False),
        "bin": ("categorical", 2, False),
        "text": ("categorical", 2, False),
        "same": ("continuous", 2, True),
        "both": ("categorical", 2, False),
        "none": ("categorical", 0, False),
    }
