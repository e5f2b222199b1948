import re

import pytest
from pyspark.sql import functions as F

from recordlab.operators.redact import hit_counts, hit_totals, redact, term_list, term_pattern

TERMS = ["ment", "mentation", "the", "that", "ere", "a.b", "阿托伐他汀", "他汀", "NAC", "x", "Straße", "kit", "stop all (now)"]
TEXTS = [
    "The argumentation, that there MENTATION mentat",
    "axb a.b A.B a,b",
    "服用阿托伐他汀和他汀片 nac NACL",
    "straße STRASSE kit ſtop",
    "stop all (now) stop all now",
    "  two  \t spaces the  end ",
    "",
    None,
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("g", t) for t in [*TERMS, "the"]], "category STRING, term STRING")


def plain(text, collapse=True):
    """One pass, longest term first, as a flat alternation."""
    if text is None:
        return "", []
    pattern = re.compile("|".join(map(re.escape, sorted(set(TERMS), key=len, reverse=True))), re.I)
    cleaned = pattern.sub("", text)
    return (re.sub(r"[ \t]{2,}", " ", cleaned).strip() if collapse else cleaned), pattern.findall(text)


@pytest.mark.parametrize("collapse", [True, False])
def test_equals_flat_alternation(spark, dictionary, collapse):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id INT, line STRING")
    got = {r["id"]: (r["text"], r["hits"]) for r in redact(df, "line", dictionary, collapse).collect()}
    assert got == {i: plain(t, collapse) for i, t in enumerate(TEXTS)}


def test_word_boundary(spark, dictionary):
    df = spark.createDataFrame([("there the NAC nacl x 阿托伐他汀x",)], "line STRING")
    row = redact(df, "line", dictionary, word_boundary=True).first()
    assert row["hits"] == ["the", "NAC", "x", "阿托伐他汀", "x"]


def test_counts(spark, dictionary):
    df = redact(spark.createDataFrame([("the The the x",), ("none",)], "line STRING"), "line", dictionary)
    assert [tuple(r) for r in hit_counts(df, 2).collect()] == [("the", 2), ("The", 1)]
    assert tuple(hit_totals(df).first()) == (2, 4, 1)


def test_terms_are_distinct_and_bounded(dictionary):
    assert len(term_list(dictionary)) == len(TERMS)
    with pytest.raises(ValueError):
        term_list(dictionary, limit=3)


def test_no_terms(spark):
    empty = spark.createDataFrame([], "category STRING, term STRING")
    row = redact(spark.createDataFrame([("abc",)], "line STRING"), "line", empty).first()
    assert (row["text"], row["hits"]) == ("abc", [])


def test_pattern_shares_prefixes():
    assert term_pattern(["丙的", "丙"]) == "(?:丙(?:的|))"
