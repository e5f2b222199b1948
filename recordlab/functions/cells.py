"""Rules that turn one dirty laboratory cell into a number, a canonical text or null.

A cell is a pair ``(num DOUBLE, txt STRING)``: the JSON value was a number or a string. Each
rule looks at ``txt`` only and returns a struct of the same pair, so all rules compose into one
Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlab.functions.text import strip, to_number

# They must equal the established vocabulary for results to match.
POSITIVE_WORDS = ("阳性", "pos", "+")
NEGATIVE_WORDS = ("阴性", "neg", "-")
MALE_WORDS = ("男", "male", "m")
FEMALE_WORDS = ("女", "female", "f")
SEX_COLUMNS = ("性别",)
FREE_TEXT_COLUMNS = ("病理诊断结论", "超声结论", "放射结论", "胃镜结论")
METADATA_COLUMNS = ("样本来源", "文件名", "完整路径", "疾病标签")
MISSING_MARKER = -1.0

LETTERS = r"[A-Za-z一-龥]"
E_FORM = r"^([\d.]+)\s*[Ee]十?(\d+)$"
TEN_FORM = r"^([\d.]+)\s*[x×]10\^(\d+)$"
COMPARISON = r"^([<>])\s*([\d.]+)"
SIGNED_E = r"^([+-]?(?:\d+\.?\d*|\.\d+))\s*[Ee]([+-]?\d+)$"


def cell(num: Column, txt: Column) -> Column:
    return F.struct(num.cast("double").alias("num"), txt.cast("string").alias("txt"))


def _number(value: Column | float) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return cell(value, F.lit(None))


def _has_any(t: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(t, F.lit(word))
    return found


def yinyang(c: Column) -> Column:
    """Text that names a positive finding → 1, else a negative one → 0, else unchanged."""
    low = F.lower(c["txt"])
    return (
        F.when(_has_any(low, POSITIVE_WORDS), _number(1.0))
        .when(_has_any(low, NEGATIVE_WORDS), _number(0.0))
        .otherwise(c)
    )


def sex(c: Column) -> Column:
    """Whole-cell match of a sex word → 1 (male) or 0 (female)."""
    low = F.lower(strip(c["txt"]))
    return (
        F.when(low.isin(*MALE_WORDS), _number(1.0))
        .when(low.isin(*FEMALE_WORDS), _number(0.0))
        .otherwise(c)
    )


def _power_form(t: Column, pattern: str) -> Column:
    base = F.regexp_extract(t, pattern, 1).try_cast("double")
    exponent = F.regexp_extract(t, pattern, 2).try_cast("int")
    return F.when(t.rlike(pattern), base * F.pow(F.lit(10.0), exponent.cast("double")))


def scientific(c: Column) -> Column:
    """``1.30E3``, ``1.30E十3``, ``3.32x10^2`` → number; other text comes back trimmed."""
    t = strip(c["txt"])
    value = F.coalesce(_power_form(t, E_FORM), _power_form(t, TEN_FORM))
    return F.when(c["txt"].isNull(), c).when(value.isNotNull(), _number(value)).otherwise(
        cell(F.lit(None), t)
    )


def signed_scientific(c: Column) -> Column:
    """Plain and signed numbers in e-notation → number (only used with ``strict_signs``)."""
    t = strip(c["txt"])
    value = F.coalesce(to_number(t), _power_form(t, SIGNED_E))
    return F.when(value.isNotNull(), _number(value)).otherwise(c)


def _compared(t: Column) -> Column:
    digits = F.regexp_extract(t, COMPARISON, 2)
    short = F.when(
        F.contains(digits, F.lit(".")), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    ).otherwise(digits)
    return F.concat(F.substring(t, 1, 1), short)


def comparison(c: Column) -> Column:
    """``>130.0`` → ``>130``: keep sign and number, drop the tail and the idle zeros."""
    t = strip(c["txt"])
    return F.when(t.rlike(COMPARISON), cell(F.lit(None), _compared(t))).otherwise(c)


def blank(c: Column) -> Column:
    """Blank text → null."""
    return F.when(strip(c["txt"]) == "", cell(F.lit(None), F.lit(None))).otherwise(c)


def _is_mixed(t: Column) -> Column:
    # plain numbers and comparisons hold no letter, so they need no exception
    return t.rlike(LETTERS) & t.rlike(r"\d")


def mixed(c: Column) -> Column:
    """Letters and digits together, in none of the known forms → null."""
    t = strip(c["txt"])
    return F.when((t == "") | _is_mixed(t), cell(F.lit(None), F.lit(None))).otherwise(c)


def clean_cell(
    num: Column,
    txt: Column,
    is_sex: Column | bool = False,
    skip_mixed: Column | bool = False,
    strict_signs: bool = False,
    marker: float = MISSING_MARKER,
    trimmed: Column | None = None,
) -> Column:
    """All rules in their fixed order, as one flat CASE.

    Every rule either decides a text or leaves it (trimmed) to the next one, so the chain needs
    the original text only and each pattern is evaluated once. ``strict_signs`` reads numbers
    before the sign words, so that ``1.30E+3`` and ``-1`` stay numbers; by default any '+' or
    '-' in a text decides the cell, as in the original rules. ``trimmed`` is the stripped text
    when the caller has it as a column.
    """
    is_sex = is_sex if isinstance(is_sex, Column) else F.lit(is_sex)
    skip_mixed = skip_mixed if isinstance(skip_mixed, Column) else F.lit(skip_mixed)
    none = cell(F.lit(None), F.lit(None))
    t = strip(txt) if trimmed is None else trimmed
    low = F.lower(t)

    def number(value: Column) -> Column:
        return _number(F.when((value != marker) & ~F.isnan(value), value))

    chain = F.when(num.isNotNull(), number(num)).when(t.isNull() | (t == ""), none)
    chain = chain.when(is_sex & low.isin(*MALE_WORDS), _number(1.0))
    chain = chain.when(is_sex & low.isin(*FEMALE_WORDS), _number(0.0))
    if strict_signs:
        plain = F.coalesce(to_number(t), _power_form(t, SIGNED_E))
        chain = chain.when(plain.isNotNull(), number(plain))
    chain = chain.when(_has_any(low, POSITIVE_WORDS), _number(1.0))
    chain = chain.when(_has_any(low, NEGATIVE_WORDS), _number(0.0))
    for pattern in (E_FORM, TEN_FORM):
        value = _power_form(t, pattern)
        chain = chain.when(value.isNotNull(), number(value))
    chain = chain.when(t.rlike(COMPARISON), cell(F.lit(None), _compared(t)))
    chain = chain.when(~skip_mixed & _is_mixed(t), none)
    if marker < 0:  # the sign rule has already taken every text with a minus
        return chain.otherwise(cell(F.lit(None), t))
    return chain.when(to_number(t) == marker, none).otherwise(cell(F.lit(None), t))
