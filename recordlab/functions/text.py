"""String expressions: whitespace clean-up, tokens, vector text and age parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as text tools see it: Unicode blanks plus the ASCII separators.
BLANK = r"[\s\x1c-\x1f\x85]"
# The same set as characters, for trimming without a pattern.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(t: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(t, F.lit(BLANKS))


def squeeze(t: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(t, rf"(?U){BLANK}+", " "))


def clean_text(t: Column, is_zero: Column | None = None) -> Column:
    """One-line text without stars; null, and a numeric zero, give ''."""
    cleaned = F.coalesce(squeeze(F.regexp_replace(t, "★", "")), F.lit(""))
    if is_zero is None:
        return cleaned
    return F.when(F.coalesce(is_zero, F.lit(False)), F.lit("")).otherwise(cleaned)


def tokens(t: Column) -> Column:
    """Whitespace tokens; blank text gives an empty array."""
    return F.filter(F.split(squeeze(t), " "), lambda x: x != "")


def to_number(t: Column) -> Column:
    """Decimal text to double, null when it is anything else (Java suffixes are rejected)."""
    return F.when(t.rlike(NUMBER), strip(t).try_cast("double"))


def parse_age(txt: Column, num: Column | None = None) -> Column:
    """Whole-number text or any number to INT; '58.7' and '58岁' give null."""
    from_text = F.when(txt.rlike(r"(?U)^\s*[+-]?\d+\s*$"), strip(txt).try_cast("int"))
    if num is None:
        return from_text
    return F.when(num.isNotNull(), num.try_cast("int")).otherwise(from_text)


def parse_vector(line: Column) -> Column:
    """Floats separated by blanks; an unparsable entry becomes null."""
    return F.transform(F.split(squeeze(line), " "), lambda x: x.try_cast("double"))


def format_vector(v: Column, decimals: int = 6) -> Column:
    """Space-separated fixed-point text."""
    return F.array_join(
        F.transform(v, lambda x: F.format_string(f"%.{decimals}f", x.cast("double"))), " "
    )
