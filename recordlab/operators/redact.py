"""Deletion of dictionary terms from text, with the list of what was deleted."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.functions.text import strip

MAX_TERMS = 20_000
MAX_ALTERNATIVES = 4
_WORD = "[A-Za-z0-9_]"


def term_list(dictionary: DataFrame, term: str = "term", limit: int = MAX_TERMS) -> list[str]:
    """Distinct terms. They become one pattern on the driver, so their number is checked."""
    found = dictionary.select(term).where(F.col(term) != "").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"the dictionary has more than {limit} terms")
    return sorted(r[0] for r in found)


def _fold(char: str) -> str:
    """Case folding of single characters as pattern engines do it."""
    upper = char.upper()
    lower = (upper if len(upper) == 1 else char).lower()
    return lower if len(lower) == 1 else char


@lru_cache(maxsize=1)
def _spellings() -> dict[str, str]:
    """Folded character → all its spellings, for characters that have more than one."""
    groups: dict[str, list[str]] = {}
    for code in range(0x10000):
        if not 0xD800 <= code < 0xE000:
            groups.setdefault(_fold(chr(code)), []).append(chr(code))
    return {k: "".join(v) for k, v in groups.items() if len(v) > 1}


def _case_set(char: str) -> str:
    return _spellings().get(char, char)


def _one_of(chars: str) -> str:
    """Pattern for a character in every spelling. A plain set is faster than the case flag."""
    return re.escape(chars) if len(chars) == 1 else f"[{re.escape(chars)}]"


def _choice(options: list[tuple[str, str]]) -> str:
    """Alternatives that start with different characters, as a search tree of range checks.

    An engine tries alternatives one by one; with many of them each half first checks whether
    the next character is in its range at all.
    """
    if len(options) <= MAX_ALTERNATIVES:
        return "|".join(_one_of(chars) + below for chars, below in options)
    half = len(options) // 2
    sides = []
    for part in (options[:half], options[half:]):
        every = "".join(chars for chars, _ in part)
        sides.append(f"(?=[{re.escape(min(every))}-{re.escape(max(every))}])(?:{_choice(part)})")
    return "|".join(sides)


def _branch(node: dict, guard_end: bool) -> str:
    """Pattern of everything below a prefix; longer continuations are tried first."""
    options = sorted(((_case_set(c), _branch(b, guard_end)) for c, b in node.items() if c), key=lambda o: max(o[0]))
    parts = [_choice(options)] if options else []
    if "" in node:
        latin_end = guard_end and re.match(_WORD, node[""])
        parts.append(f"(?!{_WORD})" if latin_end else "")
    single = len(parts) == 1 and len(options) <= 1
    return parts[0] if single else "(?:" + "|".join(parts) + ")"


def term_pattern(terms: Iterable[str], word_boundary: bool = False) -> str:
    """One pattern, in any case, that takes the longest term at each place.

    Terms share their prefixes, so the work per position depends on the length of the match and
    not on the number of terms. ``word_boundary`` keeps Latin terms from matching inside words.
    """
    tries: dict[bool, dict] = {False: {}, True: {}}
    for term in {"".join(map(_fold, t)) for t in terms if t}:
        latin_start = word_boundary and re.match(_WORD, term[0]) is not None
        node = tries[latin_start]
        for char in term:
            node = node.setdefault(char, {})
        node[""] = term[-1]
    parts = []
    if tries[True]:
        parts.append(f"(?<!{_WORD})" + _branch(tries[True], True))
    if tries[False]:
        parts.append(_branch(tries[False], word_boundary))
    return "(?:" + "|".join(parts) + ")" if parts else "(?!)"


def redact(
    df: DataFrame,
    column: str,
    dictionary: DataFrame,
    collapse: bool = True,
    word_boundary: bool = False,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Add ``text`` (without the terms) and ``hits`` (surface forms in order)."""
    pattern = F.lit(term_pattern(term_list(dictionary, limit=max_terms), word_boundary))
    source = F.coalesce(F.col(column), F.lit(""))
    hits = F.regexp_extract_all(source, pattern, F.lit(0))
    cleaned = F.regexp_replace(source, pattern, F.lit(""))
    if collapse:
        cleaned = strip(F.regexp_replace(cleaned, "[ \t]{2,}", " "))
    return df.withColumns({"hits": hits, "text": cleaned})


def hit_counts(redacted: DataFrame, top: int | None = 20) -> DataFrame:
    """How often each surface form was deleted, most frequent first."""
    counts = (
        redacted.select(F.explode("hits").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "term").limit(top) if top else counts


def hit_totals(redacted: DataFrame) -> DataFrame:
    return redacted.agg(
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("n_hits"),
        F.count_if(F.size("hits") > 0).alias("n_lines_hit"),
    )
