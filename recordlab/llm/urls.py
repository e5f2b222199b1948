"""URL filters by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into ``suffix + prefix`` expressions: all label suffixes
of the host with all path prefixes of the lengths that rules have. Expressions meet rules in an
equi-join on the first digits of their SHA-256, the full digest confirms a hit, and the longest
rule decides. Pages get the answer of their (host, path) by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import LOWER, UPPER, fresh, named, stored

PREFIX_DIGITS = 8
#: more rules than this are joined by shuffle, never broadcast
BROADCAST_RULES = 50_000
SALTS = 16


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_rows(rules: DataFrame) -> DataFrame:
    """``rule, action, digest, short, size``: one row per rule; block beats allow if both are given."""
    rule = F.concat(F.translate(F.col("host"), UPPER, LOWER), F.col("path"))
    one = rules.select(rule.alias("rule"), "action", F.length("path").alias("path_size")).where("rule IS NOT NULL")
    one = one.groupBy("rule", "path_size").agg(F.max("action").alias("action"))
    digest = F.sha2("rule", 256)
    return one.select("rule", "path_size", "action", digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("short"))


def _expressions(places: DataFrame, sizes: list[int]) -> DataFrame:
    """``host, path, expr, path_size`` for every host suffix and rule-length prefix of the path."""
    labels = F.split("host", "\\.", -1)
    count = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), ".")
    )
    prefixes = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s <= F.length("path"))
    cut = places.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("sizes"))
    sized = cut.select("host", "path", "suffix", F.explode("sizes").alias("path_size"))
    return sized.withColumn("expr", F.concat("suffix", F.substr("path", F.lit(1), F.col("path_size"))))


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``rules`` has ``host, path, action``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule text wins, then the longer host, and ``block`` before ``allow`` for one rule given
    twice. Without a rule the verdict is ``default`` and ``rule`` is null. A null url, or one
    without ``://``, has an empty host and path. Columns of ``pages`` with one of the four names
    are replaced, others pass unchanged; equal rows stay; an empty table gives no rows, an empty
    rule table the default everywhere.
    """
    rows = stored(_rule_rows(rules), "url-rules")
    head = rows.agg(F.count("*").alias("n"), F.collect_set("path_size").alias("sizes")).first()
    if len(head.sizes) > 4096:
        raise ValueError("rules have more than 4096 different path lengths")
    names = ["host", "path", "rule", "verdict"]
    others = [c for c in pages.columns if c not in names]
    own = pages.select(*named(others), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = own.select("host", "path").distinct()
    exprs = _expressions(places, sorted(head.sizes) or [0])
    exprs = exprs.withColumn("full", F.sha2("expr", 256)).withColumn("start", F.substring("full", 1, PREFIX_DIGITS))
    if head.n <= broadcast_rules:
        hits = exprs.join(F.broadcast(rows.drop("path_size")), F.col("start") == F.col("short"))
    else:
        # a rule like a whole top-level domain meets a large part of all places
        salted = rows.drop("path_size").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = exprs.withColumn("own_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
        hits = spread.join(salted, (F.col("start") == F.col("short")) & (F.col("own_salt") == F.col("salt")))
    hits = hits.where("full = digest")
    rank = F.struct(F.length("rule"), F.length("suffix"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("best"))
    h, p, won = fresh([*others, *names], "h", "p", "won")
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best").alias(won))
    found = own.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return found.select(
        *named(others),
        "host",
        "path",
        F.col(f"{won}.rule").alias("rule"),
        F.coalesce(f"{won}.action", F.lit(default)).alias("verdict"),
    )
