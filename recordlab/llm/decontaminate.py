"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are runs of letters and digits of the lower-cased text. A mask such as ``11011001`` is
laid on every token position; tokens under a 0 are ignored, those under a 1 are hashed. Equal
hashes of a document and a benchmark item give a hit with a diagonal (document position minus
item position). Each distinct hit is verified along its diagonal: some window of ``window``
item tokens (the whole item if shorter) must agree in at least ``share`` of its positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlab.llm.common import fresh, stored

#: six tokens count in each; one of them is free of substitutions wherever an item of ``LEAST``
#: tokens or more passes the check with the default window and share (enumerated in the tests)
MASKS = ("1101111", "111010011", "11100100011")
LEAST = 12
#: masks of shorter items by their tokens, with the same promise; below five tokens the whole item
SHORT = {n: ("1" * n,) for n in range(1, 5)} | {5: ("1101", "111")}
SHORT |= {n: ("11011", "1111") for n in (6, 7)} | {n: ("111011", "11111") for n in (8, 9)} | {n: ("111011", "11010011", "11111") for n in (10, 11)}
WINDOW = 20
SHARE = 0.8
#: item positions that may be broadcast (8 bytes of hash and a few of payload each)
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null and for none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _seeds(words: str, masks: Sequence[str]) -> Column:
    """Array of (pos, hash) for every mask at every position of the token array."""

    def laid(mask: str) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(words) - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def seed(i: Column) -> Column:
            cared = [F.get(F.col(words), i + o) for o in ones]
            return F.struct(i.alias("pos"), F.xxhash64(F.lit(int(mask, 2)), *cared).alias("hash"))

        return F.transform(at, seed)

    return F.concat(*[laid(mask) for mask in masks])


def seed_hits(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """Distinct ``key, item, diagonal`` of ``docs(key, words)`` and ``items(item, item_words)``."""
    short = F.size("item_words")
    sizes = sorted(r[0] for r in items.where(short.between(1, LEAST - 1)).select(short).distinct().collect())
    own = _seeds("item_words", masks)
    for n in sizes:
        own = F.when(short == n, _seeds("item_words", SHORT[n])).otherwise(own)
    masks = list(dict.fromkeys([*masks, *(m for n in sizes for m in SHORT[n])]))  # documents meet all that are in use
    seeds = items.select("item", F.explode(own).alias("s"))
    seeds = stored(seeds.select(F.col("s.hash").alias("seed"), "item", F.col("s.pos").alias("item_pos")).distinct(), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    found = docs.select("key", F.explode(_seeds("words", masks)).alias("s")).select("key", "s.hash", "s.pos")
    hits = found.join(F.broadcast(seeds) if small else seeds, F.col("hash") == F.col("seed"))
    return hits.select("key", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()


def _agreement(window: int, share: float) -> dict[str, Column]:
    """Best window of the item along the diagonal, from ``words, item_words, diagonal``."""
    size = F.size("item_words")
    same = F.transform(
        "item_words",
        lambda w, i: F.when(
            (F.col("diagonal") + i >= 0) & (F.get("words", F.col("diagonal") + i) == w), F.lit(1)
        ).otherwise(F.lit(0)),
    )
    width = F.least(size, F.lit(window))
    sums = F.transform(
        F.sequence(F.lit(1), size - width + 1),
        lambda i: F.aggregate(F.slice("same", i, width), F.lit(0), lambda a, x: a + x),
    )
    return {"same": same, "width": width, "best": F.array_max(sums)}


def _key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id), F.col(text).cast("string"))


def _overlaps(docs, items, id, text, item, item_text, masks, window, share) -> DataFrame:
    """``key, id, item, width, matched`` of verified overlaps; key hashes id and text."""
    own = docs.select(_key(id, text).alias("key"), F.col(id).alias("id"), F.col(text).cast("string").alias("body"))
    own = own.withColumn("words", tokens(F.col("body")))
    bench = items.select(F.col(item).alias("item"), tokens(F.col(item_text).cast("string")).alias("item_words")).distinct()
    hits = stored(seed_hits(own.select("key", "words"), bench, masks), "seed-hits")
    # few documents have hits; their texts are read again, and only theirs go on
    keys = hits.select(F.col("key").alias("hit_key")).distinct()
    few = keys.count() <= BROADCAST_SEEDS
    raw = own.drop("words")
    texts = raw.join(F.broadcast(keys) if few else keys, F.col("key") == F.col("hit_key"), "left_semi")
    texts = texts.dropDuplicates(["key"]).withColumn("words", tokens(F.col("body"))).select(F.col("key").alias("k"), "id", "words")
    pairs = hits.join(texts, F.col("key") == F.col("k")).drop("k")
    pairs = pairs.join(bench.withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i"))).drop("i")
    columns = _agreement(window, share)
    for name, column in columns.items():
        pairs = pairs.withColumn(name, column)
    good = pairs.where(F.col("best") >= F.ceil(F.col("width") * F.lit(share)))
    return good.groupBy("key", "id", "item", "width").agg(F.max("best").alias("matched"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    masks: Sequence[str] = MASKS,
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """``id, item, matched, width``: every document and item with a verified overlap, once.

    ``matched`` of ``width`` tokens agree in the best window. With the default masks, window and
    share every overlap has a seed, whatever tokens are substituted. Null and empty texts have no
    tokens and no result. Equal rows give one result; a null id is a document of its own text. Other columns
    aren't read. An empty table on either side gives no rows.
    """
    found = _overlaps(docs, items, id, text, item, item_text, masks, window, share)
    found = found.groupBy("id", "item", "width").agg(F.max("matched").alias("matched"))
    return found.select(F.col("id").alias(id), F.col("item").alias(item), "matched", "width")


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    masks: Sequence[str] = MASKS,
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """``docs`` without the documents that overlap any benchmark item, all columns unchanged.

    Rows that share id and text go together; null and empty texts, having no tokens, stay; an
    empty table gives no rows, an empty benchmark leaves all of them.
    """
    bad = _overlaps(docs, items, id, text, item, item_text, masks, window, share)
    met, owner = fresh(docs.columns, "met", "owner")
    bad = stored(bad.select(F.col("key").alias(met), F.col("id").alias(owner)).distinct(), "leaks")
    few = bad.count() <= BROADCAST_SEEDS
    same = (_key(id, text) == F.col(met)) & F.col(id).eqNullSafe(F.col(owner))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
