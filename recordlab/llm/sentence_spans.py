"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence on, and back from every sentence, the shortest
run of ``run`` or more sentences with ``min_words`` or more words is a span, as is a single
sentence of ``alone`` or more words; a span is hashed (128 bits, its sentences without outer white
space). So every repeated passage that holds one span is covered by spans inside it, whatever the
lengths of its sentences. Spans meet by hash, in order of place; every place but the first of a
hash marks its sentences, and marked sentences are removed from the text.

Words are counted by spaces; in scripts that write none, two letters count as a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.llm.common import stored, whole_text

RUN = 2
MIN_WORDS = 12
ALONE = 25
#: a sentence keeps its end marks and the white space after them; a line end also ends one
SENTENCE = r"[^.!?\n。！？؟।]*[.!?\n。！？؟।]+[ \t\r\n]*|[^.!?\n。！？؟।]+"
#: letters of scripts without spaces between words
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"
#: hashes that may be dealt over salts, and places of a hash below which none is
HOT, LEAST_HOT = 10_000, 256
SALTS = 32

_SENTENCES, _BLANK, _LETTERS = re.compile(SENTENCE), re.compile(r"[ \t\r\n]+"), regex.compile(UNSPACED)


def sentence_sizes(bare: list[str]) -> np.ndarray:
    """Words of bare sentences; an empty one counts as a word."""
    size = [s.count(" ") + 1 + (0 if s.isascii() else len(_LETTERS.findall(s)) // 2) for s in bare]
    return np.array(size, dtype=np.int64)


def bare_sentences(text: str) -> list[str]:
    """Sentences without outer white space, runs of it inside as one space."""
    out = []
    for s in _SENTENCES.findall(text):
        s = s.strip(" \t\r\n")
        if "  " in s or "\t" in s or "\r" in s:
            s = _BLANK.sub(" ", s)
        out.append(s)
    return out


def shortest_runs(size: np.ndarray, run: int, min_words: int, alone: int) -> list[tuple[int, int]]:
    """First sentence and length of every span, each once."""
    n, ends = len(size), np.concatenate([[0], np.cumsum(size)])
    at = np.arange(n)
    # a run of sentences a..b-1 has ends[b] - ends[a] words
    ahead = np.maximum(np.searchsorted(ends, ends[:-1] + min_words), at + run)
    back = np.minimum(np.searchsorted(ends, ends[1:] - min_words, side="right") - 1, at + 1 - run)
    spans = {(int(a), int(b)) for a, b in zip(at, ahead) if b <= n}
    spans |= {(int(a), int(b) + 1) for a, b in zip(back, at) if a >= 0}
    spans |= {(int(a), int(a) + 1) for a in np.flatnonzero(size >= alone)}
    return [(a, b - a) for a, b in sorted(spans)]


def _spans(texts: DataFrame, run: int, min_words: int, alone: int) -> DataFrame:
    """``id, pos, size, h, g`` of every span: 128 bits of hash in two numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, sizes, sums = [], [], [], []
            for id, text in zip(*(c.to_pylist() for c in batch.columns)):
                bare = bare_sentences(text)
                if not bare:
                    continue
                raw = [s.encode() for s in bare]
                for pos, size in shortest_runs(sentence_sizes(bare), run, min_words, alone):
                    ids.append(id)
                    places.append(pos)
                    sizes.append(size)
                    sums.append(xxhash.xxh3_128_digest(b"\n".join(raw[pos : pos + size])))
            if ids:
                halves = np.frombuffer(b"".join(sums), dtype=np.int64).reshape(-1, 2)
                columns = [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())]
                columns += [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "pos", "size", "h", "g"])

    return texts.mapInArrow(cut, "id bigint, pos int, size int, h bigint, g bigint")


def _later_places(spans: DataFrame) -> DataFrame:
    """``id, pos, size`` of every span that is not the first of its hash.

    Spans move once, by hash, and are numbered in order of place. Hashes with more than a
    ten-thousandth of all frequent spans (so at most ``HOT``) are dealt over salts, and the first
    places of their salts are numbered once more.
    """
    counts = spans.groupBy("h").agg(F.count("*").alias("n"))
    counts = stored(counts.where(F.col("n") > LEAST_HOT), "span-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total // HOT).select(F.col("h").alias("k"), F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = spans.join(F.broadcast(hot), F.col("h") == F.col("k"), "left").withColumn("salt", salt).drop("k")
    place = [F.col("id").asc_nulls_last(), F.col("pos").asc()]
    nth = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*place))
    numbered = dealt.withColumn("nth", nth("h", "g", "salt"))
    firsts = numbered.where("hot AND nth = 1").drop("nth").withColumn("nth", nth("h", "g"))
    columns = ["id", "pos", "size"]
    return numbered.where("nth > 1").select(*columns).unionByName(firsts.where("nth > 1").select(*columns))


def remove_repeated_spans(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    run: int = RUN,
    min_words: int = MIN_WORDS,
    alone: int = ALONE,
) -> DataFrame:
    """One row per row of ``docs``: ``id, text, kept_text, n_sentences, n_removed``.

    The first place of a span is the one with the smallest id, then position; a null id comes
    after all others. Rows that share an id count as one document: they are first together, and
    a sentence marked at a position in one is marked in all of them. Null and empty texts have no
    sentences and an empty ``kept_text``. Only the two columns are read. An empty table gives no
    rows.
    """
    texts = docs.select(F.col(id).cast("bigint").alias("id"), whole_text(text).alias("text"))
    again = _later_places(_spans(texts, run, min_words, alone))
    # at most as many different ranges as the document has sentences, three times
    marks = again.groupBy("id").agg(F.collect_set(F.struct("pos", "size")).alias("spans"))
    every = F.transform("spans", lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1))
    marks = marks.select("id", F.array_distinct(F.flatten(every)).alias("gone"))
    marks = marks.select(F.col("id").alias("__id"), "gone")
    cut = texts.join(marks, F.col("id").eqNullSafe(F.col("__id")), "left")
    cut = cut.withColumn("sentences", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))
    size = F.size("sentences")
    stays = F.array_except(F.sequence(F.lit(0), size - 1), "gone")
    cut = cut.withColumn("stays", F.when(F.col("gone").isNotNull() & (size > 0), stays))
    kept = F.transform("stays", lambda i: F.get("sentences", i))
    left = F.size("stays")
    return cut.select(
        F.col("id").alias(id),
        F.col("text").alias(text),
        F.when(F.col("stays").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("kept_text"),
        size.alias("n_sentences"),
        F.when(F.col("stays").isNull(), F.lit(0)).otherwise(size - left).alias("n_removed"),
    )
