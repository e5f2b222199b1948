"""Byte-level BPE encoding and decoding.

A text of up to ``CHUNK`` characters is one piece. A longer one is cut into chunks that overlap
by ``OVERLAP`` characters, and the chunks of all texts are spread over the tasks:

1. every chunk is pre-tokenised alone; near its two ends it reports where pre-tokens start;
2. two neighbours resynchronise at the first reported start they share inside the overlap. Only
   starts at a white space after another character count: no pre-token crosses such a place,
   whatever stands before or after, and a cut there doesn't change the pre-tokens around it;
3. the stretches between such places are encoded alone and put together in order. A chunk that
   finds no shared start (one unbroken run fills the overlap) is joined to the one before.

Equal long texts are encoded once. Decoding looks up the bytes of every id and concatenates.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlab.llm.common import fresh, named, small_batches, stored, whole_text

CHUNK = 32_768
OVERLAP = 512
#: a pre-token start this near the end of a chunk may depend on what follows
UNSURE = 8
MAX_VOCABULARY_BYTES = 64 << 20

_CODERS: dict = {}


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast of (file content, pattern). The file is read by the driver; its size is checked."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast((content, pattern))


def _kept(shared, what: str, build):
    """What a worker needs of the vocabulary, built once; decoding needs no encoder."""
    key = hash(shared.value), what
    if key not in _CODERS:
        _CODERS[key] = build(*shared.value)
    return _CODERS[key]


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def _encoding(content: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(content), special_tokens={})


def _words(content: bytes, pattern: str) -> pa.Array:
    ranks = _ranks(content)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return pa.array(words, pa.large_binary())


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _encoder(shared):
    @F.arrow_udf("array<int>")
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _kept(shared, "encoding", _encoding)
        for texts in batches:
            yield _lists([encoding.encode_ordinary(t) for t in texts.to_pylist()])

    return encode_pieces


def _decoder(shared):
    @F.arrow_udf("binary")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _kept(shared, "words", _words)
        for ids in batches:
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            out = []
            flat, ends = ids.values, ids.offsets.to_numpy()
            for i in range(len(ids)):  # one document at a time: a batch may exceed 2 GB of bytes
                got = words.take(flat.slice(ends[i], ends[i + 1] - ends[i]))
                at = np.frombuffer(got.buffers()[1], dtype=np.int64)[got.offset : got.offset + len(got) + 1]
                out.append(got.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(got) else b"")
            yield pa.array(out, pa.binary())

    return decode_ids


def _overlapping(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, at in enumerate(range(0, len(text), chunk)):
                    part = pa.array([text[at : at + chunk + overlap]], pa.string())
                    columns = [pa.array([key], pa.string()), pa.array([n], pa.int32()), part]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "part"])

    return cut


def _starts(shared, chunk: int, overlap: int):
    """Safe pre-token starts in the first ``overlap`` characters, and in those after ``chunk``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, space = regex.compile(shared.value[1]), regex.compile(r"\s").match
        for batch in batches:
            keys, ns, parts = (c.to_pylist() for c in batch.columns)
            heads, tails = [], []
            for n, part in zip(ns, parts):
                head, tail, sure = [], [], min(len(part), chunk + overlap) - UNSURE
                for found in pattern.finditer(part):
                    s = found.start()
                    if overlap <= s < chunk or not 0 < s <= sure:
                        continue
                    if space(part, s) and not space(part, s - 1):
                        (head if s < overlap else tail).append(n * chunk + s)
                heads.append(head)
                tails.append(tail)
            kind = pa.list_(pa.int64())
            columns = [pa.array(keys, pa.string()), pa.array(ns, pa.int32()), pa.array(heads, kind), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "head", "tail"])

    return find


def _encode_long(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """``key, ids`` of rows ``key, text`` with texts above ``chunk`` characters; keys may repeat."""
    chunks = stored(
        texts.mapInArrow(_overlapping(chunk, overlap), "key string, n int, part string")
        .groupBy("key", "n")
        .agg(F.first("part").alias("part")),
        "bpe-chunks",
    )
    starts = chunks.mapInArrow(
        _starts(shared, chunk, overlap), "key string, n int, head array<bigint>, tail array<bigint>"
    )
    # a window over one text: as many rows as it has chunks
    order = W.partitionBy("key").orderBy("n")
    shared_start = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    cuts = starts.withColumn("sync", F.when(F.col("n") == 0, F.lit(0)).otherwise(shared_start))
    cuts = cuts.withColumn("last", F.lead("n").over(order).isNull())
    cuts = cuts.select(
        "key",
        "n",
        F.coalesce("sync", F.col("n") * chunk).alias("from_"),
        F.when(~F.col("last"), F.coalesce(F.lead("sync").over(order), (F.col("n") + 1) * chunk)).alias("to_"),
        F.max(F.when(F.col("sync").isNotNull(), F.col("n"))).over(order).alias("piece"),
    )
    base = F.col("n") * chunk
    length = F.coalesce(F.col("to_") - F.col("from_"), F.lit(chunk + overlap)).cast("int")
    stretch = F.substr("part", (F.col("from_") - base + 1).cast("int"), length)
    pieces = (
        chunks.join(cuts, ["key", "n"])
        .select("key", "piece", "n", stretch.alias("stretch"))
        .groupBy("key", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("n", "stretch"))).alias("s"))
        .select("key", "piece", F.array_join("s.stretch", "").alias("text"))
    )
    coded = pieces.select("key", "piece", _encoder(shared)("text").alias("ids"))
    whole = coded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return whole.select("key", F.flatten("p.ids").alias("ids"))


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): the encoding of each whole text.

    ``ranks`` is the path of a rank file, ``pattern`` the pre-token pattern; special tokens are
    ordinary text. A null text counts as empty and has no ids. A column named like ``ids`` is
    replaced, others pass unchanged whatever their names; equal rows stay; an empty table gives
    no rows.
    """
    if not UNSURE < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk and longer than the unsure end")
    small_batches(docs.sparkSession)
    shared = vocabulary(docs.sparkSession, ranks, pattern)
    rest = docs.drop(ids) if ids != text else docs
    body = whole_text(text)
    order = named([c for c in docs.columns if c != ids] + [ids])
    short = rest.where(F.length(body) <= chunk).withColumn(ids, _encoder(shared)(body))
    long = rest.where(F.length(body) > chunk)
    key = F.sha2(body, 256)
    coded = _encode_long(long.select(key.alias("key"), body.alias("text")), shared, chunk, overlap)
    own, met, found = fresh([*docs.columns, ids], "own", "met", "found")
    coded = coded.select(F.col("key").alias(met), F.col("ids").alias(found))
    joined = long.withColumn(own, key).join(coded, F.col(own) == F.col(met))
    return short.select(*order).unionByName(joined.withColumn(ids, F.col(found)).select(*order))


def decode(coded: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` with a binary column ``out``: the bytes of all ids put together.

    Null ids count as none and give no bytes; an id outside the vocabulary is an error.
    """
    shared = vocabulary(coded.sparkSession, ranks, pattern)
    small_batches(coded.sparkSession)
    listed = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return coded.withColumn(out, _decoder(shared)(listed))
