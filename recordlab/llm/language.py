"""Language ID: averaged hashed subword embeddings with a linear softmax.

The model is fitted by stochastic gradient descent in numpy on a bounded sample of labelled
rows (``sample`` documents, equal shares per language, chosen by a hash of id and text; whole
texts, reduced to bucket counts by the tasks). A fifth of the sample is kept aside to fit the
temperature of the softmax and the rejection threshold. Embedding and output matrix are
multiplied once, so prediction averages one row of scores per subword of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlab.llm import subwords
from recordlab.llm.common import fresh, small_batches

SAMPLE = 4_000
MAX_LANGUAGES = 500
WIDTH = 16
EPOCHS = 8
UNKNOWN = "und"
#: rejected share of right predictions that the threshold aims at, and its upper end
REJECT_SHARE = 0.001
MAX_THRESHOLD = 0.4


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times output weights
    bias: np.ndarray
    temperature: float
    threshold: float


@F.arrow_udf(T.BinaryType())
def _counted(texts: pa.Array) -> pa.Array:
    """Bucket and count pairs of each text as int32 bytes."""
    pairs = (subwords.counts(t.encode()) for t in texts.to_pylist())
    return pa.array([np.stack(p).astype(np.int32).tobytes() for p in pairs], pa.binary())


def _sgd(docs, labels, n_languages, epochs, width, seed=7):
    """Embedding, output weights and bias after plain stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / width, 1 / width, (subwords.BUCKETS, width))
    out, bias = np.zeros((width, n_languages)), np.zeros(n_languages)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            where, weight = docs[i]
            rate = 0.5 * (1 - step / steps)
            step += 1
            mean = weight @ embed[where]
            score = mean @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            embed[where] -= (rate * 20) * np.outer(weight, back)
    return embed, out, bias


def _softmax(scores: np.ndarray, temperature: float) -> np.ndarray:
    scaled = scores / temperature
    p = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(
    docs: DataFrame,
    where: Column | None = None,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
) -> Model:
    """Fits on rows of ``docs`` with a text and a language (and ``where``, if given).

    Without any such row the model knows no language and predicts ``und`` everywhere.
    """
    small_batches(docs.sparkSession)
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((subwords.BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = max(1, sample // len(names))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, each / sizes[n]))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    picked = (
        rows.withColumn("draw", draw)
        .where(F.col("draw") < F.element_at(share, F.col("lang")) * F.lit(float(1 << 30)))
        .select("lang", "draw", _counted("text").alias("pairs"))
        .limit(2 * sample)
        .collect()
    )
    picked.sort(key=lambda r: (r["draw"], r["lang"], bytes(r["pairs"])))
    docs_, labels = [], []
    for r in picked:
        where_, weight = np.frombuffer(r["pairs"], dtype=np.int32).reshape(2, -1)
        docs_.append((where_, weight / max(1, weight.sum())))
        labels.append(names.index(r["lang"]))
    aside = [i for i in range(len(docs_)) if i % 5 == 4]
    used = [i for i in range(len(docs_)) if i % 5 != 4]
    embed, out, bias = _sgd([docs_[i] for i in used], [labels[i] for i in used], len(names), EPOCHS, WIDTH)
    table = embed @ out
    temperature, threshold = 1.0, 0.0
    if aside:
        scores = np.array([docs_[i][1] @ table[docs_[i][0]] + bias for i in aside])
        truth = np.array([labels[i] for i in aside])
        loss = {
            t: -np.log(np.maximum(_softmax(scores, t)[np.arange(len(truth)), truth], 1e-12)).mean()
            for t in np.geomspace(0.05, 20, 61)
        }
        temperature = float(min(loss, key=loss.get))
        p = _softmax(scores, temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            threshold = float(min(MAX_THRESHOLD, np.quantile(right, REJECT_SHARE) * (1 - 1e-9)))
    return Model(names, table, bias, temperature, threshold)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang, score, rejected``.

    ``lang`` is ``und`` with score 0 if the text is null or has no letter (or the model knows no
    language); such rows are rejected, as are those whose calibrated score is below the model's
    threshold. Only the text decides. A column named like ``out`` is replaced, others pass
    unchanged; equal rows get equal answers.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        scores = subwords.mean_scores([t.encode() for t in texts.to_pylist()], m.table) + m.bias
        p = _softmax(scores, m.temperature)
        best = p.argmax(axis=1)
        names = pa.array(m.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(p[np.arange(len(p)), best])], names=["lang", "score"])

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if not model.languages:
        return docs.withColumn(out, none)
    body = F.col(text).cast("string")
    (judged,) = fresh([*docs.columns, out], "judged")
    found = docs.withColumn(judged, judge(F.coalesce(body, F.lit(""))))
    known = F.struct(
        F.col(f"{judged}.lang").alias("lang"),
        F.col(f"{judged}.score").alias("score"),
        (F.col(f"{judged}.score") < model.threshold).alias("rejected"),
    )
    letter = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    return found.withColumn(out, F.when(letter, known).otherwise(none)).drop(judged)


def held_out(id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) == 2
