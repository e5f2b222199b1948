"""Quality classifier with a weak-label model.

Overlapping heuristics vote good, bad or nothing on every document. All that expectation
maximisation needs of the corpus is how many documents show each pattern of votes (at most
3^labellers rows), so it runs on exact counts of all documents. It estimates each labeller's
accuracy and the share of good documents. The posterior of its pattern is the soft label of a
document, and a linear scorer on hashed subwords learns from a bounded sample of them
(``sample`` documents, chosen by a hash of id and text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlab.llm import subwords
from recordlab.llm.common import small_batches, stored, whole_text

SAMPLE = 4_000
GOOD, BAD, ABSTAIN = 1, 0, -1
KEEP = 0.5
#: the votes count three times the scorer, which can't see repetition
VOTES_WEIGHT = 0.75
FEW_WORDS = 12
LEAST = (0.1, 0.95)

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256)) + b"0123456789"
_SPACES = b" \t\r\n\v\f"
_ODD = b"#$%&*+/<=>@[\\]^_`{|}~"

LABELLERS = ["letters and digits", "odd marks", "capitals", "exclamations", "echoes", "pairs", "lines", "length"]


def _band(value: float, good_to: float, bad_from: float) -> int:
    """Good up to one bound, bad from the other, no vote between."""
    return GOOD if value <= good_to else BAD if value >= bad_from else ABSTAIN


def votes(text: bytes) -> list[int]:
    """Votes of all labellers on one whole text; none on one of a few words."""
    words = text.split()
    if not words:
        return [BAD] * len(LABELLERS)
    n, solid = len(words), len(text.translate(None, _SPACES))
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    odd = len(text) - len(text.translate(None, _ODD))
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    if n < FEW_WORDS:
        return [ABSTAIN] * len(LABELLERS)  # too little to tell
    return [
        _band(1 - letters / solid, 0.06, 0.1),
        _band(odd / n, 0.02, 0.15),
        _band(upper / max(1, letters), 0.15, 0.3),
        _band(text.count(b"!") / n, 0.02, 0.15),
        _band(echoes / n, 0.05, 0.15),
        _band(1 - pairs / (n - 1), 0.3, 0.6),
        _band(1 - len(set(lines)) / len(lines), 0.2, 0.5) if len(lines) > 3 else ABSTAIN,
        _band(solid / n, 9, 16),
    ]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _votes(texts: pa.Array) -> pa.Array:
    return pa.array([votes(t.encode()) for t in texts.to_pylist()], pa.list_(pa.int32()))


@dataclass
class WeakLabels:
    prior: float
    accuracy: np.ndarray  # labeller x (bad, good): chance that a vote agrees with the class
    patterns: np.ndarray
    posterior: np.ndarray


def fit_labels(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> WeakLabels:
    """Expectation maximisation on vote patterns and their counts.

    Labellers are independent given the class; an abstention says nothing. Counts are smoothed
    by one vote each way. A labeller knows one fault, so it may miss most bad documents, but it
    seldom votes bad on a good one: the lower bounds ``LEAST`` of the accuracies say so and keep
    the classes from swapping.
    """
    voted = patterns != ABSTAIN
    # most votes on a bad document are still good: each labeller knows one fault
    accuracy, prior = np.tile([0.3, 0.98], (patterns.shape[1], 1)), 0.85
    for _ in range(rounds):
        good = np.where(patterns == GOOD, accuracy[:, 1], 1 - accuracy[:, 1])
        bad = np.where(patterns == BAD, accuracy[:, 0], 1 - accuracy[:, 0])
        odds = np.log(prior / (1 - prior)) + (np.log(np.where(voted, good, 1)) - np.log(np.where(voted, bad, 1))).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        new = np.empty_like(accuracy)
        for k, weight, vote in ((1, posterior * n, GOOD), (0, (1 - posterior) * n, BAD)):
            agree = (weight[:, None] * (patterns == vote)).sum(axis=0) + 1
            new[:, k] = np.clip(agree / ((weight[:, None] * voted).sum(axis=0) + 2), LEAST[k], 0.999)
        prior = float(np.clip((posterior * n).sum() / max(1, n.sum()), 0.01, 0.99))
        moved = np.abs(new - accuracy).max()
        accuracy = new
        if moved < 1e-9:
            break
    return WeakLabels(prior, accuracy, patterns, posterior)


def _fit_scorer(docs, targets, epochs: int = 10, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of a logistic scorer on mean hashed subwords, by gradient descent on soft labels."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(subwords.BUCKETS), 0.0
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            where, share = docs[i]
            rate = 1 - step / steps
            step += 1
            gap = 1 / (1 + np.exp(-np.clip(share @ weights[where] + bias, -50, 50))) - targets[i]
            weights[where] -= rate * 200 * gap * share
            bias -= rate * 0.1 * gap
    return weights, bias


@F.arrow_udf(T.BinaryType())
def _counted(texts: pa.Array) -> pa.Array:
    pairs = (subwords.counts(t.encode(), subwords.MARKS) for t in texts.to_pylist())
    return pa.array([np.stack(p).astype(np.int32).tobytes() for p in pairs], pa.binary())


def quality_scores(
    docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_votes, weak_label, score, keep``.

    ``weak_label`` is the posterior of the votes, ``score`` the linear scorer's probability and
    ``keep`` whether their weighted mean is at least one half. A null text counts as empty, and an empty
    text gets a bad vote of every labeller. Equal texts get equal answers; ids may be null;
    other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    # votes of all documents; the text itself is not stored again
    cast = stored(
        texts.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)).alias("draw"), _votes("text").alias("votes")),
        "quality-votes",
    )
    seen = cast.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^8 patterns
    if not seen:
        return cast.select(F.col("id").alias(id), F.lit(0).alias("n_votes"), F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    seen.sort(key=lambda r: r["votes"])
    labels = fit_labels(np.array([r["votes"] for r in seen]), np.array([r["n"] for r in seen], dtype=float))
    belief = {tuple(p): float(q) for p, q in zip(labels.patterns.tolist(), labels.posterior)}
    total = sum(r["n"] for r in seen)
    below = min(1.0, sample / total) * (1 << 30)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    picked = (
        texts.where(draw < F.lit(below))
        .select(draw.alias("draw"), _votes("text").alias("votes"), _counted("text").alias("pairs"))
        .limit(2 * sample)
        .collect()
    )
    picked.sort(key=lambda r: (r["draw"], bytes(r["pairs"])))
    features, targets = [], []
    for r in picked:
        where, weight = np.frombuffer(r["pairs"], dtype=np.int32).reshape(2, -1)
        features.append((where, weight / max(1, weight.sum())))
        targets.append(belief[tuple(r["votes"])])
    weights, bias = _fit_scorer(features, targets) if features else (np.zeros(subwords.BUCKETS), 0.0)
    shared = spark.sparkContext.broadcast((belief, weights[:, None], bias))

    @F.arrow_udf("struct<n_votes: int, weak_label: double, score: double>")
    def judge(batch: pa.Array) -> pa.Array:
        known, table, shift = shared.value
        raw = [t.encode() for t in batch.to_pylist()]
        own = [votes(t) for t in raw]
        score = 1 / (1 + np.exp(-np.clip(subwords.mean_scores(raw, table, subwords.MARKS)[:, 0] + shift, -50, 50)))
        n = pa.array([sum(v != ABSTAIN for v in x) for x in own], pa.int32())
        weak = pa.array([known[tuple(x)] for x in own], pa.float64())
        return pa.StructArray.from_arrays([n, weak, pa.array(score)], names=["n_votes", "weak_label", "score"])

    judged = texts.select("id", judge("text").alias("j")).select("id", "j.*")
    keep = F.col("weak_label") * VOTES_WEIGHT + F.col("score") * (1 - VOTES_WEIGHT) >= KEEP
    return judged.select(F.col("id").alias(id), "n_votes", "weak_label", "score", keep.alias("keep"))
